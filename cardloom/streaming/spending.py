"""Running budgets, card caps and awaited batches as streams, with keyed state.

The same rules as operators/ledger.py, for calls that arrive.  State is kept by Spark's RocksDB store and
goes on after a restart from the query's checkpoint; STATE is the setting that these streams need.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cardloom.operators.ledger import BUDGET, MAX_CARDS, WARN_AT

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
EPOCH = datetime.datetime(1970, 1, 1)


class BudgetProcessor(StatefulProcessor):
    """Holds a key's calls until the watermark has passed their time, then gives them in the order of (time, id).

    One timer for each key, at the time of its earliest call that waits.
    """

    def __init__(self, budget: float, warn_at: float):
        self.budget, self.warn_from = budget, warn_at * budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "spent double, warned boolean, timer long")
        self.waiting = handle.getMapState("waiting", "at long, id long", "cost double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.micros, r.id), (r.cost_usd,))
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        spent, warned, _ = self.account.get()
        self.account.update((spent, warned, -1))
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def _ready(self, key: tuple, watermark: int) -> Iterator[Row]:
        spent, warned, timer = self.account.get() if self.account.exists() else (0.0, False, -1)
        held = sorted((at, i) for at, i in self.waiting.keys())
        for at, i in held:
            if at // 1000 > watermark:
                break
            cost = self.waiting.getValue((at, i))[0]
            self.waiting.removeKey((at, i))
            allowed = spent <= self.budget
            warns = allowed and not warned and spent >= self.warn_from
            yield Row(key=key[0], id=i, ts=EPOCH + datetime.timedelta(microseconds=at), spent_before=spent, allowed=allowed, warns=warns)
            spent, warned = spent + cost, warned or warns
        left = next((at // 1000 for at, _ in held if at // 1000 > watermark), -1)
        if left != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if left >= 0:
                self.handle.registerTimer(left)
        self.account.update((spent, warned, left))

    def close(self) -> None:
        pass


def stream_budget_gate(calls: DataFrame, budget: float = BUDGET, warn_at: float = WARN_AT, late: str = "10 minutes") -> DataFrame:
    """W2, W3, P3 on a stream of calls: key, id, ts, spent_before, allowed, warns; calls later than `late` are left out.

    calls: key and id (longs), ts (in a session whose time zone is UTC), cost_usd.  A call is given once the
    watermark has passed its ts, as the budget depends on the calls before it.  A call that comes twice counts once.
    """
    rows = calls.withWatermark("ts", late).selectExpr("key", "id", "unix_micros(ts) AS micros", "cost_usd", "ts")
    return rows.groupBy("key").transformWithState(
        BudgetProcessor(budget, warn_at), "key long, id long, ts timestamp, spent_before double, allowed boolean, warns boolean", "Append", "EventTime"
    )


class CapProcessor(StatefulProcessor):
    """Holds the sections of a key that come before their turn, and gives them as soon as none is missing."""

    def __init__(self, max_cards: int):
        self.max_cards = max_cards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", "next long, cards long")
        self.waiting = handle.getMapState("waiting", "turn long", "n_cards long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        turn, cards = self.account.get() if self.account.exists() else (0, 0)
        for r in rows:
            if r.turn >= turn:
                self.waiting.updateValue((r.turn,), (r.n_cards,))
        while self.waiting.containsKey((turn,)):
            n = self.waiting.getValue((turn,))[0]
            self.waiting.removeKey((turn,))
            yield Row(key=key[0], turn=turn, cards_before=cards, allowed=cards < self.max_cards)
            turn, cards = turn + 1, cards + n
        self.account.update((turn, cards))

    def close(self) -> None:
        pass


def stream_card_cap(sections: DataFrame, max_cards: int = MAX_CARDS) -> DataFrame:
    """W4, P4 on a stream of sections (key, turn from 0 without gaps, n_cards, all longs): key, turn, cards_before, allowed."""
    return sections.select("key", "turn", "n_cards").groupBy("key").transformWithState(CapProcessor(max_cards), "key long, turn long, cards_before long, allowed boolean", "Append", "None")


class PollProcessor(StatefulProcessor):
    """Looks at a batch whenever its timer goes off, until it has ended or `timeout` has passed since it came."""

    def __init__(self, status: Callable[[str], str], every: float, timeout: float):
        self.status, self.every, self.timeout = status, int(1000 * every), int(1000 * timeout)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for _ in rows:
            if not self.since.exists():
                now = timerValues.getCurrentProcessingTimeInMs()
                self.since.update((now,))
                yield from self._look(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._look(key, timerValues.getCurrentProcessingTimeInMs())

    def _look(self, key: tuple, now: int) -> Iterator[Row]:
        waited = now - self.since.get()[0]
        if self.status(key[0]) == "ended":
            yield Row(batch_id=key[0], state="ended", waited_ms=waited)
        elif waited > self.timeout:
            yield Row(batch_id=key[0], state="timeout", waited_ms=waited)
        else:
            self.handle.registerTimer(now + self.every)

    def close(self) -> None:
        pass


def stream_batches(batches: DataFrame, status: Callable[[str], str], every: float = 30.0, timeout: float = 86_400.0) -> DataFrame:
    """G8 on a stream of batch ids (batch_id): batch_id, state (ended or timeout), waited_ms, once for each.

    The time is looked at after each poll.  A batch is remembered, so an id that comes again isn't polled again.
    """
    return batches.select("batch_id").groupBy("batch_id").transformWithState(PollProcessor(status, every, timeout), "batch_id string, state string, waited_ms long", "Append", "ProcessingTime")
