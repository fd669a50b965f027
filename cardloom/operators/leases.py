"""Budget leases: many tasks spend one budget, and none asks before each call.

A small ledger on the driver lends parts of the budget to shards.  A shard calls while what it spent is
within what it holds, asks for more when it isn't, and gives back the rest when it ends.  What all shards
hold never exceeds the budget, so a run overshoots by one call a shard at most, and with one shard by the
one call that a plain loop overshoots by.  A shard that can't get more waits while others may still give
something back.

The ledger holds three numbers for each shard, and its messages are a few bytes; requests and answers never
pass through it.  A task that is lost leaves its lease charged until its next attempt reports what its kept
answers cost.  Only a driver with all its tasks is a run: a new run begins with the answers that it finds.
"""

from __future__ import annotations

import secrets
import threading
from dataclasses import dataclass, field
from multiprocessing import AuthenticationError
from multiprocessing.connection import Client, Connection, Listener


@dataclass
class Account:
    """What a shard holds and has spent, and whether it may still give some back."""

    held: float = 0.0
    spent: float = 0.0
    open: bool = False


@dataclass
class Ledger:
    """The accounts of a run.  spent: before it began.  Amounts are those of the shards' own reports."""

    budget: float
    warn_at: float
    spent: float = 0.0
    accounts: dict[int, Account] = field(default_factory=dict)
    warned_after: int | None = None
    refused: bool = False

    def __post_init__(self) -> None:
        self._changed = threading.Condition()

    def _rest(self) -> float:
        return self.budget - self.spent - sum(max(a.held, a.spent) if a.open else a.spent for a in self.accounts.values())

    def known(self) -> float:
        return self.spent + sum(a.spent for a in self.accounts.values())

    def ask(self, shard: int, spent: float, want: float) -> tuple[float, float] | None:
        """(what the shard holds from now on, what is known to be spent in all), or None: the budget is used up.

        A shard asks when it has spent more than it holds, or holds nothing yet.
        """
        with self._changed:
            mine = self.accounts.setdefault(shard, Account())
            mine.spent, mine.held, mine.open = spent, spent, False
            self._changed.notify_all()
            while True:
                rest = self._rest()
                if rest > 0:
                    break
                if not any(a.open for a in self.accounts.values()):
                    if rest < 0:
                        self.refused = True
                        return None
                    break  # what equals the budget passes
                self._changed.wait()
            mine.held, mine.open = spent + min(want, rest), True
            return mine.held, self.known()

    def close(self, shard: int, spent: float) -> None:
        """The shard has ended, or its task is lost and may come again: its rest is free, or stays charged until then."""
        with self._changed:
            mine = self.accounts.setdefault(shard, Account())
            mine.spent, mine.held, mine.open = spent, spent, False
            self._changed.notify_all()

    def lost(self, shard: int) -> None:
        with self._changed:
            mine = self.accounts.setdefault(shard, Account())
            mine.spent, mine.open = max(mine.spent, mine.held), False
            self._changed.notify_all()

    def warn(self, shard: int, calls: int) -> bool:
        """Whether this is the run's one warning.  calls: those of the shard so far."""
        with self._changed:
            first = self.warned_after is None
            if first:
                self.warned_after = calls
            return first


class LedgerServer:
    """Serves a ledger to the tasks of a run while its block lasts."""

    def __init__(self, ledger: Ledger, host: str):
        self.ledger, self.key = ledger, secrets.token_bytes(32)
        self._listener = Listener((host, 0), authkey=self.key)
        self.address, self._closed = self._listener.address, False

    def __enter__(self) -> LedgerServer:
        threading.Thread(target=self._accept, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self._closed = True
        self._listener.close()

    def _accept(self) -> None:
        while not self._closed:
            try:
                one = self._listener.accept()
            except (OSError, EOFError, AuthenticationError):  # closed, or a caller that gave up or lacks the key
                continue
            threading.Thread(target=self._serve, args=(one,), daemon=True).start()

    def _serve(self, one: Connection) -> None:
        shard = None
        try:
            while True:
                what, shard, *more = one.recv()
                one.send({"ask": self.ledger.ask, "close": self.ledger.close, "warn": self.ledger.warn}[what](shard, *more))
                if what == "close":
                    shard = None
        except (EOFError, OSError):
            if shard is not None:
                self.ledger.lost(shard)
        finally:
            one.close()


class Lease:
    """A shard's side: may() before each call, paid() after it, and close()."""

    def __init__(self, address: tuple[str, int], key: bytes, shard: int, want: float, warn_from: float, spent: float = 0.0):
        """spent: what an earlier attempt of this task has spent in this run; warn_from: spending at which to warn."""
        self.shard, self.want, self.warn_from, self.spent = shard, want, warn_from, spent
        self.held: float | None = None
        self.others, self.calls, self.warned = 0.0, 0, False
        self._line = Client(address, authkey=key)

    def _say(self, *what: object) -> object:
        self._line.send(what)
        return self._line.recv()

    def may(self) -> bool:
        """Whether one more call may be made."""
        if self.held is None or self.spent > self.held:
            got = self._say("ask", self.shard, self.spent, self.want)
            if got is None:
                return False
            self.held, known = got
            self.others = known - self.spent
        if not self.warned and self.others + self.spent >= self.warn_from:
            self.warned = True
            self._say("warn", self.shard, self.calls)
        return True

    def paid(self, cost: float) -> None:
        self.spent += cost
        self.calls += 1

    def close(self) -> None:
        self._say("close", self.shard, self.spent)
        self._line.close()
