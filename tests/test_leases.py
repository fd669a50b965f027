"""Budget leases: against a plain loop, between shards, and after a lost task."""

from __future__ import annotations

import json
import threading
from collections import defaultdict

import pytest

from cardloom.operators import leases, requests
from cardloom.operators.cards import count_valid, parse_responses
from tests.test_runs import CARD, COST, asked_of, book, provider


def plain_loop(asked, budget, warn_at, max_cards):
    """(keys bought, the call before which it warned) by one loop over the documents."""
    spent, bought, warned, cards = 0.0, [], 0, defaultdict(int)
    for r in asked:
        if spent > budget:
            break
        if cards[r.source_file] >= max_cards:
            continue
        if not warned and spent >= warn_at * budget:
            warned = len(bought) + 1
        spent += COST
        cards[r.source_file] += 2
        bought.append((r.source_file, r.custom_id))
    return sorted(bought), warned


@pytest.mark.parametrize("calls", [0, 1, 2.5, 4, 7, 100])
def test_one_shard_is_a_plain_loop(spark, tmp_path, calls):
    docs = book(spark, *"abcd").unionByName(book(spark, *"efghi", name="/in/x.md")).unionByName(book(spark, "j", name="/in/y.md"))
    asked = asked_of(spark, docs)
    rows = sorted(asked.collect(), key=lambda r: (r.source_file, r.section_pos, r.part))
    budget = calls * COST
    answers, spent = requests.spend(asked, provider, str(tmp_path / "a"), budget=budget, max_cards=6, in_turn=True)
    want, warned = plain_loop(rows, budget, 0.8, 6)
    assert sorted((r.source_file, r.custom_id) for r in answers.collect()) == want
    assert spent.warned_at == warned and spent.calls == len(want)


@pytest.mark.parametrize("calls", [0, 3, 11, 40])
def test_shards_share_a_budget(spark, tmp_path, calls):
    docs = book(spark, *"abcd", name="/in/0.md")
    for k in range(1, 12):
        docs = docs.unionByName(book(spark, *"abcd", name=f"/in/{k}.md"))
    asked, budget = asked_of(spark, docs), (calls + 0.5) * COST
    answers, spent = requests.spend(asked, provider, str(tmp_path / "a"), budget=budget, max_cards=None, shards=4)
    assert min(48, calls + 1) <= spent.calls <= min(48, calls + 4)  # all of the budget, and one call a shard over it
    assert spent.stopped or spent.calls == 48
    order = defaultdict(list)
    for r in answers.collect():
        order[r.source_file].append(r.custom_id)
    for ids in order.values():  # a document's sections in order, without gaps
        assert sorted(ids) == [f"section-{k}" for k in range(len(ids))]


def test_a_lost_task_goes_on_where_it_stopped(spark, tmp_path):
    """The second attempt of a task finds what the first one has bought."""
    log = requests.AnswerLog(str(tmp_path / "a"), "part-run-000001-", 2)
    row = dict(zip([c.split()[0] for c in requests.ANSWER.split(", ")], ("s", "c", "succeeded", "low-tier", 1, 1, "text", "[]"), strict=True))
    for k in range(5):
        log.add({**row, "custom_id": f"c{k}"})
    again = requests.AnswerLog(str(tmp_path / "a"), "part-run-000001-", 2)
    assert [r["custom_id"] for r in again.kept()] == ["c0", "c1", "c2", "c3"]
    again.add(row), again.flush()
    assert requests.answers_at(spark, str(tmp_path / "a")).count() == 5
    assert requests.AnswerLog(str(tmp_path / "a"), "part-run-000002-", 2).kept() == []


def test_a_lost_lease_stays_charged_until_its_shard_comes_again():
    book = leases.Ledger(10.0, 0.8)
    with leases.LedgerServer(book, "localhost") as server:
        first = leases.Lease(server.address, server.key, 1, 6.0, 8.0)
        assert first.may() and first.held == 6.0
        first.paid(2.0)
        first._line.close()  # the task is gone; what it hadn't said is unknown
        other = leases.Lease(server.address, server.key, 2, 6.0, 8.0)
        while not book.accounts[1].spent:
            pass
        assert other.may() and other.held == 4.0
        again = leases.Lease(server.address, server.key, 1, 6.0, 8.0, spent=2.0)
        assert again.may() and again.held == 6.0
        again.close(), other.close()
        assert book.known() == 2.0


def test_a_shard_waits_for_what_others_give_back():
    book, got = leases.Ledger(10.0, 0.8), []
    assert book.ask(1, 0.0, 10.0) == (10.0, 0.0)
    waiting = threading.Thread(target=lambda: got.append(book.ask(2, 0.0, 10.0)))
    waiting.start()
    waiting.join(0.2)
    assert waiting.is_alive()
    book.close(1, 4.0)
    waiting.join(5)
    assert got == [(6.0, 4.0)]
    assert book.ask(2, 6.5, 1.0) is None and book.refused
    assert book.warn(2, 3) and not book.warn(1, 9) and book.warned_after == 3


def test_cards_are_counted_as_the_columns_count_them(spark):
    said = [
        json.dumps([CARD, {**CARD, "front": ""}, {**CARD, "tags": []}, 3]), "```json\n" + json.dumps([CARD]) + "\n```", " 　\n" + json.dumps([CARD]) + " ",
        "text ```\n" + json.dumps([CARD, CARD]) + "``` more ``` []```", json.dumps(CARD), "[", "[] []", "", "[NaN]", '[{"front": "a", "front": "b"}]', json.dumps([{**CARD, "mnemonic_hint": None}, {**CARD, "mnemonic_hint": 1}]),
        json.dumps([{**CARD, "back": None}, {k: v for k, v in CARD.items() if k != "back"}]), json.dumps([{**CARD, "media": ["a", None]}, {**CARD, "media": ["a"]}, {**CARD, "related_concepts": None}]),
        json.dumps([{**CARD, "card_type": "none"}, {**CARD, "bloom_level": ["apply"]}, {**CARD, "more": {"a": [1]}}]), "\x1c[]", json.dumps([[CARD]]),
    ]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, text string")
    want = {r.k: r["count"] for r in parse_responses(rows, "k").where("valid").groupBy("k").count().collect()}
    assert {k: count_valid(t) for k, t in enumerate(said) if count_valid(t)} == want
