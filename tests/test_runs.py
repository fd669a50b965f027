"""Whole runs around a provider that answers from the prompt."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cardloom.operators import export, images, requests, review
from cardloom.plans import runs
from cardloom.sources.config import Config

BODY = "a body that is long enough to be asked about, surely so"
CARD = {"front": "What is it, and why?", "back": "It is a thing of some length.", "card_type": "qa", "bloom_level": "apply", "tags": ["a::b", "c"]}


def provider(model, system, prompt, max_tokens):
    if "Review these cards" in prompt:
        return {"model": model, "input_tokens": 50, "output_tokens": 20, "text": json.dumps([{"card_index": 0, "action": "remove"}])}
    if "unlucky" in prompt:
        raise KeyError("something nobody thought of")
    cards = [CARD, {**CARD, "front": "x", "back": "y"}] if "weak" in prompt else [CARD, CARD]
    return {"model": model, "input_tokens": 100_000, "output_tokens": 10_000, "text": json.dumps(cards)}


def book(spark, *sections, name="/in/book.md"):
    text = "\n".join(f"# {s}\n{BODY} {s}" for s in sections)
    return spark.createDataFrame([(name, text, [text], None)], "source_path string, text string, chunks array<string>, error string")


def asked_of(spark, docs):
    from cardloom.plans.convert import plan_requests

    return plan_requests(docs)


COST = 100_000 / 1e6 * 0.8 + 10_000 / 1e6 * 4.0


def test_budget_is_looked_at_before_each_call(spark, tmp_path):
    asked = asked_of(spark, book(spark, "one", "two", "three", "four"))
    answers, spent = requests.spend(asked, provider, str(tmp_path / "a"), budget=2 * COST, in_turn=True, max_cards=None)
    assert answers.count() == 3 and spent.calls == 3 and spent.spent == pytest.approx(3 * COST)  # what equals the budget passes
    assert spent.stopped and spent.warned_at == 3
    # Going on with more: only what is missing is bought.
    answers, spent = requests.spend(asked, provider, str(tmp_path / "a"), budget=1.0, in_turn=True, max_cards=None)
    assert answers.count() == 4 and spent.stopped is None and spent.warned_at == 0
    _, none = requests.spend(asked, provider, str(tmp_path / "b"), budget=-1.0)
    assert none.calls == 0 and none.stopped


def test_card_cap_counts_valid_cards_of_each_document(spark, tmp_path):
    docs = book(spark, *"abcdef").unionByName(book(spark, "x", name="/in/other.md"))
    answers, spent = requests.spend(asked_of(spark, docs), provider, str(tmp_path / "a"), budget=9.0, max_cards=3)
    assert {r.source_file: r["count"] for r in answers.groupBy("source_file").count().collect()} == {"/in/book.md": 2, "/in/other.md": 1}
    assert spent.calls == 3


def test_failures_are_rows_and_are_tried_again(spark, tmp_path):
    asked = asked_of(spark, book(spark, "one", "unlucky", "three"))
    for _ in range(2):
        answers = requests.call_provider(asked, provider, str(tmp_path / "a"))
        assert sorted(r.status for r in answers.collect()) == ["errored", "succeeded", "succeeded"]
    mended = requests.call_provider(asked, lambda *a: {**provider(a[0], a[1], "", a[3])}, str(tmp_path / "a"))
    assert sorted(r.status for r in mended.collect()) == ["succeeded"] * 3
    assert requests.answers_at(spark, str(tmp_path / "a")).where("status = 'succeeded'").count() == 3


def test_convert_from_documents_to_files(spark, tmp_path):
    docs = book(spark, "one", "weak", "unlucky").unionByName(book(spark, "solo", name="/in/sub/book.md"))
    docs = docs.unionByName(spark.createDataFrame([("/in/bad.txt", None, None, "not UTF-8")], docs.schema))
    done = runs.convert(docs, provider, str(tmp_path / "run"), Config(cost_budget_limit=9.0))
    cards = sorted((r.source_file, r.card_idx, r.front, r.tags[-1]) for r in done.cards.collect())
    strong, weak = CARD["front"], "x"
    assert cards == [("/in/book.md", 0, strong, "_section::section-0"), ("/in/book.md", 1, strong, "_section::section-0"), ("/in/book.md", 2, strong, "_section::section-1"), ("/in/sub/book.md", 0, strong, "_section::section-0"), ("/in/sub/book.md", 1, strong, "_section::section-0")]
    report = {r.source_file: r for r in done.report.collect()}
    assert (report["/in/book.md"].total_cards, report["/in/book.md"].critiqued_cards, report["/in/book.md"].removed_cards) == (4, 1, 1) and weak
    summary = runs.run_summary(done, files=2).first()
    assert (summary.api_calls, summary.total_cards, summary.final_card_count, summary.files) == (4, 6, 5, 2)
    assert summary.total_cost == pytest.approx(3 * COST + 50 / 1e6 * 3 + 20 / 1e6 * 15)
    made = export.write_documents(export.tsv_documents(done.cards), "tsv", str(tmp_path / "out"), "tsv")
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in made) == ["book.tsv", "sub/book.tsv"]
    plain = runs.convert(docs, provider, str(tmp_path / "run2"), Config(cost_budget_limit=9.0, quality_enable_critique=False))
    assert plain.cards.count() == 6


def test_chunks_are_asked_in_place_of_sections(spark, tmp_path):
    docs = spark.createDataFrame([("/in/a.txt", "x" * 10, ["first", "second"], None)], "source_path string, text string, chunks array<string>, error string")
    cards, ledger, spent = runs.generate(docs, provider, str(tmp_path / "r"), Config(cost_budget_limit=9.0), by_chunks=True, force="top-tier")
    assert sorted((r.section_id, r.card_idx, r.tags) for r in cards.collect()) == [("chunk-0", 0, ["a::b", "c"]), ("chunk-0", 1, ["a::b", "c"]), ("chunk-1", 2, ["a::b", "c"]), ("chunk-1", 3, ["a::b", "c"])]
    assert {r.model for r in ledger.collect()} == {"top-tier"} and spent.calls == 2


def test_vision_is_one_call_for_a_document(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def look(model, system, prompt, max_tokens):
        (seen / "prompt").write_text(prompt)
        return {"model": model, "input_tokens": 5, "output_tokens": 1, "text": ""}

    docs = book(spark, "one", "two")
    shown = spark.createDataFrame([("/in/book.md", 2, 0, "image/png", bytearray(b"b")), ("/in/book.md", 1, 1, "image/jpeg", bytearray(b"")), ("/in/book.md", 1, 0, "image/png", bytearray(b"a"))], "doc_id string, page_num int, idx int, media_type string, image_bytes binary")
    assert [i.data for i in images.flattened(shown).first().images] == ["YQ==", "", "Yg=="]
    cards, ledger, _ = runs.generate(docs, look, str(tmp_path / "r"), Config(model="some-model"), images=shown)
    parts = json.loads((seen / "prompt").read_text())
    assert [p["type"] for p in parts] == ["image", "image", "text"] and parts[0]["data"] == "YQ==" and parts[2]["text"].startswith("3 images")
    assert cards.count() == 0 and [(r.model, r.input_tokens) for r in ledger.collect()] == [("some-model", 5)]  # empty answers cost


def test_batches(spark):
    docs, states = book(spark, "one", "two"), iter(["running", "ended"])
    sent = []

    def results(ids):
        rows = [(r["source_file"], r["custom_id"], "succeeded", r["model"], 10, 5, "text", json.dumps([CARD])) for b in sent for r in b]
        return spark.createDataFrame(rows, requests.ANSWER)

    cards, ledger = runs.from_batch(docs, lambda block: sent.append(block) or f"b{len(sent)}", lambda i: next(states), results, Config(), every=0.0)
    assert cards.count() == 2 and all(r.batch for r in ledger.collect())
    with pytest.raises(ValueError):
        requests.submit(asked_of(spark, docs).where("false"), lambda b: "x")


def test_evaluation_leaves_failed_cases_out(spark, tmp_path):
    cases = spark.createDataFrame([("c1", "some text"), ("c2", "unlucky text")], "case_id string, text string")
    expected = spark.createDataFrame([("c1", 0, ["What"], ["thing"], "qa"), ("c1", 1, ["none"], ["none"], None), ("c2", 0, ["a"], ["b"], None)], "case_id string, exp_idx int, front_keywords array<string>, back_keywords array<string>, wanted_type string")
    metrics, each, matches = runs.evaluate(cases, expected, provider, str(tmp_path / "e"), Config())
    row = metrics.first()
    assert (row.total_expected, row.total_matched, row.total_generated, row.recall, row.precision) == (2, 1, 2, 0.5, 0.5)
    assert row.total_cost_usd == pytest.approx(100_000 / 1e6 * 3 + 10_000 / 1e6 * 15)
    said = [(r.kind, r.name, r.said) for r in runs.eval_report(metrics, each).orderBy("kind", "pos", "name").collect()]
    assert said[0] == ("case", "c1", "1/2") and [n for _, n, _ in said[1:]] == ["recall", "precision", "f1", "avg_similarity", "total_cost_usd"]


def test_review_transitions(spark):
    schema = "source_file string, card_idx int, status string, new_front string, new_back string"
    decided = spark.createDataFrame([("s", 0, "rejected", None, None), ("s", 1, "pending", "f", "b")], schema)
    pick = lambda *n: spark.createDataFrame([("s", k) for k in n], "source_file string, card_idx int")
    rows = review.set_status(decided, pick(0, 2), "accepted")
    rows = review.edit_cards(rows, pick(2).withColumns({"new_front": F.lit(""), "new_back": F.lit("z")}))
    assert sorted(map(tuple, rows.collect())) == [("s", 0, "accepted", None, None), ("s", 1, "pending", "f", "b"), ("s", 2, "accepted", "", "z")]
