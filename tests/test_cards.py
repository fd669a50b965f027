"""Parsing, scoring, duplicates, critique, ledger, evaluation, export and review by hand."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cardloom.functions import scoring, similarity
from cardloom.functions.cost import estimated_cost, selected_model
from cardloom.operators import cards as C
from cardloom.operators import critique, duplicates, export, images, ledger, matching, review
from cardloom.plans.convert import critique_requests, run_quality, summary
from cardloom.schemas import CARD

GOOD = {"front": "What is it?", "back": "A thing it is.", "card_type": "qa", "bloom_level": "remember", "tags": ["a::b", "c"]}


def parsed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return C.parse_responses(rows, "k").orderBy("k", "item_idx").collect()


def test_parse_shapes(spark):
    got = parsed(spark, json.dumps([GOOD]), f"said\n```json\n{json.dumps([GOOD, GOOD])}\n``` and ```[1]```", "[]", "not json", "{}", "```\n[7, null, \"x\"]\n```", "", None, "[1] trailing", '[{"front": "a"', "[1]]", "[1]}", "1,2", '[1],"x":2')
    seen = {}
    for r in got:
        seen.setdefault(r.k, []).append((r.status, r.valid))
    assert seen == {
        0: [("ok", True)], 1: [("ok", True)] * 2, 2: [("ok", False)], 3: [("invalid_json", False)], 4: [("not_array", False)], 5: [("ok", False)] * 3,
        6: [("invalid_json", False)], 7: [("invalid_json", False)], 8: [("invalid_json", False)], 9: [("invalid_json", False)], **{k: [("invalid_json", False)] for k in (10, 11, 12, 13)},
    }


@pytest.mark.parametrize(
    ("change", "valid"),
    [
        ({}, True), ({"back": None}, False), ({"back": 3}, False), ({"front": ""}, False), ({"front": 5}, False), ({"card_type": "QA"}, False), ({"bloom_level": "x"}, False),
        ({"tags": []}, False), ({"tags": ["a", None]}, False), ({"tags": "a"}, False), ({"tags": [1]}, False), ({"related_concepts": []}, True), ({"related_concepts": [None]}, False),
        ({"media": ["m"]}, True), ({"media": None}, False), ({"mnemonic_hint": None}, True), ({"mnemonic_hint": "h"}, True), ({"mnemonic_hint": 1}, False), ({"more": {"x": 1}}, True),
    ],
)
def test_validation(spark, change, valid):
    row = parsed(spark, json.dumps([GOOD | change]))[0]
    assert row.valid is valid
    without = {k: v for k, v in GOOD.items() if k != "back"}
    assert change or parsed(spark, json.dumps([without]))[0].back == ""


def cards(spark, *rows):
    """rows: front, back, card_type, tags and perhaps a source."""
    full = [(r[4] if len(r) > 4 else "s", k, r[0], r[1], r[2], "remember", r[3], [], None, []) for k, r in enumerate(rows)]
    fields = CARD.removeprefix("struct<").removesuffix(">")
    return spark.createDataFrame(full, f"source_file string, card_idx int, {fields.replace(':', ' ', 0)}".replace("front:", "front ").replace("back:", "back ").replace("card_type:", "card_type ").replace("bloom_level:", "bloom_level ").replace("tags:", "tags ").replace("related_concepts:", "related_concepts ").replace("mnemonic_hint:", "mnemonic_hint ").replace("media:", "media "))


def one(spark, front, back, kind, tags=("t",)):
    return C.score_cards(cards(spark, (front, back, kind, list(tags)))).first()


@pytest.mark.parametrize(
    ("front", "kind", "score"),
    [
        ("x" * 9, "qa", 0.54), ("x" * 3, "qa", 0.3), ("x" * 10, "qa", 0.7 + 0.1), ("x" * 9 + "?", "qa", 0.7 + 0.2 + 0.1), ("x" * 201, "qa", 0.7 - 0.1), ("x" * 201 + "？", "qa", 0.7 + 0.2 - 0.1),
        ("x" * 80, "reversible", 1.0), ("x" * 81, "term_definition", 0.8), ("{{c1::a}}", "cloze", 0.7), ("{{c1::aa}}", "cloze", 1.0), ("plain text", "cloze", 0.4),
    ],
)
def test_front_quality(spark, front, kind, score):
    assert one(spark, front, "answer", kind).front_quality == min(1.0, score)


@pytest.mark.parametrize(("size", "kind", "score"), [(0, "qa", 0.0), (4, "qa", 0.4), (5, "qa", 0.7), (9, "qa", 0.7), (10, "qa", 1.0), (200, "qa", 1.0), (201, "qa", 0.7 - 1 / 200), (400, "qa", 0.2), (0, "cloze", 1.0), (1, "cloze", 0.8)])
def test_back_quality(spark, size, kind, score):
    assert one(spark, "front", "y" * size, kind).back_quality == pytest.approx(score, abs=1e-15)


@pytest.mark.parametrize(
    ("front", "back", "kind", "score"),
    [
        ("f", "", "qa", 0.9), ("f", "One.", "qa", 1.0), ("f", "One. Two", "qa", 0.8), ("f", "a. b! c。", "qa", 0.6), ("f", "a. b. c. d", "qa", 0.4), ("f", "a. b. c. d さらに", "qa", 0.25),
        ("f", "1.5 is 2.5", "qa", 0.6), ("{{c1::a}}" * 3, "", "cloze", 1.0), ("{{c1::a}}" * 4, "", "cloze", 0.9), ("{{c1::a}}" * 9, "", "cloze", 0.5),
    ],
)
def test_atomicity(spark, front, back, kind, score):
    assert one(spark, front, back, kind).atomicity == pytest.approx(score, abs=1e-12)


def test_type_fit_tags_flags_and_total(spark):
    assert one(spark, "違いは", "b", "compare_contrast").card_type_fit == 1.0
    assert one(spark, "nothing", "b", "sequence").card_type_fit == 0.7
    assert one(spark, "x", "b", "image_occlusion").card_type_fit == 0.8
    assert [one(spark, "x", "b", "qa", t).tags_quality for t in ((), ("a",), ("a::b",), ("a", "b"), ("a::b", "c"))] == [0.0, 0.5, 0.8, 0.7, 1.0]
    assert one(spark, "short", "y" * 201, "qa").flags == ["vague_question", "too_long_answer"]
    assert one(spark, "列挙して下さい。お願い", "1. one 2. two", "qa").flags == ["list_not_cloze"]
    assert one(spark, "short", "y", "cloze").flags == []
    row = one(spark, "What is the thing?", "A thing it is", "qa", ("a::b", "c"))
    assert row.weighted_total == 0.9999999999999999 * 0.25 + 1.0 * 0.25 + 1.0 * 0.15 + 0.9 * 0.10 + 1.0 * 0.10 + 1.0 * 0.15
    assert set(scoring.dimensions(F.lit("a"), F.lit("b"), F.lit("qa"), F.array())) == set(scoring.WEIGHTS)


def test_sets(spark):
    rows = spark.createDataFrame([("ab cd", "漢字、かな 한글"), ("a", ""), ("", "x-yy.zz")], "a string, b string")
    got = rows.select(similarity.bigrams(F.col("a")), similarity.tokens(F.col("b"))).collect()
    assert [set(r[0]) for r in got] == [{"ab", "b ", " c", "cd"}, {"a"}, set()]
    assert set(got[0][1]) == {"漢字", "かな", "한글", "字か", "な한"} and set(got[1][1]) == set() and set(got[2][1]) == {"yy", "zz"}


def plain_similar(a, b):
    def grams(s):
        return {s[i : i + 2] for i in range(len(s) - 1)} if len(s) > 1 else set(s)

    def jac(x, y):
        return len(x & y) / len(x | y) if x and y else 0.0

    words = lambda s: {w for w in s.split() if len(w) > 1}
    front, typed, tagged = jac(grams(a[0]), grams(b[0])), a[2] == b[2], set(a[3]) == set(b[3])
    if (typed and front > 0.7) or (tagged and front > 0.5) or (typed and jac(words(a[0]), words(b[0])) > 0.5):
        return True
    back = jac(grams(a[1]), grams(b[1])) if typed and a[1] and b[1] else 0.0
    return (back > 0.4 and front > 0.1) or (tagged and back > 0.35)


def test_pairs_by_index_and_by_join_equal_a_loop(spark):
    rnd = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    say = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 6)))
    rows = [(say() or "x", rnd.choice(["", say()]), rnd.choice(["qa", "cloze"]), rnd.choice([["a"], ["b", "a"], ["a", "b"], ["a", "a"]]), rnd.choice("st")) for _ in range(90)]
    frame = cards(spark, *rows)
    want = sorted((a[4], i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[4] == b[4] and plain_similar(a, b))
    for indexed in (True, False):
        assert sorted(map(tuple, duplicates.similar_pairs(frame, indexed).collect())) == want
    flagged = duplicates.flag_duplicates(C.score_cards(frame), duplicates.similar_pairs(frame)).collect()
    members = {(s, k) for s, i, j in want for k in (i, j)}
    assert {(r.source_file, r.card_idx) for r in flagged if "duplicate_concept" in r.flags} == members and len(flagged) == len(rows)


def test_critique_merge_order_and_report(spark):
    frame = cards(spark, *[(f"q{i}", "", "qa", ["t"]) for i in range(5)], ("What is the thing?", "A thing it is", "qa", ["a::b", "c"]))
    routed = critique.route(C.score_cards(frame))
    low = routed.where("NOT passed")
    new = lambda f: GOOD | {"front": f}
    said = [
        {"card_index": 3, "action": "split", "improved_cards": [new("s1"), {"front": ""}, new("s2")]}, {"card_index": 0, "action": "remove"}, {"card_index": 9, "action": "improve", "improved_cards": [new("far")]},
        {"card_index": 1, "action": "keep"}, {"card_index": 8, "action": "keep"}, {"card_index": "2", "action": "remove"}, {"action": "remove"}, 5, {"card_index": 1, "action": "improve", "improved_cards": None}, {"card_index": 4, "action": 7},
    ]
    reviews = critique.parse_reviews(spark.createDataFrame([("s", f"```json\n{json.dumps(said)}\n```")], "source_file string, text string"))
    merged = critique.merge_reviews(low, reviews)
    assert [r.front for r in merged.orderBy("kind", "pos", "item").collect()] == ["s1", "s2", "far", "q1", "q1", "q4", "q2"]
    final, report = run_quality(frame, reviews)
    assert [r.front for r in final.orderBy("card_idx").collect()] == ["What is the thing?", "s1", "s2", "far", "q1", "q1", "q4", "q2"]
    assert report.first().asDict() == {"source_file": "s", "total_cards": 6, "passed_cards": 1, "critiqued_cards": 5, "removed_cards": 0, "improved_cards": 5, "split_cards": 2, "final_card_count": 8, "pass_rate": 1 / 6}
    final, report = run_quality(frame)
    assert final.count() == 6 and report.first().critiqued_cards == 0
    for bad in ("no json", "{}"):
        none = critique.parse_reviews(spark.createDataFrame([("s", bad)], "source_file string, text string"))
        assert none.count() == 0
    asked = critique_requests(routed, spark.createDataFrame([("s", "x" * 5000)], "source_file string, text string")).first()
    assert asked.user_prompt.endswith("x" * 3000) and "x" * 3001 not in asked.user_prompt


def test_ledger(spark):
    rows = spark.createDataFrame([(i, "mid-tier" if i % 2 else "no such", 100_000, 0, i == 3) for i in range(6)], "n int, model string, input_tokens long, output_tokens long, batch boolean")
    costed = ledger.with_cost(rows)
    assert [r.cost_usd for r in costed.orderBy("n").collect()] == pytest.approx([1.5, 0.3, 1.5, 0.15, 1.5, 0.3])
    for partition in (None, ["one"]):
        got = ledger.budget_gate(costed.withColumn("one", F.lit(1)), ["n"], budget=3.3, warn_at=0.5, partition=partition).orderBy("n").collect()
        assert [r.allowed for r in got] == [True, True, True, True, False, False] and [r.warns for r in got] == [False, False, True, False, False, False]
        assert [round(r.spent_before, 6) for r in got] == [0, 1.5, 1.8, 3.3, 3.45, 4.95]
    total = ledger.totals(costed, budget=5.0).first()
    assert total.request_count == 6 and total.total_cost == pytest.approx(5.25) and not total.within_budget
    empty = ledger.totals(costed.where("n < 0")).first()
    assert (empty.total_cost, empty.request_count, empty.budget_remaining) == (0.0, 0, 1.0)
    assert summary(critique.quality_report(critique.route(C.score_cards(cards(spark, ("q", "", "qa", ["t"]))))), ledger.totals(costed)).count() == 1
    routed = spark.createDataFrame([(9999, 29), (10000, 0), (0, 30)], "a int, b int").select(selected_model(F.col("a"), F.col("b")), selected_model(F.col("a"), F.col("b"), F.lit("mine"))).collect()
    assert [r[0] for r in routed] == ["low-tier", "mid-tier", "mid-tier"] and {r[1] for r in routed} == {"mine"}
    assert spark.range(1).select(estimated_cost(F.lit("top-tier"), F.lit(1_000_000), F.lit(1_000_000))).first()[0] == 90.0


def test_sections_plan_and_cap(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate((49, 50, 10_000))], "source_file string, section_pos int, char_count int")
    assert [r.model for r in ledger.section_plan(rows).orderBy("section_pos").collect()] == ["low-tier", "mid-tier"]
    assert ledger.section_plan(rows, skip_short=False, max_cards=5, force="x").select("section_cards", "model").distinct().collect() == [(5, "x")]
    capped = ledger.card_cap_gate(rows.withColumn("n_cards", F.lit(25)), ["section_pos"], ["source_file"], max_cards=50)
    assert [r.allowed for r in capped.orderBy("section_pos").collect()] == [True, True, False]


def test_matching(spark):
    expected = spark.createDataFrame(
        [("c", 0, ["sun"], ["hot"], None), ("c", 1, ["sun"], ["hot"], "qa"), ("c", 2, [], [], None), ("c", 3, ["moon"], ["x"], "cloze"), ("d", 0, ["a"], ["b"], None)],
        "case_id string, exp_idx int, front_keywords array<string>, back_keywords array<string>, wanted_type string",
    )
    made = cards(spark, ("the sun", "hot", "qa", ["t"], "c"), ("sun", "hot", "qa", ["t"], "c"), ("moon", "y", "qa", ["t"], "c")).withColumnRenamed("source_file", "case_id")
    got = matching.greedy_match(expected, made).orderBy("case_id", "exp_idx").collect()
    assert [(r.case_id, r.exp_idx, r.gen_idx, round(r.similarity, 9)) for r in got] == [("c", 0, 0, 1.0), ("c", 1, 1, 1.0), ("c", 2, None, 0.0), ("c", 3, 2, 0.4), ("d", 0, None, 0.0)]
    frame = matching.greedy_match(expected, made)
    m = matching.metrics(frame, made, 0.5).first()
    assert (m.total_expected, m.total_generated, m.total_matched, m.recall, m.precision) == (5, 3, 3, 0.6, 1.0) and m.f1 == pytest.approx(0.75) and m.avg_similarity == pytest.approx(0.8)
    assert [r.recall for r in matching.case_recall(frame, made).orderBy("case_id").collect()] == [0.75, 0.0]
    assert matching.unmatched(made, frame).count() == 0
    none = matching.metrics(frame.where("false"), made.where("false")).first()
    assert (none.recall, none.precision, none.f1, none.avg_similarity) == (0.0, 0.0, 0.0, 0.0)
    delta = {r.metric: r.delta for r in matching.compare_metrics(matching.metrics(frame, made), matching.metrics(frame.where("false"), made)).collect()}
    assert delta["recall"] == -0.6 and len(delta) == 5
    told = json.loads(export.metrics_json(matching.metrics(frame, made), matching.case_recall(frame, made)).first().json)
    assert told["metrics"]["total_matched"] == 3 and [c["case_id"] for c in told["cases"]] == ["c", "d"]


def test_export(spark, tmp_path):
    frame = cards(spark, ("a\tb", "c\nd\re", "qa", ["t"]), ("one", "two", "reversible", ["t", "u"]), ("{{c1::x}}", "kept", "cloze", ["t"]))
    rows = [r.row for r in export.tsv_rows(frame, ["z"]).orderBy("card_idx", "row_idx").collect()]
    assert rows == ["a b\tc<br>d\re\tt bloom::remember z", "one\ttwo\tt u bloom::remember z", "two\tone\tt u bloom::remember z", "{{c1::x}}\tkept\tt bloom::remember z"]
    whole = export.tsv_documents(frame, ["z"])
    assert whole.first().tsv == export.TSV_HEADER + "\n".join(rows)
    made = export.json_documents(frame, "m", "now")
    data = json.loads(made.first().json)
    assert data["_meta"] == {"schema_version": "1.0", "generated_at": "now"} and data["cards"][0]["mnemonic_hint"] is None and len(data["cards"]) == 3
    assert [p.name for p in export.write_documents(whole, "tsv", str(tmp_path / "o"), "tsv") + export.write_documents(made, "json", str(tmp_path / "o"), "json")] == ["s.tsv", "s.json"]
    assert (tmp_path / "o/s.tsv").read_bytes().decode() == whole.first().tsv
    notes = [r.note for r in export.notes(frame, "deck").orderBy("card_idx").collect()]
    assert [n.modelName for n in notes] == ["Basic", "Basic (and reversed card)", "Cloze"] and notes[2]["fields"] == {"Text": "{{c1::x}}", "Extra": "kept"} and not notes[0].options.allowDuplicate
    sent = []

    def send(action, body):
        sent.append(action)
        return {"result": [None if n["fields"].get("Front") == "one" else 7 for n in body["params"].get("notes", [])] if action == "addNotes" else 6, "error": None}

    service = export.NoteService(send)
    assert service.running() and service.push(export.notes(frame, "d"), "d", size=2) == {"total": 3, "added": 2, "failed": 1, "errors": ["Card 2 failed to add"]}
    assert sent == ["version", "createDeck", "addNotes", "addNotes"]
    assert service.push(export.notes(frame.where("false"), "d"), "d")["total"] == 0
    with pytest.raises(export.PushError):
        export.NoteService(send, host="example.org")
    with pytest.raises(export.PushError):
        export.NoteService(lambda a, b: {"error": "no"}).call("x")
    report = export.push_report(spark.createDataFrame([(0, 5), (1, None)], "position int, note_id long")).first()
    assert (report.total, report.added, report.failed, report.errors) == (2, 1, 1, ["Card 2 failed to add"])
    places = [str(export.resolve_output(*a)) for a in (("d/a.md", None, "tsv"), ("d/a.md", None, "both"), ("d", None, "tsv", True), ("d/a.md", "x.json", "tsv"))]
    assert places == ["d/a.tsv", "d", "output", "x.json"]


def test_review(spark):
    frame = cards(spark, ("a", "b", "qa", ["t"]), ("c", "d", "qa", ["t"]), ("e", "f", "qa", ["t"]))
    decided = spark.createDataFrame([("s", 0, "accepted", "", None), ("s", 2, "rejected", None, "g")], "source_file string, card_idx int, status string, new_front string, new_back string")
    items = review.review_items(frame, decided)
    assert sorted((r.card_idx, r.status, r.front, r.back) for r in items.collect()) == [(0, "accepted", "", "b"), (1, "pending", "c", "d"), (2, "rejected", "e", "g")]
    assert review.stats(items).first().asDict() == {"total": 3, "pending": 1, "accepted": 1, "rejected": 1}
    assert review.accepted(items).count() == 1 and review.accepted(items, saved=False).count() == 3 and review.view(items).count() == 3 and review.view(items, "pending").count() == 1
    assert review.moved(2, 1, 3) == 0 and review.moved(0, -1, 3) == 2 and review.moved(4, 1, 0) == 4
    assert [review.next_filter(x) for x in (None, "pending", "accepted", "rejected")] == ["pending", "accepted", "rejected", None]


def test_images(spark, tmp_path):
    box = lambda page, idx, w, h: (1, page, 100.0, 100.0, idx, 0.0, 0.0, float(w), float(h))
    rows = spark.createDataFrame([box(1, k, 30, 30) for k in range(7)] + [box(2, 0, 40, 49), box(3, 0, 40, 50), box(4, 0, -50, 50), (1, 5, 0.0, 0.0, 0, 0.0, 0.0, 1.0, 1.0)], "doc_id int, page_num int, page_width double, page_height double, idx int, x0 double, y0 double, x1 double, y1 double")
    pages = {r.page_num: (round(r.coverage, 6), r.significant) for r in images.page_coverage(rows).collect()}
    assert pages == {1: (0.63, True), 2: (0.196, False), 3: (0.2, True), 4: (0.0, False), 5: (0.0, False)}
    assert sorted((r.page_num, r.idx) for r in images.chosen_images(rows).collect()) == [(1, k) for k in range(5)] + [(3, 0)]
    made = spark.createDataFrame([(1, 2, 0, "image/png", b"x"), (1, 2, 1, "image/jpeg", b"")], "d int, p int, i int, m string, image_bytes binary").withColumn("name", images.media_name("d", "p", "i", "m"))
    assert [str(p.relative_to(tmp_path)) for p in export.write_media(made, str(tmp_path))] == ["_media/1_page2_img0.png"]
