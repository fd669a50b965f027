"""Sparse scores and greedy matching against plain loops; a broken invalidation of the cache."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import edges
from cardloom.operators.matching import score_matrix
from cardloom.sources.cache import invalidate, read_cache

EXPECTED = "case_id string, exp_idx int, front_keywords array<string>, back_keywords array<string>, wanted_type string"
CARDS = "case_id string, card_idx int, front string, back string, card_type string"
WORDS = ("sun", "sunday", "day", "a", "münchen", "日本", "x y", "")


def made(seed: int, cases=("p", "q"), n_expected=6, n_cards=14):
    pick = random.Random(seed)
    words = lambda n: [pick.choice(WORDS) for _ in range(pick.randrange(n))]
    text = lambda: pick.choice([None, "", " ".join(words(6))])
    expected = [(c, i, words(4), words(4), pick.choice([None, "qa", "cloze"])) for c in (*cases, "without cards") for i in range(n_expected)]
    cards = [(c, i, text(), text(), pick.choice(["qa", "cloze", "mixed"])) for c in (*cases, "without expectations") for i in range(n_cards)]
    return expected, cards


def plain_score(e, c) -> float:
    share = lambda words, text: sum(text is not None and w in text for w in words) / len(words) if words else 0.0
    f, b = share(e[2], c[2]), share(e[3], c[3])
    return f * 0.4 + b * 0.4 + (1.0 if c[4] == e[4] else 0.0) * 0.2 if e[4] is not None else f * 0.5 + b * 0.5


def plain_match(expected, cards, threshold):
    out, used = [], set()
    for e in sorted(expected, key=lambda e: e[:2]):
        free = [(plain_score(e, c), -c[1]) for c in cards if c[0] == e[0] and c[:2] not in used]
        best, at = max(free, default=(0.0, 0))
        hit = best > 0 and best >= threshold
        if hit:
            used.add((e[0], -at))
        out.append((e[0], e[1], -at if hit else None, best if hit else 0.0))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_edges_and_matches_equal_a_plain_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(edges, "SHARD", 5)
    expected, cards = made(seed)
    e, c = spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(cards, CARDS)
    found = sorted(map(tuple, edges.score_edges(e, c).collect()))
    every = [(x[0], x[1], y[1], plain_score(x, y)) for x in expected for y in cards if x[0] == y[0]]
    assert found == sorted(r for r in every if r[3] > 0)
    keyworded = {r[:3] for r in map(tuple, edges.score_edges(e, c, by_type=False).collect())}
    assert all(r[:3] in keyworded for r in every if r[3] > 0.2) and keyworded <= {r[:3] for r in found}
    for threshold in (0.0, 0.15, 0.3, 0.9):
        assert sorted(map(repr, map(tuple, edges.sparse_match(e, c, threshold).collect()))) == sorted(map(repr, plain_match(expected, cards, threshold)))


def test_the_matrix_has_the_same_scores(spark):
    expected, cards = made(7)
    cards = [(i, j, f or "", b or "", t) for i, j, f, b, t in cards]
    e, c = spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(cards, CARDS)
    dense = score_matrix(e, c).select("case_id", "exp_idx", F.explode(F.arrays_zip("gen", "scores")).alias("x")).select("case_id", "exp_idx", "x.*").where("scores > 0")
    assert sorted(map(tuple, dense.collect())) == sorted(map(tuple, edges.score_edges(e, c).collect()))


def test_a_case_of_many_cards(spark):
    """100,000 cards of one case in shards; each expected card takes the best free one, copies of its words in order."""
    n = F.col("id")
    cards = spark.range(100_000).select(F.lit("big").alias("case_id"), n.cast("int").alias("card_idx"), F.concat(F.lit("term "), n % 1000, F.lit(".")).alias("front"), F.concat(F.lit("means "), n % 500, F.lit(".")).alias("back"), F.lit("qa").alias("card_type"))
    expected = spark.range(40).select(F.lit("big").alias("case_id"), n.cast("int").alias("exp_idx"), F.array(F.concat(F.lit("term "), n % 20, F.lit("."))).alias("front_keywords"), F.array(F.concat(F.lit("means "), n % 20, F.lit("."))).alias("back_keywords"), F.lit("qa").alias("wanted_type"))
    found = {r.exp_idx: (r.gen_idx, r.similarity) for r in edges.sparse_match(expected, cards, 0.3).collect()}
    assert found == {i: (i % 20 + (1000 if i >= 20 else 0), 1.0) for i in range(40)}


def test_empty_tables(spark):
    e, c = spark.createDataFrame([], EXPECTED), spark.createDataFrame([], CARDS)
    assert edges.score_edges(e, c).count() == 0 and edges.sparse_match(e, c, 0.3).count() == 0
    one = spark.createDataFrame([("p", 0, ["a"], [], None)], EXPECTED)
    assert list(map(tuple, edges.sparse_match(one, c, 0.3).collect())) == [("p", 0, None, 0.0)]


def test_a_broken_invalidation_is_finished(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(c * 64, c) for c in "abc"], "cache_key string, text string")
    rows.write.parquet(path)
    assert invalidate(spark, path, "a" * 64) == 1 and sorted(r.text for r in read_cache(spark, path).collect()) == ["b", "c"]
    assert not (tmp_path / "cache-old").exists() and not (tmp_path / "cache-next").exists()
    # A failure after the old table was put aside, before the new one took its place.
    rows.where("text = 'c'").write.parquet(f"{path}-next")
    (tmp_path / "cache").rename(tmp_path / "cache-old")
    assert [r.text for r in read_cache(spark, path).collect()] == ["c"]
    assert not (tmp_path / "cache-old").exists() and not (tmp_path / "cache-next").exists()
