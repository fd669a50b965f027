from __future__ import annotations

import bisect
import math
import random
import zlib

import numpy as np

from cardloom.llm import quality
from tests.llm.helpers import awkward, documents


def corpus(n=600):
    rnd = random.Random(1)
    words = ["the", "river", "went", "over", "old", "stones", "and", "under", "bridges", "again"]
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        text = " ".join(rnd.choices(words, k=rnd.randint(5, 80)))
        rows.append((i, text + "." if good else " ".join(w + "!!" for w in text.upper().split())))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows, clashing=True)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    truth = {i: q for i, q, _ in labels}
    got = quality.classify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)


def test_held_out_labels_are_never_used(spark):
    rows, labels = corpus(200)
    docs = documents(spark, rows)
    table = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t) for i, q, t in labels]
    a, b = (quality.train(docs, table(x)) for x in (labels, turned))
    x = np.array([quality.features(t) for _, t in rows])
    assert np.array_equal(a.score(x), b.score(x))


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows, clashing=True)
    odd = [(4, 1, 0), (4, 0, 0), (7, None, None), (None, 1, 0), (9, 5, 0), (10**9, 0, 0), (12, 0, None)]
    model = quality.train(docs, spark.createDataFrame(odd, "doc_id long, quality int, toxic int"))
    got = quality.classify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(documents(spark, []), model).count() == 0


def test_scores_are_sums_of_table_entries(spark):
    """Every score again, one bin after the other."""
    rows, labels = corpus(200)
    docs = documents(spark, rows + awkward())
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = []
    for i, t in rows + awkward():
        x = quality.features(t or "")
        total = model.intercept + sum(table[bisect.bisect_right(list(e), v)] for table, e, v in zip(model.tables, model.edges, x, strict=True))
        for f, g, values in model.pairs:
            total += values[bisect.bisect_right(list(model.coarse[f]), x[f])][bisect.bisect_right(list(model.coarse[g]), x[g])]
        want.append((i if i is not None else -1, round(1 / (1 + math.exp(-total)), 9)))
    got = [(r.doc_id if r.doc_id is not None else -1, round(r.score, 9)) for r in quality.classify(docs, model).collect()]
    assert sorted(got) == sorted(want)


def test_documents_that_share_an_id_stay_within_the_bound(spark, monkeypatch):
    rows, labels = corpus(60)
    first = next(i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    taken = []
    monkeypatch.setattr(quality, "fit", lambda x, y: taken.append(len(x)))
    docs = documents(spark, rows + [(first, f"copy {k}") for k in range(500)])
    quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), limit=50)
    assert len(taken) == 1 and 0 < taken[0] <= 50


def test_no_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in quality.classify(docs, model).collect()] == [0.5, 0.5]


def test_pairs_are_learnt():
    rnd = np.random.default_rng(0)
    x = rnd.random((2000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in {(f, g) for f, g, _ in model.pairs}
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
