"""The pipeline's stages, each against a plain version of itself."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cardloom.llm import pipeline as P
from cardloom.llm import quality, secret_scan
from tests.llm.helpers import awkward, documents
from tests.llm.test_dedup import UPPER
from tests.llm.test_near_texts import groups_of
from tests.llm.test_quality import corpus
from tests.llm.test_tokens import library  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def tables(spark, tmp_path, rows, labels, clashing=False):
    documents(spark, rows, clashing).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def texts(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_quality_stage(spark, tmp_path):
    rows, labels = corpus(300)
    sf = tables(spark, tmp_path, rows + [(None, None), (5000, "")], labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.keep_quality(spark, docs, sf)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in quality.classify(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    good = {i for i, q, _ in labels if q}
    assert len(good & want) > 0.97 * len(good) and len(want - good - {None, 5000}) < 0.03 * len(rows)


def test_exact_stage(spark):
    rows = awkward()
    docs = documents(spark, rows, clashing=True)
    kept = P.drop_copies(spark, docs, "")
    best = {}
    for i, t in rows:
        key = (t or "").translate(UPPER)
        best[key] = max(i if i is not None else -1, best.get(key, -1))
    got = [(r.doc_id, (r.text or "").translate(UPPER)) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert Counter(got) == Counter((i if i >= 0 else None, k) for k, i in best.items())


def test_near_stage(spark):
    rows = awkward()
    docs = documents(spark, rows, clashing=True)
    kept = P.drop_near_copies(spark, docs, "")
    root = groups_of([t for _, t in rows])
    assert kept.columns == docs.columns
    got = Counter(root[r.text or ""] for r in kept.collect())
    assert set(got) == set(root.values()) and set(got.values()) == {1}
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[t or ""]] = min(i, least.get(root[t or ""], i))
    assert all(r.doc_id == least.get(root[r.text or ""]) for r in kept.collect())


def test_secrets_stage(spark):
    rows = [(1, "password=abcdefgh1 é"), (2, None), (3, ""), (None, "clean"), (3, "")]
    docs = documents(spark, rows, clashing=True)
    got = P.hide_secrets(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str) == sorted([(1, "[assign] é", 10), (2, None, None), (3, "", 0), (3, "", 0), (None, "clean", 5)], key=str)


def test_whole_run_and_empty_table(spark, tmp_path):
    rows, labels = corpus(120)
    sf = tables(spark, tmp_path / "a", rows + awkward()[:12], labels, clashing=True)
    pieces = P.run(spark, sf).collect()
    assert pieces and all(0 < r.length <= 1024 for r in pieces)
    done = Counter()
    for r in pieces:
        done[(r.doc_id, r.doc_tokens)] += r.length
    assert all(total == tokens for (_, tokens), total in done.items())
    assert P.run(spark, tables(spark, tmp_path / "b", [], [])).count() == 0
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]


def plainly_hidden(text):
    """The text with every secret replaced, by searching it with every rule."""
    hits = []
    for order, r in enumerate(secret_scan.RULES):
        regex = re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0))
        hits += [(m.start(), order, r.kind, m.end()) for m in regex.finditer(text) if len(m[r.group]) >= r.least]
    out, at = "", 0
    for start, _, kind, end in sorted(hits):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_whole_run_against_a_plain_version(spark, tmp_path, library):  # noqa: F811
    """Given documents, with copies, near copies and secrets added: the documents that stay, and the ids of each."""
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables are not here")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SMALL}/labels.parquet'").fetchall()
    good = [t for i, t in rows if t and len(t.split()) > 150][:12]
    web = "eyJabcdefgh1.eyJabcdefgh2.abcdefgh_-"
    for k, t in enumerate(good):
        words = t.split()
        words[len(words) // 2] = "elsewhere"
        rows += [(10_000 + k, t.upper()), (20_000 + k, " ".join(words)), (30_000 + k, f"{web} {t} password=hunter2hunter2 {'deadbeef' * 5}")]
    rows += [(40_000, None), (40_001, "")]
    sf = tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    stays = {r.doc_id for r in quality.classify(docs, model).collect() if r.predicted}
    same = defaultdict(list)
    for i, t in rows:
        if i in stays:
            same[(t or "").translate(UPPER)].append((i, t))
    left = [max(x) for x in same.values()]
    root, near = groups_of([t for _, t in left]), defaultdict(list)
    for i, t in left:
        near[root[t or ""]].append((i, t))
    want = {i: [*library(plainly_hidden(t or "")), 0] for i, t in map(min, near.values())}
    assert len(want) < len(left) < len(stays) < len(rows)

    parts, sequences = defaultdict(list), defaultdict(list)
    for r in P.run(spark, sf).collect():
        assert r.length == len(bytes(r.ids)) // 4 and r.doc_tokens == len(want[r.doc_id])
        parts[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for _, p in sorted(x) for x in p] for i, x in parts.items()} == want
    for spans in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(spans)]).tolist()
        assert [a for a, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 1024
