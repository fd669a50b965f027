"""Texts longer than a stretch: results don't depend on where they are cut, and memory stays near the text's size."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardloom.llm import common, quality, secret_scan, simhash
from cardloom.llm.pieces import text_chunks
from cardloom.llm.queries import table
from tests.llm.helpers import awkward

SMALL = "/root/testdata/sf0.001"
TEXTS = sorted({t or "" for _, t in awkward()}) + ["!!!" * 50 + "\n\n" + "AKIA" + "Q" * 20 + " Token: 'abcdefghij'\n" * 30]


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 21])
def test_cuts_change_nothing(monkeypatch, step):
    whole = [(quality.features(t), _spans(t)) for t in TEXTS]
    for module in (common, quality, secret_scan):
        monkeypatch.setattr(module, "STEP", step)
    for text, (features, spans) in zip(TEXTS, whole, strict=True):
        assert simhash.fingerprint(text) == simhash.fingerprint(text.encode()) == plain_fingerprint(text)
        assert quality.features(text) == features and _spans(text) == spans


def _spans(text: str):
    return [secret_scan.scanner(secret_scan.RULES).spans(buf, at) for _, _, buf, at in text_chunks(pa.array([text]))]


def test_features_by_plain_counts():
    for text in TEXTS:
        data, got = text.encode(), dict(zip(quality.FEATURES, quality.features(text), strict=True))
        words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
        assert got["log_words"] == math.log1p(len(words))
        assert got["distinct_words"] == len(set(words)) / max(1, len(words))
        assert got["repeated_lines"] == 1 - len(set(lines)) / max(1, len(lines))
        assert got["short_words"] == sum(len(x) < 4 for x in words) / max(1, len(words))
        assert got["capitalised"] == sum(65 <= x[0] <= 90 for x in words) / max(1, len(words))
        doubled = sum(a == b and quality.SYMBOL[a] for a, b in zip(data, data[1:], strict=False))
        assert got["doubled_symbols"] == doubled / max(1, len(words))


@pytest.mark.parametrize("what", ["fingerprint", "features", "spans"])
def test_memory_of_a_long_text(what):
    rnd = random.Random(1)
    said = " ".join(f"{rnd.getrandbits(96):024x}" for _ in range(40_000))
    text = said + ("\n" + said) * 39  # 40 MB
    one = text_chunks(pa.array([text], pa.large_string())) if what == "spans" else None
    held = next(iter(one)) if one else None
    tracemalloc.start()
    if what == "fingerprint":
        simhash.fingerprint(text)
    elif what == "features":
        quality.features(text)
    else:
        secret_scan.scanner(secret_scan.RULES).index.postings(held[2], held[3])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 3 * len(text)


def test_registered_quality_query(spark):
    """op6 on whole tables: the model fitted again on the rows that the contract allows, its tables added up plainly."""
    got = {r.doc_id: r for r in entry.queries()["op6_quality"](spark, SMALL).collect()}
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").select(F.col("doc_id").cast("long"), "quality").collect()}
    learnt = sorted(i for i in docs if i in labels and zlib.crc32(str(i).encode()) % 3 != 1)
    model = quality.train(table(spark, SMALL, "documents"), table(spark, SMALL, "labels").where(F.col("doc_id").isin(learnt)))
    x = np.array([quality.features(docs[i]) for i in sorted(docs)])
    want = dict(zip(sorted(docs), model.score(x).tolist(), strict=True))
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r.score == pytest.approx(want[i], abs=1e-9) and r.predicted == int(r.score >= 0.5)
    held = [i for i in labels if i in docs and got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.95 * len(held)
