from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cardloom.llm import hamming


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, k, every):
    codes = {}
    for i, c in rows:
        if i is not None and c is not None:
            codes[i] = min(c, codes.get(i, c))
    out = []
    for q in codes:
        if q % every == 0:
            near = sorted((bin((codes[q] ^ c) % (1 << 64)).count("1"), i) for i, c in codes.items() if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "lookups"), [(1 << 17, 1 << 12), (40, 0)])
def test_equals_brute_force(spark, monkeypatch, shard, lookups):
    monkeypatch.setattr(hamming, "LOOKUPS", lookups)  # 0: far queries are compared with all codes
    rnd = random.Random(7)
    hot = rnd.getrandbits(64)
    rows = [(i, signed(rnd.getrandbits(64))) for i in range(250)] + [(1000 + i, signed(hot)) for i in range(80)]
    rows += [(2000 + i, signed(hot ^ (1 << i % 9) ^ (1 << i % 5))) for i in range(40)] + [(None, 1), (7, None), (20, 5), (20, 5), (-30, 0), (30, -1)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "id long, code long, s string, ids string")
    got = hamming.top_k(frame, k=6, every=10, shard=shard).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in got) == brute(rows, 6, 10)


def test_few_rows_and_none(spark):
    schema = "id long, code long"
    assert hamming.top_k(spark.createDataFrame([], schema)).count() == 0
    got = hamming.top_k(spark.createDataFrame([(0, 3), (1, 1)], schema)).collect()
    assert [(r.query_id, r["rank"], r.id, r.distance) for r in got] == [(0, 1, 1, 1)]
    assert hamming.top_k(spark.createDataFrame([(1, 3), (2, 1)], schema)).count() == 0


def test_sign_codes(spark):
    rows = [([1.0, -1.0, 0.0, 2.0],), (None,), ([float("nan"), None, 3.0],), ([1.0] * 70,), ([],)]
    got = [r.c for r in spark.createDataFrame(rows, "e array<float>").select(hamming.sign_code(F.col("e")).alias("c")).collect()]
    assert got == [0b1001, 0, 0b100, -1, 0]
