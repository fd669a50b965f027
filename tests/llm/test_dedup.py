"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from cardloom.llm import simhash
from cardloom.llm.exact_dedup import BLOCK, exact_duplicates
from tests.llm.helpers import awkward, documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        taken = False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_equals_brute_force(spark):
    long = "é" * (3 * BLOCK) + "tail"
    rows = awkward() + [(200, long), (201, long), (202, long + "!"), (203, long[:-1]), (204, "y" * BLOCK), (205, "y" * (BLOCK + 1)), (206, "y" * 2 * BLOCK), (201, long)]
    got = exact_duplicates(documents(spark, rows, clashing=True)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == exact(rows)


def test_exact_of_an_empty_table_and_of_nulls(spark):
    assert exact_duplicates(documents(spark, [])).count() == 0
    got = exact_duplicates(documents(spark, [(None, None), (None, "")])).collect()
    assert sorted(r.kept for r in got) == [False, True] and {r.group_size for r in got} == {2}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints, radius=2):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def test_near_equals_brute_force(spark):
    rows = awkward()
    got = simhash.near_duplicates(documents(spark, rows, clashing=True)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    root = components(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, p, least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_covering_reaches_every_pair():
    masks = simhash.masks(2)
    for a in range(64):
        for b in range(a + 1):
            flip = (1 << a) ^ (1 << b) if a != b else 1 << a
            assert any(not flip & m % (1 << 64) for m in masks)
    rnd = random.Random(6)
    for radius in range(7):
        masks = simhash.masks(radius)
        assert all(28 <= bin(m % (1 << 64)).count("1") for m in masks) and len(masks) == (2 << radius) - 1
        for _ in range(300):
            flip = sum(1 << i for i in rnd.sample(range(64), radius))
            assert any(not flip & m % (1 << 64) for m in masks)
    with pytest.raises(ValueError):
        simhash.masks(7)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_in_large_buckets_and_long_chains(spark, radius):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    values = {base}
    for _ in range(120):  # one bucket of many, above the size that is compared in pairs
        values.add(base ^ (1 << rnd.randrange(0, 63, 7)) ^ (1 << rnd.randrange(0, 63, 7)))
    chain = rnd.getrandbits(64)
    for bit in range(0, 60, 2):
        chain ^= 3 << bit
        values.add(chain)
    values |= {rnd.getrandbits(64) for _ in range(50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, radius).collect()]
    assert all(a != b and bin(a ^ b).count("1") <= radius for a, b in links)
    edges = simhash.links(frame, radius)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.least_reachable(edges).collect()}
    groups = defaultdict(set)
    for v, r in components(values, radius).items():
        groups[r].add(v)
    mine = defaultdict(set)
    for v in values:
        mine[found.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_a_round_of_components_is_one_query(spark, monkeypatch):
    """The driver keeps plans and tasks of every query: a path of 300 and a hub take a few, not eight a round."""
    calls, settle = [], simhash.settle
    monkeypatch.setattr(simhash, "settle", lambda *a: calls.append(1) or settle(*a))
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)]
    found = {r.node: r.root for r in simhash.least_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(301)}
    assert len(calls) <= 12
    calls.clear()
    assert simhash.least_reachable(spark.createDataFrame([], "a long, b long")).count() == 0
    assert len(calls) == 2
