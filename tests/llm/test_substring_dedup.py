from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cardloom.llm import substring_dedup
from cardloom.llm.substring_dedup import COVER, PERIOD, repeated_passages
from tests.llm.helpers import awkward, documents


def brute(rows, length=35):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in texts for k in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def test_cover_gives_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("length", [35, 30])
def test_equals_brute_force(spark, length):
    rows = awkward()
    got = repeated_passages(documents(spark, rows, clashing=True), length).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_long_texts_in_segments(spark, monkeypatch):
    """Segments of a few words, in texts whose passages run over their borders."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 100)
    rnd = random.Random(2)
    say = lambda n: " ".join(f"{rnd.choice('abcdef')}{rnd.randint(0, 99)}" for _ in range(n))
    passage, twice = say(90), say(36)
    rows = [(1, f"{say(50)} {passage} {say(70)}   "), (2, passage + "\n" + say(10)), (3, f"{twice} {say(200)} {twice}"), (4, say(300)), (5, "w" * 3000 + " " + say(40)), (6, say(60) + " " + "v" * 2000), (7, twice), (8, " " * 900)]
    for _, t in rows:
        parts = [w for _, _, x in substring_dedup.segmented(pa.array([t]), 35) for w in x.keys()[: x.core].tolist()]
        assert parts == substring_dedup.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).keys().tolist()
    assert in_process(rows) == brute(rows)


def in_process(rows, length=35):
    """repeated_passages() without Spark, so that constants can be changed."""
    ids, texts = pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())

    def again(batches):
        found = [r for b in batches for r in b.to_pylist()]
        times = Counter((r["h"], r.get("g")) for r in found)
        mine = [sorted({r["h"] for r in found if r["owner"] == i and times[r["h"], r.get("g")] > 1}) for i, _ in rows]
        return pa.record_batch([ids, texts, pa.array(mine, pa.list_(pa.int64()))], ["owner", "text", "hashes"])

    near = again(substring_dedup.anchor_hashes([pa.record_batch([ids, texts], ["owner", "text"])], length))
    hits = again(substring_dedup.window_hashes([near], length))
    return sorted((tuple(r.values()) for b in substring_dedup.removed([hits], length) for r in b.to_pylist()), key=str)


def test_passage_of_36_words_at_every_alignment(spark):
    passage = " ".join(f"w{i}" for i in range(36))
    rows = [(i, " ".join([f"u{i}_{k}" for k in range(i)] + [passage])) for i in range(PERIOD + 2)]
    got = {r.doc_id: r.kept for r in repeated_passages(documents(spark, rows)).collect()}
    assert got == {i: " ".join(f"u{i}_{k}" for k in range(i)) for i, _ in rows}


def test_empty_table_and_short_length(spark):
    assert repeated_passages(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(documents(spark, []), 20)
