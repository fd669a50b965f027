"""Near copies by Jaccard similarity, against all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from cardloom.llm import near_texts
from tests.llm.helpers import awkward, documents


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def groups_of(texts):
    """text -> a name of its group, by comparing all pairs."""
    values = sorted({t or "" for t in texts})
    sets, root = [plain_set(t) for t in values], list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both, b = len(a & sets[j]), sets[j]
            if 5 * both >= 4 * (len(a) + len(b) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {t: top(i) for i, t in enumerate(values)}


def same_groups(spark, rows):
    got, want = defaultdict(set), defaultdict(set)
    frame = documents(spark, rows, clashing=True)
    found = near_texts.similar_texts(frame)
    held = {(r.doc_id, r.digest): r.component for r in found.collect()}
    assert found.count() == len(rows)
    names = groups_of([t for _, t in rows])
    for r in frame.select("doc_id", "text", near_texts.text_hash().alias("digest")).collect():
        got[held[r.doc_id, r.digest]].add((r.doc_id, r.text))
        want[names[r.text or ""]].add((r.doc_id, r.text))
    return sorted(map(repr, map(sorted, (map(repr, x) for x in got.values())))) == sorted(map(repr, map(sorted, (map(repr, x) for x in want.values()))))


def edited(rnd, words, times):
    out = list(words)
    for _ in range(times):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def test_equals_all_pairs(spark):
    rnd = random.Random(1)
    rows = awkward()
    vocabulary = [f"w{i}" for i in range(3000)]
    for g in range(12):
        base = rnd.choices(vocabulary, k=rnd.randint(40, 300))
        rows += [(1000 + 20 * g + k, edited(rnd, base, rnd.randint(0, len(base) // 30))) for k in range(6)]
    assert same_groups(spark, rows)


def test_large_buckets_meet_by_their_rarest_shingles(spark, monkeypatch):
    """Many copies of one text, near and less near, beyond the size that is compared in pairs."""
    monkeypatch.setattr(near_texts, "PAIRED", 3)
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(4000)}" for _ in range(150)]
    rows = [(k, edited(rnd, base, rnd.randint(1, 9))) for k in range(60)]
    rows += [(100 + k, edited(rnd, base[:75] + [f"v{i}" for i in range(75)], 2)) for k in range(20)]
    assert same_groups(spark, rows)


def test_long_texts_in_segments_and_empty_table(spark, monkeypatch):
    from cardloom.llm import substring_dedup

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(3)
    texts = pa.array([" ".join(rnd.choices("abcdefgh", k=n)) for n in (900, 3, 0, 700)])
    want = [near_texts.shingles(k).tolist() for _, k in near_texts.word_keys(texts)]
    monkeypatch.setattr(substring_dedup, "CHUNK", 100)
    got = list(near_texts.word_keys(texts))
    assert [r for r, _ in got] == [0, 1, 2, 3] and [near_texts.shingles(k).tolist() for _, k in got] == want
    assert near_texts.shingles(np.empty(0, np.uint64)).tolist() == []
    assert near_texts.similar_texts(documents(spark, [])).count() == 0


def test_texts_of_one_template_don_t_meet(spark, monkeypatch):
    """Many texts that share most of their shingles, none of them similar: few pairs are looked at."""
    from pyspark.sql import functions as F

    rnd, seen = random.Random(5), []
    base = [f"w{k}" for k in range(100)]
    rows = [(k, edited(rnd, base, 3)) for k in range(400)]
    verified = near_texts._verified
    monkeypatch.setattr(near_texts, "_verified", lambda docs, known, pairs, least: seen.append(pairs.count()) or verified(docs, known, pairs, least))
    found = near_texts.similar_texts(documents(spark, rows))
    groups = sorted(r["count"] for r in found.groupBy("component").agg(F.count("*").alias("count")).collect())
    assert groups == sorted(Counter(groups_of([x for _, x in rows]).values()).values())
    assert sum(seen) < 10 * len(rows)
