"""Alignment, periodic runs and MinHash: their registered queries against plain versions, and their parts."""

from __future__ import annotations

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc

from cardloom.llm import alignment, period_runs, superminhash
from cardloom.llm.pieces import byte_letters
from cardloom.settling import shared_dir
from tests.llm.helpers import awkward, documents
from tests.llm.test_near_texts import plain_set
from tests.llm.test_queries import rows_of, tables  # noqa: F401


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11 -------------------------------------------------------------------------------------


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    value = {c: i for i, c in enumerate(byte_letters())}
    spell_a = lambda i: bytes(value[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ended(ids, spell):
        out, end = [], 0
        for i in ids:
            end += len(spell(i))
            out.append((end, i))
        return out

    counts, found = Counter(), []
    for doc_id, text in rows:
        ids = [[], []]
        if text:
            ids, said = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)], (" " + text).encode()
            if any(b"".join(map(spell, x)) != said for x, spell in zip(ids, (spell_a, spell_b), strict=True)):
                ids = [[], []]
        ends = [ended(x, spell) for x, spell in zip(ids, (spell_a, spell_b), strict=True)]
        cuts = sorted(dict(ends[0]).keys() & dict(ends[1]).keys())
        at = [dict(x) for x in ends]
        links = [(at[0][c], at[1][c]) for c in cuts]
        counts.update(links)
        sides = [[[] for _ in cuts] for _ in ends]
        for side, tokens in zip(sides, ends, strict=True):
            for e, i in tokens:
                side[bisect.bisect_left(cuts, e)].append(str(i))
        groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True))
        found.append((doc_id, len(ids[0]), len(ids[1]), len(cuts), links, groups))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, n, m, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha(s) if s else "") for d, n, m, g, ls, s in found]


def test_op11(spark, tables):  # noqa: F811
    at, rows = tables
    assert rows_of(spark, "op11_alignment", at) == sorted(plain_alignment(rows), key=str)


def test_alignment_of_awkward_texts(spark, tmp_path, monkeypatch):
    """Marks, odd white space, specials, repeated and missing ids; in blocks and chunks of a few texts and units."""
    more = ["a▁b c", " ", "x ", "tab\t then \n  new  line\n\n  x", "<0x41> <s> </s> <unk>\x00 z", "　 a  b", "  a   b", " \n a", "don't  stop", "é" * 50]
    rows = [*awkward(), *[(500 + i, t) for i, t in enumerate(more)], (500, "again"), (None, "again")]
    want = sorted(plain_alignment(rows), key=str)
    for block, scope, chunk in ((alignment.BLOCK, alignment.SCOPE, alignment.CHUNK), (200, 200, 7), (100, 900, 7)):
        monkeypatch.setattr(alignment, "BLOCK", block)
        monkeypatch.setattr(alignment, "SCOPE", scope)
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        found = alignment.align(documents(spark, rows, clashing=True), "byte_bpe_50k.json", "piece_bpe_32k.model")
        got = [(*map(int, r[1:7]), sha(r.groups) if r.groups else "") for r in found.collect()]
        assert sorted(map(str, got)) == sorted(str(w[1:]) for w in want)
        assert sorted(map(str, (r.doc_id for r in found.collect()))) == sorted(str(i) for i, _ in rows)
    assert alignment.align(documents(spark, []), "byte_bpe_50k.json", "piece_bpe_32k.model").count() == 0


def test_figures_of_units_travel_packed(monkeypatch):
    """As rows they took 66 bytes each of the shuffle; texts read them from several packs of a block, in any order."""
    rnd = np.random.default_rng(3)
    rows = [(k % 3, k // 3, int(rnd.integers(1, 4)), int(rnd.integers(0, 3)), int(rnd.integers(1, 1 << 20)), f"{rnd.integers(50_000)},{rnd.integers(50_000)}|{rnd.integers(32_000)};3|4,5") for k in range(60_000)]
    names = ["block", "number", *alignment.FIGURES, "groups"]
    sent = [pa.record_batch([pa.array(c) for c in zip(*(rows[i] for i in part), strict=True)], names) for part in np.array_split(rnd.permutation(len(rows)), 9)]
    monkeypatch.setattr(alignment, "PACK", 20_000)
    packs = pa.Table.from_batches(alignment.packed(iter(sent)))
    assert len(packs) == 9 and sum(packs.column("n").to_pylist()) == len(rows)
    assert sum(map(len, packs.column("pack").to_pylist())) < 30 * len(rows)

    docs = [{"doc_id": 7, "units": [5, 0, 5]}, {"doc_id": None, "units": []}, {"doc_id": 8, "units": [19_999]}]
    kind = pa.list_(alignment.DOC)
    mine = packs.filter(pc.equal(packs.column("block"), 1)).append_column("docs", pa.nulls(3, kind)).combine_chunks().to_batches()[0]
    of = pa.record_batch([pa.array([1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([docs], kind)], mine.schema.names)
    got = pa.Table.from_batches(alignment.looked_up(iter([mine, of]))).to_pylist()
    unit = {n: x for b, n, *x in rows if b == 1}
    for doc, found in zip(docs, got, strict=True):
        own = [unit[i] for i in doc["units"]]
        want = {c: sum(x[k] for x in own) for k, c in enumerate(alignment.FIGURES)}
        n_b = sum(x[3].count(",") + 2 * x[3].count("|") - x[0] for x in own)
        assert found == {"doc_id": doc["doc_id"], **want, "n_b": n_b, "n_groups": 2 * len(own), "groups": ";".join(x[3] for x in own)}


def test_units_begin_where_both_tokenizers_end(spark):
    buf = np.frombuffer(" a  b\n c   d".encode(), np.uint8)
    assert alignment.unit_starts(buf, np.array([0, len(buf)])).tolist() == [0, 2, 8]
    first, back = alignment._same(np.array([7, 7, 7], np.uint64), np.array([1, 2, 1], np.uint64))
    assert len(first) == 2 and back[0] == back[2] != back[1]
    assert shared_dir(spark)


# ---- op12 -------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    """start, length, period of every run, by looking at each period from each place."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, 2 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_op12(rows):
    out = []
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        gone = {i for s, size, p in runs for i in range(s + p, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        said = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(said), sha(kept)))
    return out


def test_op12(spark, tables):  # noqa: F811
    at, rows = tables
    assert rows_of(spark, "op12_period_runs", at) == sorted(plain_op12(rows), key=str)


def test_runs_equal_all_periods(spark):
    rnd = random.Random(0)
    for _ in range(400):
        n = rnd.randint(0, 90)
        words = [rnd.randrange(rnd.choice((1, 2, 3, 30))) for _ in range(n)]
        if n and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = 1 + (n - a) // (3 + rnd.randrange(8))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert list(map(tuple, period_runs.periodic_runs(np.array(words, np.int64)).tolist())) == plain_runs(words)


def test_runs_of_awkward_and_long_texts(spark, monkeypatch):
    from cardloom.llm import substring_dedup

    rnd = random.Random(4)
    cycle = " ".join(rnd.choices("abcdefgh", k=25))
    texts = [None, "", " \n", "x " * 11, "x " * 12, "a\tb\n" * 40, f"one two {cycle} {cycle} {cycle} a", " ".join(rnd.choices("ab", k=800)), "y " * 3000]
    rows = [*enumerate(texts), (3, "x " * 12), (None, "z " * 30)]

    def got():
        found = period_runs.collapse_runs(documents(spark, rows, clashing=True)).collect()
        return sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.kept) for r in found)

    want = []
    for i, t in rows:
        words = (t or "").split()
        runs = plain_runs(words)
        gone = {k for s, size, p in runs for k in range(s + p, s + size)}
        want.append((str(i), len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got() == sorted(want)
    ids, strings = zip(*rows, strict=True)
    import pyarrow as pa

    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(strings, pa.string())], ["doc_id", "text"])
    monkeypatch.setattr(substring_dedup, "CHUNK", 100)  # long texts come in segments
    parts = [r for b in period_runs.collapsed(iter([batch])) for r in b.to_pylist()]
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x.values()) for x in r["runs"]], r["kept"]) for r in parts) == sorted(want)
    assert period_runs.collapse_runs(documents(spark, [])).count() == 0


def test_range_minimum(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 500).astype(np.int32)
    minima = period_runs.RangeMinimum(values)
    a, b = np.sort(rng.integers(0, 500, (2, 2000)), 0)
    assert minima.least(a, b).tolist() == [int(values[x : y + 1].min()) for x, y in zip(a, b, strict=True)]


# ---- op13 -------------------------------------------------------------------------------------


def plain_op13(rows):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x]).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
        for x in s:
            where[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    names = [least.get(top(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return [(d, len(s), c, c == d) for (d, _), s, c in zip(rows, sets, names, strict=True)]


def test_op13(spark, tables):  # noqa: F811
    at, rows = tables
    assert rows_of(spark, "op13_minhash", at) == sorted(plain_op13(rows), key=str)


def test_minhash_of_near_copies_nulls_and_repeats(spark):
    from cardloom.llm.minhash import near_duplicates

    rnd = random.Random(7)
    rows = [*awkward(), (700, "one two"), (701, "ONE  two"), (702, "one two three")]
    for g in range(10):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(40, 300))]
        for k in range(8):
            near = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 60))):
                near[rnd.randrange(len(near))] = f"v{rnd.randrange(10**6)}"
            rows.append((800 + 10 * g + k, " ".join(near)))
    found = near_duplicates(documents(spark, rows, clashing=True))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain_op13(rows)))
    assert near_duplicates(documents(spark, [])).count() == 0


def test_signatures_are_those_of_whole_permutations(spark):
    rng, m = np.random.default_rng(0), 24

    def plain(elements):
        out = [np.iinfo(np.uint64).max] * m
        for e in elements:
            order = list(range(m))
            for k in range(m):
                source, value = superminhash._drawn(np.array([e], np.uint64), k, m)
                s = int(source[0])
                order[k], order[s] = order[s], order[k]
                out[order[k]] = min(out[order[k]], int(value[0]))
        return out

    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 0, 3, 40, 200)]
    got = superminhash.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), m)
    assert [g.tolist() for g in got] == [plain(s) for s in sets]
    same = []
    for _ in range(100):
        u = rng.integers(0, 2**63, 300).astype(np.uint64)
        x, y = superminhash.signatures(np.concatenate([u, u[:255]]), np.array([0, 300, 555]))
        same.append((x == y).mean())
    assert abs(np.mean(same) - 0.85) < 0.01 and np.std(same) < 0.0275  # that of independent components
