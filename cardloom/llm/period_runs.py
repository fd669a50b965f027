"""Finds periodic runs of words, and collapses them to their first period, on a harmonic grid.

A run of period p that is at least 2 * p long holds two neighbouring multiples of p, j * p and (j + 1) * p.
From these, the longest common extensions forwards and backwards give the whole run, so n / p queries find
all runs of a period and n log n those of all.  An extension is a range minimum over the longest common
prefixes of neighbours in a suffix array, of the text's words or of its words reversed.

Grid points whose words differ, or all of whose neighbours do, have no extension worth asking for.  Texts
no six consecutive words of which occur twice have no run, so nothing is built for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import text_of
from cardloom.llm.substring_dedup import Words, segmented

#: Words of the shortest run.  It has as many matches a period apart as half of that, at least.
LEAST = 12
BLOCK = 32
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of codes (0 to n - 1) in order, and the place of each in that order, by doubling prefixes."""
    n, rank, size = len(codes), codes.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        del key
        if n == 0 or rank[order[-1]] == n - 1:
            return order.astype(np.int32), rank.astype(np.int32)
        size = min(2 * size, n)


def neighbour_prefixes(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common words of the suffix at each place of the order and the one before it."""
    n, out = len(codes), np.zeros(len(codes), np.int32)
    word, place, suffix, prefix = memoryview(np.append(codes, -1).astype(np.int32)), memoryview(rank), memoryview(order), memoryview(out)
    same = 0
    for i in range(n):
        r = place[i]
        if r:
            j = suffix[r - 1]
            most = n - max(i, j)
            while same < most and word[i + same] == word[j + same]:
                same += 1
            prefix[r] = same
            same -= same > 0
        else:
            same = 0
    return out


class RangeMinimum:
    """Minima of ranges: a sparse table over blocks, and running minima from both ends of each block."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        held = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        held[: len(values)] = values
        grid = held.reshape(-1, BLOCK)
        self.values, self.left = held, np.minimum.accumulate(grid, 1).ravel()
        self.right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [grid.min(1)]
        while 2 << (len(self.table) - 1) <= blocks:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of values[a : b + 1] for each pair."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.right[a], self.left[b])
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            x, y = first[inner] + 1, last[inner]
            level = np.frexp((y - x).astype(np.float64))[1] - 1  # the greatest power of two that fits
            for k in np.unique(level):
                at = level == k
                both = np.minimum(self.table[k][x[at]], self.table[k][y[at] - (1 << int(k))])
                out[inner[at]] = np.minimum(out[inner[at]], both)
        same = np.flatnonzero(first == last)
        if len(same):
            x, y = a[same], b[same]
            least = self.values[x]
            for _ in range(int((y - x).max())):
                x = np.minimum(x + 1, y)
                least = np.minimum(least, self.values[x])
            out[same] = least
        return out


class Extensions:
    """Longest common extensions: how many codes from x and from y on are the same."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        order, self.rank = suffix_array(codes)
        self.minima = RangeMinimum(neighbour_prefixes(codes, order, self.rank))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For x < y <= n."""
        out, some = np.zeros(len(x), np.int64), np.flatnonzero(y < self.n)
        a, b = self.rank[x[some]].astype(np.int64), self.rank[y[some]].astype(np.int64)
        out[some] = self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def grid(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (a multiple of p), p: the points at which x and x + p, and a neighbour of both, have the same word."""
    n = len(codes)
    edge = np.concatenate([[-1], codes, [-2]])  # word i is edge[i + 1]
    xs, ps = [], []

    def keep(x: np.ndarray, p: np.ndarray | int) -> None:
        hit = np.flatnonzero(codes[x] == codes[x + p])
        if len(hit):
            x, p = x[hit], p[hit] if isinstance(p, np.ndarray) else np.full(len(hit), p)
            near = (edge[x] == edge[x + p]) | (edge[x + 2] == edge[x + p + 2])
            xs.append(x[near])
            ps.append(p[near])

    most = n // 2
    root = int(most**0.5)
    for p in range(1, root + 1):
        keep(np.arange(0, n - p, p), p)
    for j in range(n // (root + 1)):  # longer periods, by the multiple
        p = np.arange(root + 1, min(most, (n - 1) // (j + 1)) + 1)
        if not len(p):
            break
        keep(j * p, p)
    return (np.concatenate(xs), np.concatenate(ps)) if xs else (np.empty(0, np.int64), np.empty(0, np.int64))


def periodic_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """start, length, period of every run of `least` words or more, by start, then period.

    A run has the smallest period p of its words, is at least 2 * p long, and no neighbouring word
    carries it on.  words: anything that np.unique tells apart.
    """
    none = np.empty((0, 3), np.int64)
    if len(words) < 2:
        return none
    codes = np.unique(words, return_inverse=True)[1]
    x, p = grid(codes)
    if not len(x):
        return none
    after = Extensions(codes).common(x, x + p)
    before = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(x)
    n = len(codes)
    if len(inner):
        before[inner] = Extensions(codes[::-1]).common(n - x[inner] - p[inner], n - x[inner])
    start, length = x - before, before + p + after
    good = np.flatnonzero((length >= 2 * p) & (length >= least))
    start, length, p = start[good], length[good], p[good]
    # A multiple of the period finds the same words again: the first of each (start, length) is the smallest.
    by = np.lexsort((p, length, start))
    start, length, p = start[by], length[by], p[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.stack([start, length, p], 1)[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which words any run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _worth_a_look(words: Words) -> np.ndarray:
    """Which texts of a chunk have the same LEAST / 2 words twice."""
    at = words.fits(LEAST // 2)
    of = words.of[at]
    keys = words.runs(LEAST // 2, at).view(np.uint64) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out = np.zeros(len(words.bound) - 1, bool)
    out[of[order[again]]] = True
    return out


def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result for texts (doc_id, text)."""
    none, names = np.empty((0, 3), np.int64), ["doc_id", "n_words", "runs", "kept"]

    def rows(ids: pa.Array, count: list[int], runs: list[np.ndarray], kept: list[bytes]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
        flat = np.concatenate(runs)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
        texts = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
        return pa.record_batch([ids, pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs), texts], names)

    for batch in batches:
        texts, parts = batch.column(1), []
        for a, b, words in segmented(texts, LEAST // 2):
            if words.whole:
                bound, keys, look = words.bound.tolist(), words.keys(), _worth_a_look(words)
                runs = [periodic_runs(keys[s:e]) if some else none for s, e, some in zip(bound[:-1], bound[1:], look.tolist(), strict=True)]
                gone = np.zeros(len(keys), bool)
                for s, e, x in zip(bound[:-1], bound[1:], runs, strict=True):
                    if len(x):
                        gone[s:e] = dropped(x, e - s)
                kept = [words.text(s, e, gone if len(x) else None) for s, e, x in zip(bound[:-1], bound[1:], runs, strict=True)]
                yield rows(batch.column(0)[a:b], np.diff(words.bound).tolist(), runs, kept)
                continue
            parts.append(words.keys()[: words.core].copy())
            if words.final:
                keys, parts = np.concatenate(parts), []
                runs = periodic_runs(keys)
                gone = dropped(runs, len(keys))
                kept = [w.text(0, w.core, gone[w.before : w.before + w.core]) for _, _, w in segmented(texts[a:b], LEAST // 2)]
                yield rows(batch.column(0)[a:b], [len(keys)], [runs], [b" ".join(x for x in kept if x)])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (start, length, period), kept (the words left, joined by one space).

    Words are separated by ASCII white space, otherwise unchanged, and numbered from 0.  A run is a stretch
    of consecutive words with smallest period p, at least LEAST and 2 * p long, that no neighbouring word
    carries on with that period; runs come by start, then period.  A word goes if any run holds it after
    that run's first period.  Null and empty texts have no words and no runs; rows that repeat, or share
    a doc_id, or have a null one, are texts of their own; other columns are ignored; an empty table gives
    no rows.

    A text is one row, handled by one task, with no shuffle; a worker holds about ten bytes for each of a
    text's bytes while it looks for its runs.  Words are told apart by 64 bits within their text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(collapsed, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string")


def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text: texts whose crc32(doc_id) divides by ten get a known run, which the contract of op12 plants.

    With h that number and g = h // 10, of n words each from word a = g % n on becomes word a + (i - a) % p,
    with p = 1 + (n - a) // (3 + g % 8).  Null texts and texts without a doc_id stay as they are.
    """

    def one(doc_id: int | None, text: bytes | None) -> bytes | None:
        h = 1 if doc_id is None or text is None else zlib.crc32(str(doc_id).encode())
        if h % 10:
            return text
        buf = np.frombuffer(text, np.uint8)
        words, g = Words(buf, np.array([0, len(buf)])), h // 10
        n = len(words.start)
        if not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        times, rest = divmod(n - a, p)
        cycle = words.text(a, a + p, None)
        return b" ".join(x for x in (words.text(0, a, None), *[cycle] * times, words.text(a, a + rest, None)) if x)

    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        made = pa.array([one(i, t) for i, t in zip(ids.to_pylist(), texts, strict=True)], pa.binary())
        yield pa.record_batch([ids, made.cast(pa.string())], ["doc_id", "text"])
