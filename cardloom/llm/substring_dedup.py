"""Removes passages that repeat, by difference-cover anchors.

Let D be a difference cover modulo p: every difference modulo p is a difference of two members of D.
Then for any two places i and j there is a shift below p that takes both into D modulo p.  So if the
windows of `length` words at i and j are equal, the shorter windows of length - p + 1 words at that
shift are equal too, and both stand at cover positions.  Hashing windows at cover positions alone thus
finds every candidate; only windows around an anchor that occurs again are then hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import discard, settle, text_of
from cardloom.llm.pieces import CHUNK, piece_keys, rolling, text_chunks

#: A perfect difference set modulo PERIOD.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a chunk of texts, and hashes of runs of them."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, before: int = 0, core: int | None = None, final: bool = True):
        """before: words of the (only) text before buf; core: bytes of buf in which runs of interest start; final: nothing follows."""
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = ~BLANK[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True  # a text's last word doesn't run on into the next text
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge) & np.append(np.ones(len(buf), bool), False))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.buf, self.before, self.whole, self.final = buf, before, core is None, final
        self.bound = np.searchsorted(self.start, offsets)  # words of text i: bound[i] to bound[i + 1]
        self.of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bound))
        self.core = len(self.start) if core is None else int(np.searchsorted(self.start, core))
        self._keys: dict[int, np.ndarray] = {}

    def keys(self, salt: int = 0) -> np.ndarray:
        """A 64-bit key of each word."""
        if salt not in self._keys:
            self._keys[salt] = piece_keys(self.buf, self.start, self.end, salt) if len(self.start) else np.empty(0, np.uint64)
        return self._keys[salt]

    def runs(self, size: int, at: np.ndarray, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of the `size` words from each place in `at` (ascending); each salt has word keys of its own."""
        mixed = (self.keys(salt) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(30)
        out = rolling(mixed, at, size)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out.view(np.int64)

    def fits(self, size: int) -> np.ndarray:
        """Places from which `size` words of one text run."""
        at = np.arange(max(0, len(self.start) - size + 1))
        return at[at + size <= self.bound[1:][self.of[at]]] if len(at) else at

    def anchors(self, size: int) -> np.ndarray:
        at = self.fits(size)
        return at[np.isin((at - self.bound[:-1][self.of[at]] + self.before) % PERIOD, COVER)] if len(at) else at

    def text(self, i: int, j: int, gone: np.ndarray | None) -> bytes:
        """Words i to j but for those that are gone, joined by one space."""
        if i == j:
            return b""
        if gone is None:
            return b" ".join(self.buf[self.start[i] : self.end[j - 1]].tobytes().split())
        stay = np.flatnonzero(~gone[i:j]) + i
        if not len(stay):
            return b""
        first = int(self.start[stay[0]])
        data = self.buf[first : int(self.end[stay[-1]])].tobytes()
        return b" ".join([data[s:e] for s, e in zip((self.start[stay] - first).tolist(), (self.end[stay] - first).tolist(), strict=True)])

    def spread(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which words lie in any of the ranges a to b (exclusive)."""
        step = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(step, a, 1)
        np.add.at(step, np.minimum(b, len(self.start)), -1)
        return np.cumsum(step[:-1]) > 0


def segmented(texts: pa.Array, length: int) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of texts; a text of more than 2 * CHUNK bytes comes in several.

    Each of those ends `length` words after its core (or with the text), so every run that starts in the core is whole.
    """
    for a, b, buf, offsets in text_chunks(texts):
        if len(offsets) > 2 or len(buf) <= 2 * CHUNK:
            yield a, b, Words(buf, offsets)
            continue
        at, before = 0, 0
        while at < len(buf):
            end = _word_end(buf, at + CHUNK)
            stop, more = end, 16 * length
            while stop < len(buf):  # as far as it takes to hold the words after the core
                stop = _word_end(buf, end + more)
                inside = ~BLANK[buf[end:stop]]
                if np.count_nonzero(inside[1:] & ~inside[:-1]) > length:
                    break
                more *= 2
            words = Words(buf[at:stop], np.array([0, stop - at]), before, end - at, end >= len(buf))
            yield a, b, words
            at, before = end, before + words.core


def _word_end(buf: np.ndarray, at: int) -> int:
    """The first place from `at` on that is no word's inside."""
    while at < len(buf):
        hit = np.flatnonzero(BLANK[buf[at : at + (1 << 16)]])
        if len(hit):
            return at + int(hit[0])
        at += 1 << 16
    return len(buf)


def anchor_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """h, owner of each anchor of texts (owner, text)."""
    anchor = length - PERIOD + 1
    for batch in batches:
        for a, b, words in segmented(batch.column(1), length):
            at = words.anchors(anchor)
            at = at[at < words.core]
            rows = batch.column(0)[a:b].take(pa.array(words.of[at]))
            yield pa.record_batch([pa.array(words.runs(anchor, at)), rows], ["h", "owner"])


def window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """h, g, owner of each window around an anchor of (owner, text, hashes) that is among the hashes."""
    anchor = length - PERIOD + 1
    for batch in batches:
        known = batch.column(2)
        for a, b, words in segmented(batch.column(1), length):
            at = words.anchors(anchor)
            at = at[np.isin(words.runs(anchor, at), known[a:b].flatten().to_numpy())]
            first = np.maximum(at - (length - anchor), words.bound[:-1][words.of[at]])
            near = words.spread(first, at + 1)
            whole = words.fits(length)
            whole = whole[near[whole] & (whole < words.core)]
            rows = batch.column(0)[a:b].take(pa.array(words.of[whole]))
            yield pa.record_batch([pa.array(words.runs(length, whole)), pa.array(words.runs(length, whole, 1).astype(np.int32)), rows], ["h", "g", "owner"])


def removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The result for texts (doc_id, text, hashes of the windows that go)."""
    for batch in batches:
        known, last, over, parts = batch.column(2), -1, 0, []
        n_words = n_removed = 0
        for a, b, words in segmented(batch.column(1), length):
            gone = np.zeros(len(words.start), bool)
            mine = known[a:b]
            hits = mine.flatten().to_numpy()
            if a != last:
                last, over, parts, n_words, n_removed = a, 0, [], 0, 0
            gone[:over] = True  # words of windows that started in the segment before
            if len(hits):
                at = words.fits(length)
                has = mine.value_lengths().to_numpy() > 0
                at = at[(at < words.core) & has[words.of[at]]]
                at = at[np.isin(words.runs(length, at), hits)]
                gone |= words.spread(at, at + length)
                over = max(over - words.core, int(at[-1]) + length - words.core if len(at) else 0, 0)
            gone, bound = gone[: words.core], np.minimum(words.bound, words.core).tolist()
            count, lost = np.diff(bound), np.diff(np.concatenate([[0], np.cumsum(gone)])[bound])
            kept = [words.text(i, j, gone if n else None) for i, j, n in zip(bound[:-1], bound[1:], lost.tolist(), strict=True)]
            if not words.whole:  # a segment of a long text: the last one gives the row
                parts += [x for x in kept if x]
                n_words, n_removed = n_words + int(count[0]), n_removed + int(lost[0])
                if not words.final:
                    continue
                kept, count, lost = [b" ".join(parts)], np.array([n_words]), np.array([n_removed])
            kept = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
            yield pa.record_batch([batch.column(0)[a:b], pa.array(count.astype(np.int64)), pa.array(lost.astype(np.int64)), kept], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_passages(docs: DataFrame, length: int = 35) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of `length` words that covers it also starts anywhere else, in the same text
    or another; windows are judged on the input, so all copies of a passage go, the first included.
    Words are separated by ASCII white space and otherwise unchanged.  Null and empty texts have no
    words; rows that repeat, or share a doc_id, or have a null one, are texts of their own; other
    columns are ignored; an empty table gives no rows.  length: PERIOD + 2 or more.

    The hashes that repeat are counted with partial sums, and each text gets back only its own, so no
    task holds a hot window's texts; a window is told apart by 96 bits, of two hashes over two sets of
    word keys.  A long text is handled in segments of about CHUNK bytes.  The result reads one
    checkpoint, which Spark's cleaner removes with it; the others are gone.
    """
    if length < PERIOD + 2:
        raise ValueError(f"length must be {PERIOD + 2} or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # Whom a hash goes back to; rows that share an owner share hashes that repeat, which does no harm.
    texts = texts.withColumn("owner", F.coalesce("doc_id", F.xxhash64("text")))

    def again(rows: DataFrame, *keys: str) -> DataFrame:
        """Of each text's hashes those that occur more than once: owner, hashes."""
        twice = settle(rows.groupBy(*keys).count().where("count > 1").select(*keys))
        # Both sides of the join are plain exchanges, so a hot hash's rows can be split among tasks.
        mine = rows.join(twice, list(keys), "left_semi")
        found = settle(mine.groupBy("owner").agg(F.collect_set("h").alias("hashes")))
        discard(twice)
        return found

    owned = texts.select("owner", "text")
    near = again(owned.mapInArrow(partial(anchor_hashes, length=length), "h long, owner long"), "h")
    some = owned.join(near, "owner").select("owner", "text", "hashes")
    hits = again(some.mapInArrow(partial(window_hashes, length=length), "h long, g int, owner long"), "h", "g")
    discard(near)
    every = texts.join(hits, "owner", "left").select("doc_id", "text", F.coalesce("hashes", F.array().cast("array<long>")).alias("hashes"))
    return every.mapInArrow(partial(removed, length=length), "doc_id long, n_words long, n_removed long, kept string")
