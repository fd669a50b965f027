"""Near copies of texts: locality-sensitive hashing finds candidates, an exact check of shingles decides.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.  A
changed word changes five shingles, so fingerprints of shingles of such texts differ in up to a third of
their bits, more than any covering of 64 bits allows.  Fingerprints of the distinct words differ much
less: here each text has several, over hashes of their own, and every one is covered with the masks of
simhash.masks().  Every pair with a fingerprint within the radius is a candidate; pairs whose words all differ
too much are found by bands of a signature of their shingles (superminhash.py).

Only components are wanted, so a bucket's members first meet one or two of them, and then those
alone whose component is still another one.  In a bucket of more than PAIRED members these don't meet
in pairs: they do so by their rarest shingles.  Of two similar sets, shingles in order of rarity, the smaller
one shares one of its first (1 - 2s / (1 + s)) share, and one more, with the first 1 - s, and one more, of the
other; texts of one template, whose rarest shingles are their own, so don't meet at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import discard, lower_ascii, settle, text_of
from cardloom.llm.simhash import PAIRED, least_reachable, majority, masks, text_hash
from cardloom.llm.substring_dedup import segmented
from cardloom.llm.superminhash import band_keys, signatures

WORDS = 5
#: Fingerprints of a text, and the radius within which each is covered: 2 * 31 tables.
PRINTS, RADIUS = 2, 4
#: Longs of a set's bitmap, whose bits are parities: no more of them differ than members do.
BITMAP = 8
#: Rows of a batch that a worker takes at a time.
PART = 200


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct hashes of the runs of five words (of all words, if there are fewer), ascending; no words: none."""
    size = min(WORDS, len(words))
    runs = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(runs)]
    return np.unique(_mixed(runs + np.uint64(size)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Similarity(NamedTuple):
    """The least Jaccard similarity of a link, num / den."""

    num: int
    den: int


def similar(a: np.ndarray, b: np.ndarray, least: Similarity) -> bool:
    """Jaccard similarity of at least that; two sets without members are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least.den * both >= least.num * (len(a) + len(b) - both)


def bitmap(found: np.ndarray) -> np.ndarray:
    """The parity of the members that fall on each of 64 * BITMAP bits."""
    bits = np.bincount((found % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def word_keys(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and keys of the words of each text."""
    parts: list[np.ndarray] = []
    for a, _, words in segmented(texts, WORDS):
        keys = words.keys()[: words.core]
        if words.whole:
            yield from ((a + i, keys[s:e]) for i, (s, e) in enumerate(zip(words.bound[:-1].tolist(), words.bound[1:].tolist(), strict=True)))
        else:
            parts.append(keys)
            if words.final:
                yield a, np.concatenate(parts)
                parts = []


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), sid (identity of the set of shingles), n (its size), bits (its bitmap), prints and bands of every row."""

    def prints(words: np.ndarray) -> np.ndarray:
        distinct = np.unique(words)
        found = [majority(_mixed(distinct * np.uint64(2 * j + 3) + np.uint64(j))) if len(distinct) else 0 for j in range(PRINTS)]
        return np.array(found, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x: pa.array(list(x), pa.list_(pa.int64()))
        for batch in batches:
            for a in range(0, len(batch), PART):
                part, sets, marks = batch.slice(a, PART), [], []
                for _, words in word_keys(part.column(1)):
                    sets.append(shingles(words))
                    marks.append(prints(words))
                size = np.array([len(x) for x in sets])
                bands = band_keys(signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])))
                sids = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
                yield pa.record_batch([part.column(0), part.column(2), sids, pa.array(size, pa.int64()), longs(map(bitmap, sets)), longs(marks), longs(bands)], ["doc_id", "digest", "sid", "n", "bits", "prints", "bands"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(text_of()).alias("text"), text_hash().alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest long, sid binary, n long, bits array<long>, prints array<long>, bands array<long>")


def _near(least: Similarity) -> Column:
    """Whether two sets can be similar by their sizes and bitmaps: as many members differ, at least, as bits do."""
    num, den = least
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(BITMAP)), F.lit(0))
    return (den * F.least("an", "bn") >= num * F.greatest("an", "bn")) & ((den + num) * differ <= (den - num) * (F.col("an") + F.col("bn")))


def _side(rows: DataFrame, side: str, *more: Column) -> DataFrame:
    return rows.select(F.col("id").alias(side), F.col("n").alias(f"{side}n"), *[F.col("bits")[k].alias(f"{side}{k}") for k in range(BITMAP)], *more)


def _texts(docs: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """id, text of one text of each wanted set; known: id, digest."""
    named = wanted.select("id").distinct().join(known.select("id", "digest"), "id")
    return docs.select(text_hash().alias("digest"), lower_ascii(text_of()).alias("text")).join(named, "digest").dropDuplicates(["id"]).select("id", "text")


def _verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, least: Similarity) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar, by their texts, in a checkpoint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for at in range(0, len(batch), PART):
                part, good = batch.slice(at, PART), []
                for a, (_, s), (_, t) in zip(part.column(0).to_pylist(), word_keys(part.column(2)), word_keys(part.column(3)), strict=True):
                    if a != last:
                        last, held = a, shingles(s)
                    good.append(similar(held, shingles(t), least))
                yield pa.record_batch([c.filter(pa.array(good, pa.bool_())) for c in part.columns[:2]], ["a", "b"])
            pa.default_memory_pool().release_unused()

    pairs = settle(pairs)
    held = settle(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), known))
    of = lambda side: held.select(F.col("id").alias(side), F.col("text").alias(f"t{side}"))
    found = settle(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))
    discard(pairs, held)
    return found


def _rarest(docs: DataFrame, known: DataFrame, ids: DataFrame, least: Similarity) -> DataFrame:
    """key, id, place: the rarest shingles of each set, as many as may be missing in a similar one, and one more, with their places from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row, words in word_keys(batch.column(1)):
                held.append((row, shingles(words)))
                size += len(held[-1][1])
                if size > 1 << 20 or row == len(batch) - 1:
                    at = np.repeat([r for r, _ in held], [len(x) for _, x in held]).astype(np.int64)
                    tokens = np.concatenate([x for _, x in held]).view(np.int64)
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(tokens)], ["id", "token"])
                    held, size = [], 0

    tokens = settle(_texts(docs, ids, known).mapInArrow(run, "id long, token long"))
    times = tokens.groupBy("token").agg(F.count("*").alias("times"))
    w = Window.partitionBy("id")
    ranked = tokens.join(times, "token").withColumn("turn", F.row_number().over(w.orderBy("times", "token"))).withColumn("n", F.count("*").over(w))
    found = settle(ranked.where(f"times > 1 and turn <= floor(n * {least.den - least.num} / {least.den}) + 1").select(F.xxhash64(F.lit(-1), "token").alias("key"), "id", F.col("turn").alias("place")))
    discard(tokens)
    return found


def similar_texts(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, digest (text_hash()), component (a number).

    Rows have the same component if a chain of texts leads from one to the other, each linked to the
    next.  Links are exact; of the pairs of that similarity, those are missed that share no table and no band,
    which at 0.8 has a probability of 2e-4 for the bands alone.  A-Z are lower-cased,
    words are separated by ASCII white space.  Null texts count as empty; texts without words are one
    component; texts of fewer than five words are similar if their words are the same; rows that repeat
    or share a doc_id are texts of their own; other columns are ignored; an empty table gives no rows.
    Hot keys are split as skewed joins are.  The result is one checkpoint.
    """
    tables = F.array(*[F.lit(m) for m in masks(RADIUS)])
    keys = F.flatten(F.transform("prints", lambda p, j: F.transform(tables, lambda m, i: F.xxhash64(j, i, p.bitwiseAND(m)))))
    rows = settle(_described(docs))
    found = settle(components(docs, rows.withColumn("keys", F.concat(keys, "bands")), Similarity(4, 5)).select("doc_id", "digest", "component"))
    discard(rows)
    return found


def components(docs: DataFrame, rows: DataFrame, least: Similarity) -> DataFrame:
    """rows (doc_id, digest, sid, n of every row of docs) with component, and in_component, the least doc_id in it.

    rows also has bits (bitmap()) and keys: sets that share a key are candidates.  Empty sets are one component.
    """
    known = rows.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "bits", "keys")], F.min("digest").alias("digest"), F.min("doc_id").alias("doc_id"))
    # As many parts as the session shuffles to: each row has a key for every table.
    known = known.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = settle(known.withColumn("id", F.monotonically_increasing_id()))
    keyed = known.where("n > 0").select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("least"), F.max("id").alias("most")).where("members > 1")
    held = settle(keyed.join(shared, "key"))
    # Every bucket's least, and in half of the buckets the greatest too.
    first = F.when(F.col("key") % 2 == 0, F.array("least", "most")).otherwise(F.array("least"))
    met = held.select("id", F.explode(first).alias("m")).where("id <> m")
    met = met.select(F.least("id", "m").alias("a"), F.greatest("id", "m").alias("b")).distinct()
    links = _verified(docs, known, met.join(_side(known, "a"), "a").join(_side(known, "b"), "b").where(_near(least)).select("a", "b"), least)
    roots = least_reachable(links)

    rooted = lambda rows: rows.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    member = rooted(held.select("key", "id", "members"))
    mixed = member.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    member = settle(member.join(mixed, "key"))
    discard(held)
    rarest = _rarest(docs, known, member.where(F.col("members") > PAIRED).select("id"), least)
    def side(rows: DataFrame, name: str) -> DataFrame:
        return _side(rows, name, F.col("key"), F.col("root").alias(f"r{name}"), *([F.col("place").alias(f"p{name}")] if "place" in rows.columns else []))

    apart = (F.col("ra") != F.col("rb")) & _near(least)
    few = settle(member.where(F.col("members") <= PAIRED).select("key", "id", "root").join(known.select("id", "n", "bits"), "id"))
    pairs = side(few, "a").join(side(few, "b"), "key").where((F.col("a") < F.col("b")) & apart).select("a", "b")
    many = settle(rooted(rarest).join(known.select("id", "n", "bits"), "id"))
    # b is the smaller set, or the one of the smaller id; what can follow the shared shingle in both must do.
    num, den = least
    smaller = side(many.where(F.col("place") <= F.floor(F.col("n") * (den - num) / (den + num)) + 1), "b")
    follow = (den + num) * (1 + F.least(F.col("an") - F.col("pa"), F.col("bn") - F.col("pb"))) >= num * (F.col("an") + F.col("bn"))
    met = side(many, "a").join(smaller, "key").where((F.struct("an", "a") > F.struct("bn", "b")) & follow & apart)
    pairs = pairs.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    more = _verified(docs, known, pairs, least)
    discard(member, rarest, few, many, links)
    if not more.isEmpty():
        stars = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        joined = least_reachable(stars.unionByName(more))
        discard(roots)
        roots = joined
    of = known.join(roots, F.col("id") == F.col("node"), "left").select("sid", F.coalesce("root", "id").alias("component"), F.col("doc_id").alias("own"))
    lowest = of.groupBy("component").agg(F.min("own").alias("in_component"))
    found = settle(rows.select("doc_id", "digest", "sid", "n").join(of.join(lowest, "component").drop("own"), "sid").drop("sid"))
    discard(known, more, roots)
    return found
