"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint has a nonzero vector m(i) of radius + 1 bits; table v (any nonzero such vector)
keys a fingerprint by its bits i with <m(i), v> = 1 modulo 2.  Two fingerprints that differ in at most
`radius` bits give at most `radius` equations <m(i), v> = 0, which some nonzero v solves, so the pair has
equal keys in that table: no pair within the radius is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import SPACES, discard, settle, steps, text_of

BITS = 64
#: Buckets of up to so many fingerprints compare them in pairs; larger ones link them through points.
PAIRED = 32


def fingerprint(text: str | bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half the hashes of the shingles, repeats included; no words: 0.

    Holds the text and, beside it, the words of a stretch of STEP bytes: some 60 MB, however long the text is.
    """
    data = text.encode() if isinstance(text, str) else text or b""
    digest, ones, total, held = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []
    for part in steps(data, SPACES):
        words = held + part.lower().split()  # of bytes: A-Z alone, and ASCII white space
        if len(words) >= shingle:
            runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            hashes = np.array([digest(x, seed) for x in runs], np.uint64)
            ones += ones_in(hashes)
            total += len(hashes)
        held = words[max(0, len(words) - shingle + 1) :]
    if not total and held:
        ones, total = ones_in(np.array([digest(b" ".join(held), seed)], np.uint64)), 1
    return most_of(ones, total)


def ones_in(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def most_of(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    return most_of(ones_in(hashes), len(hashes))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, digest (a hash of the text), fp (the fingerprint as a signed long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1).cast(pa.binary())), np.uint64, len(batch))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["doc_id", "digest", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), text_hash().alias("digest")).mapInArrow(run, "doc_id long, digest long, fp long")


def text_hash() -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(text_of())


def masks(radius: int) -> list[int]:
    """The bits that each table of the covering keys by, as signed longs: about half of them in every table.

    radius: up to 6, where the vectors are those of 7 bits that begin with a one.
    """
    if not 0 <= radius <= 6:
        raise ValueError("64 bits are covered up to a radius of 6")
    vectors = (1 << (radius + 1)) - 1
    m = [(1 << radius) + i if vectors > BITS else 1 + i % vectors for i in range(BITS)]
    return [_signed(sum(1 << i for i in range(BITS) if bin(m[i] & v).count("1") % 2)) for v in range(1, vectors + 1)]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """a, b (a < b): links between the distinct values of prints.fp whose components are those of all pairs
    within the radius (0 to 4), and which all lie within it.

    Small buckets give the pairs themselves.  In a larger bucket each fingerprint goes to the points that
    differ from it in up to radius - radius // 2 of the bits that the table leaves out; those that reach a
    point within radius // 2 hold it, and all that reach it link to the least holder.  Any two fingerprints
    within the radius meet at a point that one of them holds, so a bucket's work grows with its size and
    not with its square.  Hot keys are split as skewed joins are.
    """
    if not 0 <= radius <= 4:
        raise ValueError("links() covers a radius of 0 to 4")
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks(radius))]))
    rows = prints.select("fp").distinct().select("fp", tables.alias("t")).select("fp", "t.v", "t.key")
    full = rows.groupBy("v", "key").count().where("count > 1")
    held = settle(rows.join(full, ["v", "key"]))
    few = held.where(F.col("count") <= PAIRED)
    other = few.select("v", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = few.withColumnRenamed("fp", "a").join(other, ["v", "key"]).where(F.col("a") < F.col("b")).where(near).select("a", "b")
    out = [_signed(1 << i) for i in range(BITS)]
    left_out = F.element_at(F.array(*[F.array(*[F.lit(x) for x in out if not x & m]).cast("array<bigint>") for m in masks(radius)]), F.col("v") + 1)
    points = _changed(left_out, radius - radius // 2)
    many = held.where(F.col("count") > PAIRED).select("v", "key", "fp", F.explode(points).alias("change"))
    many = many.select("v", F.col("fp").bitwiseXOR(F.col("change")).alias("point"), "fp", (F.bit_count("change") <= radius // 2).alias("holds"))
    # At most one fingerprint for each change: a bounded group.
    met = many.groupBy("v", "point").agg(F.min(F.when(F.col("holds"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.where("a is not null").select(F.col("a").alias("x"), F.explode("fps").alias("y")).where("x <> y")
    stars = stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = settle(pairs.unionByName(stars).distinct())
    discard(held)
    return found


def _changed(bits: Column, most: int) -> Column:
    """The exclusive ors of up to `most` different members of an array of single bits."""
    none = F.array(F.lit(0).cast("long"))
    if most == 0:
        return none
    if most == 1:
        return F.concat(none, bits)
    two = F.flatten(F.transform(bits, lambda x, i: F.transform(F.slice(bits, i + 2, F.size(bits)), lambda y: x.bitwiseXOR(y))))
    return F.concat(none, bits, two)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def least_reachable(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of edges (a, b), in a checkpoint.

    Alternates two steps: each node hands its larger neighbours to the least one it knows, then its
    smaller neighbours.  Both keep components as they are, no hub is ever collected, and the edges end
    up as stars around the roots after a number of rounds that is logarithmic in the longest path.  A round
    is one query, as the driver keeps the plan and the tasks of each.
    """
    edges, last = settle(edges.select("a", "b")), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            found = settle(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct())
            discard(edges)
            return found
        last = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        half = _star(both, larger=True)
        turned = settle(_star(half.select(F.col("b").alias("a"), F.col("a").alias("b")), larger=False).distinct())
        discard(edges)
        edges = turned


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over directed edges a -> b; gives a < b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    # The second key has both sides dealt out for the join alone, so that a hub's edges are split as skewed joins are.
    odd = lambda name: F.col(name).bitwiseAND(F.lit(1))
    moved = edges.withColumn("odd", odd("a")).join(least.withColumn("odd_of", odd("of")), (F.col("a") == F.col("of")) & (F.col("odd") == F.col("odd_of")))
    # Larger neighbours go to the least; with none but smaller ones, they and the node itself do.
    moved = moved.where("b > a") if larger else moved
    out = moved.select(F.col("m").alias("x"), F.col("b").alias("y"))
    if not larger:
        out = out.unionByName(least.select(F.col("m").alias("x"), F.col("of").alias("y")))
    return out.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, digest, fp, component, component_id, n_links.

    component is the root fingerprint of the group; component_id is the smallest doc_id reachable over
    links of at most `radius` (0 to 4) differing bits; null doc_ids count only where a component has no
    other.  n_links: how many other fingerprints the document's own links to directly in links().  Null
    texts count as empty; texts without words share fingerprint 0; other columns are ignored; an empty
    table gives no rows.  The result is one checkpoint.
    """
    rows = settle(fingerprints(docs, shingle))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(nodes, radius)
    roots = least_reachable(edges)
    degree = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(lowest, "root").join(degree, F.col("fp") == F.col("node"), "left").select("fp", F.col("root").alias("component"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = settle(rows.join(member, "fp").select("doc_id", "digest", "fp", "component", "component_id", "n_links"))
    discard(rows, nodes, edges, roots)
    return found


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
