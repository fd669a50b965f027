"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, each with an index from its value to the codes that have it: the rows
(segment, value, code).  Codes within distance m * (r + 1) - 1 of a query have a segment within r of the
query's, so after looking up all segment values within radius r every such code has been seen.  The
radius grows until the kth best verified distance is covered by that bound; then no unseen code can be
nearer, or as near, and the query is dropped.  All of it are joins on (segment, value): the index is
never copied, whatever the number of queries.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import discard, settle

BITS = 64
#: Codes that one shard of a scan has, about; values that a radius may look up for a query, even among fewer codes.
SHARD, LOOKUPS = 1 << 17, 1 << 12


def sign_code(embedding: Column) -> Column:
    """Bit i is 1 if component i is positive; missing, null and NaN components give 0.  The first 64 count."""
    one = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(F.slice(F.coalesce(embedding, F.array()), 1, BITS), one)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def whole_sign_code(embedding: Column) -> Column:
    """sign_code(); an error for more than 64 components, which would not all count."""
    longer = F.raise_error(F.concat(F.lit("an embedding has "), F.size(embedding).cast("string"), F.lit(" components; codes have 64 bits"))).cast("long")
    return F.when(F.size(embedding) > BITS, longer).otherwise(sign_code(embedding))


def segments(codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment.

    Looking up a value costs as much as comparing many codes, and wider segments need many more lookups
    for a radius, so 13 bits serve up to 2**20 codes, where a value has 128 of them on average, and 16
    beyond; below 2**13 codes a value has about one.
    """
    size = max(2, codes)
    m = 4 if size > 1 << 20 else 5 if size >= 1 << 13 else min(16, round(BITS / log2(size)))
    bounds = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def flips(width: int, radius: int) -> list[int]:
    """All values of `width` bits with exactly `radius` ones."""
    return [sum(1 << i for i in c) for c in combinations(range(width), radius)]


def _value(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _lookups(j: int, part: tuple[int, int], radius: int) -> Column:
    """Array of (j, value): the values of segment j that differ from the query's in `radius` bits."""
    value = _value(F.col("qcode"), *part)
    return F.transform(F.array(*map(F.lit, flips(part[1], radius))), lambda x: F.struct(F.lit(j).alias("j"), value.bitwiseXOR(x).alias("value")))


def _first_here(j: int, radius: int, parts: list[tuple[int, int]]) -> Column:
    """Whether segment j is the first of those that differ least between qcode and code: where a pair is met once."""
    differ = F.col("qcode").bitwiseXOR(F.col("code"))
    out = F.lit(True)
    for i, (shift, width) in enumerate(parts):
        if i != j:
            out &= F.bit_count(_value(differ, shift, width)) >= F.lit(radius + (i < j))
    return out


def top_k(rows: DataFrame, k: int = 10, every: int = 100, shard: int = SHARD) -> DataFrame:
    """query_id, rank (1 to k), id, distance: for each query the k other rows with the nearest codes, exactly.

    rows: id, code (64 bits as a long).  Queries are the rows whose id is divisible by `every`; ties go to
    the smaller id, and a query is no neighbour of itself.  Rows with a null id or code are left out;
    repeated rows (one id) count once, with their least code; extra columns are ignored; fewer than k
    other rows give fewer ranks.

    Rows with one code are one entry of the index, with their k + 1 least ids, which is all that any
    query can need.  A pair is met in one segment and at one radius only, and a task keeps the k + 1 best
    rows of a query before they are shuffled.  Skewed values of a segment are split as skewed joins are.
    Where a radius has more values to look up than there are codes, the queries left over are compared
    with all codes, shard by shard.  The result is one checkpoint.
    """
    given = rows.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).where("id is not null and code is not null")
    given = settle(given.groupBy("id").agg(F.min("code").alias("code")))
    # A hot code is first cut down within shares, so its rows never meet in one task.
    share = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("code").orderBy("id")
    least = given.withColumn("n", F.row_number().over(share)).where(F.col("n") <= k + 1).withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1)
    index = settle(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    codes = index.count()
    parts = segments(codes)
    values = lambda code: F.array(*[F.struct(F.lit(j).alias("j"), _value(code, *p).alias("value")) for j, p in enumerate(parts)])
    entries = index.select(F.explode(values(F.col("code"))).alias("at"), "code", "ids").select("at.j", "at.value", "code", "ids")
    best = Window.partitionBy("query_id").orderBy("distance", "id")

    def nearest(met: DataFrame) -> DataFrame:
        met = met.withColumn("distance", F.bit_count(F.col("qcode").bitwiseXOR(F.col("code"))).cast("long")).where("distance <= reach")
        return met.select("query_id", F.explode("ids").alias("id"), "distance").where("id <> query_id")

    def kept(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    asking = given.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("code").alias("qcode"), F.lit(BITS).cast("long").alias("reach"))
    asking = settle(asking)
    discard(given)
    found = None
    radius, widest = 0, max(w for _, w in parts)
    while radius <= widest and not asking.isEmpty():
        lookups = sum(comb(w, radius) for _, w in parts)
        if lookups > max(codes, LOOKUPS):
            # The rest, against all codes: each shard once for each query; pairs met before are left out.
            shards = max(1, -(-codes // shard))
            left = asking.select("query_id", "qcode", "reach", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"))
            differ = F.col("qcode").bitwiseXOR(F.col("code"))
            unmet = F.lit(True)
            for p in parts:
                unmet &= F.bit_count(_value(differ, *p)) >= radius
            met = index.withColumn("s", F.pmod(F.xxhash64("code"), F.lit(shards))).join(left, "s").where(unmet)
            radius = widest
        else:
            look = [_lookups(j, p, radius) for j, p in enumerate(parts) if radius <= p[1]]
            asked = asking.select("query_id", "qcode", "reach", F.explode(F.concat(*look)).alias("at")).select("query_id", "qcode", "reach", "at.j", "at.value")
            once = F.lit(False)
            for j in range(len(parts)):
                once |= (F.col("j") == j) & _first_here(j, radius, parts)
            met = asked.join(entries, ["j", "value"]).where(once)
        more = kept(nearest(met)).drop("rank")
        before, found = found, settle(kept(more if found is None else found.drop("rank").unionByName(more)))
        covered = len(parts) * (radius + 1) - 1
        # A query's reach: no farther row can be among its k best.
        known = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        reach = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(BITS).cast("long"))
        was, asking = asking, settle(asking.drop("reach").join(known, "query_id", "left").select("query_id", "qcode", reach.alias("reach"), F.coalesce(F.col("n") >= k, F.lit(False)).alias("full")).where(~F.col("full") | (F.col("reach") > covered)).drop("full"))
        discard(was, *([] if before is None else [before]))
        radius += 1
    discard(index, asking)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance long")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")
