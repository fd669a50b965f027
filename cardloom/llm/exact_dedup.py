"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size.  Blocks are sorted, and the place of a block in that order is
its integer name; then adjacent names are paired and the pairs named in the same way, until one name is
left for each text.  Equal names mean equal texts: contents are compared, never digests.

A name is a bucket number and a rank within the bucket's sorted order, so it depends on the contents
alone and not on how Spark deals out the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import discard, lower_ascii, settle, text_of

BLOCK = 4096
#: Buckets that blocks are sorted in; a bucket's rows are sorted, and spilled, by one task.
BUCKETS = 1 << 16
#: Copies of a block are first named within so many shares at least, so no task gets more than a share of a hot
#: block; as many as the session shuffles to, where that is more.
SHARES = 64


def _bucket(*what: Column) -> Column:
    return F.pmod(F.xxhash64(*what), F.lit(BUCKETS))


def _name(bucket: str, *order: str) -> Column:
    """Integer name of the columns `order` within a bucket."""
    return F.col(bucket) * (1 << 40) + F.dense_rank().over(Window.partitionBy(bucket).orderBy(*order))


def _block_names(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n (blocks), idx, share_name, name (null but on the first row of a share_name)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(text_of()).alias("norm"))
    # The digest only tells rows apart that share a doc_id; names decide what is equal.
    rows = rows.select("doc_id", F.sha2("norm", 256).alias("digest"), F.col("norm").cast("binary").alias("data"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / F.lit(BLOCK)).cast("int")))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("data"), i * BLOCK + 1, F.lit(BLOCK)))
    blocks = rows.select("doc_id", "digest", "n", F.posexplode(cut).alias("idx", "block"))
    shares = max(SHARES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(shares))
    blocks = blocks.withColumn("bucket", _bucket(F.col("idx"), F.col("block"), share))
    # Within a share: name, and keep the bytes on the first row of each name alone.
    named = blocks.withColumn("share_name", _name("bucket", "idx", "block"))
    named = named.withColumn("earlier", F.lag("share_name").over(Window.partitionBy("bucket").orderBy("idx", "block")))
    first = F.col("earlier").isNull() | (F.col("earlier") != F.col("share_name"))
    sent = named.select("doc_id", "digest", "n", "idx", "share_name", F.when(first, F.col("block")).alias("block"))
    # Across shares: rows without bytes need no name; they go anywhere.
    sent = sent.withColumn("bucket", F.when(F.col("block").isNotNull(), _bucket(F.col("idx"), F.col("block"))).otherwise(-1 - _bucket(F.col("doc_id"), F.col("digest"))))
    sent = sent.withColumn("name", F.when(F.col("block").isNotNull(), _name("bucket", "idx", "block")))
    return sent.select("doc_id", "digest", "n", "idx", "share_name", "name")


def text_names(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n, name, row (a number of its own): equal (n, name) mean equal normalised texts.

    One row for each row of docs, in a checkpoint.
    """
    blocks = settle(_block_names(docs))
    known = blocks.where("name is not null").select("share_name", F.col("name").alias("of_share"))
    # A hot share_name's rows can be split among tasks: this join and the one below are plain exchanges.
    rows = settle(blocks.drop("name").join(known, "share_name").select("doc_id", "digest", "n", "idx", F.col("of_share").alias("name")))
    discard(blocks)
    width = rows.agg(F.max("n")).first()[0] or 1
    done, held = rows.where("n = 1").select("doc_id", "digest", "n", "name"), [rows]
    left = rows.where("n > 1").withColumn("of", F.col("n"))
    while width > 1:
        # Rows that share doc_id and digest are the same text and get the same names, so either will do.
        pairs = left.groupBy("doc_id", "digest", "n", F.shiftright("idx", 1).alias("idx"), F.shiftright(F.col("of") + 1, 1).alias("of")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"),
        )
        pairs = settle(pairs)
        kinds = pairs.groupBy("idx", "a", "b").count().withColumn("bucket", _bucket(F.col("idx"), F.col("a"), F.col("b")))
        kinds = kinds.select(*(F.col(x).alias(f"k_{x}") for x in ("idx", "a", "b")), _name("bucket", "idx", "a", "b").alias("name"))
        kinds = settle(kinds)
        same = (F.col("idx") == F.col("k_idx")) & (F.col("a") == F.col("k_a")) & F.col("b").eqNullSafe(F.col("k_b"))
        left = settle(pairs.join(kinds, same).select("doc_id", "digest", "n", "idx", "of", "name"))
        discard(pairs, kinds)
        held.append(left)
        width = (width + 1) // 2
        done = done.unionByName(left.where("of = 1").select("doc_id", "digest", "n", "name"))
        left = left.where("of > 1")
    # Repeated rows were merged while pairing: bring back as many as there were.
    times = rows.where("n > 1 and idx = 0").groupBy(F.col("doc_id").alias("t_id"), F.col("digest").alias("t_digest")).agg(F.count("*").alias("times"))
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("digest") == F.col("t_digest"))
    again = F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))).alias("again")
    found = done.join(times.where("times > 1"), same, "left").select("doc_id", "digest", "n", "name", again).drop("again")
    named = settle(found.withColumn("row", F.monotonically_increasing_id()))
    discard(*held)
    return named


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts (null: empty) are equal if identical after lower-casing A-Z; of equal texts the row with the
    largest doc_id stays.  A null doc_id is less than any other, and keep_id is null where no row of the
    group has one.  Of rows that share both text and the largest doc_id, exactly one is kept.  Other
    columns are ignored; an empty table gives no rows.  Joins on a hot name are plain exchanges, whose
    skewed partitions Spark splits (spark.sql.adaptive.skewJoin.enabled).  The result is one checkpoint.
    """
    rows = text_names(docs)
    groups = settle(rows.groupBy("n", "name").agg(F.max(F.struct("doc_id", "row")).alias("w"), F.count("*").alias("group_size")))
    found = rows.join(groups, ["n", "name"]).select("doc_id", F.col("w.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("w.row")).alias("kept"), F.col("digest").alias("text_sha256"))
    found = settle(found)
    discard(rows, groups)
    return found
