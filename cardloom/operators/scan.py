"""Running sums and last values over keys of any size, by a segmented prefix scan.

A window puts all rows of a key into one task.  Here rows are dealt to range partitions by (key, order), so a
hot key lies in many of them; each partition runs its own windows, leaves one row of totals for each key
that it holds, and gets back what the partitions before it carry over for that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.settling import settle


def scanned(rows: DataFrame, partition: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with more columns: sums, of the rows before each row, and lasts, the last value that isn't null up to and with it.

    Rows are taken by partition (none: all rows are one) in order, nulls first.  Rows that tie in both come in
    any order, but stay together.  A sum that has no rows before it is 0, or null where its values are never numbers.
    Column names that begin with `scan_` are used inside.

    Dealing the rows is a job that runs when this is called.  It leaves a checkpoint that the result reads,
    since the numbers of the partitions must be the same for the totals and the rows.
    """
    sums, lasts = sums or {}, lasts or {}
    given = {**{k: c for k, c in sums.items()}, **lasts}
    dealt = rows.select("*", *[c.alias(f"scan_{k}") for k, c in given.items()]).repartitionByRange(*partition, *order)
    dealt = settle(dealt.withColumn("scan_part", F.spark_partition_id()))
    of = dealt.schema
    at = F.struct(*[F.col(c).isNotNull() for c in order], *[F.col(c) for c in order])  # orders as the windows do
    last = lambda k: F.max_by(F.col(f"scan_{k}"), F.when(F.col(f"scan_{k}").isNotNull(), at))
    totals = dealt.groupBy(*partition, "scan_part").agg(*[F.sum(f"scan_{k}").alias(f"scan_of_{k}") for k in sums], *[last(k).alias(f"scan_of_{k}") for k in lasts])
    # As many rows of a key as partitions hold it.
    before = Window.partitionBy(*partition).orderBy("scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"scan_of_{k}").over(before).alias(f"scan_of_{k}") for k in sums] + [F.last(f"scan_of_{k}", True).over(before).alias(f"scan_of_{k}") for k in lasts]
    carried = totals.select(*[F.col(c).alias(f"scan_by_{c}") for c in partition], "scan_part", *carried)
    same = [F.col(c).eqNullSafe(F.col(f"scan_by_{c}")) for c in partition]
    inner = Window.partitionBy("scan_part", *partition).orderBy(*order)
    zero = {k: F.lit(0).cast(of[f"scan_{k}"].dataType) for k in sums}
    mine = [F.coalesce(F.sum(f"scan_{k}").over(inner.rowsBetween(Window.unboundedPreceding, -1)), zero[k]).alias(f"scan_{k}") for k in sums]
    mine += [F.last(f"scan_{k}", True).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias(f"scan_{k}") for k in lasts]
    kept = [f"`{c}`" for c in rows.columns if c not in given]
    found = dealt.select(*kept, F.col("scan_part").alias("scan_here"), *mine)
    on = F.col("scan_here") == F.col("scan_part")
    for s in same:
        on = on & s
    out = [(F.col(f"scan_{k}") + F.coalesce(F.col(f"scan_of_{k}"), zero[k])).alias(k) for k in sums]
    out += [F.coalesce(f"scan_{k}", f"scan_of_{k}").alias(k) for k in lasts]
    return found.join(carried, on).select(*kept, *out)


def numbered_rows(rows: DataFrame, out: str, partition: list[str], order: list[str]) -> DataFrame:
    """W5 over keys of any size: the place of each row in its key, from 0."""
    return scanned(rows, partition, order, sums={out: F.lit(1).cast("long")})
