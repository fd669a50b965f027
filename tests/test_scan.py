"""Prefix scans and streams of spending, against windows."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cardloom.operators import ledger, scan
from cardloom.operators.sections import heading_trail
from cardloom.streaming import spending


def hot_rows(spark, n=4000, parts=16):
    """One key holds nine rows of ten; another is null."""
    key = F.when(F.col("id") % 10 < 9, F.lit(0)).when(F.col("id") % 3 > 0, F.col("id") % 7)
    mixed = F.xxhash64("id")
    value = F.when(mixed % 5 > 0, (mixed % 100).cast("long"))
    return spark.range(0, n, 1, parts).select(key.cast("long").alias("k"), (F.pmod(mixed, F.lit(10**9))).alias("o"), "id", value.alias("v"), F.lit("kept").alias("scan"))


@pytest.mark.parametrize("partition", [["k"], []])
def test_scan_equals_the_window(spark, partition):
    rows = hot_rows(spark)
    before = Window.partitionBy(*partition).orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"), F.last("v", True).over(upto).alias("l"), (F.row_number().over(before.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("n"))
    got = scan.scanned(rows, partition, ["o", "id"], sums={"s": F.col("v"), "n": F.lit(1).cast("long")}, lasts={"l": F.col("v")})
    assert got.columns == [*rows.columns, "s", "n", "l"]
    assert sorted(map(tuple, got.select("id", "s", "l", "n").collect())) == sorted(map(tuple, want.collect()))


def test_a_hot_key_lies_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would be one task's
    try:
        got = scan.numbered_rows(hot_rows(spark), "n", ["k"], ["o", "id"]).where("k = 0")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    assert scan.numbered_rows(hot_rows(spark).where("false"), "n", ["k"], ["o"]).count() == 0


def test_trail_of_headings_over_a_hot_key(spark):
    rows = hot_rows(spark).select("k", "o", "id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int").alias("level"), F.concat(F.lit("h"), "id").alias("heading"), F.lit("t").alias("title"))
    plain = {r.id: r.breadcrumb for r in heading_trail(rows, "k", "o").collect()}
    assert {r.id: r.breadcrumb for r in heading_trail(rows, "k", "o", spread=True).collect()} == plain and len(plain) == 4000


def finished(query):
    query.processAllAvailable()
    query.stop()
    query.awaitTermination()


@pytest.fixture
def stateful(spark):
    for name, value in spending.STATE.items():
        spark.conf.set(name, value)
    yield spark
    for name in spending.STATE:
        spark.conf.unset(name)


def test_streamed_budget_is_the_table_s_also_after_a_restart(stateful, tmp_path):
    spark, rnd = stateful, random.Random(1)
    schema = "key long, id long, ts timestamp, cost_usd double"
    start = 1_700_000_000
    rows = [(rnd.randrange(3), k, float(start + 10 * k + rnd.randrange(300)), rnd.randrange(20) / 16) for k in range(200)]
    rows.append((9, 1000, float(start + 100_000), 0.0))  # moves the watermark on
    table = spark.createDataFrame(rows, "key long, id long, at double, cost_usd double").select("key", "id", F.col("at").cast("timestamp").alias("ts"), "cost_usd").cache()
    want = ledger.budget_gate(table.where("key < 9"), ["ts", "id"], budget=30.0, partition=["key"])
    want = sorted((r.key, r.id, r.spent_before, r.allowed, r.warns) for r in want.collect())

    def put(rows, name):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    got = []
    for low, high in ((0, 90), (90, 201)):  # the second query begins from the first one's checkpoint
        put(table.where((F.col("id") >= low) & (F.col("id") < high) | (F.col("id") == 1000) & F.lit(high == 201)), high)
        calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        gate = spending.stream_budget_gate(calls, budget=30.0, late="10 minutes")
        finished(gate.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).where("key < 9")
    assert sorted((r.key, r.id, r.spent_before, r.allowed, r.warns) for r in got.collect()) == want
    assert sum(w for *_, w in want) == 3 and not all(a for *_, a, _ in want)
    table.unpersist()


def test_streamed_card_cap_is_the_table_s_also_after_a_restart(stateful, tmp_path):
    spark, rnd = stateful, random.Random(2)
    rows = [(c, t, rnd.randrange(30)) for c in range(6) for t in range(9)]
    rnd.shuffle(rows)
    schema = "key long, turn long, n_cards long"
    want = ledger.card_cap_gate(spark.createDataFrame(rows, schema), ["turn"], ["key"])
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        capped = spending.stream_card_cap(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        finished(capped.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out"))
    columns = ["key", "turn", "cards_before", "allowed"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_batches_are_polled_until_they_end_or_time_is_up(stateful, tmp_path):
    spark, seen = stateful, str(tmp_path)

    def status(batch_id):
        with open(f"{seen}/{batch_id}.seen", "a+") as f:
            f.write("x")
            f.seek(0)
            return "ended" if batch_id == "soon" and len(f.read()) >= 3 else "running"

    spark.createDataFrame([("soon",), ("never",)], "batch_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    found = spending.stream_batches(spark.readStream.schema("batch_id string").parquet(str(tmp_path / "in")), status, every=0.2, timeout=10)
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
    until, rows = time.time() + 60, {}
    while time.time() < until:
        time.sleep(1)
        try:
            rows = {r.batch_id: r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        except Exception:  # no file yet
            continue
        if len(rows) == 2:
            break
    failed = query.exception()
    query.stop()
    assert failed is None and rows == {"soon": "ended", "never": "timeout"}
    assert len((tmp_path / "soon.seen").read_text()) == 3
