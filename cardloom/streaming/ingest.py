"""The same transformations over a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.text import preprocessed
from cardloom.operators.ledger import with_cost
from cardloom.sources.files import content_hash, supported


def stream_documents(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Text and Markdown as they arrive: source_path, arrived, content_hash, text; a content seen within a day comes once.

    Files that need a converter go through load_documents() instead, as do those that aren't UTF-8.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(path)
    rows = files.where(supported(F.col("path")) & ~F.lower("path").endswith(".pdf")).select(F.col("path").alias("source_path"), F.col("modificationTime").alias("arrived"), content_hash(F.col("content")).alias("content_hash"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    once = rows.where("text IS NOT NULL").withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["content_hash"])
    return once.withColumn("text", preprocessed(F.col("text")))


def spending_by_window(usage: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Cost and calls of each window of a stream (or a table) of calls; calls later than `late` are left out of a stream."""
    rows = with_cost(usage).withWatermark(time, late)
    found = rows.groupBy(F.window(time, every).alias("w")).agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cost_usd", "calls")
