"""A content-addressed cache of loaded documents in a Parquet table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cardloom.settling import remove, settle

HASH = r"^[0-9a-f]{64}$"


def valid_hash(column: str):
    """K12."""
    return F.col(column).rlike(HASH)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _recover(spark: SparkSession, path: str) -> None:
    """Finishes an invalidate() that broke off after it had put the old table aside: by then the new one was whole."""
    at, store = _store(spark, path)
    if not store.exists(at(path)) and store.exists(at(f"{path}-next/_SUCCESS")) and store.exists(at(f"{path}-old")):
        store.rename(at(f"{path}-next"), at(path))
    if store.exists(at(path)) and store.exists(at(f"{path}-old")):
        store.delete(at(f"{path}-old"), True)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if there is none; entries whose key is no hash are left out, files that can't be read are misses."""
    _recover(spark, path.rstrip("/"))
    try:
        return spark.read.option("ignoreCorruptFiles", "true").parquet(path).where(valid_hash("cache_key"))
    except AnalysisException:
        return None


def cache_key(by_settings: bool = False, **settings) -> Callable:
    """The content's hash alone, so a renamed file gets the old entry; by_settings adds the settings to it."""
    tail = "|".join(f"{k}={settings[k]}" for k in sorted(settings))
    return lambda h: F.sha2(F.concat(h, F.lit("|" + tail)), 256) if by_settings else h


def load_with_cache(files: DataFrame, path: str, load: Callable[[DataFrame], DataFrame], key: Callable = lambda h: h, enabled: bool = True) -> DataFrame:
    """Cached documents for the files that have an entry, loaded ones for the rest.

    What loads without an error is added to the cache; a file that fails stays in the result with its
    error, and is tried again next time.  Files are loaded once: into a folder beside the cache, which goes when
    its rows are in the cache, and the failed ones in a checkpoint.
    """
    if not enabled:
        return load(files)
    spark = files.sparkSession
    keyed = files.withColumn("cache_key", key(F.sha2("content", 256)))
    known = read_cache(spark, path)
    missing = keyed.drop("cache_key") if known is None else cache_misses(keyed, known).drop("cache_key")
    fresh = f"{path.rstrip('/')}-loaded/{uuid.uuid4().hex}"
    load(missing).write.parquet(fresh)
    loaded = spark.read.parquet(fresh).withColumn("cache_key", key(F.col("content_hash")))
    loaded.where("error IS NULL").dropDuplicates(["cache_key"]).write.mode("append").parquet(path)
    cached = keyed.select("cache_key").join(read_cache(spark, path), "cache_key")
    failed = settle(loaded.where("error IS NOT NULL"))
    remove(spark, fresh)
    return cached.unionByName(failed).drop("cache_key")


def cache_misses(keyed: DataFrame, known: DataFrame, column: str = "cache_key") -> DataFrame:
    """Rows without an entry."""
    return keyed.join(known.select(column), column, "left_anti")


def invalidate(spark: SparkSession, path: str, key: str | None = None) -> int:
    """Removes one entry or all; how many there were.

    The rest is written beside the table, which is put aside before the rest takes its place, both by renaming.  A
    failure leaves the old table or all of the new one, which the next read_cache() then moves to its place.
    """
    path = path.rstrip("/")
    known = read_cache(spark, path)
    if known is None:
        return 0
    before = known.count()
    rest = known.where(F.lit(False)) if key is None else known.where(F.col("cache_key") != key)
    rest.write.mode("overwrite").parquet(f"{path}-next")
    left = spark.read.parquet(f"{path}-next").count()
    at, store = _store(spark, path)
    for source, target in ((path, f"{path}-old"), (f"{path}-next", path)):
        if not store.rename(at(source), at(target)):
            raise OSError(f"{source} could not be renamed to {target}")
    store.delete(at(f"{path}-old"), True)
    spark.catalog.refreshByPath(path)
    return before - left
