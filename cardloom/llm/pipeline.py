"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one keeps is written and read again
as the next one's docs.  All but the last return the columns of documents, extra ones included.  Null
and empty texts are documents like any other: the classifier scores them, one of each group of copies
stays, and packing gives them their end id.  An empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm import packing, quality, secret_scan
from cardloom.llm.common import lean, lower_ascii, remove, text_of, under, work_path
from cardloom.llm.exact_dedup import exact_duplicates
from cardloom.llm.near_texts import similar_texts
from cardloom.llm.queries import TOKENIZER, table
from cardloom.llm.simhash import text_hash

#: Python gets so many bytes at a time: a batch takes memory in the executor and in its worker, and a worker lives through all stages.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m"}
#: Slots of the packing worker's table of pieces, as a power of two.
BITS = 19


def _row_key(digest: Column) -> Column:
    """Tells rows apart, also where doc_ids repeat or are null."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest.cast("string"))


def _only(docs: DataFrame, digest: Column, winners: DataFrame) -> DataFrame:
    """The rows of docs with the keys of winners (doc_id, digest), one for each key."""
    rows = docs.select(_row_key(digest).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(winners.select(_row_key(F.col("digest")).alias("key")).distinct(), "key")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    return kept.withColumn("turn", turn).where("turn = 1").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not reject.

    Null texts are scored as empty ones; rows that repeat share a score; other columns stay as they are.
    """
    docs = under(docs, BATCHES)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scored(F.col("text"), model) >= 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id.

    Null texts count as empty, a null doc_id as the least; of rows that repeat one stays.
    """
    kept = exact_duplicates(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return _only(docs, F.sha2(lower_ascii(text_of()), 256), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the document with the smallest doc_id.

    Texts without words, null ones included, are one group; a null doc_id comes last, ties go to the
    least digest of the text; of rows that repeat one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    docs = under(docs, BATCHES)
    least = similar_texts(docs).groupBy("component").agg(F.min(order).alias("w"))
    return _only(docs, text_hash(), least.select("w.doc_id", "w.digest"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by their kinds; n_chars follows where the text changed.  Null texts stay null."""
    hidden = secret_scan.redacted(F.col("text"))
    rows = under(docs, BATCHES).withColumn("text", F.struct(F.col("text").alias("old"), hidden.alias("new")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text.old").eqNullSafe(F.col("text.new"))
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text.new").cast("long")).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.col("text.new"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, empty and null texts included, in sequences of at most 1024 tokens."""
    return packing.pack(under(docs, BATCHES), TOKENIZER, bits=BITS)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the fingerprints; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again.

    A stage's rows go when the next one's are written; the result reads those of the last but one.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        lean(stage(spark, docs, sf_dir)).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
