"""Documents from files: text, Markdown, and anything else through an injected converter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.text import preprocessed, stripped
from cardloom.operators.chunks import TOKEN_LIMIT, split_into_chunks

SUPPORTED = r"(?i)\.(pdf|txt|md)$"
#: Below so many characters a converted file counts as scanned.
OCR_BELOW = 50
LARGEST = 100 * 1024 * 1024


def supported(path: Column) -> Column:
    """P1."""
    return path.rlike(SUPPORTED)


def list_files(spark: SparkSession, path: str, largest: int | None = None, ordered: bool = True) -> DataFrame:
    """Path, length, content of the supported files of a folder (not of those below it) or of one file, by path.

    A folder without any, and a file of another kind, raise ValueError.  largest leaves out bigger files.
    Sorting moves the contents; large loads, whose plans order by ordinals of their own, pass ordered=False.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    files = files.where(supported(F.col("path")))
    if largest is not None:
        files = files.where(F.col("length") <= largest)
    if files.select("path").limit(1).isEmpty():
        raise ValueError(f"no supported file in {path}")
    files = files.select("path", "length", "content")
    return files.orderBy("path") if ordered else files


def content_hash(content: Column) -> Column:
    """S13."""
    return F.sha2(content, 256)


def needs_ocr(raw: Column, enabled: bool) -> Column:
    """S6."""
    return F.lit(enabled) & (F.length(stripped(raw)) < OCR_BELOW)


def load_documents(files: DataFrame, convert: Callable[[bytes, bool, str], str] | None = None, ocr: bool = False, ocr_lang: str = "jpn+eng", token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """source_path, file_type, used_ocr, content_hash, text, chunks, error.

    convert(content, with_ocr, language) turns any other file into Markdown.  Bytes that are not UTF-8 and
    files without a converter give an error in place of a text; no file stops the others.
    """
    kind = F.lower(F.regexp_extract("path", SUPPORTED, 1))
    rows = files.select(F.col("path").alias("source_path"), kind.alias("file_type"), content_hash(F.col("content")).alias("content_hash"), "content")
    plain = rows.where("file_type <> 'pdf'").withColumn("as_text", F.try_validate_utf8(F.col("content").cast("string")))
    plain = plain.select("source_path", "file_type", "content_hash", "as_text", F.lit(False).alias("used_ocr"), F.when(F.col("as_text").isNull(), F.concat(F.lit("not UTF-8: "), "source_path")).alias("error"))
    columns = "source_path string, file_type string, content_hash string, as_text string, used_ocr boolean, error string"

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                text, used, error = None, False, None
                if convert is None:
                    error = f"no converter for {r.source_path}"
                else:
                    try:
                        text = convert(bytes(r.content), False, ocr_lang)
                        if ocr and len(text.strip()) < OCR_BELOW:
                            text, used = convert(bytes(r.content), True, ocr_lang), True
                    except Exception as e:  # a converter's failure is that file's error
                        error = f"{type(e).__name__}: {e}"
                out.append((r.source_path, r.file_type, r.content_hash, text, used, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    converted = rows.where("file_type = 'pdf'").mapInPandas(run, columns)
    met = plain.unionByName(converted).withColumn("text", preprocessed(F.col("as_text")))
    return met.select("source_path", "file_type", "used_ocr", "content_hash", "text", split_into_chunks(F.col("text"), token_limit).alias("chunks"), "error")


def file_stem(path: Column) -> Column:
    """The title of a document: its file's name without the suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def stem(path: str) -> str:
    return PurePosixPath(path).stem
