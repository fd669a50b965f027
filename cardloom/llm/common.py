"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.settling import discard, lean, remove, settle, shared_dir, under, work_path

__all__ = ["SPACES", "STEP", "WORD", "discard", "lean", "lower_ascii", "remove", "settle", "shared_dir", "steps", "text_of", "under", "work_path"]

#: Bytes that separate words: space and U+0009 to U+000D.  Python's bytes.split() uses the same six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a long text that a worker takes at a time.
STEP = 1 << 21


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def steps(data: bytes, mark: re.Pattern[bytes]) -> Iterator[bytes]:
    """Data in stretches of STEP bytes and as many more as lie before a mark, with which the next one begins."""
    at = 0
    while at < len(data):
        found = mark.search(data, at + STEP)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end
