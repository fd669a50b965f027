"""Text normalisation and sizing as column expressions.

Regular expressions follow Python's idea of lines and white space: (?U) makes \\s and \\d Unicode-aware
and (?d) keeps \\n as the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as CJK when sizes are estimated (no Hangul).
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
# Characters for each token.
CJK_PER_TOKEN, OTHER_PER_TOKEN = 2.5, 4.0
# Control characters that are removed; tab, newline and carriage return stay.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any kind, U+3000 included, at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def preprocessed(text: Column) -> Column:
    """no control characters, runs of blank lines become one, both ends stripped."""
    return stripped(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"(?U)\n\s*\n(\s*\n)+", "\n\n"))


def cjk_count(text: Column) -> Column:
    """How many characters are CJK: runs of them are cut out, so other texts are only read through."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]+", ""))


def is_cjk(char: Column) -> Column:
    """F2 for a single character."""
    return char.rlike(rf"\A[{CJK}]\z")


def estimated_tokens(text: Column) -> Column:
    """characters over the characters for each token, summed, then cut to an int."""
    cjk = cjk_count(text)
    return (cjk / F.lit(CJK_PER_TOKEN) + (F.length(text) - cjk) / F.lit(OTHER_PER_TOKEN)).cast("int")


def breadcrumb(parts: Column) -> Column:
    """F6."""
    return F.array_join(parts, " > ")


def image_base64(data: Column) -> Column:
    """base64 in one line, empty for no bytes."""
    return F.coalesce(F.regexp_replace(F.base64(data), r"[\r\n]", ""), F.lit(""))


def image_tokens(width: Column, height: Column) -> Column:
    """one token for each 750 pixels."""
    return F.floor(width.cast("long") * height.cast("long") / F.lit(750)).cast("long")


def image_scale(width: Column, height: Column, long_edge: int = 1568, pixels: float = 1.15e6) -> Column:
    """By how much an image shrinks before it is sent; 1 if it fits."""
    edge = F.greatest(width, height).cast("double")
    area = width.cast("double") * height.cast("double")
    by_edge = F.when(edge > long_edge, F.lit(float(long_edge)) / edge).otherwise(F.lit(1.0))
    by_area = F.when(area > pixels, F.sqrt(F.lit(pixels) / area)).otherwise(F.lit(1.0))
    return F.least(by_edge, by_area)


def shortened(text: Column, size: int = 100) -> Column:
    """The first characters."""
    return F.substring(text, 1, size)


def parse_csv_option(value: str | None) -> list[str] | None:
    """items between commas, trimmed; empty ones stay."""
    return None if value is None else [x.strip() for x in value.split(",")]
