"""Set similarity of card texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that give bigram tokens (Hangul included) and those that separate tokens.
TOKEN_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
SEPARATORS = r"[\s\x{3000}\x{3001}\x{3002}\x{FF1F}?\x{FF01}!,.\-:\x{FF1A}]+"


def _pairs(text: Column) -> Column:
    """Substrings of two characters; none for a shorter text.  One pass: each match takes a character and looks at the next."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))."), 1)


def bigrams(text: Column) -> Column:
    """Q9: the set of two-character windows; a single character stands for itself."""
    short = F.when(F.length(text) == 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.length(text) >= 2, _pairs(text)).otherwise(short))


def tokens(text: Column) -> Column:
    """Q10: words of two characters or more, and bigrams over the text's CJK characters joined together."""
    words = F.filter(F.split(text, "(?U)" + SEPARATORS, -1), lambda w: F.length(w) >= 2)
    return F.array_union(words, _pairs(F.regexp_replace(text, f"[^{TOKEN_CJK}]", "")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two sets, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def keyword_similarity(keywords: Column, text: Column) -> Column:
    """Share of the keywords that the text contains; repeats count, no keywords give 0."""
    found = F.size(F.filter(keywords, lambda k: F.contains(text, k)))
    return F.when(F.size(keywords) == 0, F.lit(0.0)).otherwise(found / F.size(keywords).cast("double"))


def pair_score(front_keywords: Column, back_keywords: Column, wanted_type: Column, front: Column, back: Column, card_type: Column) -> Column:
    """Keywords in front and back, and the type where one is wanted."""
    f, b = keyword_similarity(front_keywords, front), keyword_similarity(back_keywords, back)
    bonus = F.when(card_type == wanted_type, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(wanted_type.isNotNull(), f * F.lit(0.4) + b * F.lit(0.4) + bonus * F.lit(0.2)).otherwise(f * F.lit(0.5) + b * F.lit(0.5))
