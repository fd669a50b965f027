"""Card quality in six dimensions, as column expressions over a card's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.schemas import WEIGHTS

# Patterns that the rules look for.
QUESTION = r"[？?]"
CLOZE = r"(?U)\{\{c\d+::"
LIST = r"(?U)(?:\d+[.、．]|[・\-*])\s*\S.*(?:\n|\s+)(?:\d+[.、．]|[・\-*])\s*\S"
ENUMERATION = r"(?:挙げ|列挙|リスト|すべて|全て|3つ|三つ|4つ|四つ|5つ|五つ)"
SENTENCE_END = r"(?U)[。．.！!]\s*"
CONNECTIVE = r"(?:また[、,]|さらに|加えて|そして|および|ならびに)"
COMPARISON = r"(?:違い|比較|差|differ|compar)"
ORDER = r"(?:次|後|ステップ|step|after|before)"
# Lengths that the rules compare with.
FRONT_MIN, FRONT_MAX, BACK_MIN, BACK_MAX, BACK_GOOD = 10, 200, 5, 200, 10


def _d(x: float) -> Column:
    return F.lit(float(x))


def front_quality(front: Column, card_type: Column) -> Column:
    """Q1."""
    size = F.length(front)
    cloze = F.when(front.rlike(CLOZE), F.when(size >= FRONT_MIN, _d(1.0)).otherwise(_d(0.7))).otherwise(_d(0.4))
    term = F.when(size <= 80, _d(1.0)).otherwise(_d(0.8))
    asked = F.when(front.rlike(QUESTION), _d(0.7) + _d(0.2)).otherwise(_d(0.7))
    sized = F.when(size <= FRONT_MAX, asked + _d(0.1)).otherwise(asked - _d(0.1))
    other = F.when(size < FRONT_MIN, F.greatest(_d(0.3), size / _d(FRONT_MIN) * _d(0.6))).otherwise(F.least(_d(1.0), F.greatest(_d(0.0), sized)))
    return F.when(card_type == "cloze", cloze).when(card_type.isin("reversible", "term_definition") & (size >= 1), term).otherwise(other)


def back_quality(back: Column, card_type: Column) -> Column:
    """Q2."""
    size = F.length(back)
    long = F.greatest(_d(0.2), _d(0.7) - F.least(_d(0.5), (size - BACK_MAX) / _d(200)))
    other = F.when(size == 0, _d(0.0)).when(size < BACK_MIN, _d(0.4)).when(size > BACK_MAX, long).when(size >= BACK_GOOD, _d(1.0)).otherwise(_d(0.7))
    return F.when(card_type == "cloze", F.when(size == 0, _d(1.0)).otherwise(_d(0.8))).otherwise(other)


def card_type_fit(front: Column, back: Column, card_type: Column) -> Column:
    """Q3."""
    one_or = lambda good, rest: F.when(good, _d(1.0)).otherwise(_d(rest))
    marked, filled, size = front.rlike(CLOZE), F.length(back) > 0, F.length(front)
    return (
        F.when(card_type == "cloze", one_or(marked, 0.3))
        .when(card_type.isin("qa", "summary_point"), one_or(~marked, 0.5))
        .when(card_type == "term_definition", one_or((size <= 50) & filled, 0.7))
        .when(card_type == "reversible", one_or((size <= 80) & filled, 0.7))
        .when(card_type == "compare_contrast", one_or(front.rlike(COMPARISON), 0.7))
        .when(card_type == "sequence", one_or(front.rlike(ORDER), 0.7))
        .otherwise(_d(0.8))
    )


def bloom_level_fit() -> Column:
    """Q4."""
    return _d(0.9)


def tags_quality(tags: Column) -> Column:
    """Q5."""
    nested = F.when(F.exists(tags, lambda t: F.contains(t, F.lit("::"))), _d(0.5) + _d(0.3)).otherwise(_d(0.5))
    score = F.when(F.size(tags) >= 2, nested + _d(0.2)).otherwise(nested)
    return F.when(F.size(tags) == 0, _d(0.0)).otherwise(F.least(_d(1.0), score))


def sentences(back: Column) -> Column:
    """Pieces between sentence ends, blank ones left out; at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(back, SENTENCE_END, -1), lambda s: s.rlike(r"(?U)\S"))))


def atomicity(front: Column, back: Column, card_type: Column) -> Column:
    """Q6."""
    n_cloze, n = F.regexp_count(front, F.lit(CLOZE)), sentences(back)
    cloze = F.when(n_cloze <= 3, _d(1.0)).otherwise(F.greatest(_d(0.5), _d(1.0) - (n_cloze - 3) * _d(0.1)))
    many = F.greatest(_d(0.3), _d(1.0) - n * _d(0.15))
    many = F.when(back.rlike(CONNECTIVE), F.greatest(_d(0.2), many - _d(0.15))).otherwise(many)
    other = F.when(F.length(back) == 0, _d(0.9)).when(n <= 1, _d(1.0)).when(n == 2, _d(0.8)).when(n == 3, _d(0.6)).otherwise(many)
    return F.when(card_type == "cloze", cloze).otherwise(other)


def flags(front: Column, back: Column, card_type: Column, front_score: Column) -> Column:
    """Q7: the flags in their order."""
    vague = ~card_type.isin("cloze", "reversible", "term_definition") & ((F.length(front) < FRONT_MIN) | (~front.rlike(QUESTION) & (front_score < 0.7)))
    listed = card_type.isin("qa", "summary_point") & (back.rlike(LIST) | front.rlike(ENUMERATION))
    named = [(vague, "vague_question"), (F.length(back) > BACK_MAX, "too_long_answer"), (listed, "list_not_cloze")]
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in named]), lambda x: x.isNotNull())


def weighted_total(scores: dict[str, Column]) -> Column:
    """summed from left to right, so doubles come out as they would one by one."""
    total = None
    for name, weight in WEIGHTS.items():
        part = scores[name] * F.lit(weight)
        total = part if total is None else total + part
    return total


def dimensions(front: Column, back: Column, card_type: Column, tags: Column) -> dict[str, Column]:
    """Q1 to Q6 by name."""
    return {
        "front_quality": front_quality(front, card_type),
        "back_quality": back_quality(back, card_type),
        "card_type_fit": card_type_fit(front, back, card_type),
        "bloom_level_fit": bloom_level_fit(),
        "tags_quality": tags_quality(tags),
        "atomicity": atomicity(front, back, card_type),
    }
