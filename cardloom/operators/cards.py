"""Model responses to validated cards, and cards to quality scores."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import scoring
from cardloom.functions.text import stripped
from cardloom.schemas import BLOOM_LEVELS, CARD_FIELDS, CARD_TYPES, WEIGHTS

# Fixed value: a block between triple backticks, which may be tagged json.
FENCE = r"(?sU)```(?:json)?\s*\n?(.*?)\n?```"


def json_body(response: Column) -> Column:
    """The first fenced block of a response, or all of it."""
    whole = stripped(response)
    return F.when(whole.rlike(FENCE), stripped(F.regexp_extract(whole, FENCE, 1))).otherwise(whole)


def parse_status(body: Column) -> Column:
    """ok, invalid_json or not_array.

    The parser stops after the first value, so what follows it is found by parsing the body once more
    inside an array and inside an object: no text closes both early.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull()
    parsed = F.try_parse_json(body)
    return F.when(parsed.isNull() | ~alone, "invalid_json").when(~F.schema_of_variant(parsed).startswith("ARRAY"), "not_array").otherwise("ok")


def elements(body: Column) -> Column:
    """The elements of a JSON array as variants; null unless parse_status() is ok."""
    return F.when(parse_status(body) == "ok", F.from_json(body, "array<variant>"))


def _kind(item: str, field: str) -> str:
    return f"schema_of_variant(try_variant_get({item}, '$.{field}', 'variant'))"


def _strings(item: str, field: str) -> str:
    return f"try_variant_get({item}, '$.{field}', 'array<string>')"


def is_card(item: str) -> Column:
    """C11: whether a variant column holds a valid card; keys beyond a card's are ignored."""

    def text(field: str) -> str:
        return f"{_kind(item, field)} <=> 'STRING'"

    def listed(field: str) -> str:
        got = _strings(item, field)
        empty = f"({_kind(item, field)} <=> 'ARRAY<VOID>' AND size({got}) = 0)"
        return f"({empty} OR ({_kind(item, field)} <=> 'ARRAY<STRING>' AND NOT exists({got}, x -> x IS NULL)))"

    def one_of(field: str, values: tuple[str, ...]) -> str:
        names = ", ".join(f"'{v}'" for v in values)
        return f"({text(field)} AND try_variant_get({item}, '$.{field}', 'string') IN ({names}))"

    rules = [
        f"schema_of_variant({item}) LIKE 'OBJECT%'",
        f"({text('front')} AND length(try_variant_get({item}, '$.front', 'string')) >= 1)",
        f"({_kind(item, 'back')} IS NULL OR {text('back')})",
        one_of("card_type", CARD_TYPES),
        one_of("bloom_level", BLOOM_LEVELS),
        f"({listed('tags')} AND size({_strings(item, 'tags')}) >= 1)",
        f"({_kind(item, 'related_concepts')} IS NULL OR {listed('related_concepts')})",
        f"({_kind(item, 'media')} IS NULL OR {listed('media')})",
        f"({_kind(item, 'mnemonic_hint')} IS NULL OR {_kind(item, 'mnemonic_hint')} = 'VOID' OR {text('mnemonic_hint')})",
    ]
    return F.coalesce(F.expr(" AND ".join(f"({r})" for r in rules)), F.lit(False))


def card_fields(item: str) -> list[Column]:
    """The columns of a valid card."""
    one = lambda f: F.expr(f"try_variant_get({item}, '$.{f}', 'string')")
    many = lambda f: F.coalesce(F.expr(_strings(item, f)), F.array().cast("array<string>"))
    return [
        one("front").alias("front"),
        F.coalesce(one("back"), F.lit("")).alias("back"),
        one("card_type").alias("card_type"),
        one("bloom_level").alias("bloom_level"),
        many("tags").alias("tags"),
        many("related_concepts").alias("related_concepts"),
        one("mnemonic_hint").alias("mnemonic_hint"),
        many("media").alias("media"),
    ]


WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
FENCED = re.compile(FENCE.replace("(?sU)", "(?s)").replace(r"\s*", WHITE))
ENDS = re.compile(rf"\A{WHITE}|{WHITE}\Z")


def _refused(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


def _object(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key that repeats")
    return found


def count_valid(response: str) -> int:
    """How many valid cards a response holds.

    The rules of parse_responses(), for a task that calls a provider and must know at once.
    """
    whole = ENDS.sub("", response)
    fenced = FENCED.search(whole)
    try:
        items = json.loads(ENDS.sub("", fenced.group(1)) if fenced else whole, parse_constant=_refused, object_pairs_hook=_object)
    except (ValueError, RecursionError):
        return 0
    listed = lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x)

    def valid(c: object) -> bool:
        if not isinstance(c, dict) or not isinstance(c.get("front"), str) or not isinstance(c.get("back", ""), str):
            return False
        if c.get("card_type") not in CARD_TYPES or c.get("bloom_level") not in BLOOM_LEVELS or not isinstance(c.get("mnemonic_hint"), str | None):
            return False
        return bool(c["front"] and c.get("tags") and listed(c["tags"]) and listed(c.get("related_concepts", [])) and listed(c.get("media", [])))

    return sum(map(valid, items)) if isinstance(items, list) else 0


def parse_responses(responses: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Keys, status, item_idx, valid and the card's columns, one row for each array element.

    A response that isn't a JSON array gives one row with its status and no item.  Invalid elements stay
    as rows with valid = false, so callers see the rejects.
    """
    body = responses.select(*keys, json_body(F.col(text)).alias("body"))
    rows = body.select(*keys, parse_status(F.col("body")).alias("status"), F.posexplode_outer(elements(F.col("body"))).alias("item_idx", "item"))
    rows = rows.withColumn("valid", F.col("item").isNotNull() & is_card("item"))
    return rows.select(*keys, "status", "item_idx", "valid", *card_fields("item"))


def valid_cards(parsed: DataFrame, *keys: str) -> DataFrame:
    """The valid cards, numbered anew within keys."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("item_idx")
    return parsed.where("valid").select(*keys, (F.row_number().over(w) - 1).alias("card_idx"), *CARD_FIELDS)


def score_cards(cards: DataFrame) -> DataFrame:
    """Q1 to Q8 without duplicates: the six dimensions, weighted_total and flags beside the card's columns."""
    dims = scoring.dimensions(F.col("front"), F.col("back"), F.col("card_type"), F.col("tags"))
    rows = cards.withColumns(dims)
    total = scoring.weighted_total({name: F.col(name) for name in WEIGHTS})
    return rows.withColumns({"weighted_total": total, "flags": scoring.flags(F.col("front"), F.col("back"), F.col("card_type"), F.col("front_quality"))})


def section_tagged(cards: DataFrame, section_id: str = "section_id") -> DataFrame:
    """The section's id as a tag."""
    return cards.withColumn("tags", F.array_append("tags", F.concat(F.lit("_section::"), F.col(section_id))))


def by_type(cards: DataFrame, card_type: str) -> DataFrame:
    """P6."""
    return cards.where(F.col("card_type") == card_type)


def by_bloom(cards: DataFrame, bloom_level: str) -> DataFrame:
    """P6."""
    return cards.where(F.col("bloom_level") == bloom_level)
