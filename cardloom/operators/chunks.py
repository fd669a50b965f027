"""Greedy packing of paragraphs, as folds that carry boundaries and never growing strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import estimated_tokens, let, stripped

#: Tokens of a chunk and characters of a section, unless the caller says otherwise.
TOKEN_LIMIT, SECTION_CHARS = 150_000, 30_000
STATE = "struct<done:array<struct<a:int,b:int>>,start:int,used:long>"


def _ranges(sizes: Column, limit: int, separator: int) -> Column:
    """Runs [a, b) of paragraphs that go together; b = -1 for a paragraph above the limit on its own.

    What a separator costs is settled before a run closes, so the first paragraph after that still pays it.
    """
    items = F.transform(sizes, lambda s, i: F.struct(s.cast("long").alias("size"), i.cast("int").alias("i")))
    begin = F.from_json(F.lit('{"done":[],"start":-1,"used":0}'), STATE)
    pair = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))

    def step(acc: Column, x: Column) -> Column:
        open_ = acc["start"] >= 0
        extra = F.when(open_, F.lit(separator)).otherwise(F.lit(0)).cast("long")
        close = open_ & (acc["used"] + extra + x["size"] > limit)
        goes_on = open_ & ~close
        done = F.when(close, F.concat(acc["done"], pair(acc["start"], x["i"]))).otherwise(acc["done"])
        used = F.when(close, F.lit(0).cast("long")).otherwise(acc["used"])
        alone = (x["size"] > limit) & ~goes_on
        return F.struct(
            F.when(alone, F.concat(done, pair(x["i"], F.lit(-1)))).otherwise(done).alias("done"),
            F.when(alone, F.lit(-1)).when(goes_on, acc["start"]).otherwise(x["i"]).cast("int").alias("start"),
            F.when(alone, used).otherwise(used + extra + x["size"]).cast("long").alias("used"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["start"] >= 0, F.concat(acc["done"], pair(acc["start"], F.size(sizes)))).otherwise(acc["done"])

    return F.aggregate(items, begin, step, finish)


def _cut(paragraphs: Column, ranges: Column, width) -> Column:
    """The text of each range; a paragraph on its own is sliced every width(paragraph) characters."""

    def slices(p: Column) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(0), ((F.length(p) - 1) / w).cast("int")), lambda k: F.substring(p, (k * w + 1).cast("int"), w.cast("int")))
        return let(width(p), cut)

    def texts(r: Column) -> Column:
        together = F.array(F.array_join(F.slice(paragraphs, r["a"] + 1, F.greatest(F.lit(1), r["b"] - r["a"])), "\n\n"))
        return F.when(r["b"] < 0, let(F.get(paragraphs, r["a"]), slices)).otherwise(together)

    return F.flatten(F.transform(ranges, texts))


def _packed(text: Column, size, limit: int, separator: int, width) -> Column:
    """The paragraphs of a text packed by size(paragraph)."""
    cut = lambda p: let(F.transform(p, size), lambda n: _cut(p, _ranges(n, limit, separator), width))
    return let(F.split(text, "\n\n", -1), cut)


def split_into_chunks(text: Column, token_limit: int = TOKEN_LIMIT) -> Column:
    """The text in chunks of at most token_limit estimated tokens, cut between paragraphs where it can be."""
    if token_limit <= 0:
        raise ValueError(f"token_limit must be positive, not {token_limit}")
    # int(limit * (length / tokens)), as doubles
    width = lambda p: F.greatest(F.lit(1), (F.lit(float(token_limit)) * (F.length(p) / estimated_tokens(p).cast("double"))).cast("int"))
    none = F.array().cast("array<string>")

    def chunks(whole: Column) -> Column:
        many = _packed(whole, estimated_tokens, token_limit, 1, width)
        return F.when(whole == "", none).when(estimated_tokens(whole) <= token_limit, F.array(whole)).otherwise(many)

    return let(stripped(text), chunks)


def split_section(text: Column, max_chars: int = SECTION_CHARS) -> Column:
    """A section's text in parts of at most max_chars characters; the text itself if one is enough."""
    many = _packed(text, F.length, max_chars, 2, lambda p: F.lit(max_chars))
    whole = F.array(text)
    return F.when(F.length(text) <= max_chars, whole).otherwise(let(many, lambda parts: F.when(F.size(parts) <= 1, whole).otherwise(parts)))


def numbered(parts: Column) -> Column:
    """Each part as (part_text, n_parts)."""
    return let(parts, lambda p: F.transform(p, lambda t: F.struct(t.alias("part_text"), F.size(p).alias("n_parts"))))


def chunk_rows(docs: DataFrame, key: str, text: str = "text", token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """key, chunk_idx, chunk, tokens: one row for each chunk."""
    rows = docs.select(key, F.posexplode(split_into_chunks(F.col(text), token_limit)).alias("chunk_idx", "chunk"))
    return rows.withColumn("tokens", estimated_tokens(F.col("chunk")))
