"""Duplicate concepts: exact set-similarity joins of cards within a source.

Every rule asks for a similarity above some threshold between cards of one type or one set of tags.  For
each rule, cards meet that share an element among the rarest of their sets, as many as the threshold
leaves room for, if their sizes and the places of that element allow the similarity; then the rules
decide.  Elements are ranked by how many cards of the source have them, so hot ones come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.similarity import bigrams, jaccard, tokens
from cardloom.functions.text import let
from cardloom.settling import settle

# The thresholds of both tables.
#: The least similarity that any rule accepts, by the set that it compares.
FLOOR = {"f": 0.5, "t": 0.5, "b": 0.35}
#: What meets by which set, above which similarity: (set, threshold, same type, same tags).
MEETINGS = (("f", 0.7, True, False), ("t", 0.5, True, False), ("b", 0.4, True, False), ("f", 0.5, False, True), ("b", 0.35, True, True))


def _codes(grams: Column) -> Column:
    """A number for each set element of one or two characters, which compares faster than the string."""
    second = lambda g: F.when(F.length(g) > 1, F.ascii(F.substring(g, 2, 1)) + 1).otherwise(F.lit(0))
    return F.transform(grams, lambda g: F.ascii(g).cast("long") * (1 << 21) + second(g))


def featured(cards: DataFrame) -> DataFrame:
    """source_file, card_idx and what similarity needs."""
    return cards.select(
        "source_file",
        "card_idx",
        "card_type",
        F.array_sort(F.array_distinct("tags")).alias("tag_set"),
        (F.length("back") > 0).alias("has_back"),
        _codes(bigrams(F.col("front"))).alias("f"),
        tokens(F.col("front")).alias("t"),
        _codes(bigrams(F.col("back"))).alias("b"),
    )


def similar(a: str = "a", b: str = "b") -> Column:
    """Q11 over two aliased featured() frames: pairs of unlike type and tags fall out first, and each similarity is worked out once."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    typed, tagged = x("card_type") == y("card_type"), x("tag_set") == y("tag_set")
    both = typed & x("has_back") & y("has_back")
    # A similarity is at most the ratio of the sets' sizes, so most needn't be worked out.
    reach = lambda n: F.least(F.size(x(n)), F.size(y(n))) > F.greatest(F.size(x(n)), F.size(y(n))) * F.lit(FLOOR[n])
    sim = lambda n, needed: F.when(needed, jaccard(x(n), y(n))).otherwise(F.lit(0.0)).alias(n)
    sims = F.struct(sim("f", F.lit(True)), sim("t", typed & reach("t")), sim("b", both & reach("b")))
    rules = lambda s: (typed & (s["f"] > 0.7)) | (tagged & (s["f"] > 0.5)) | (typed & (s["t"] > 0.5)) | (both & (s["b"] > 0.4) & (s["f"] > 0.1)) | (both & tagged & (s["b"] > 0.35))
    return (typed | tagged) & let(sims, rules)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys in as many partitions as shuffles have: comparing costs far more than the rows weigh."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def similar_pairs(cards: DataFrame, indexed: bool = True) -> DataFrame:
    """source_file, i, j (i < j) of the pairs of cards that cover the same concept; without the index, by comparing all pairs."""
    return _indexed_pairs(cards) if indexed else _plain_pairs(cards)


def _plain_pairs(cards: DataFrame) -> DataFrame:
    rows = _spread(featured(_spread(cards, "source_file", "card_idx")), "source_file")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.source_file") == F.col("b.source_file")) & (F.col("a.card_idx") < F.col("b.card_idx")))
    return met.where(similar()).select(F.col("a.source_file").alias("source_file"), F.col("a.card_idx").alias("i"), F.col("b.card_idx").alias("j"))


def _rarest(rows: DataFrame) -> DataFrame:
    """source_file, card_idx, k (the meeting), key, h, n (size of the set), place (of the element, from 1) of the elements that must be shared."""

    def elements(k: int, name: str, typed: bool, tagged: bool) -> Column:
        key = F.xxhash64(F.lit(k), *([F.col("card_type")] if typed else []), *([F.col("tag_set")] if tagged else []))
        each = F.transform(name, lambda e: F.struct(F.lit(k).alias("k"), key.alias("key"), F.xxhash64(e).alias("h"), F.size(name).alias("n")))
        return F.when(F.col("has_back") | F.lit(name != "b"), each).otherwise(F.array().cast("array<struct<k:int,key:bigint,h:bigint,n:int>>"))

    listed = [elements(k, name, typed, tagged) for k, (name, _, typed, tagged) in enumerate(MEETINGS)]
    every = rows.select("source_file", "card_idx", F.explode(F.concat(*listed)).alias("e")).select("source_file", "card_idx", "e.*")
    shared = ["source_file", "k", "key", "h"]
    every = every.withColumn("times", F.count("*").over(Window.partitionBy(*shared)))
    w = Window.partitionBy("source_file", "card_idx", "k").orderBy("times", "h")
    ranked = every.withColumn("place", F.row_number().over(w))
    least = _by_meeting(lambda t: F.floor(F.col("n") * F.lit(t) + F.lit(1e-9)).cast("int"))
    return ranked.where((F.col("times") > 1) & (F.col("place") <= F.col("n") - least)).select(*shared, "card_idx", "n", "place")


def _by_meeting(value) -> Column:
    out = F.lit(None)
    for k, (_, threshold, _, _) in enumerate(MEETINGS):
        out = F.when(F.col("k") == k, value(threshold)).otherwise(out)
    return out


def _indexed_pairs(cards: DataFrame) -> DataFrame:
    rows = settle(featured(_spread(cards, "source_file", "card_idx")))  # read three times
    keys = _rarest(rows)
    other = keys.select("source_file", "k", "key", "h", F.col("card_idx").alias("j"), F.col("n").alias("m"), F.col("place").alias("there"))
    met = keys.withColumnRenamed("card_idx", "i").join(other, ["source_file", "k", "key", "h"]).where("i < j")
    # Sizes further apart than the threshold, or an element so late in both that too few can follow it, rule a pair out.
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("there")) + 1
    fits = _by_meeting(lambda t: (F.least("n", "m") > F.greatest("n", "m") * F.lit(t)) & (most * F.lit(1 + t) > (F.col("n") + F.col("m")) * F.lit(t)))
    near = _spread(met.where(fits).select("source_file", "i", "j").distinct(), "source_file", "i").alias("near")
    a, b = rows.alias("a"), rows.alias("b")
    met = near.join(a, (F.col("near.source_file") == F.col("a.source_file")) & (F.col("near.i") == F.col("a.card_idx")))
    met = met.join(b, (F.col("near.source_file") == F.col("b.source_file")) & (F.col("near.j") == F.col("b.card_idx")))
    return met.where(similar()).select("near.source_file", "near.i", "near.j")


def flag_duplicates(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q12: both members of a pair get the flag, once; scores and routing stay as they are."""
    members = pairs.select("source_file", F.explode(F.array("i", "j")).alias("card_idx")).distinct().withColumn("dup", F.lit(True))
    rows = scored.join(members, ["source_file", "card_idx"], "left")
    mark = F.col("dup").isNotNull() & ~F.array_contains("flags", "duplicate_concept")
    return rows.withColumn("flags", F.when(mark, F.array_append("flags", F.lit("duplicate_concept"))).otherwise(F.col("flags"))).drop("dup")
