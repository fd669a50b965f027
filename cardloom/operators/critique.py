"""Threshold routing, the merge of critiques, and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.cards import card_fields, elements, is_card, json_body
from cardloom.schemas import CARD_FIELDS

THRESHOLD = 0.90
COUNTERS = ("total_cards", "passed_cards", "critiqued_cards", "removed_cards", "improved_cards", "split_cards", "final_card_count")


def route(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """P5: with a column passed; cards that fall short get low_idx, their index among those of the source."""
    rows = scored.withColumn("passed", F.col("weighted_total") >= F.lit(threshold))
    w = Window.partitionBy("source_file", "passed").orderBy("card_idx")
    return rows.withColumn("low_idx", F.when(~F.col("passed"), F.row_number().over(w) - 1))


def parse_reviews(responses: DataFrame, text: str = "text") -> DataFrame:
    """Q14: source_file, review_pos, review of the usable reviews; a response that isn't an array gives none."""
    rows = responses.select("source_file", F.posexplode(elements(json_body(F.col(text)))).alias("review_pos", "review"))
    index = "schema_of_variant(try_variant_get(review, '$.card_index', 'variant'))"
    rows = rows.where(F.expr("schema_of_variant(review) LIKE 'OBJECT%' AND schema_of_variant(try_variant_get(review, '$.action', 'variant')) IS NOT NULL"))
    # An index that isn't whole can't be used; JSON's true and false count as 1 and 0.
    rows = rows.where(F.expr(f"{index} IN ('BIGINT', 'BOOLEAN')"))
    card_index = F.expr(f"CASE WHEN {index} = 'BOOLEAN' THEN CAST(try_variant_get(review, '$.card_index', 'boolean') AS BIGINT) ELSE try_variant_get(review, '$.card_index', 'bigint') END")
    action = F.expr("CASE WHEN schema_of_variant(try_variant_get(review, '$.action', 'variant')) = 'STRING' THEN try_variant_get(review, '$.action', 'string') END")
    listed = F.expr("schema_of_variant(try_variant_get(review, '$.improved_cards', 'variant')) LIKE 'ARRAY%'")
    improved = F.expr("try_variant_get(review, '$.improved_cards', 'array<variant>')")
    return rows.select("source_file", "review_pos", card_index.alias("card_index"), action.alias("action"), F.when(listed, improved).alias("improved"))


def merge_reviews(low: DataFrame, reviews: DataFrame) -> DataFrame:
    """source_file, kind (0: reviewed, 1: not reviewed), pos, item, low_idx and the card.

    remove drops a card; improve and split with a list put its valid cards in its place, whatever the
    index; any other action keeps the card where its index exists; cards without a review follow in
    their order.  Ordering by (kind, pos, item) gives the merged order.
    """
    replaces = F.col("action").isin("improve", "split") & F.col("improved").isNotNull()
    replaces, drops = F.coalesce(replaces, F.lit(False)), F.coalesce(F.col("action") == "remove", F.lit(False))
    new = reviews.where(replaces & ~drops).select("source_file", "review_pos", "card_index", F.posexplode("improved").alias("item", "card")).where(is_card("card"))
    new = new.select("source_file", F.lit(0).alias("kind"), F.col("review_pos").alias("pos"), "item", F.col("card_index").alias("low_idx"), *card_fields("card"))
    originals = low.select("source_file", F.col("low_idx").cast("long").alias("low_idx"), *CARD_FIELDS)
    kept = reviews.where(~replaces & ~drops).select("source_file", "review_pos", F.col("card_index").alias("low_idx")).join(originals, ["source_file", "low_idx"])
    kept = kept.select("source_file", F.lit(0).alias("kind"), F.col("review_pos").alias("pos"), F.lit(0).alias("item"), "low_idx", *CARD_FIELDS)
    seen = reviews.select("source_file", F.col("card_index").alias("low_idx")).distinct()
    rest = originals.join(seen, ["source_file", "low_idx"], "left_anti")
    rest = rest.select("source_file", F.lit(1).alias("kind"), F.col("low_idx").cast("int").alias("pos"), F.lit(0).alias("item"), "low_idx", *CARD_FIELDS)
    return new.unionByName(kept).unionByName(rest)


def final_cards(routed: DataFrame, merged: DataFrame) -> DataFrame:
    """The cards that passed, in their order, then the merged ones; card_idx numbers them anew."""
    passed = routed.where("passed").select("source_file", F.lit(-1).alias("kind"), F.col("card_idx").cast("int").alias("pos"), F.lit(0).alias("item"), *CARD_FIELDS)
    rows = passed.unionByName(merged.select("source_file", "kind", "pos", "item", *CARD_FIELDS))
    w = Window.partitionBy("source_file").orderBy("kind", "pos", "item")
    return rows.select("source_file", (F.row_number().over(w) - 1).alias("card_idx"), *CARD_FIELDS)


def quality_report(routed: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """A2, A3: the counters of each source.

    What critiques removed, split and improved follows from counts alone, so removals and splits cancel
    out.  Without merged (no critique ran) those are 0.
    """
    base = routed.groupBy("source_file").agg(F.count("*").alias("total_cards"), F.count_if("passed").alias("passed_cards"))
    low = F.col("total_cards") - F.col("passed_cards")
    if merged is None:
        rows = base.withColumn("critiqued_cards", F.lit(0).cast("long")).withColumn("after", low)
        zero = F.lit(0).cast("long")
        removed = split = improved = zero
    else:
        after = merged.groupBy("source_file").agg(F.count("*").alias("after"))
        rows = base.join(after, "source_file", "left").withColumn("after", F.coalesce("after", F.lit(0).cast("long"))).withColumn("critiqued_cards", low)
        removed, split, improved = F.greatest(F.lit(0).cast("long"), low - F.col("after")), F.greatest(F.lit(0).cast("long"), F.col("after") - low), F.least("after", low)
    rows = rows.withColumns({"removed_cards": removed, "split_cards": split, "improved_cards": improved, "final_card_count": F.col("passed_cards") + F.col("after")})
    return with_pass_rate(rows.select("source_file", *COUNTERS))


def merge_reports(reports: DataFrame) -> DataFrame:
    """A4: one row of sums."""
    return with_pass_rate(reports.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in COUNTERS]))


def with_pass_rate(rows: DataFrame) -> DataFrame:
    rate = F.when(F.col("total_cards") == 0, F.lit(0.0)).otherwise(F.col("passed_cards") / F.col("total_cards").cast("double"))
    return rows.withColumn("pass_rate", rate)
