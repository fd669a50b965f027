"""Evaluation: expected cards against generated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.similarity import pair_score
from cardloom.operators.edges import sparse_match

MATCH_AT = 0.3


def score_matrix(expected: DataFrame, generated: DataFrame) -> DataFrame:
    """case_id, exp_idx, scores (array by gen_idx order) for every expected card; edges.score_edges() gives those above 0 alone."""
    cards = generated.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("card_idx", "front", "back", "card_type"))).alias("cards"))
    rows = expected.join(cards, "case_id", "left").withColumn("cards", F.coalesce("cards", F.array().cast("array<struct<card_idx:int,front:string,back:string,card_type:string>>")))
    each = lambda c: pair_score(F.col("front_keywords"), F.col("back_keywords"), F.col("wanted_type"), c["front"], c["back"], c["card_type"])
    return rows.select("case_id", "exp_idx", F.transform("cards", each).alias("scores"), F.transform("cards", lambda c: c["card_idx"]).alias("gen"))


def greedy_match(expected: DataFrame, generated: DataFrame, threshold: float = MATCH_AT) -> DataFrame:
    """case_id, exp_idx, gen_idx (null without a match), similarity (0 without a match); see edges.sparse_match()."""
    return sparse_match(expected, generated, threshold)


def unmatched(generated: DataFrame, matches: DataFrame) -> DataFrame:
    """U4: generated cards that no expected card took."""
    taken = matches.where("gen_idx is not null").select("case_id", F.col("gen_idx").alias("card_idx"))
    return generated.join(taken, ["case_id", "card_idx"], "left_anti")


def case_recall(matches: DataFrame, generated: DataFrame) -> DataFrame:
    """Matched, expected, generated and recall of each case."""
    made = generated.groupBy("case_id").agg(F.count("*").alias("n_generated"))
    found = matches.groupBy("case_id").agg(F.count("gen_idx").alias("n_matched"), F.count("*").alias("n_expected"))
    rows = found.join(made, "case_id", "left").withColumn("n_generated", F.coalesce("n_generated", F.lit(0).cast("long")))
    return rows.withColumn("recall", _ratio(F.col("n_matched"), F.col("n_expected")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b.cast("double")).otherwise(F.lit(0.0))


def metrics(matches: DataFrame, generated: DataFrame, cost_usd: float = 0.0) -> DataFrame:
    """A5: one row, every ratio 0 where it has nothing to divide by."""
    found = matches.agg(
        F.count("*").alias("total_expected"),
        F.count("gen_idx").alias("total_matched"),
        F.coalesce(F.sum(F.when(F.col("gen_idx").isNotNull(), F.col("similarity"))), F.lit(0.0)).alias("similarity_sum"),
    )
    rows = found.crossJoin(generated.agg(F.count("*").alias("total_generated")))  # one row by one row
    recall, precision = _ratio(F.col("total_matched"), F.col("total_expected")), _ratio(F.col("total_matched"), F.col("total_generated"))
    rows = rows.withColumns({"recall": recall, "precision": precision, "avg_similarity": _ratio(F.col("similarity_sum"), F.col("total_matched"))})
    both = F.col("recall") + F.col("precision")
    f1 = F.when(both > 0, F.lit(2.0) * F.col("recall") * F.col("precision") / both).otherwise(F.lit(0.0))
    return rows.select("recall", "precision", f1.alias("f1"), "avg_similarity", F.lit(float(cost_usd)).alias("total_cost_usd"), "total_expected", "total_generated", "total_matched")


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric, a, b and b - a of two one-row frames."""
    names = ("recall", "precision", "f1", "avg_similarity", "total_cost_usd")
    tall = lambda m, name: m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(name)) for n in names])).alias("x")).select("x.*")
    return tall(a, "a").join(tall(b, "b"), "metric").withColumn("delta", F.col("b") - F.col("a"))
