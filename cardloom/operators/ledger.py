"""Spending: totals, the running budget and the card cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.cost import estimated_cost, selected_model
from cardloom.operators.scan import scanned

BUDGET, WARN_AT, MAX_CARDS, SECTION_CARDS, SECTION_MIN_CHARS = 1.00, 0.8, 50, 20, 50


def with_cost(usage: DataFrame) -> DataFrame:
    """F8 over a ledger of model, input_tokens, output_tokens, batch."""
    return usage.withColumn("cost_usd", estimated_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("batch")))


def totals(ledger: DataFrame, *by: str, budget: float = BUDGET) -> DataFrame:
    """A1: total_cost, request_count, budget_remaining, within_budget."""
    found = ledger.groupBy(*by).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"), F.count("*").alias("request_count"))
    return found.withColumns({"budget_remaining": F.lit(budget) - F.col("total_cost"), "within_budget": F.col("total_cost") <= F.lit(budget)})


def _running(rows: DataFrame, value: Column, out: str, order: list[str], partition: list[str], spread: bool) -> DataFrame:
    """Sum of value over the rows before each, in order: by a scan, or by a plain window of each partition."""
    if spread:
        return scanned(rows, partition, order, sums={out: value})
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, value)
    return rows.withColumn(out, F.coalesce(F.sum(out).over(w), F.lit(0).cast(rows.schema[out].dataType)))


def budget_gate(ledger: DataFrame, order: list[str], budget: float = BUDGET, warn_at: float = WARN_AT, partition: list[str] | None = None) -> DataFrame:
    """spent_before, allowed and warns beside each call.

    A call goes ahead while what was spent before it is within the budget, so the last may overshoot.
    Costs are not negative, so the calls that go ahead come first.  The first allowed call at or beyond
    warn_at of the budget warns.  A partition may hold any share of the rows: they are scanned in range
    partitions, whose dealing runs when this is called.
    """
    rows = _running(ledger, F.col("cost_usd"), "spent_before", order, partition or [], spread=True)
    rows = rows.withColumn("allowed", F.col("spent_before") <= F.lit(budget))
    due = F.col("allowed") & (F.col("spent_before") >= F.lit(warn_at * budget))
    key = F.struct(*order)
    if partition:
        first = rows.where(due).groupBy(*partition).agg(F.min(key).alias("first_due"))
        rows = rows.join(first, partition, "left")
    else:
        rows = rows.crossJoin(F.broadcast(rows.where(due).agg(F.min(key).alias("first_due"))))  # one row
    return rows.withColumn("warns", F.coalesce(key == F.col("first_due"), F.lit(False))).drop("first_due")


def card_cap_gate(sections: DataFrame, order: list[str], partition: list[str], n_cards: str = "n_cards", max_cards: int = MAX_CARDS, spread: bool = False) -> DataFrame:
    """cards_before and allowed; a section goes ahead while the cards before it are below the cap.

    Sections of a document are few; spread scans partitions of any size, as budget_gate() does.
    """
    rows = _running(sections, F.col(n_cards).cast("long"), "cards_before", order, partition, spread)
    return rows.withColumn("allowed", F.col("cards_before") < max_cards)


def section_plan(sections: DataFrame, max_cards: int = MAX_CARDS, force: str | None = None, skip_short: bool = True) -> DataFrame:
    """The card budget and the model of each section; the batch path skips none."""
    rows = sections.where(F.col("char_count") >= SECTION_MIN_CHARS) if skip_short else sections
    cards = F.least(F.lit(max_cards), F.lit(SECTION_CARDS))
    rows = rows.withColumn("section_cards", cards)
    return rows.withColumn("model", selected_model(F.col("char_count"), F.col("section_cards"), F.lit(force) if force else None))


def model_used(calls: DataFrame, by: str, order: str, default: str) -> DataFrame:
    """The first model of each group that isn't empty."""
    named = F.when(F.col("model") != "", F.col("model"))
    found = calls.groupBy(by).agg(F.min_by(named, F.when(named.isNotNull(), F.col(order))).alias("model_used"))
    return found.withColumn("model_used", F.coalesce("model_used", F.lit(default)))
