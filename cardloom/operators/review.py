"""Human review as tables of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_items(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every card with its status (pending without a decision) and its edits applied; edits aren't validated."""
    known = decisions.select("source_file", "card_idx", F.col("status").alias("decided"), "new_front", "new_back")
    rows = cards.join(known, ["source_file", "card_idx"], "left")
    rows = rows.withColumns({"status": F.coalesce("decided", F.lit("pending")), "front": F.coalesce("new_front", "front"), "back": F.coalesce("new_back", "back")})
    return rows.drop("decided", "new_front", "new_back")


def set_status(decisions: DataFrame, chosen: DataFrame, status: str) -> DataFrame:
    """Decisions with the status of the cards in chosen (source_file, card_idx) set; their edits stay."""
    return _changed(decisions, chosen.select("source_file", "card_idx"), status=F.lit(status))


def edit_cards(decisions: DataFrame, edits: DataFrame) -> DataFrame:
    """Decisions with the texts of edits (source_file, card_idx, new_front, new_back) taken over, empty ones too; statuses stay."""
    return _changed(decisions, edits.select("source_file", "card_idx", F.col("new_front").alias("f"), F.col("new_back").alias("b")), new_front=F.col("f"), new_back=F.col("b"))


def _changed(decisions: DataFrame, cards: DataFrame, **values: Column) -> DataFrame:
    rows = decisions.withColumn("known", F.lit(True)).join(cards.withColumn("hit", F.lit(True)), ["source_file", "card_idx"], "full_outer")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("pending")))
    rows = rows.withColumns({n: F.when(F.col("hit"), v).otherwise(F.col(n)) for n, v in values.items()})
    return rows.select("source_file", "card_idx", "status", "new_front", "new_back")


def accepted(items: DataFrame, saved: bool = True) -> DataFrame:
    """On save the accepted cards; on quit all of them."""
    return items.where(F.col("status") == "accepted") if saved else items


def view(items: DataFrame, status: str | None = None) -> DataFrame:
    """The items of a status, or all."""
    return items if status is None else items.where(F.col("status") == status)


def stats(items: DataFrame, *by: str) -> DataFrame:
    """How many items there are, and of each status."""
    return items.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "accepted", "rejected")])


def moved(cursor: int, by: int, size: int) -> int:
    """The cursor goes round; without items it stays."""
    return (cursor + by) % size if size else cursor


def next_filter(current: str | None) -> str | None:
    """The filter after the current one, going round over all, pending, accepted, rejected."""
    order = (None, "pending", "accepted", "rejected")
    return order[(order.index(current) + 1) % len(order)]
