"""Whole runs: from files to requests, and from answers to final cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.cost import MID, estimated_cost
from cardloom.functions.text import estimated_tokens, preprocessed, shortened
from cardloom.operators import critique, duplicates, requests
from cardloom.operators.cards import score_cards
from cardloom.operators.chunks import TOKEN_LIMIT, split_into_chunks
from cardloom.operators.sections import sections
from cardloom.sources.files import file_stem


def preview(docs: DataFrame, text: str = "text", token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """the columns of docs with n_chars_clean, tokens, n_chunks, cost_usd (answers a quarter as long) and excerpt."""
    clean = docs.withColumn("clean", preprocessed(F.col(text)))
    rows = clean.withColumn("tokens", estimated_tokens(F.col("clean")))
    out = F.floor(F.col("tokens") / 4)
    return rows.withColumns({
        "n_chars_clean": F.length("clean"),
        "n_chunks": F.size(split_into_chunks(F.col("clean"), token_limit)),
        "cost_usd": estimated_cost(F.lit(MID), F.col("tokens"), out),
        "excerpt": shortened(F.col("clean"), 500),
    }).drop("clean")


def plan_requests(documents: DataFrame, batch: bool = False, max_cards: int = 50, force: str | None = None, **options) -> DataFrame:
    """G15, first half: loaded documents (source_path, text) to requests."""
    titled = documents.withColumn("source_file", F.col("source_path")).withColumn("title", file_stem(F.col("source_path")))
    found = sections(titled, "source_file", "text", title="title")
    found = found.join(titled.select("source_file", "title"), "source_file")
    return requests.section_requests(found, max_cards, force, batch, **options)


def run_quality(cards: DataFrame, reviews: DataFrame | None = None, threshold: float = critique.THRESHOLD, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Q13: (final cards, report).  cards: source_file, card_idx and the card; reviews: parsed critiques, once.

    Duplicates are flagged and nothing more: they change neither routing nor which cards stay.
    """
    scored = score_cards(cards)
    scored = duplicates.flag_duplicates(scored, duplicates.similar_pairs(cards))
    routed = critique.route(scored, threshold)
    if not enabled or reviews is None:
        originals = routed.where("NOT passed").select("source_file", F.lit(1).alias("kind"), F.col("low_idx").cast("int").alias("pos"), F.lit(0).alias("item"), "low_idx", *critique.CARD_FIELDS)
        return critique.final_cards(routed, originals), critique.quality_report(routed)
    merged = critique.merge_reviews(routed.where("NOT passed"), reviews)
    return critique.final_cards(routed, merged), critique.quality_report(routed, merged)


def critique_requests(routed: DataFrame, texts: DataFrame, model: str = MID) -> DataFrame:
    """L4, Q15: one request for each source with cards below the threshold: the cards as JSON and the start of the text."""
    low = routed.where("NOT passed").groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("low_idx", F.struct(*critique.CARD_FIELDS).alias("card")))).alias("c"))
    said = F.to_json(F.transform("c", lambda x: x["card"]), {"ignoreNullFields": "false"})
    rows = low.join(texts.select("source_file", shortened(F.col("text"), 3000).alias("excerpt")), "source_file")
    prompt = F.concat(F.lit("Review these cards against the text.\n\nCards:\n"), said, F.lit("\n\nText:\n"), "excerpt")
    return rows.select("source_file", F.lit("critique").alias("custom_id"), F.lit(model).alias("model"), prompt.alias("user_prompt"), F.lit(requests.SYSTEM).alias("system_prompt"), F.lit(requests.MAX_TOKENS).alias("max_tokens"))


def summary(report: DataFrame, ledger_totals: DataFrame) -> DataFrame:
    """The counters and the spending of a run in one row."""
    return critique.merge_reports(report).crossJoin(ledger_totals)  # one row by one row
