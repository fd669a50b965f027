"""Whole runs around a provider: documents to final cards, and labelled cases to metrics.

A run keeps what it buys under a folder of its own: `answers` (or `batch`), `critiques` and the tables
`cards` and `scored`.  It can be started again with the same folder, and buys only what it lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators import critique, duplicates, ledger, matching, requests
from cardloom.operators.cards import score_cards
from cardloom.operators.images import flattened
from cardloom.plans.convert import critique_requests, plan_requests
from cardloom.schemas import CARD_FIELDS
from cardloom.sources.config import Config


@dataclass
class Converted:
    """Final cards, the report of each source, the ledger of all calls, and what the generating calls spent."""

    cards: DataFrame
    report: DataFrame
    usage: DataFrame
    spending: requests.Spending


def generate(documents: DataFrame, provider: requests.Provider, folder: str, config: Config, by_chunks: bool = False, images: DataFrame | None = None, force: str | None = None, in_turn: bool = False, **options) -> tuple[DataFrame, DataFrame, requests.Spending]:
    """(cards, ledger, spending) of loaded documents (source_path, text, chunks).

    By sections, or by_chunks; with images (doc_id: the source's path, page_num, idx, media_type,
    image_bytes) each document is one vision request to the configured model, and no cap applies.
    """
    if images is not None:
        texts = documents.select(F.col("source_path").alias("source_file"), "text")
        asked = requests.vision_requests(texts, flattened(images).withColumnRenamed("doc_id", "source_file"), config.model, config.cards_max_cards)
    elif by_chunks:
        asked = requests.chunk_requests(documents.withColumn("source_file", F.col("source_path")), config.cards_max_cards, force, **options)
    else:
        asked = plan_requests(documents, max_cards=config.cards_max_cards, force=force, **options)
    # The cap is that of sections alone: chunks and vision ask as long as the budget lasts.
    cap = None if by_chunks or images is not None else config.cards_max_cards
    answers, spending = requests.spend(asked, provider, f"{folder}/answers", config.cost_budget_limit, config.cost_warn_at, cap, in_turn)
    sectioned = images is None and not by_chunks
    return numbered(requests.collect_cards(asked, answers, sectioned), asked), requests.usage(answers, empty=images is not None), spending


def numbered(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """Cards numbered within their source, in the order of its requests."""
    places = asked.select("source_file", F.col("custom_id").alias("section_id"), "section_pos", "part")
    w = Window.partitionBy("source_file").orderBy("section_pos", "part", "card_idx")
    rows = cards.join(places, ["source_file", "section_id"]).withColumn("card_idx", F.row_number().over(w) - 1)
    return rows.select("source_file", "section_id", "card_idx", *CARD_FIELDS)


def from_batch(documents: DataFrame, submit: Callable[[list[dict]], str], status: Callable[[str], str], results: Callable[[list[str]], DataFrame], config: Config, every: float = 30.0, timeout: float = 86_400.0, **options) -> tuple[DataFrame, DataFrame]:
    """(cards, ledger at the price of batches): all sections are handed over, awaited and collected."""
    asked = plan_requests(documents, batch=True, max_cards=config.cards_max_cards, **options)
    ids = requests.submit(asked, submit)
    for one in ids:
        requests.poll(lambda one=one: status(one), every, timeout)
    answers = results(ids)
    return numbered(requests.collect_cards(asked, answers), asked), requests.usage(answers, batch=True)


def improve(cards: DataFrame, texts: DataFrame, provider: requests.Provider | None, folder: str, config: Config) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Q13, Q14, Q15: (final cards, report, ledger of the critiques).

    Cards are scored once, into a table.  Sources with cards below the threshold get one critique call,
    if critique is on and any round is allowed; without an answer that can be used, originals stay.
    """
    spark = cards.sparkSession
    cards.select("source_file", "card_idx", *CARD_FIELDS).write.mode("overwrite").parquet(f"{folder}/cards")
    cards = spark.read.parquet(f"{folder}/cards")
    scored = duplicates.flag_duplicates(score_cards(cards), duplicates.similar_pairs(cards))
    critique.route(scored, config.quality_confidence_threshold).write.mode("overwrite").parquet(f"{folder}/scored")
    routed = spark.read.parquet(f"{folder}/scored")
    low = routed.where("NOT passed")
    if provider is None or not config.quality_enable_critique or config.quality_max_critique_rounds < 1:
        kept = low.select("source_file", F.lit(1).alias("kind"), F.col("low_idx").cast("int").alias("pos"), F.lit(0).alias("item"), "low_idx", *CARD_FIELDS)
        return critique.final_cards(routed, kept), critique.quality_report(routed), None
    asked = critique_requests(routed, texts, config.model)
    answers = requests.call_provider(asked, provider, f"{folder}/critiques")
    reviews = critique.parse_reviews(requests.usable(answers))
    merged = critique.merge_reviews(low, reviews)
    return critique.final_cards(routed, merged), critique.quality_report(routed, merged), requests.usage(answers)


def convert(documents: DataFrame, provider: requests.Provider, folder: str, config: Config, **how) -> Converted:
    """2.13: loaded documents to final cards; those that failed to load are left out, and stop nothing.

    how: as for generate().  Costs of all calls are in the ledger, whatever became of their answers.
    """
    good = documents.where("error IS NULL") if "error" in documents.columns else documents
    cards, bought, spending = generate(good, provider, folder, config, **how)
    texts = good.select(F.col("source_path").alias("source_file"), "text")
    final, report, reviewed = improve(cards, texts, provider, folder, config)
    return Converted(final, report, bought if reviewed is None else bought.unionByName(reviewed), spending)


def evaluate(cases: DataFrame, expected: DataFrame, provider: requests.Provider, folder: str, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """2.13: (metrics, recall of each case, matches) of a labelled set (sources.config.load_dataset).

    Each case goes the way of chunks, without sections.  Cases without any usable answer have failed, and
    are left out of the metrics; their cost isn't.
    """
    asked = cases.select(F.col("case_id").alias("source_file"), "text", F.array("text").alias("chunks"))
    asked = requests.chunk_requests(asked, config.cards_max_cards)
    answers = requests.call_provider(asked, provider, f"{folder}/answers")
    done = requests.usable(answers).select(F.col("source_file").alias("case_id")).distinct()
    cards = numbered(requests.collect_cards(asked, answers, tag_sections=False), asked).withColumnRenamed("source_file", "case_id")
    wanted = expected.join(done, "case_id", "left_semi")
    matches = matching.greedy_match(wanted, cards)
    cost = ledger.with_cost(requests.usage(answers)).agg(F.sum("cost_usd")).first()[0] or 0.0
    return matching.metrics(matches, cards, cost), matching.case_recall(matches, cards), matches


def eval_report(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """Name and value of each metric, then the recall of each case as matched/expected, as rows of a table."""
    names = ("recall", "precision", "f1", "avg_similarity", "total_cost_usd")
    said = F.format_string("%.4f", F.col("value"))
    table = metrics.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("pos", "m"))
    table = table.select(F.lit("metric").alias("kind"), F.col("m.name").alias("name"), F.col("m.value").alias("value"), "pos").withColumn("said", said)
    each = cases.select(F.lit("case").alias("kind"), F.col("case_id").alias("name"), F.col("recall").alias("value"), F.lit(0).alias("pos"), F.concat_ws("/", "n_matched", "n_expected").alias("said"))
    return table.select("kind", "name", "value", "pos", "said").unionByName(each)


def run_summary(done: Converted, files: int, pushed: int = 0) -> DataFrame:
    """One row: the counters of the report, calls, cost, files and pushed notes."""
    spent = ledger.with_cost(done.usage).agg(F.count("*").alias("api_calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"))
    return critique.merge_reports(done.report).crossJoin(spent).withColumns({"files": F.lit(files), "pushed": F.lit(pushed)})  # one row by one row

