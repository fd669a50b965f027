"""A whole run over a folder of files: cache, choice of path by file and settings, quality, files written.

What a run buys, and what it loaded, lies in a folder of its own; started again with it and the same
files, a run goes on: it loads, submits and buys only what it lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import ledger, requests
from cardloom.operators.images import chosen_images, media_name
from cardloom.plans import runs
from cardloom.plans.convert import plan_requests
from cardloom.sources import files as source
from cardloom.sources import sink
from cardloom.sources.cache import cache_key, load_with_cache
from cardloom.sources.config import Config

QUALITIES = ("off", "basic", "full")


@dataclass
class Batches:
    """A batch service: hand over requests, ask how a batch is, and fetch the answers of batches as rows (requests.ANSWER)."""

    submit: Callable[[list[dict]], str]
    status: Callable[[str], str]
    results: Callable[[list[str]], DataFrame]


@dataclass
class Services:
    """What a run takes from outside: the provider, and what turns files into text and images, if anything does.

    convert(content, with_ocr, language) gives a file's text.  images(files) gives doc_id (the path), page_num, idx,
    x0, y0, x1, y1, page_width, page_height, media_type and image_bytes of all images of files (path, length, content).
    """

    provider: requests.Provider
    convert: Callable[[bytes, bool, str], str] | None = None
    images: Callable[[DataFrame], DataFrame] | None = None
    batches: Batches | None = None


@dataclass
class Run:
    """Final cards, each source's report (None without quality) and path, the ledger of all calls, failed files, and what each path spent."""

    cards: DataFrame
    report: DataFrame | None
    paths: DataFrame
    usage: DataFrame
    failed: DataFrame
    spending: dict[str, requests.Spending]


def _kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, which is made first if it isn't whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def loaded(found: DataFrame, config: Config, convert: Callable | None) -> DataFrame:
    """A row for each file (path, length, content), from the cache where it has the content.

    Files of the same content share an entry, but each keeps its own path; those that fail have an error.
    """
    load = lambda missing: source.load_documents(missing, convert, config.ocr_enabled, config.ocr_lang)
    # What the converter gives depends on these two.
    key = cache_key(True, ocr=config.ocr_enabled, lang=config.ocr_lang)
    made = load_with_cache(found, f"{config.cache_dir.rstrip('/')}/documents", load, key, config.cache_enabled)
    own = found.select(F.col("path").alias("source_path"), source.content_hash(F.col("content")).alias("content_hash"))
    good = made.where("error IS NULL").drop("source_path").dropDuplicates(["content_hash"])
    good = own.join(good, "content_hash").withColumn("file_type", F.lower(F.regexp_extract("source_path", source.SUPPORTED, 1)))
    return good.select(made.columns).unionByName(made.where("error IS NOT NULL"))


def with_path(documents: DataFrame, config: Config, services: Services) -> DataFrame:
    """Documents with way: `vision` for PDF files if it is on, else `batch` for texts if that is on, else `sections`.

    A way whose service isn't there isn't taken.
    """
    vision = F.lit(config.vision_enabled and services.images is not None) & (F.col("file_type") == "pdf")
    batch = F.lit(config.batch_enabled and services.batches is not None) & (F.col("text") != "")
    return documents.withColumn("way", F.when(vision, "vision").when(batch, "batch").otherwise("sections"))


def _by_batch(documents: DataFrame, batches: Batches, folder: str, config: Config, options: dict) -> tuple[DataFrame, DataFrame]:
    """As runs.from_batch(), but ids and answers are kept, so no batch is handed over twice."""
    spark = documents.sparkSession
    asked = plan_requests(documents, batch=True, max_cards=config.cards_max_cards, **options)
    ids = _kept(spark, f"{folder}/batch-ids", lambda: spark.createDataFrame([(i,) for i in requests.submit(asked, batches.submit)], "id string"))
    ids = [r.id for r in ids.orderBy("id").collect()]  # one for 10,000 requests

    def awaited() -> DataFrame:
        for one in ids:
            requests.poll(lambda one=one: batches.status(one), config.batch_poll_interval, config.batch_timeout)
        return batches.results(ids)

    answers = _kept(spark, f"{folder}/batch", awaited)
    return runs.numbered(requests.collect_cards(asked, answers), asked), requests.usage(answers, batch=True)


def convert_folder(spark: SparkSession, path: str, services: Services, folder: str, config: Config, quality: str = "full", out: str | None = None, force: str | None = None, **options) -> Run:
    """G15, K8, 2.13: the files at path to final cards, and to files under out, if it is given.

    quality: `off` (cards as they come), `basic` (scores and duplicates) or `full` (one critique too).  The budget
    is one for all: vision goes first, then batches (handed over only while there is budget left, and counted
    when they are back), then sections.  Files that fail to load stop nothing.  Images of the pages that are
    sent go to out/_media.  A file's images are found and sent in one task, a file's text is one row.
    """
    if quality not in QUALITIES:
        raise ValueError(f"quality is one of {QUALITIES}, not {quality!r}")
    found = source.list_files(spark, path, source.LARGEST, ordered=False)
    documents = _kept(spark, f"{folder}/documents", lambda: loaded(found, config, services.convert))
    good = with_path(documents.where("error IS NULL"), config, services)
    ways = {r.way for r in good.select("way").distinct().collect()}
    pictures, parts, spending, left = None, [], {}, config.cost_budget_limit
    if "vision" in ways:
        seen = good.where("way = 'vision'").select(F.col("source_path").alias("path"))
        boxes = services.images(found.join(seen, "path", "left_semi"))
        pictures = _kept(spark, f"{folder}/images", lambda: chosen_images(boxes, config.vision_coverage, config.vision_max_images))
    for way in ("vision", "batch", "sections"):
        if way not in ways or (way == "batch" and left <= 0):
            continue
        mine, place = good.where(F.col("way") == way), f"{folder}/{way}"
        if way == "batch":
            cards, bought = _by_batch(mine, services.batches, place, config, options)
            cost = ledger.with_cost(bought).agg(F.sum("cost_usd"), F.count("*")).first()
            spent = requests.Spending(cost[0] or 0.0, cost[1])
        else:
            more = {"images": pictures} if way == "vision" else {"force": force, **options}
            cards, bought, spent = runs.generate(mine, services.provider, place, replace(config, cost_budget_limit=left), **more)
        left -= spent.spent
        spending[way] = spent
        parts.append((cards, bought))
    if not parts:
        raise ValueError(f"no file in {path} could be loaded" if not ways else "no budget")
    cards, bought = parts[0]
    for more_cards, more_bought in parts[1:]:
        cards, bought = cards.unionByName(more_cards), bought.unionByName(more_bought)
    report = None
    if quality != "off":
        texts = good.select(F.col("source_path").alias("source_file"), "text")
        cards, report, reviewed = runs.improve(cards, texts, services.provider if quality == "full" else None, folder, config)
        bought = bought if reviewed is None else bought.unionByName(reviewed)
    if out:
        sink.write_cards(cards, out, config.output_format, config.model)
        if pictures is not None:
            named = pictures.withColumn("doc", F.md5("doc_id"))  # paths don't do as names
            sink.write_media(named.select(media_name("doc", "page_num", "idx", "media_type").alias("name"), "image_bytes"), out)
    return Run(cards, report, good.select(F.col("source_path").alias("source_file"), "way"), bought, documents.where("error IS NOT NULL").select("source_path", "error"), spending)
