"""Generation requests and responses, around an injected provider."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions.cost import call_cost, selected_model
from cardloom.operators import leases
from cardloom.operators.cards import count_valid, parse_responses, section_tagged, valid_cards
from cardloom.operators.ledger import BUDGET, MAX_CARDS, WARN_AT, section_plan, with_cost

SYSTEM = "You write study cards. Answer with a JSON array of cards and nothing else."
MAX_TOKENS = 8192


class Provider(Protocol):
    """Answers one request: {"text", "model", "input_tokens", "output_tokens", "block_type"}."""

    def __call__(self, model: str, system: str, prompt: str | list, max_tokens: int) -> dict: ...


def _line(label: str, values: list[str] | None) -> Column:
    return F.lit(f"{label}: {', '.join(values)}") if values else F.lit(None).cast("string")


def _options(card_types: list[str] | None, focus: list[str] | None, bloom: list[str] | None, extra_tags: list[str] | None) -> list[Column]:
    """Options are asked for in the prompt; nothing enforces them on the answer."""
    return [_line("Card types", card_types), _line("Focus on", focus), _line("Bloom levels", bloom), _line("Add the tags", extra_tags)]


def user_prompt(text: Column, max_cards: int, card_types=None, focus=None, bloom=None, extra_tags=None) -> Column:
    """G1: optional lines, then the text, with a blank line between; null for an empty text."""
    count = F.lit(f"Write at most {max_cards} cards about the text below.")
    whole = F.concat_ws("\n\n", count, *_options(card_types, focus, bloom, extra_tags), F.concat(F.lit("Text:\n"), text))
    return F.when(F.length(text) > 0, whole)


def section_prompt(section_cards: Column, card_types=None, focus=None, bloom=None, extra_tags=None) -> Column:
    """Where the section stands, how many cards, its tag path, options and the text."""
    where = F.concat_ws(
        "\n",
        F.when(F.col("title") != "", F.concat(F.lit("Document: "), "title")),
        F.when(F.col("breadcrumb") != "", F.concat(F.lit("Section: "), "breadcrumb")),
        F.when(F.col("page_range") != "", F.concat(F.lit("Pages: "), "page_range")),
    )
    count = F.concat(F.lit("Write at most "), section_cards.cast("string"), F.lit(" cards."))
    path = F.when(F.col("breadcrumb") != "", F.concat(F.lit("Tag path: "), F.replace(F.col("breadcrumb"), F.lit(" > "), F.lit("::"))))
    return F.concat_ws("\n\n", F.when(where != "", where), count, path, *_options(card_types, focus, bloom, extra_tags), F.concat(F.lit("Text:\n"), "text"))


def section_requests(sections: DataFrame, max_cards: int = 50, force: str | None = None, batch: bool = False, **options) -> DataFrame:
    """A request for each section; its key is (source_file, custom_id).  Batches skip no short section."""
    rows = section_plan(sections, max_cards, force, skip_short=not batch)
    prompt = section_prompt(F.col("section_cards"), **options)
    return rows.select("source_file", F.col("id").alias("custom_id"), "section_pos", "part", "model", prompt.alias("user_prompt"), F.lit(SYSTEM).alias("system_prompt"), F.lit(MAX_TOKENS).alias("max_tokens"))


def vision_messages(text: str, images: list[dict]) -> list[dict]:
    """The images that have bytes, then the text; the count it announces includes empty ones."""
    parts = [{"type": "image", "media_type": i["media_type"], "data": i["data"]} for i in images if i["data"]]
    return [*parts, {"type": "text", "text": f"{len(images)} images come with this text.\n\n{text}"}]


def with_retry(call: Callable[[], dict], retryable: tuple[type[Exception], ...], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Retries after wait, then twice that; RuntimeError when every attempt failed."""
    last: Exception | None = None
    for n in range(1, attempts + 1):
        try:
            return call()
        except retryable as e:
            last = e
            if n < attempts:
                sleep(wait * n)
    raise RuntimeError(f"no answer after {attempts} attempts") from last


ANSWER = "source_file string, custom_id string, status string, model string, input_tokens long, output_tokens long, block_type string, text string"


def answers_at(spark: SparkSession, path: str) -> DataFrame:
    """The answers that a run has bought so far; none yet: an empty table."""
    try:
        return spark.read.schema(ANSWER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ANSWER)


def call_provider(requests: DataFrame, provider: Provider, path: str, retryable: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> DataFrame:
    """The answers to requests, kept at path before anything reads them, since calls cost money and a plan may run twice.

    A request whose key has an answer there is not sent again, so a run that broke off goes on where it
    stopped; one that failed is.  Any error of the provider makes that request an errored row and leaves
    the others alone.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([_answer(r, provider, retryable) for r in frame.itertuples()], columns=[c.split()[0] for c in ANSWER.split(", ")])

    spark, key = requests.sparkSession, ["source_file", "custom_id"]
    answered = answers_at(spark, path).where("status = 'succeeded'").select(*key)
    requests.join(answered, key, "left_anti").select(*key, "model", "system_prompt", "user_prompt", "max_tokens").mapInPandas(run, ANSWER).write.mode("append").parquet(path)
    return _best_answers(answers_at(spark, path)).join(requests.select(*key), key, "left_semi")


def chunk_requests(documents: DataFrame, max_cards: int = MAX_CARDS, force: str | None = None, **options) -> DataFrame:
    """G3 without sections: a request for each chunk (source_file, text, chunks), the model chosen once by the whole text."""
    rows = documents.withColumn("model", selected_model(F.length("text"), F.lit(max_cards), F.lit(force) if force else None))
    rows = rows.select("source_file", "model", F.posexplode("chunks").alias("section_pos", "chunk"))
    name = F.concat(F.lit("chunk-"), F.col("section_pos").cast("string"))
    asked = user_prompt(F.col("chunk"), max_cards, **options)
    return rows.select("source_file", name.alias("custom_id"), "section_pos", F.lit(0).alias("part"), "model", asked.alias("user_prompt"), F.lit(SYSTEM).alias("system_prompt"), F.lit(MAX_TOKENS).alias("max_tokens")).where("user_prompt IS NOT NULL")


def vision_requests(documents: DataFrame, images: DataFrame, model: str, max_cards: int = MAX_CARDS) -> DataFrame:
    """One request for each document, over its whole text and all its images; always the model given, no options.

    documents: source_file, text; images: source_file, images (C12).  user_prompt is the JSON of the
    message's parts: the images that have bytes, then a text that announces how many there are in all.
    """
    rows = documents.select("source_file", "text").join(images, "source_file", "left")
    part = lambda kind, media, data, text: F.struct(F.lit(kind).alias("type"), media.alias("media_type"), data.alias("data"), text.alias("text"))
    none = F.lit(None).cast("string")
    shown = F.transform(F.filter("images", lambda i: i["data"] != ""), lambda i: part("image", i["media_type"], i["data"], none))
    shown = F.coalesce(shown, F.array().cast("array<struct<type:string,media_type:string,data:string,text:string>>"))
    count = F.coalesce(F.size("images"), F.lit(0))
    said = F.concat(F.greatest(count, F.lit(0)).cast("string"), F.lit(" images come with this text.\n\n"), user_prompt(F.col("text"), max_cards))
    prompt = F.to_json(F.concat(shown, F.array(part("text", none, none, said))))
    rows = rows.where(F.length("text") > 0)
    return rows.select("source_file", F.lit("vision").alias("custom_id"), F.lit(0).alias("section_pos"), F.lit(0).alias("part"), F.lit(model).alias("model"), prompt.alias("user_prompt"), F.lit(SYSTEM).alias("system_prompt"), F.lit(MAX_TOKENS).alias("max_tokens"))


@dataclass
class Spending:
    """What a run has spent, the call of its shard before which it warned (0: none), and why it stopped early, if it did."""

    spent: float = 0.0
    calls: int = 0
    warned_at: int = 0
    stopped: str | None = None


class AnswerLog:
    """The answers that a shard has bought in this run, in small Parquet files at path, written as it goes."""

    def __init__(self, path: str, name: str, every: int):
        import pyarrow as pa
        from pyarrow import fs

        self.store, place = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))
        self.place, self.name, self.every, self.rows = place.rstrip("/"), name, every, []
        self.schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in ANSWER.split(", "))])
        self.store.create_dir(self.place, recursive=True)
        files = self.store.get_file_info(fs.FileSelector(self.place))
        self.files = sorted(f.path for f in files if f.base_name.startswith(name))

    def kept(self) -> list[dict]:
        """What an earlier attempt of this task has bought."""
        import pyarrow.parquet as pq

        return [row for f in self.files for row in pq.read_table(f, filesystem=self.store).to_pylist()]

    def add(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.every:
            self.flush()

    def flush(self) -> None:
        """A file is moved to its name when it is whole; Spark doesn't read names that begin with an underscore."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        if self.rows:
            path = f"{self.place}/{self.name}{len(self.files):06d}.parquet"
            whole = f"{self.place}/_{uuid.uuid4().hex}"
            pq.write_table(pa.Table.from_pylist(self.rows, self.schema), whole, filesystem=self.store)
            self.store.move(whole, path)
            self.files.append(path)
            self.rows = []


def spend(requests: DataFrame, provider: Provider, path: str, budget: float = BUDGET, warn_at: float = WARN_AT, max_cards: int | None = MAX_CARDS, in_turn: bool = False, retryable: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), shards: int | None = None, every: int = 16) -> tuple[DataFrame, Spending]:
    """P3, P4, W2 to W4 around the calls themselves: (answers, what was spent).

    Documents are dealt to shards (None: as many as the session shuffles to), and a shard calls for one
    document after the other, its sections in order, in one task.  It spends what it has leased (leases.py): nothing
    is sent once the budget is used up, which a run overshoots by one call a shard at most.  There is
    one warning, by the first shard that sees warn_at of the budget spent.  A document that has max_cards valid cards
    (None: no cap) asks for no more.  in_turn: one shard, which is a plain loop over the documents by name.

    Runs one job, however many sections there are.  Answers are kept at path as they come, `every` of them in a file, so
    a lost task loses fewer than that, and its next attempt goes on.  Answers that path holds from an earlier
    run count as spent and as cards, and aren't bought again; failed ones are.  Speculative attempts would buy twice.
    """
    spark, key, run_id = requests.sparkSession, ["source_file", "custom_id"], uuid.uuid4().hex
    bought = answers_at(spark, path).where("status = 'succeeded'")
    before = with_cost(usage(bought)).agg(F.sum("cost_usd"), F.count("*")).first()
    n = 1 if in_turn else shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = bought.groupBy(*key).agg(F.first("text").alias("had"), F.first("block_type").alias("had_type"), F.lit(True).alias("answered"))
    asked = requests.select(*key, "section_pos", "part", "model", "system_prompt", "user_prompt", "max_tokens").join(held, key, "left")
    # The shard goes with the row: how Spark numbers or joins partitions doesn't matter.
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("source_file"), F.lit(n)).cast("int")).repartition(n, "shard").sortWithinPartitions("shard", "source_file", "section_pos", "part")
    book = leases.Ledger(budget, warn_at, float(before[0] or 0.0))
    with leases.LedgerServer(book, spark.conf.get("spark.driver.host", "localhost")) as server:
        address, secret, want, warn_from = server.address, server.key, max(budget, 0.0) / (8 * n if n > 1 else 1), warn_at * budget

        def begin(shard: int) -> tuple:
            log = AnswerLog(path, f"part-{run_id}-{shard:06d}-", every)
            kept = log.kept()
            spent = sum(_cost(r) for r in kept)
            return log, leases.Lease(address, secret, shard, want, warn_from, spent), {(r["source_file"], r["custom_id"]): r for r in kept}

        def run(frames: Iterator) -> Iterator:
            import pandas as pd

            shard = source = None
            log = lease = None
            mine: dict = {}
            cards, calls, stopped = 0, 0, False
            for frame in frames:
                for r in frame.itertuples():
                    if r.shard != shard:
                        if lease is not None:
                            log.flush()
                            lease.close()
                        shard, (log, lease, mine), stopped = r.shard, begin(int(r.shard)), False
                    if r.source_file != source:
                        source, cards = r.source_file, 0
                    again = mine.get((r.source_file, r.custom_id))
                    if r.answered is True or again is not None and again["status"] == "succeeded":
                        had = (r.had, r.had_type) if again is None else (again["text"], again["block_type"])
                        cards += count_valid(had[0]) if had[1] == "text" and had[0] else 0
                        continue
                    if stopped or max_cards is not None and cards >= max_cards:
                        continue
                    if not lease.may():
                        stopped = True
                        continue
                    answer = _answer(r, provider, retryable)
                    lease.paid(_cost(answer))
                    log.add(answer)
                    cards += count_valid(answer["text"]) if answer["block_type"] == "text" and answer["text"] else 0
                    calls += 1
            if lease is not None:
                log.flush()
                lease.close()
            yield pd.DataFrame([(calls,)], columns=["calls"])

        asked.mapInPandas(run, "calls long").agg(F.sum("calls")).first()
    found = _best_answers(answers_at(spark, path))
    total = with_cost(usage(found)).agg(F.sum("cost_usd"), F.count("*")).first()
    stopped = f"spent {book.known():.6f} of {budget:.6f}" if book.refused else None
    return found, Spending(float(total[0] or 0.0), total[1], 0 if book.warned_after is None else book.warned_after + 1, stopped)


def _answer(r, provider: Provider, retryable: tuple[type[Exception], ...]) -> dict:
    """One call; any error of the provider is this request's error, and leaves the others alone."""
    names = [c.split()[0] for c in ANSWER.split(", ")]
    try:
        a = with_retry(lambda: provider(r.model, r.system_prompt, r.user_prompt, int(r.max_tokens)), retryable)
        return dict(zip(names, (r.source_file, r.custom_id, "succeeded", a["model"], a["input_tokens"], a["output_tokens"], a.get("block_type", "text"), a.get("text")), strict=True))
    except Exception:
        return dict(zip(names, (r.source_file, r.custom_id, "errored", r.model, 0, 0, None, None), strict=True))


def _cost(a: dict) -> float:
    """What usage() and with_cost() charge for an answer."""
    charged = a["status"] == "succeeded" and a["block_type"] == "text" and a["text"]
    return call_cost(a["model"], a["input_tokens"], a["output_tokens"]) if charged else 0.0


def _best_answers(found: DataFrame) -> DataFrame:
    """A request that failed before and has an answer now counts once."""
    best = F.row_number().over(Window.partitionBy("source_file", "custom_id").orderBy(F.col("status") != "succeeded"))
    return found.withColumn("turn", best).where("turn = 1").drop("turn")


def usable(responses: DataFrame) -> DataFrame:
    """Answers that succeeded and whose first block is text."""
    return responses.where("status = 'succeeded' AND block_type = 'text' AND text IS NOT NULL")


def collect_cards(requests: DataFrame, responses: DataFrame, tag_sections: bool = True) -> DataFrame:
    """The valid cards of each request, tagged with its section; failed answers give none."""
    answered = requests.select("source_file", "custom_id").join(usable(responses), ["source_file", "custom_id"])
    cards = valid_cards(parse_responses(answered, "source_file", "custom_id"), "source_file", "custom_id")
    cards = cards.withColumnRenamed("custom_id", "section_id")
    return section_tagged(cards) if tag_sections else cards


def usage(responses: DataFrame, batch: bool = False, empty: bool = False) -> DataFrame:
    """The ledger of usable answers: empty ones and those without text cost nothing here, but with empty (vision) all do."""
    rows = responses.where("status = 'succeeded'") if empty else usable(responses).where("text <> ''")
    return rows.select("source_file", "custom_id", "model", "input_tokens", "output_tokens", F.lit(batch).alias("batch"))


def submit(requests: DataFrame, send: Callable[[list[dict]], str], size: int = 10_000) -> list[str]:
    """Hands the requests to a batch service, `size` at a time; the ids of the batches.  No requests are an error."""
    made, block = [], []
    for row in requests.orderBy("source_file", "section_pos", "part").toLocalIterator():
        block.append(row.asDict())
        if len(block) == size:
            made.append(send(block))
            block = []
    if block:
        made.append(send(block))
    if not made:
        raise ValueError("no requests to submit")
    return made


def poll(status: Callable[[], str], every: float, timeout: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
    """Waits until a batch has ended; the time is looked at after each poll."""
    began = clock()
    while status() != "ended":
        if clock() - began > timeout:
            raise TimeoutError(f"the batch hadn't ended after {timeout} seconds")
        sleep(every)
