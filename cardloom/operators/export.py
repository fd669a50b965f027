"""Cards as tab-separated rows, JSON documents and notes."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.schemas import CARD_FIELDS

# The directives that begin a file of rows, and the version of the JSON form.
TSV_HEADER = "#separator:tab\n#html:true\n#tags column:3\n"
JSON_VERSION = "1.0"
#: Note types by card type; the rest are basic.
NOTE_MODELS = {"cloze": "Cloze", "reversible": "Basic (and reversed card)"}


def tsv_field(text: Column) -> Column:
    """K3: tabs become spaces and newlines line breaks; carriage returns stay."""
    return F.replace(F.replace(text, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))


def all_tags(tags: Column, bloom: Column, extra: list[str] | None = None) -> Column:
    """K4: the card's tags, its Bloom level, then extra ones."""
    return F.concat(tags, F.array(F.concat(F.lit("bloom::"), bloom), *[F.lit(t) for t in extra or []]))


def tsv_rows(cards: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """source_file, card_idx, row_idx, row; a reversible card gives a second row the other way round."""
    front, back = tsv_field(F.col("front")), tsv_field(F.col("back"))
    tags = F.array_join(all_tags(F.col("tags"), F.col("bloom_level"), extra), " ")
    one, two = F.concat_ws("\t", front, back, tags), F.concat_ws("\t", back, front, tags)
    rows = F.when(F.col("card_type") == "reversible", F.array(one, two)).otherwise(F.array(one))
    return cards.select("source_file", "card_idx", F.posexplode(rows).alias("row_idx", "row"))


def tsv_documents(cards: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """K1: source_file and its whole file as one string, without a newline at the end."""
    ordered = F.sort_array(F.collect_list(F.struct("card_idx", "row_idx", "row")))
    met = tsv_rows(cards, extra).groupBy("source_file").agg(ordered.alias("rows"))
    return met.select("source_file", F.concat(F.lit(TSV_HEADER), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("tsv"))


def json_documents(cards: DataFrame, model_used: str, generated_at: str | None = None) -> DataFrame:
    """source_file and its cards as a JSON document with metadata; nulls are written."""
    met = cards.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("card_idx", F.struct(*CARD_FIELDS).alias("card")))).alias("c"))
    document = F.struct("source_file", F.transform("c", lambda x: x["card"]).alias("cards"), *json_meta(model_used, generated_at))
    return met.select("source_file", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def json_meta(model_used: str, generated_at: str | None = None) -> list[Column]:
    """What follows the cards of a JSON document: model_used and _meta."""
    stamp = generated_at or datetime.now(UTC).isoformat()
    meta = F.struct(F.lit(JSON_VERSION).alias("schema_version"), F.lit(stamp).alias("generated_at"))
    return [F.lit(model_used).alias("model_used"), meta.alias("_meta")]


def notes(cards: DataFrame, deck: str, models: dict[str, str] | None = None) -> DataFrame:
    """source_file, card_idx, note."""
    names = models or NOTE_MODELS
    model = F.when(F.col("card_type") == "cloze", names["cloze"]).when(F.col("card_type") == "reversible", names["reversible"]).otherwise("Basic")
    cloze = F.create_map(F.lit("Text"), "front", F.lit("Extra"), "back")
    other = F.create_map(F.lit("Front"), "front", F.lit("Back"), "back")
    note = F.struct(
        F.lit(deck).alias("deckName"),
        model.alias("modelName"),
        F.when(F.col("card_type") == "cloze", cloze).otherwise(other).alias("fields"),
        all_tags(F.col("tags"), F.col("bloom_level")).alias("tags"),
        F.struct(F.lit(False).alias("allowDuplicate")).alias("options"),
    )
    return cards.select("source_file", "card_idx", note.alias("note"))


def push_report(results: DataFrame) -> DataFrame:
    """Total, added, failed and errors from position (from 0) and note_id (null: failed)."""
    failed = F.when(F.col("note_id").isNull(), F.struct("position", F.concat(F.lit("Card "), (F.col("position") + 1).cast("string"), F.lit(" failed to add")).alias("said")))
    rows = results.agg(F.count("*").alias("total"), F.count("note_id").alias("added"), F.sort_array(F.collect_list(failed)).alias("e"))
    return rows.select("total", "added", (F.col("total") - F.col("added")).alias("failed"), F.transform("e", lambda x: x["said"]).alias("errors"))


class PushError(RuntimeError):
    """The note service answered with an error, or isn't on this machine."""


class NoteService:
    """A note service on this machine; send(action, params) is injected and returns its answer as a dict."""

    def __init__(self, send: Callable[[str, dict], dict], host: str = "localhost"):
        if host not in ("localhost", "127.0.0.1", "::1"):
            raise PushError(f"{host} is not this machine")
        self.send = send

    def call(self, action: str, **params):
        answer = self.send(action, {"action": action, "version": 6, "params": params})
        if answer.get("error"):
            raise PushError(str(answer["error"]))
        return answer.get("result")

    def running(self) -> bool:
        try:
            return self.call("version") is not None
        except (PushError, OSError):
            return False

    def push(self, noted: DataFrame, deck: str, size: int = 500) -> dict:
        """Adds the notes, `size` at a time, in order; nothing is sent if there are none."""
        position, added, errors, started = 0, 0, [], False
        for block in _blocks(noted.orderBy("source_file", "card_idx").select("note").toLocalIterator(), size):
            if not started:
                self.call("createDeck", deck=deck)
                started = True
            answers = self.call("addNotes", notes=[row.note.asDict(recursive=True) for row in block])
            for answer in answers:
                position += 1
                if answer is None:
                    errors.append(f"Card {position} failed to add")
                else:
                    added += 1
        return {"total": position, "added": added, "failed": len(errors), "errors": errors}


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def resolve_output(source: str, out: str | None, fmt: str, is_dir: bool = False) -> Path:
    """K9: an explicit place wins; a folder of sources writes to output/ beside it; both forms go to the parent folder."""
    if out:
        return Path(out)
    path = Path(source)
    if is_dir:
        return path.parent / "output"
    return path.parent if fmt == "both" else path.with_suffix(f".{fmt}")


def _places(sources: list[str]) -> dict[str, str]:
    """Where each source's output goes, without its suffix: its stem, or as much of its path as tells it from the others."""
    out, left = {}, sources
    for name in (lambda p: p.stem, lambda p: str(_below(p, sources).with_suffix("")), lambda p: str(_below(p, sources))):
        named = {s: name(PurePosixPath(s)) for s in left}
        times = Counter([*named.values(), *out.values()])
        out |= {s: n for s, n in named.items() if times[n] == 1}
        left = [s for s in left if s not in out]
    return out | {s: str(_below(PurePosixPath(s), sources)) for s in left}


def _below(path: PurePosixPath, sources: list[str]) -> PurePosixPath:
    top = os.path.commonpath([str(PurePosixPath(s).parent) for s in sources])
    return path.relative_to(top) if top else PurePosixPath(str(path).lstrip("/"))


def write_documents(documents: DataFrame, column: str, folder: str, suffix: str) -> list[Path]:
    """K6, K8: one file for each source on the driver's disk, written over what is there; for small results (sources.sink has tasks write).

    Sources with one stem keep the folders below the one that they share, so none replaces another; those
    that differ in their suffix alone keep it.
    """
    sources = [r.source_file for r in documents.select("source_file").distinct().toLocalIterator()]
    places = _places(sources)
    made = []
    for row in documents.select("source_file", column).toLocalIterator():
        path = Path(folder, places[row.source_file] + f".{suffix}")
        path.parent.mkdir(parents=True, exist_ok=True)
        text = row[column]
        if suffix == "json":
            text = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        path.write_text(text, encoding="utf-8", newline="")
        made.append(path)
    return made


def write_media(images: DataFrame, folder: str) -> list[Path]:
    """K7: image_bytes under name in folder; empty ones are left out."""
    made = []
    for row in images.where(F.octet_length("image_bytes") > 0).select("name", "image_bytes").toLocalIterator():
        path = Path(folder, row.name)
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(bytes(row.image_bytes))
        made.append(path)
    return made


def metrics_json(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """One JSON document of the metrics and the counts of each case."""
    listed = cases.agg(F.sort_array(F.collect_list(F.struct("case_id", "n_matched", "n_expected", "n_generated"))).alias("cases"))
    return metrics.crossJoin(listed).select(F.to_json(F.struct(F.struct(*[F.col(c) for c in metrics.columns]).alias("metrics"), "cases")).alias("json"))  # one row by one row
