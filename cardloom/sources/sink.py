"""Files written by tasks: a Spark data source whose rows are pieces of files, with commit and abort.

Rows (place, kind, text or content) come sorted; each task writes the pieces of each file that it holds as a
part in a folder of its own attempt.  Only parts that a finished task has reported count, so a task that
runs twice leaves one file.  The commit moves a part to its place; where a range boundary cuts a file, its
parts are copied one after the other, in the order of the tasks, never held whole.  Until then no file at
a place changes, and a job that fails leaves none of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cardloom.operators.export import TSV_HEADER, json_meta, tsv_rows
from cardloom.schemas import CARD_FIELDS

NAME = "cardloom_files"
HEAD, BODY, FOOT = 0, 1, 2
#: Bytes that a commit copies at a time, and files that it moves at a time.
COPIED, MOVED = 1 << 22, 16
#: What goes between two pieces of a body, by format.
GLUE = {"tsv": b"\n", "json": b",\n", "media": b""}


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, and the folder there."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


@dataclass
class Part:
    """What one task wrote of one file, and the kinds of its first and last piece."""

    place: str
    path: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    task: int
    parts: list[Part]


def piece(form: str, kind: int, value: str | bytes) -> bytes:
    """The bytes of a row: those of a JSON document are indented, as parts of one document."""
    if form != "json":
        return value if isinstance(value, bytes) else value.encode()
    said = json.dumps(json.loads(value), ensure_ascii=False, indent=2)
    if kind == HEAD:
        return (said.removesuffix("\n}") + ',\n  "cards": [\n').encode()
    if kind == FOOT:
        return ("\n  ]," + said.removeprefix("{")).encode()
    return ("    " + said.replace("\n", "\n    ")).encode()


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.form = options["path"], options["form"]
        self.scratch = f"{self.folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """The parts of a task; rows of one place have to follow each other."""
        store, scratch = opened(self.scratch)
        task = TaskContext.get().partitionId()
        mine, parts, out = f"{scratch}/{task}-{uuid.uuid4().hex}", [], None
        try:
            for batch in iterator:
                for place, kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not parts or parts[-1].place != place or self.form == "media":
                        if not parts:
                            store.create_dir(mine)
                        if out:
                            out.close()
                        parts.append(Part(place, f"{mine}/{len(parts)}", kind, kind))
                        out = store.open_output_stream(parts[-1].path)
                    elif parts[-1].last == kind == BODY:
                        out.write(GLUE[self.form])
                    out.write(piece(self.form, kind, value))
                    parts[-1].last = kind
        finally:
            if out:
                out.close()
        return Written(task, parts)

    def commit(self, messages: list[Written | None]) -> None:
        """Every file at its place, over what was there.  Names are checked before the first one moves."""
        files: dict[str, list[Part]] = {}
        for done in sorted((m for m in messages if m), key=lambda m: m.task):
            for part in done.parts:
                files.setdefault(part.place, []).append(part)
        for place, parts in files.items():
            if PurePosixPath(place).is_absolute() or ".." in PurePosixPath(place).parts:
                self.abort(messages)
                raise ValueError(f"{place!r} lies outside the folder")
            if self.form == "media" and len(parts) > 1:
                self.abort(messages)
                raise ValueError(f"{len(parts)} files are named {place!r}")
        store, top = opened(self.folder)
        for below in {str(PurePosixPath(top, place).parent) for place in files}:
            store.create_dir(below)

        def put(place: str) -> None:
            parts = files[place]
            if len(parts) > 1:
                self._join(store, parts)
            store.move(parts[0].path, str(PurePosixPath(top, place)))

        with ThreadPoolExecutor(MOVED) as pool:
            list(pool.map(put, files))
        self.abort(messages)

    def _join(self, store: fs.FileSystem, parts: list[Part]) -> None:
        joined = parts[0].path + "-joined"
        with store.open_output_stream(joined) as out:
            for before, part in zip([None, *parts], parts, strict=False):
                if before and before.last == part.first == BODY:
                    out.write(GLUE[self.form])
                with store.open_input_stream(part.path) as given:
                    while block := given.read(COPIED):
                        out.write(block)
        parts[0].path = joined

    def abort(self, messages: list[Written | None]) -> None:
        """What the tasks wrote goes."""
        store, scratch = opened(self.scratch)
        if store.get_file_info(scratch).type == fs.FileType.Directory:
            store.delete_dir(scratch)


class Files(DataSource):
    """Options: path, a folder that all executors reach, and form: tsv, json or media."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def places(sources: DataFrame) -> DataFrame:
    """source_file, place: where the output of each distinct source goes, without the format's suffix.

    The first of these that no other source may take too: the stem; the path below the folder that all
    share, without its suffix; that path whole, which is a source's own.
    """
    path, parent = F.col("source_file"), F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1)
    named = sources.select("source_file").distinct().withColumn("folders", F.when(path.contains("/"), F.split(parent, "/")).otherwise(F.array().cast("array<string>")))
    # The first and the last folder, in order, share what all do.
    ends = named.agg(F.min("folders").alias("x"), F.max("folders").alias("y"))
    same = F.zip_with("x", "y", lambda x, y: x.eqNullSafe(y))
    shared = ends.select(F.coalesce(F.array_position(F.transform(same, lambda s: s.cast("int")), 0), F.lit(0)).alias("at"), F.size("x").alias("n"))
    shared = shared.select(F.when(F.col("at") == 0, F.col("n")).otherwise(F.col("at") - 1).cast("int").alias("depth"))
    suffix = r"(?<=[^/])\.[^./]+$"
    below = F.regexp_replace(F.array_join(F.slice(F.split(path, "/"), F.col("depth") + 1, F.size(F.split(path, "/"))), "/"), "^/+", "")
    choices = F.array(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), suffix, ""), F.regexp_replace(below, suffix, ""), below)
    listed = named.crossJoin(shared).select("source_file", choices.alias("choices"))  # one row
    each = listed.select("source_file", F.posexplode("choices").alias("k", "place"))
    free = each.groupBy("place").agg(F.countDistinct("source_file").alias("takers"))
    best = each.join(free, "place").where("takers = 1 OR k = 2").groupBy("source_file").agg(F.min(F.struct("k", "place")).alias("b"))
    return best.select("source_file", "b.place")


def _put(pieces: DataFrame, folder: str, form: str) -> None:
    pieces.sparkSession.dataSource.register(Files)
    pieces.write.format(NAME).option("form", form).mode("append").save(folder)


def write_cards(cards: DataFrame, folder: str, form: str, model_used: str = "", generated_at: str | None = None, extra: list[str] | None = None) -> None:
    """K1, K5, K6, K8: a file for each source with cards, as tsv, json or both, written by many tasks.

    cards: source_file, card_idx and the fields of cards.  The files hold what export.write_documents() writes,
    in as many tasks as the rows have ranges, however many of them are one source's; the names are those of places().
    """
    if form == "both":
        for one in ("tsv", "json"):
            write_cards(cards, folder, one, model_used, generated_at, extra)
        return
    _put(card_pieces(cards, form, model_used, generated_at, extra), folder, form)


def card_pieces(cards: DataFrame, form: str, model_used: str = "", generated_at: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """place, kind, text of the files of write_cards(), dealt to ranges and sorted; form: tsv or json."""
    if form == "tsv":
        body = tsv_rows(cards, extra).withColumnRenamed("row", "text")
        ends = [(HEAD, F.lit(TSV_HEADER))]
    else:
        body = cards.select("source_file", "card_idx", F.lit(0).alias("row_idx"), _json(*[F.col(c) for c in CARD_FIELDS]).alias("text"))
        ends = [(HEAD, _json(F.col("source_file"))), (FOOT, _json(*json_meta(model_used, generated_at)))]
    named = places(cards)
    edges = named.select("source_file", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), text.alias("text")) for k, text in ends])).alias("e"))
    edges = edges.select("source_file", "e.kind", F.lit(-1).alias("card_idx"), F.lit(0).alias("row_idx"), "e.text")
    pieces = body.select("source_file", F.lit(BODY).alias("kind"), "card_idx", "row_idx", "text").unionByName(edges).join(named, "source_file")
    order = ["place", "kind", "card_idx", "row_idx"]
    dealt = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select(F.concat("place", F.lit(f".{form}")).alias("place"), "kind", "text")


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_media(images: DataFrame, folder: str) -> None:
    """K7, P10: image_bytes under name in folder, by the tasks that hold them; empty ones are left out.

    A name that occurs twice, or leads out of the folder, is refused, and then nothing is written.
    """
    _put(images.where(F.octet_length("image_bytes") > 0).select(F.col("name").alias("place"), F.lit(BODY).alias("kind"), F.col("image_bytes").alias("content")), folder, "media")
