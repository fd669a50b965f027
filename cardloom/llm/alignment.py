"""Aligns the tokens of two tokenizers: a byte-level one (A) and a word-piece one that marks spaces (B).

Texts are cut before each space that follows something else than white space.  Tokens of both end there,
whatever stands around: A splits texts there before it merges, and no piece of B goes on after a space.  So
what lies between two cuts is a unit that is tokenised, and aligned, alike wherever it stands.  A block of
texts (about SCOPE bytes, taken BLOCK bytes at a time) names each of its units once, and the corpus aligns
each unit once.

All else is relational.  Tokens of a chunk of units are exploded with their places, running sums of their
lengths give where they end, an equi-join on chunk and end finds the cuts, running counts of cuts give the
groups, links are counted by their pair of ids, and a join brings the figures back to the units of each block:
packed by block before they are sent, as that is a third of their size as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import discard, lean, remove, settle, text_of, work_path
from cardloom.llm.pieces import SPACE, PieceEncoder, byte_classes, byte_letters, library_encoder, locate, piece_keys, text_chunks

#: Bytes of text that a worker takes at a time, those in a block (one such part more at most), and units in a chunk.
BLOCK, SCOPE, CHUNK = 1 << 22, 3 << 23, 1 << 15
#: Lets a join on (chunk, end) use rows that are partitioned by chunk; lists of several keys are sorted, as a task can't hold them all.
SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1",
    "spark.sql.parquet.compression.codec": "zstd",
}
#: Row groups of few rows where rows are large, as a reader takes up to a row group at a time.
LARGE_ROWS = {"parquet.block.size": str(1 << 24), "parquet.block.size.row.check.min": "1"}
#: Figures of a unit that its text adds up, and rows that a worker packs at a time.
FIGURES = ("n_a", "n_best", "count_sum")
PACK = 1 << 19
MARK = "▁"
UNIT = pa.struct([("unit", pa.string()), ("times", pa.int64())])
DOC = pa.struct([("doc_id", pa.int64()), ("units", pa.list_(pa.int32()))])
TOKEN = pa.struct([("id", pa.int32()), ("size", pa.int32()), ("number", pa.int32())])


class Aligner:
    """Tokens of both tokenizers for units, which begin with a space; kept for the life of a Python worker."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a: PieceEncoder = library_encoder(a, bits=17, specials=False)
        self.b = SentencePieceProcessor(model_file=locate(b))
        value = {c: i for i, c in enumerate(byte_letters())}
        entries = [x for x in Tokenizer.from_file(locate(a)).get_vocab(with_added_tokens=False).items() if all(c in value for c in x[0])]
        self.a_bytes = dict.fromkeys(range(1 + max(i for _, i in entries)), b"") | {i: bytes(value[c] for c in entry) for entry, i in entries}
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[1:-1], 16)]))
                continue
            if MARK in piece.lstrip(MARK) and not self.b.is_control(i):
                raise ValueError(f"piece {i} goes on after a space, so texts can't be cut at spaces")
            self.b_bytes.append(piece.replace(MARK, " ").encode())
        self.lone = self.b.piece_to_id(MARK)
        self.sizes = [np.array([len(x) for x in values], np.int32) for values in (self.a_bytes.values(), self.b_bytes)]

    def tokens(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: all ids of the units, and where those of each start and end.  Raises where they don't spell a unit."""
        data = [u.encode() for u in units]
        a, bound = self.a.ids(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
        # B puts a space before what it is given, unless that is nothing.
        pieces = [ids or [self.lone] for ids in self.b.encode([u[1:] for u in units], num_threads=1)]
        b = np.fromiter((i for ids in pieces for i in ids), np.int64)
        found = [(a.astype(np.int64), bound), (b, np.concatenate([[0], np.cumsum([len(x) for x in pieces])]))]
        for values, (ids, at) in zip((self.a_bytes, self.b_bytes), found, strict=True):
            ids, at = ids.tolist(), at.tolist()
            if b"".join(values[i] for i in ids) != b"".join(data):
                bad = next(u for u, s, e, x in zip(units, at[:-1], at[1:], data, strict=True) if b"".join(values[i] for i in ids[s:e]) != x)
                raise ValueError(f"a tokenizer that rewrites texts: its tokens don't spell {bad!r}")
        return found


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def unit_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of the texts start; each text that isn't empty begins with a space."""
    start = np.zeros(len(buf), bool)
    if len(buf):
        start[1:] = (buf[1:] == 0x20) & (byte_classes(buf)[:-1] != SPACE)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def _spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty and doesn't hold MARK, which B reads as a space; those are emptied."""
    size = np.diff(offsets)
    lead, middle, last = MARK.encode()
    marks = np.flatnonzero((buf[:-2] == lead) & (buf[1:-1] == middle) & (buf[2:] == last)) if len(buf) > 2 else np.empty(0, np.int64)
    if len(marks):
        out = np.unique(np.searchsorted(offsets, marks, "right") - 1)
        gone = np.zeros(len(size), bool)
        gone[out] = True
        buf = buf[~np.repeat(gone, size)]
        size = np.where(gone, 0, size)
    some = size > 0
    bound = np.concatenate([[0], np.cumsum(size + some)])
    spaced = np.empty(int(bound[-1]), np.uint8)
    text = np.ones(len(spaced), bool)
    first = bound[:-1][some]
    text[first] = False
    spaced[first], spaced[text] = 0x20, buf
    return spaced, bound


def _lists(count: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values)


def _structs(kind: pa.StructType, *columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns), fields=list(kind))


def _same(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct pair of keys, and which of them each pair is."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    if (more != more[first][back]).any():  # the same 64 bits for two units: all 128 tell them apart
        _, first, back = np.unique(np.stack([keys, more], 1), axis=0, return_index=True, return_inverse=True)
    return first, back.ravel()


class Part(NamedTuple):
    """Texts of a block: their ids and numbers of units; the distinct units, their keys and texts, and which each unit is."""

    ids: pa.Array
    size: np.ndarray
    keys: np.ndarray
    more: np.ndarray
    said: pa.Array
    unit: np.ndarray


def _part(ids: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> Part:
    buf, offsets = _spaced(buf, offsets)
    start = unit_starts(buf, offsets)
    end = np.append(start[1:], len(buf))[: len(start)]
    keys, more = (piece_keys(buf, start, end, salt) for salt in (0, 1))
    first, unit = _same(keys, more)
    said = pa.array([buf[s:e].tobytes() for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
    return Part(ids, np.diff(np.searchsorted(start, offsets)), keys[first], more[first], said, unit.astype(np.int32))


def _block(number: int, parts: list[Part]) -> Iterator[pa.RecordBatch]:
    """A row for each part; the first has the units of all, the most frequent ones first."""
    first, back = _same(np.concatenate([p.keys for p in parts]), np.concatenate([p.more for p in parts]))
    bound = np.cumsum([0] + [len(p.keys) for p in parts])
    times = np.zeros(len(first), np.int64)
    for p, a, b in zip(parts, bound[:-1], bound[1:], strict=True):
        times[back[a:b]] += np.bincount(p.unit, minlength=b - a)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    units = _structs(UNIT, pa.concat_arrays([p.said for p in parts]).take(pa.array(first[order])), pa.array(times[order]))
    for p, a, b in zip(parts, bound[:-1], bound[1:], strict=True):
        docs = _structs(DOC, p.ids, _lists(p.size, pa.array(rank[back[a:b]][p.unit])))
        yield pa.record_batch([pa.array([number], pa.int64()), _lists(np.array([len(docs)]), docs), _lists(np.array([len(units)]), units)], ["block", "docs", "units"])
        units = units.slice(0, 0)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, docs (doc_id, numbers of their units), units (and how often each occurs) for texts (doc_id, text)."""
    number, parts, size = TaskContext.get().partitionId() << 32, [], 0
    for ids, texts in _gathered(batches):
        for a, b, buf, offsets in text_chunks(texts, BLOCK):
            parts.append(_part(ids.slice(a, b - a), buf, offsets))
            size += len(buf)
            if size >= SCOPE:
                yield from _block(number, parts)
                number, parts, size = number + 1, [], 0
        pa.default_memory_pool().release_unused()
    if parts:
        yield from _block(number, parts)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """ids and texts of at least BLOCK bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held)
    return table.column(0).combine_chunks(), table.column(1).cast(pa.large_string()).combine_chunks()


def chunks(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """chunk, units, a, b (tokens with their size in bytes and the number of their unit in units) for units (unit, times)."""
    held, number = aligner(a, b), TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.slice(at, CHUNK)
            sides = []
            for (ids, bound), sizes in zip(held.tokens(part.column(0).to_pylist()), held.sizes, strict=True):
                of = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(bound))
                sides.append(_lists(np.array([len(ids)]), _structs(TOKEN, pa.array(ids.astype(np.int32)), pa.array(sizes[ids]), pa.array(of))))
            units = _lists(np.array([len(part)]), _structs(UNIT, part.column(0), part.column(1)))
            yield pa.record_batch([pa.array([number], pa.int64()), units, *sides], ["chunk", "units", "a", "b"])
            number += 1


BLOCKS = "block long, docs array<struct<doc_id: long, units: array<int>>>, units array<struct<unit: string, times: long>>"
TOKENS = "array<struct<id: int, size: int, number: int>>"
PACKS = "block long, n long, size long, pack binary"
LOOKED_UP = "doc_id long, n_a long, n_best long, count_sum long, n_b long, n_groups long, groups string"
CHUNKS = f"chunk long, units array<struct<unit: string, times: long>>, a {TOKENS}, b {TOKENS}"


def _ends(made: DataFrame, side: str) -> DataFrame:
    """chunk, end, and the unit's number and id of each token of one tokenizer."""
    rows = made.select("chunk", F.posexplode(side).alias("place", "t"))
    w = Window.partitionBy("chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("chunk", F.sum("t.size").over(w).alias("end"), F.col("t.number").alias(f"number_{side}"), F.col("t.id").alias(side))


def _said(tokens: Column, side: str) -> Column:
    """The units' ids of one tokenizer, from (end, number, group, a, b) in this order: 1,2;3 by group, a line for each unit."""

    def one(t: Column, x: Column, i: Column) -> Column:
        before = t[F.greatest(i - 1, F.lit(0))]
        mark = F.when(i == 0, "").when(before["number"] != x["number"], "\n").when(before["group"] != x["group"], ";").otherwise(",")
        return F.concat(mark, x[side].cast("string"))

    mine = F.filter(tokens, lambda x: x[side].isNotNull())
    # An array of one binds the tokens, so that they are picked once.
    return F.split(F.transform(F.array(mine), lambda t: F.array_join(F.transform(t, lambda x, i: one(t, x, i)), ""))[0], "\n")


def cut_up(made: DataFrame) -> DataFrame:
    """chunk, end, number (of the unit), a, b, group of each place of the chunks where a token ends.

    a, b: the ids of the tokens that end there, or null; group: how many cuts lie before, by chunk.
    """
    made = made.repartition("chunk")
    w = Window.partitionBy("chunk").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.coalesce(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).over(w), F.lit(0))
    ends = _ends(made, "a").join(_ends(made, "b"), ["chunk", "end"], "full")
    return ends.select("chunk", "end", F.coalesce("number_a", "number_b").alias("number"), "a", "b", cuts.alias("group"))


def spelt(places: DataFrame) -> DataFrame:
    """chunk, number, groups, n_a of each unit."""
    tokens = F.sort_array(F.collect_list(F.struct("end", "number", "group", "a", "b")))
    units = places.groupBy("chunk").agg(tokens.alias("t")).select("chunk", F.arrays_zip(_said(F.col("t"), "a").alias("a"), _said(F.col("t"), "b").alias("b")).alias("z"))
    units = units.select("chunk", F.posexplode("z").alias("number", "z")).select("chunk", "number", F.split("z.a", ";").alias("a"), F.split("z.b", ";").alias("b"))
    groups = F.array_join(F.zip_with("a", "b", lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    return units.select("chunk", "number", groups.alias("groups"), F.size(F.split(F.array_join("a", ","), ",")).alias("n_a"))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, n, size, pack: the n units of a block among up to PACK rows (block, number, FIGURES, groups), as compressed columns."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= PACK:
            yield _packs(held)
            held, rows = [], 0
    if rows:
        yield _packs(held)


def _packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("number", "ascending")])
    block = table.column("block").to_numpy()
    start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    bound, size, packs = np.append(start, len(block)), [], []
    values = [table.column(c).to_numpy().astype("<i8") for c in ("number", *FIGURES)]
    said = table.column("groups").combine_chunks()
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        data = b"".join([*(v[a:b].tobytes() for v in values), "\n".join(said.slice(a, b - a).to_pylist()).encode()])
        size.append(len(data))
        packs.append(pa.compress(data, codec="zstd", asbytes=True))
    return pa.record_batch([pa.array(block[start]), pa.array(np.diff(bound)), pa.array(size, pa.int64()), pa.array(packs, pa.binary())], ["block", "n", "size", "pack"])


class Table(NamedTuple):
    """The units of a block by their number: FIGURES, n_b and n_groups in columns, and groups."""

    figures: np.ndarray
    groups: pa.Array


def _table(packs: list[tuple[int, int, bytes]]) -> Table:
    columns, said = [], []
    for n, size, pack in packs:
        data = pa.decompress(pack, decompressed_size=size, codec="zstd", asbytes=True)
        end = 8 * n * (1 + len(FIGURES))
        columns.append(np.frombuffer(data[:end], "<i8").reshape(1 + len(FIGURES), n))
        said.append(pa.array(data[end:].decode().split("\n"), pa.large_string()))
    both, groups = np.concatenate(columns, 1), pa.concat_arrays(said)
    order = np.argsort(both[0])
    both, groups = both[1:, order], groups.take(pa.array(order))
    # A group ends with a link, and has a comma between any two tokens of one side.
    n_groups, commas = (pc.count_substring(groups, mark).to_numpy(zero_copy_only=False).astype(np.int64) for mark in "|,")
    return Table(np.stack([*both, commas + 2 * n_groups - both[0], n_groups]), groups)


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, FIGURES, n_b, n_groups and groups of texts; a block's packs come before its docs."""
    block, packs, table = None, [], None
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            number, n, size, pack = (row.column(k)[0].as_py() for k in range(4))
            if number != block:
                block, packs, table = number, [], None
            if pack is not None:
                packs.append((n, size, pack))
                continue
            if table is None:
                table = _table(packs) if packs else Table(np.zeros((len(FIGURES) + 2, 0), np.int64), pa.array([], pa.large_string()))
                packs = []
            docs = row.column(4).flatten()
            units = docs.field(1)
            at = units.offsets.to_numpy().astype(np.int64)
            at, which = at - at[0], units.flatten()
            added = [np.diff(np.append(0, np.cumsum(f[which.to_numpy()]))[at]) for f in table.figures]
            groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), table.groups.take(which)), pa.scalar(";", pa.large_string()))
            yield pa.record_batch([docs.field(0), *map(pa.array, added), groups.cast(pa.string())], ["doc_id", *FIGURES, "n_b", "n_groups", "groups"])
        pa.default_memory_pool().release_unused()


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    a: a byte-level vocabulary of the tokenizers library, which gets the text with a space before it; b: a
    sentencepiece model that adds that space itself.  Strings of special tokens are plain text.  Offsets
    (in bytes) at which tokens of both end cut them into groups, given as `a1,a2|b1;a3|b2,b3` by their
    ids.  A link is a pair of tokens that end together; the count of a pair of ids is the number of such links
    in all docs.  n_best: links whose count is the highest of their id of b, ties included; count_sum: sum
    of the counts.  Null and empty texts, and those that b can't spell (with U+2581, which it reads as a
    space), have no tokens: zeros, and no groups; a b that rewrites other texts is refused.  Rows that repeat,
    or share a doc_id, or have a null one, are texts of their own; other columns are ignored; an empty table
    gives no rows.

    The units of a block are one row, its texts, or a single longer one, are rows of BLOCK bytes, so a task holds
    about ten bytes for each byte of such a row, and five for each of a block.  Figures come back in packs, up to one for
    each block and PACK rows of a task, and a worker holds those of one block.  A unit (a stretch without a space) goes to the tokenizers whole.  A hot
    unit has one row for each block, a hot pair of ids one for each unit that holds it, and what is left of both
    is split as skewed joins are.  Runs jobs when it is called; the result reads two of the folders they write.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    made, _ = _written(texts.mapInArrow(blocks, BLOCKS), "blocks", LARGE_ROWS)
    units = made.select("block", F.posexplode("units").alias("number", "u"))
    distinct = units.groupBy("u.unit").agg(F.sum("u.times").alias("times"))
    chunked, first = _written(distinct.mapInArrow(partial(chunks, a=a, b=b), CHUNKS), "chunks", LARGE_ROWS)
    places, second = _written(cut_up(chunked), "places")

    named = chunked.select("chunk", F.posexplode("units").alias("number", "u")).select("chunk", "number", "u.*")
    links = places.where("a is not null and b is not null").select("chunk", "number", "a", "b")
    pairs = settle(links.join(named, ["chunk", "number"]).groupBy("a", "b").agg(F.sum("times").alias("count")), SETTINGS)
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    ranked = pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    counted = links.join(ranked, ["a", "b"]).groupBy("chunk", "number").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    counted, third = _written(counted, "counts")
    discard(pairs)
    figures = named.join(spelt(places), ["chunk", "number"]).join(counted, ["chunk", "number"])
    figures, fourth = _written(figures.select("unit", *FIGURES, "groups"), "figures")
    for path in (first, second, third):
        remove(spark, path)

    # The texts of a block look their units up by number.
    rows = units.select("block", "number", "u.unit").join(figures, "unit").select("block", "number", *FIGURES, "groups")
    packs, _ = _written(rows.mapInArrow(packed, PACKS), "packs")
    remove(spark, fourth)
    sent = made.select("block", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("pack"), "docs")
    sent = packs.withColumn("docs", F.lit(None).cast(sent.schema["docs"].dataType)).unionByName(sent)
    rows = sent.repartition("block").sortWithinPartitions("block", F.col("docs").isNotNull()).mapInArrow(looked_up, LOOKED_UP)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")


def _written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """The rows as a folder of Parquet files in the shared folder, read again, and that folder."""
    path = work_path(df.sparkSession, f"alignment-{name}")
    lean(df, SETTINGS).write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
