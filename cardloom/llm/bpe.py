"""Byte-level BPE by DuckDB recursive queries, one database per partition.

Encoding: a piece (a match of the splitting pattern) is a run of token-position rows.  Each step joins
adjacent rows with the merge table, contracts the leftmost pair of lowest rank of every piece, and stops
at the fixpoint.  Pieces repeat, so each distinct piece of a partition is encoded once and texts gather
their ids from it.  Decoding joins ids with the vocabulary and aggregates their bytes in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import text_of
from cardloom.llm.pieces import CHUNK, PieceEncoder, locate, segments, text_chunks

#: Pieces of one recursive query; bounds its rows.
BLOCK = 20_000
#: Tokens of one decoding query; a longer sequence is joined from several.
TOKENS = 1 << 19
MEMORY = "256MB"

# Rows: (piece, pos, id, done).  A step gives each piece its lowest rank at its leftmost place, drops the row
# after that place and renames the row there; the rows of a piece without a pair come out once more as done.
ENCODE = """
WITH RECURSIVE steps(piece, pos, id, done) AS (
    SELECT piece, pos, id, false FROM tokens
    UNION ALL
    (WITH paired AS (
        SELECT piece, pos, s.id, merges.id * 4294967296 + pos AS pick, next_pos
        FROM (
            SELECT piece, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos
            FROM steps WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)
        ) s LEFT JOIN merges ON merges.a = s.id AND merges.b = s.next_id
    ), best AS (
        SELECT piece, min(pick) AS pick, arg_min(next_pos, pick) AS gone FROM paired GROUP BY piece
    )
    SELECT piece, pos, CASE WHEN pos = best.pick % 4294967296 THEN best.pick // 4294967296 ELSE id END, best.pick IS NULL
    FROM paired JOIN best USING (piece) WHERE best.pick IS NULL OR pos <> gone)
)
SELECT piece, list(id ORDER BY pos) AS ids FROM steps WHERE done GROUP BY piece
"""

# The bytes of a token are held as the text of the code points of the same numbers; MARK, which no byte gives, ends a sequence.
DECODE = "SELECT string_agg(text, '' ORDER BY pos) FROM tokens JOIN vocabulary USING (id)"
MARK, MARK_ID = "\u0100", -1


def load_ranks(path: str) -> dict[bytes, int]:
    """token -> rank, from lines of base64 and rank."""
    with open(locate(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, id of both) for each way in which a token joins two others."""
    return [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


class Merger:
    """A DuckDB database with the merge table and the vocabulary."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        a, b, c = np.array(merge_rows(self.ranks), np.int64).reshape(-1, 3).T
        merges = pa.table({"a": a, "b": b, "id": c})
        vocabulary = pa.table({"id": pa.array([*self.ranks.values(), MARK_ID], pa.int32()), "text": [*(t.decode("latin-1") for t in self.ranks), MARK]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for a in range(0, len(pieces), BLOCK):
            block = pieces[a : a + BLOCK]
            size = np.fromiter(map(len, block), np.int64, len(block))
            first = np.cumsum(size) - size
            tokens = pa.table({
                "piece": np.repeat(np.arange(len(block)), size),
                "pos": np.arange(int(size.sum())) - np.repeat(first, size),
                "id": self.single[np.frombuffer(b"".join(block), np.uint8)],
            })
            self.db.register("tokens", tokens)
            found = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("tokens")
            ids = [[]] * len(block)
            for piece, x in zip(found["piece"].to_pylist(), found["ids"].to_pylist(), strict=True):
                whole = self.ranks.get(block[piece])  # a piece that is a token stays whole, even if no merges lead to it
                ids[piece] = x if whole is None else [whole]
            out += ids
        return out

    def decode(self, ids: np.ndarray, bound: np.ndarray) -> list[bytes]:
        """The bytes of each sequence ids[bound[i] : bound[i + 1]].  An unknown id raises ValueError."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.ranks)):
            raise ValueError("an id that the vocabulary lacks")
        marked, texts = np.insert(ids.astype(np.int32), bound[1:], MARK_ID), []
        for a in range(0, len(marked), TOKENS):
            part = marked[a : a + TOKENS]
            self.db.register("tokens", pa.table({"pos": np.arange(len(part), dtype=np.int32), "id": part}))
            texts += self.db.sql(DECODE).fetchall()[0]
            self.db.unregister("tokens")
        return [x.encode("latin-1") for x in "".join(texts).split(MARK)[:-1]]


@cache
def merger(path: str) -> Merger:
    return Merger(path)


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(merger(path).encode)


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids (array of int) of every text.

    ranks: a rank file, by its path or its name among the public tokenizers.  Null texts count as empty and give no ids; every row is a text of its own, so
    repeated and null doc_ids are kept; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(1)):
                ids, bound = piece_encoder(ranks).ids(buf, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0)[a:b], lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, bytes of every row of doc_id, ids; null or empty ids give no bytes, unknown ids an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                lists = part.column(1)
                bound = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                yield pa.record_batch([part.column(0), pa.array(merger(ranks).decode(lists.flatten().to_numpy(zero_copy_only=False), bound), pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids as decimals joined by commas, and the bytes that the ids decode to, of every text.

    Both steps run where the text is, so no ids are shuffled; the bytes come from the text's whole sequence of
    ids, by the same ordered aggregation as decode().  Nulls and the rest as for encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(1)):
                count, texts, raw = _trip(ranks, buf, offsets)
                yield pa.record_batch([batch.column(0)[a:b], pa.array(count, pa.int64()), pa.array(texts, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, bytes binary")


@cache
def _decimals(ranks: str) -> list[str]:
    return [str(i) for i in range(len(merger(ranks).ranks))]


def _trip(ranks: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """Tokens, decimal ids and decoded bytes of each text; a long one goes through in segments."""
    if len(offsets) == 2 and len(buf) > 2 * CHUNK:
        count, texts, raw = zip(*(_part(ranks, buf[a:b], np.array([0, b - a])) for a, b in segments(buf)), strict=True)
        return [sum(x[0] for x in count)], [b",".join(x[0] for x in texts)], [b"".join(x[0] for x in raw)]
    return _part(ranks, buf, offsets)


def _part(ranks: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    ids, bound = piece_encoder(ranks).ids(buf, offsets)
    names, ends = _decimals(ranks), bound.tolist()
    said = [names[i] for i in ids.tolist()]
    texts = [",".join(said[a:b]).encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.diff(bound).tolist(), texts, merger(ranks).decode(ids, bound)
