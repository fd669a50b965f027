"""Token ids as length-delimited binary records, with a separate offset index.

A data file is a run of records, each

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | newline

(little-endian).  The payload is u8 flags (1: the document id is null), u8 width of an id in bytes
(2 or 4), i64 document id, then the ids.  Spark's own writer commits the files, so a task that runs
twice leaves one copy and any store that Spark writes can hold them.  Files are sized by the bytes of
the input.  Two Parquet tables stand beside them: `index` (part, cut, seq, doc_id, offset, length,
n_tokens, before: ids before the record in its file) and `files` (file, part, cut, tokens, base: ids
before the file).  With these a reader seeks to any record, in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.common import lean, text_of
from cardloom.llm.pieces import library_encoder, text_chunks

HEAD = struct.Struct("<QI")
INNER = struct.Struct("<BBq")
#: Fixed value: the constant that record formats of this kind add to a rotated checksum.
DELTA = 0xA282EAD8
#: Bytes of input (as its files hold it) for each data file; bytes that a reader takes in at a time.
FILE_BYTES, BLOCK = 128 << 20, 4 << 20
#: part and cut are the numbers in a file's name: of the partition, and of the file within it.
INDEX = "part int, cut int, seq long, doc_id long, offset long, length long, n_tokens long, before long"
READ = "doc_id long, start long, n_tokens long, file string, offset long, length long, ids binary"


class CorruptRecord(ValueError):
    """A record whose length or checksum doesn't hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record, without the newline."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = INNER.pack(doc_id is None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, document id, ids) of each record of a file; raises CorruptRecord."""
    at, view = 0, memoryview(data)
    while at < len(data):
        try:
            size, check = HEAD.unpack_from(data, at)
            body = at + HEAD.size
            if masked(bytes(view[at : at + 8])) != check or len(data) < body + size + 5:
                raise CorruptRecord(f"length at byte {at}")
            payload = bytes(view[body : body + size])
            if masked(payload) != struct.unpack_from("<I", data, body + size)[0]:
                raise CorruptRecord(f"payload at byte {body}")
            missing, width, doc_id = INNER.unpack_from(payload)
        except struct.error as e:
            raise CorruptRecord(f"cut short at byte {at}") from e
        length = HEAD.size + size + 4
        yield at, length, None if missing else doc_id, np.frombuffer(payload, f"<u{width}", offset=INNER.size)
        at += length + 1


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, per_file: int = 0) -> None:
    """Write the ids of every text (null: empty) and end_id to path/data in ascending doc_id order, then path/index and path/files.

    A null doc_id sorts first; rows with one doc_id follow in the order of their texts' hashes, then
    texts, so that they too can be dealt to several tasks.  Other columns are ignored; an empty table
    gives no records.  per_file: at most so many records a file (0: no bound).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, buf, offsets in text_chunks(batch.column(1)):
                ids, bound = encoder.ids(buf, offsets)
                rows = [frame(doc_ids[a + i], np.append(ids[bound[i] : bound[i + 1]], np.uint32(end_id))) for i in range(b - a)]
                yield pa.record_batch([pa.array(rows, pa.binary())], ["frame"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("digest", F.xxhash64("text"))
    ordered = rows.repartitionByRange(_files(docs), "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").select("doc_id", "text")
    frames = lean(ordered.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value")))
    frames.write.option("maxRecordsPerFile", per_file).option("lineSep", "\n").text(f"{path}/data")
    _listed(spark, path).mapInArrow(_index, INDEX).write.parquet(f"{path}/index")
    sums = spark.read.parquet(f"{path}/index").groupBy("part", "cut").agg(F.sum("n_tokens").alias("tokens"))
    # One row for each file of FILE_BYTES of input, in one task: a running total over the files in order.
    base = (F.sum("tokens").over(Window.orderBy("part", "cut")) - F.col("tokens")).alias("base")
    lean(sums.select("part", "cut", "tokens", base).join(_listed(spark, path).select("file", "part", "cut"), ["part", "cut"])).write.parquet(f"{path}/files")


def _files(docs: DataFrame) -> int:
    """How many ranges to deal the input to: by its size in bytes where Spark knows it, and no fewer than it shuffles to."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // FILE_BYTES)) if size < 1 << 60 else least  # more: Spark's way to say unknown


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), part, cut, path and content (null where the executors can open the file themselves) of the data files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    name = F.element_at(F.split("path", "/"), -1)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("int")
    content = F.lit(None).cast("binary") if _opened(f"{path}/data") else F.col("content")
    return files.select(name.alias("file"), number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("cut"), "path", content.alias("content"))


def _opened(path: str, file: str = "") -> pa.NativeFile | bool:
    """A file of a store that Arrow reads, to seek in; without a file, whether Arrow reads the store."""
    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    try:
        store, place = fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        if file:
            raise
        return False
    return store.open_input_file(f"{place}/{file}" if file else place) if file else True


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each listed file, checked; a block and a record of it in memory."""
    for batch in batches:
        for row in range(len(batch)):
            name, part, cut, path, content = (c[row].as_py() for c in batch.columns)
            held = pa.BufferReader(content) if content is not None else _opened(path.rpartition("/")[0], name)
            rows, before = [], 0
            for seq, (offset, length, doc_id, ids) in enumerate(_records(held)):
                rows.append((part, cut, seq, doc_id, offset, length, len(ids), before))
                before += len(ids)
                if len(rows) == 10_000:
                    yield _batch(rows, INDEX)
                    rows = []
            yield _batch(rows, INDEX)


def _records(held: pa.NativeFile) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """As unframe(), of a file that is read block by block."""
    base, data = 0, b""
    while True:
        more = held.read(BLOCK)
        data += more
        at = 0
        while len(data) - at >= HEAD.size:
            need = HEAD.size + struct.unpack_from("<Q", data, at)[0] + 5
            if len(data) - at < need and masked(data[at : at + 8]) == struct.unpack_from("<I", data, at + 8)[0] and more:
                if need > BLOCK:  # a long record: take in what it lacks
                    more = held.read(need - (len(data) - at))  # none: the file is cut short, which unframe() tells
                    data += more
                    continue
                break
            offset, length, doc_id, ids = next(unframe(data[at : at + need]))
            yield base + at, length, doc_id, ids
            at += length + 1
        base, data = base + at, data[at:]
        if not more:
            if data:
                raise CorruptRecord(f"cut short at byte {base}")
            return


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def located(spark: SparkSession, path: str) -> DataFrame:
    """The offset index: file, part, cut, seq, doc_id, offset, length, n_tokens, start (ids of all records before)."""
    files = spark.read.parquet(f"{path}/files").select("part", "cut", "file", "base")
    index = spark.read.parquet(f"{path}/index").join(files, ["part", "cut"])
    return index.select("file", "part", "cut", "seq", "doc_id", "offset", "length", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


class _Seeking:
    """Reads ranges of a file; ranges that follow each other come out of one block."""

    def __init__(self, held: pa.NativeFile):
        self.held, self.first, self.data, self.next = held, 0, b"", -1

    def read(self, offset: int, size: int) -> bytes:
        if not self.first <= offset <= offset + size <= self.first + len(self.data):
            self.held.seek(offset)
            self.first, self.data = offset, self.held.read(max(size, BLOCK) if offset == self.next else size)
        self.next = offset + size
        return self.data[offset - self.first : offset - self.first + size]


def read_records(spark: SparkSession, path: str, wanted: DataFrame | None = None, **derived: Column) -> DataFrame:
    """The records that rows of located() name (all without wanted), in whatever order these come: doc_id, start, n_tokens, file, offset, length, ids.

    ids: little-endian u32; columns derived from ids take their place.  A reader seeks to each record;
    where Arrow can't open the store, Spark reads the files whole and joins.  Raises CorruptRecord if a
    length or checksum doesn't hold, or a record isn't the one that the index has there.
    """
    wanted = located(spark, path) if wanted is None else wanted
    rows = wanted.select("file", "offset", "length", "doc_id", "n_tokens", "start")
    folder = f"{path}/data"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            out, size = [], 0
            for file, offset, length, doc_id, n_tokens, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, held = file, _Seeking(_opened(folder, file))
                found = list(unframe(held.read(offset, length + 1)))
                if len(found) != 1 or found[0][1:3] != (length, doc_id) or len(found[0][3]) != n_tokens:
                    raise CorruptRecord(f"{file} has another record at byte {offset}")
                out.append((doc_id, start, n_tokens, file, offset, length, found[0][3].astype("<u4").tobytes()))
                size += len(out[-1][-1])
                if size > BLOCK:
                    yield _batch(out, READ)
                    out, size = [], 0
            yield _batch(out, READ)

    if _opened(folder):
        found = rows.mapInArrow(fetch, READ)
    else:
        parsed = _listed(spark, path).select("file", "content").mapInArrow(_whole, "file string, offset long, ids binary")
        lost = F.raise_error(F.concat(F.lit("no record where the index has one, in "), F.col("file"))).cast("binary")
        found = rows.join(parsed, ["file", "offset"], "left").withColumn("ids", F.when(F.col("ids").isNull(), lost).otherwise(F.col("ids")))
    kept = [c.alias(name) for name, c in derived.items()] or ["ids"]
    return found.select("doc_id", "start", "n_tokens", "file", "offset", "length", *kept)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for offset, _, _, ids in unframe(data.as_py()):
                yield _batch([(name, offset, ids.astype("<u4").tobytes())], "file string, offset long, ids binary")


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of little-endian u32 ids."""
    return F.crc32(ids)
