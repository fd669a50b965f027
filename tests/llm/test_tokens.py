"""Piece encoding, BPE, records and packing against the public libraries."""

from __future__ import annotations

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from cardloom.llm import bpe, packing, pieces, token_records
from tests.llm.helpers import awkward, documents

JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def strings(n, seed):
    rnd = random.Random(seed)
    parts = list("ab1!? \n\t'stmdrevlé漢Ä½😀 　\x85\x1c_") + ["'re", "'ll", " '", "  ", "I'll", "don't ", "<|endoftext|>", "<|endof"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(n)]


def test_pieces_match_both_libraries(library, multi):
    texts = strings(1500, 1) + ["", None, "x" * 300, " " * 70, "é" * 100, "a\r\nb"]
    for encoder, want in ((pieces.library_encoder(JSON), library), (bpe.piece_encoder(MULTI), lambda s: multi(s or ""))):
        got = []
        for a, b, buf, offsets in pieces.text_chunks(pa.array(texts, pa.string()), size=700):
            ids, bound = encoder.ids(buf, offsets)
            got += [ids[bound[i] : bound[i + 1]].tolist() for i in range(b - a)]
        assert got == [want(t) for t in texts]


def test_table_forgets_when_full(library):
    encoder = pieces.PieceEncoder(pieces.library_encoder(JSON).encode_pieces, bits=8, specials=(b"<|endoftext|>",))
    texts = strings(400, 2)
    for a, b, buf, offsets in pieces.text_chunks(pa.array(texts), size=300):
        ids, bound = encoder.ids(buf, offsets)
        assert [ids[bound[i] : bound[i + 1]].tolist() for i in range(b - a)] == [library(t) for t in texts[a:b]]


def test_bpe_round_trip(spark, multi):
    rows = awkward()
    docs = documents(spark, rows, clashing=True)
    encoded = bpe.encode(docs, MULTI)
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
    assert got == sorted(((i, multi(t or "")) for i, t in rows), key=str)
    back = sorted(((r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded, MULTI).collect()), key=str)
    assert back == sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    trip = sorted(((r.doc_id, r.n_tokens, bytes(r.ids).decode(), bytes(r.bytes)) for r in bpe.round_trip(docs, MULTI).collect()), key=str)
    assert trip == sorted(((i, len(multi(t or "")), ",".join(map(str, multi(t or ""))), (t or "").encode()) for i, t in rows), key=str)
    assert bpe.round_trip(documents(spark, []), MULTI).count() == 0


def test_decode_of_nulls_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(rows, MULTI).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) >= 2
    with pytest.raises(ValueError):
        bpe.merger(MULTI).decode(np.array([10**9]), np.array([0, 1]))


def signed_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_records(spark, library, tmp_path):
    rows = awkward()
    path = f"file://{tmp_path}/r"
    token_records.write_records(documents(spark, rows, clashing=True), path, JSON, per_file=7)
    got = sorted(token_records.read_records(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1])))
    want = [(i, [*library(t), 2]) for i, t in order]
    assert [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [len(x) for _, x in want])[:-1].tolist()
    assert len(list((tmp_path / "r/data").glob("part-*"))) > 3
    digest = token_records.read_records(spark, path, crc=token_records.ids_crc32(token_records.F.col("ids")))
    some = token_records.located(spark, path).where("doc_id % 3 = 0").orderBy(token_records.F.rand(5))
    back = [(r.doc_id, r.start) for r in token_records.read_records(spark, path, some).collect()]
    assert sorted(back) == sorted((r.doc_id, r.start) for r in got if r.doc_id is not None and r.doc_id % 3 == 0)
    assert sorted(r.crc for r in digest.collect()) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want)


@pytest.mark.parametrize("seeks", [True, False])
def test_many_files_of_a_partition_keep_their_order(spark, library, tmp_path, monkeypatch, seeks):
    path, rows = f"file://{tmp_path}/r", [(i, f"text {i} " * (i % 4)) for i in range(1100)]
    if not seeks:
        held = token_records._opened
        monkeypatch.setattr(token_records, "_opened", lambda path, file="": held(path, file) if file else False)
    monkeypatch.setattr(token_records, "_files", lambda docs: 1)
    token_records.write_records(documents(spark, rows), path, JSON, per_file=1)
    got = sorted((r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in token_records.read_records(spark, path).collect())
    ids = [[*library(t), 2] for _, t in rows]
    starts = np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    assert got == [(i, s, x) for (i, _), s, x in zip(rows, starts, ids, strict=True)]


def test_an_index_that_misplaces_a_record_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    token_records.write_records(documents(spark, [(1, "a b"), (2, "c d")]), path, JSON)
    moved = token_records.located(spark, path).withColumn("doc_id", token_records.F.col("doc_id") + 1)
    with pytest.raises(Exception, match="another record"):
        token_records.read_records(spark, path, moved).collect()


def test_long_records_are_indexed_block_by_block(monkeypatch):
    monkeypatch.setattr(token_records, "BLOCK", 64)
    parts = [np.arange(n, dtype=np.uint32) for n in (3, 500, 0, 40, 2000)]
    data = b"".join(token_records.frame(i, x) + b"\n" for i, x in enumerate(parts))
    got = list(token_records._records(pa.BufferReader(data)))
    assert [(o, n, d, x.tolist()) for o, n, d, x in got] == [(o, n, d, x.tolist()) for o, n, d, x in token_records.unframe(data)]
    with pytest.raises(token_records.CorruptRecord):
        list(token_records._records(pa.BufferReader(data[:-3])))


def test_long_texts_in_segments_and_colliding_keys(library, multi, monkeypatch):
    rnd = random.Random(3)
    long = " ".join(rnd.choices(["plain", "word's", "é漢 字", "12 3", "\n\n", "we'll", "<|endoftext|>", "x" * 90], k=4000))
    monkeypatch.setattr(pieces, "CHUNK", 2000)
    monkeypatch.setattr(bpe, "CHUNK", 2000)
    cuts = list(pieces.segments(np.frombuffer(long.encode(), np.uint8), 2000))
    assert len(cuts) > 5 and cuts[0][0] == 0 and cuts[-1][1] == len(long.encode())
    one = np.array([0, len(long.encode())])
    buf = np.frombuffer(long.encode(), np.uint8)
    encoder = pieces.PieceEncoder(pieces.library_encoder(JSON).encode_pieces, specials=(b"<|endoftext|>",))
    assert encoder.ids(buf, one)[0].tolist() == library(long)
    count, texts, raw = bpe._trip(MULTI, buf, one)
    assert texts == [",".join(map(str, multi(long))).encode()] and raw == [long.encode()] and count == [len(multi(long))]
    # Every piece has the key of others: bytes decide.
    keys = pieces.piece_keys
    monkeypatch.setattr(pieces, "piece_keys", lambda buf, start, end, salt=0: keys(buf, start, end, salt) % np.uint64(5) + np.uint64(1))
    crowded = pieces.PieceEncoder(pieces.library_encoder(JSON).encode_pieces, specials=(b"<|endoftext|>",))
    assert crowded.ids(buf[:1500], np.array([0, 1500]))[0].tolist() == library(long.encode()[:1500].decode("utf-8", "ignore"))


def test_keys_do_not_depend_on_steps(monkeypatch):
    rnd = random.Random(8)
    data = bytes(rnd.randrange(256) for _ in range(5000))
    buf, start = np.frombuffer(data, np.uint8), np.sort(np.array(rnd.sample(range(4900), 900)))
    end = start + np.array([rnd.randint(1, 90) for _ in start])
    want = pieces.piece_keys(buf, start, end).tolist()
    monkeypatch.setattr(pieces, "STEP", 100)
    assert pieces.piece_keys(buf, start, end).tolist() == want
    assert pieces.piece_keys(buf, start, end, 1).tolist() != want


def test_records_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    token_records.write_records(documents(spark, []), path, JSON)
    assert token_records.read_records(spark, path).count() == 0


@pytest.mark.parametrize("at", [3, 9, 20, -2])
def test_corrupt_records_are_found(at):
    data = bytearray(token_records.frame(5, np.arange(9, dtype=np.uint32)) + b"\n" + token_records.frame(None, np.array([70000], np.uint32)) + b"\n")
    assert [(d, x.tolist()) for _, _, d, x in token_records.unframe(bytes(data))] == [(5, list(range(9))), (None, [70000])]
    data[at] ^= 1
    with pytest.raises(token_records.CorruptRecord):
        list(token_records.unframe(bytes(data)))


def test_packing(spark, library):
    rows = awkward()
    got = packing.pack(documents(spark, rows, clashing=True), JSON, group=4).collect()
    sequences, tokens = defaultdict(list), []
    for r in got:
        assert r.length == len(bytes(r.ids)) // 4 and 0 < r.length <= 1024
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    pieces_of = defaultdict(list)
    for r in got:
        pieces_of[(r.doc_id, r.doc_tokens, r.start)].append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    for i, t in rows:
        tokens = [*library(t), 0]
        at = 0
        while at < len(tokens):
            found = next(x for x in pieces_of[(i, len(tokens), at)] if tokens[at : at + len(x)] == x)
            pieces_of[(i, len(tokens), at)].remove(found)
            at += len(found)
    assert not any(pieces_of.values())
    assert packing.pack(documents(spark, []), JSON).count() == 0


def test_differencing_balances_and_fill_keeps_capacity():
    rnd = random.Random(4)
    for _ in range(30):
        sizes = [rnd.randint(1, 256) for _ in range(rnd.randint(0, 200))]
        k = rnd.randint(1, 20)
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) == k
        full = packing.fill(sizes, 1024)
        assert sorted(i for w in full for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 1024 for w in full)
    sums = [sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(sums) == [14, 16]
    assert packing.padded_length(512, 1024) == 512 and packing.padded_length(513, 1024) == 1024
