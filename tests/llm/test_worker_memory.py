"""What the pipeline's Python workers hold: small batches, tables of a bounded size, and the same results with them."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from cardloom.llm import packing, pieces, secret_scan
from cardloom.llm import pipeline as P
from tests.llm.helpers import awkward, documents

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MB = 1 << 20


def batch_sizes(frame):
    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return [(r.n, r.size) for r in frame.select("doc_id", "text").mapInArrow(run, "n long, size long").collect()]


class Enough(Exception):
    pass


@pytest.mark.parametrize("stage", ["quality", "near_dedup", "secrets", "packing"])
def test_stages_send_small_batches(spark, monkeypatch, stage):
    rows = [(i, f"word{i} " * 300) for i in range(4000)]  # 10 MB
    docs, before, given = documents(spark, rows).coalesce(1), spark.conf.get(BYTES), []

    def take(docs, *_, **__):
        given.append(docs)
        raise Enough

    monkeypatch.setattr(P.quality, "train", take)
    monkeypatch.setattr(P, "table", lambda *_: None)
    monkeypatch.setattr(P, "similar_texts", take)
    monkeypatch.setattr(P.packing, "pack", take)
    try:
        given.append(dict(P.STAGES)[stage](spark, docs, ""))
    except Enough:
        pass
    sizes = batch_sizes(given[0])
    assert sum(n for n, _ in sizes) == len(rows) and max(size for _, size in sizes) < 2 * MB
    assert spark.conf.get(BYTES) == before


def test_index_takes_memory_for_wanted_trigrams_only():
    held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) * 1024
    before = held()
    index = secret_scan.Scanner(secret_scan.RULES).index
    assert held() - before < 20 * MB and index.slot.nbytes > 30 * MB


def test_packing_worker_forgets_in_time():
    encoder = pieces.PieceEncoder(lambda found: [[1, 2, 3, 4] for _ in found], P.BITS)
    for a in range(0, 900_000, 90_000):
        data = b"".join(b" %06d" % i for i in range(a, a + 90_000))
        ids, _ = encoder.ids(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert len(ids) >= 4 * 90_000
    table = encoder.table
    assert sum(x.nbytes for x in (table.keys, table.codes, encoder.flat, encoder.raw, encoder.begin, encoder.count, encoder.at, encoder.size)) < 40 * MB


def test_small_table_packs_the_same(spark):
    docs = documents(spark, awkward()).coalesce(1)
    packed = lambda **more: sorted(map(str, packing.pack(docs, P.TOKENIZER, group=4, **more).collect()))
    assert packed(bits=5) == packed()
