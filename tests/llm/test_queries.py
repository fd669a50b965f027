"""The registered queries, over whole tables, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from cardloom.llm import queries
from cardloom.llm.pipeline import run
from tests.llm.helpers import awkward, documents
from tests.llm.test_dedup import components, plain_fingerprint
from tests.llm.test_secret_scan import PLAIN
from tests.llm.test_substring_dedup import brute
from tests.llm.test_tokens import library, multi  # noqa: F401

SMALL, SQL_AT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module", params=["given", "awkward"])
def tables(request, spark, tmp_path_factory):
    """Where the tables are, and the rows of documents: (doc_id, text)."""
    if request.param == "given":
        if not os.path.isdir(SMALL):
            pytest.skip("the driver's tables are not here")
        return SMALL, duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    rows = list({i: (i, t) for i, t in awkward() if i is not None}.values())
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    return path, rows


def rows_of(spark, name, at):
    return sorted(map(tuple, queries.QUERIES[name](spark, at).collect()), key=str)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, tables):
    at, rows = tables
    assert rows_of(spark, "op1_substring_dedup", at) == sorted(((i, n, gone, sha(kept)) for i, n, gone, kept in brute(rows)), key=str)


def test_op2(spark, tables, multi):  # noqa: F811
    at, rows = tables
    want = [(i, len(x), sha(",".join(map(str, x))), sha(t or "")) for i, t, x in ((i, t, multi(t or "")) for i, t in rows)]
    assert rows_of(spark, "op2_byte_bpe", at) == sorted(want, key=str)


def test_op4(spark, tables):
    at, rows = tables
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root, least = components(prints.values()), {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert rows_of(spark, "op4_simhash", at) == sorted(((i, f"{p:016x}", least[root[p]]) for i, p in prints.items()), key=str)


def test_op7(spark, tables, library):  # noqa: F811
    at, rows = tables
    want, start = [], 0
    for i, t in sorted(rows):
        ids = [*library(t), 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows_of(spark, "op7_token_records", at) == sorted(want, key=str)


def test_op8(spark, tables, library):  # noqa: F811
    at, rows = tables
    got = queries.QUERIES["op8_packing"](spark, at).collect()
    ids, places, sequences = {i: [*library(t), 0] for i, t in rows}, defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0
        places[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(places[i], len(x)) for i, x in ids.items()] + [(x, None) for x in sequences.values()]:
        spans = sorted(spans)
        assert [a for a, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist()
        assert sum(n for _, n in spans) == total if total is not None else sum(n for _, n in spans) <= 1024
    assert len(sequences) <= sum(map(len, ids.values())) / 1024 * 1.05 + 8


def test_op9(spark, tables):
    at, rows = tables
    base = {"assign", "access", "hex"}
    order = {k: n for n, k in enumerate(("assign", "access", "hex"))}
    got = {r.doc_id: r for r in queries.QUERIES["op9_secret_scan"](spark, at).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        found = sorted((m.start(), order[kind], kind, m.end()) for kind, regex, good in PLAIN for m in regex.finditer(t or "") if good(m))
        times = Counter(kind for _, _, kind, _ in found)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(times[k] for k in ("assign", "access", "hex"))
        said = [f"{kind}:{a}:{b}" for a, _, kind, b in found]
        assert got[i].base_sha256 == sha(",".join(said))
        assert [x for x in got[i].spans.split(",") if x and x.split(":")[0] in base] == said
        assert all(re.fullmatch(r"\w+:\d+:\d+", x) for x in got[i].spans.split(",") if x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    if not os.path.isdir(SQL_AT):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SQL_AT}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SQL_AT)
    columns = sorted(frame.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(*columns).fetchall()
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_pipeline_on_the_given_tables(spark, library):  # noqa: F811
    """What each document keeps is whole, and no document comes twice."""
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables are not here")
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    places, total = defaultdict(list), {}
    for r in run(spark, SMALL).collect():
        places[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
        total[r.doc_id] = r.doc_tokens
    assert 0 < len(places) <= len(rows)
    for i, parts in places.items():
        ids = [x for _, p in sorted(parts) for x in p]
        assert len(ids) == total[i]
        if "[" not in rows[i] and not any(regex.search(rows[i]) for _, regex, _ in PLAIN) and "eyJ" not in rows[i]:
            assert ids == [*library(rows[i]), 0] or b"[" in bytes(rows[i], "utf-8")


def test_shared_folder_keeps_no_work(spark, tmp_path):
    """After a query, the shared folder holds at most the checkpoint that its result reads."""
    from cardloom.llm.common import shared_dir

    at = f"file://{tmp_path}"
    documents(spark, [r for r in awkward() if r[0] is not None]).write.parquet(f"{at}/documents.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    names = lambda: {x for x in os.listdir(folder)}
    for name, most in (("op1_substring_dedup", 1), ("op3_exact_dedup", 1), ("op4_simhash", 1), ("op7_token_records", 1)):
        before = names()
        frame = queries.QUERIES[name](spark, at)
        frame.collect()
        made = names() - before
        assert len(made) <= most, (name, made)
