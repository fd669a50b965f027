"""A folder to cards: the cache, the choice of path, one budget, quality and files."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cardloom.operators import requests
from cardloom.plans import folder, runs
from cardloom.sources import files
from cardloom.sources.config import Config
from tests.test_runs import BODY, CARD, provider

BOXES = "doc_id string, page_num int, idx int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, media_type string, image_bytes binary"


@pytest.fixture
def inputs(tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    (top / "book.md").write_text(f"# one\n{BODY} one\n# two\n{BODY} two")
    (top / "copy.txt").write_bytes((top / "book.md").read_bytes())
    (top / "bad.txt").write_bytes(b"\xff\xfe")
    (top / "scan.pdf").write_bytes(b"pdf")
    (top / "other.bin").write_bytes(b"not supported")
    return top


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[1]


def services(spark, tmp_path, sent=None):
    calls = tmp_path / "calls"
    calls.mkdir(exist_ok=True)

    def convert(content, ocr, lang):
        with (calls / "convert").open("a") as f:
            f.write("x")
        return f"# scanned\n{BODY}"

    def pictures(found):
        page = [(1, 0, 300.0), (1, 1, 300.0), (2, 0, 1.0)]  # the second page has too little
        rows = F.array(*[F.struct(F.lit(p).alias("page_num"), F.lit(i).alias("idx"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(w).alias("x1"), F.lit(w).alias("y1"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), F.lit("image/png").alias("media_type"), F.lit(bytes([65 + i])).alias("image_bytes")) for p, i, w in page])
        return found.select(F.col("path").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")

    def results(ids):
        rows = [(r["source_file"], r["custom_id"], "succeeded", r["model"], 1000, 100, "text", json.dumps([CARD])) for b in sent for r in b]
        return spark.createDataFrame(rows, requests.ANSWER)

    batches = folder.Batches(lambda block: sent.append(block) or f"b{len(sent)}", lambda i: "ended", results) if sent is not None else None
    def counted(*asked):
        with (calls / "provider").open("a") as f:
            f.write("x")
        return provider(*asked)

    return folder.Services(counted, convert, pictures, batches)


def config(tmp_path, **more):
    return Config(cache_dir=str(tmp_path / "cache"), cost_budget_limit=9.0, batch_poll_interval=0.0, **more)


def test_sections_equal_a_plain_conversion(spark, inputs, tmp_path):
    mine, given = config(tmp_path), services(spark, tmp_path)
    done = folder.convert_folder(spark, str(inputs), given, str(tmp_path / "run"), mine, out=str(tmp_path / "out"))
    assert {name_of(r.source_file): r.way for r in done.paths.collect()} == dict.fromkeys(("book.md", "copy.txt", "scan.pdf"), "sections")
    assert [(name_of(r.source_path), "UTF-8" in r.error) for r in done.failed.collect()] == [("bad.txt", True)]
    docs = files.load_documents(files.list_files(spark, str(inputs)), given.convert)
    plain = runs.convert(docs, provider, str(tmp_path / "plain"), mine)
    assert sorted(map(str, done.cards.collect())) == sorted(map(str, plain.cards.collect()))
    assert sorted(map(str, done.report.collect())) == sorted(map(str, plain.report.collect()))
    assert done.spending["sections"].calls == plain.spending.calls == 5 and done.usage.count() == plain.usage.count()
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] not in "._") == ["book.tsv", "copy.tsv", "scan.tsv"]


def test_a_second_run_loads_from_the_cache_and_buys_nothing_twice(spark, inputs, tmp_path):
    mine, given = config(tmp_path), services(spark, tmp_path)
    first = folder.convert_folder(spark, str(inputs), given, str(tmp_path / "run"), mine, quality="off")
    bought = (tmp_path / "calls/provider").read_text()
    again = folder.convert_folder(spark, str(inputs), given, str(tmp_path / "run"), mine, quality="off")
    assert (tmp_path / "calls/provider").read_text() == bought == "x" * 5
    other = folder.convert_folder(spark, str(inputs), given, str(tmp_path / "run2"), mine, quality="basic")
    assert (tmp_path / "calls/convert").read_text() == "x"
    assert again.spending == first.spending and first.report is None
    assert sorted(map(str, first.cards.collect())) == sorted(map(str, again.cards.collect()))
    assert other.report.count() == 3 and {r.model for r in other.usage.collect()} == {r.model for r in first.usage.collect()}


def test_each_file_takes_its_way(spark, inputs, tmp_path):
    sent = []
    mine = config(tmp_path, vision_enabled=True, batch_enabled=True, output_format="json")
    given = services(spark, tmp_path, sent)
    done = folder.convert_folder(spark, str(inputs), given, str(tmp_path / "run"), mine, quality="off", out=str(tmp_path / "out"))
    assert {name_of(r.source_file): r.way for r in done.paths.collect()} == {"book.md": "batch", "copy.txt": "batch", "scan.pdf": "vision"}
    assert sorted((name_of(r["source_file"]), r["custom_id"]) for b in sent for r in b) == [(f, f"section-{k}") for f in ("book.md", "copy.txt") for k in (0, 1)]
    got = {(name_of(r.source_file), r.card_idx): r.section_id for r in done.cards.collect()}
    assert got == {("book.md", 0): "section-0", ("book.md", 1): "section-1", ("copy.txt", 0): "section-0", ("copy.txt", 1): "section-1", ("scan.pdf", 0): "vision", ("scan.pdf", 1): "vision"}
    assert sorted(r.batch for r in done.usage.collect()) == [False] + [True] * 4 and set(done.spending) == {"vision", "batch"}
    media = sorted((tmp_path / "out/_media").glob("*.png"))
    assert [p.read_bytes() for p in media] == [b"A", b"B"]  # of the first page alone
    assert len(json.loads((tmp_path / "out/scan.json").read_text())["cards"]) == 2
    folder.convert_folder(spark, str(inputs), given, str(tmp_path / "run"), mine, quality="off")
    assert len(sent) == 1  # not handed over again


def test_one_budget_for_all_ways(spark, inputs, tmp_path):
    mine = replace(config(tmp_path, vision_enabled=True), cost_budget_limit=0.001)
    done = folder.convert_folder(spark, str(inputs), services(spark, tmp_path), str(tmp_path / "run"), mine, quality="off")
    assert done.spending["vision"].calls == 1 and done.spending["sections"].calls == 0 and done.spending["sections"].stopped
    with pytest.raises(ValueError, match="quality"):
        folder.convert_folder(spark, str(inputs), services(spark, tmp_path), str(tmp_path / "r"), mine, quality="best")
