"""Files written by tasks, against the strings that they should hold."""

from __future__ import annotations

import json
import os
from pathlib import Path, PurePosixPath

import pytest
from pyspark.sql import functions as F

from cardloom.operators import export
from cardloom.schemas import CARD_FIELDS
from cardloom.sources import sink

NOW = "2026-01-01T00:00:00+00:00"


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def deck(spark, sources, hot=400):
    rows = [(sources[0], i) for i in range(hot)] + [(s, i) for s in sources[1:] for i in range(3)]
    ids = spark.createDataFrame(rows, "source_file string, card_idx int")
    kind = F.when(F.col("card_idx") % 3 == 0, "reversible").otherwise("qa")
    front = F.concat(F.lit("f\t \x85 é \"\\ \n"), "card_idx", F.lit(" "), "source_file")
    return ids.select("source_file", "card_idx", front.alias("front"), F.lit("b").alias("back"), kind.alias("card_type"), F.lit("apply").alias("bloom_level"), F.array(F.lit("t")).alias("tags"), F.array().cast("array<string>").alias("related_concepts"), F.lit(None).cast("string").alias("mnemonic_hint"), F.array().cast("array<string>").alias("media"))


def files_of(folder: Path) -> dict[str, bytes]:
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_files_equal_the_documents(spark, tmp_path, many_parts):
    cards = deck(spark, ["/in/a/hot.md", "/in/b/x.md", "/in/b/ü y.txt"])
    sink.write_cards(cards, str(tmp_path / "o"), "both", "m", NOW)
    got = files_of(tmp_path / "o")
    stem = lambda s: PurePosixPath(s).stem
    want = {stem(r.source_file) + ".tsv": r.tsv.encode() for r in export.tsv_documents(cards).collect()}
    want |= {stem(r.source_file) + ".json": json.dumps(json.loads(r.json), ensure_ascii=False, indent=2).encode() for r in export.json_documents(cards, "m", NOW).collect()}
    assert got == want
    tasks = sink.card_pieces(cards, "tsv").where("place = 'hot.tsv'").select(F.spark_partition_id()).distinct().count()
    assert tasks > 1  # so its parts were joined
    assert all("_parts" not in p for p in os.listdir(tmp_path / "o"))
    sink.write_cards(cards, f"file:{tmp_path}/o", "json", "other", NOW)  # over what is there
    assert json.loads(files_of(tmp_path / "o")["x.json"])["model_used"] == "other" and len(files_of(tmp_path / "o")) == 6


def test_attempts_that_are_not_reported_do_not_count(tmp_path):
    import pyarrow as pa

    class Task:
        @staticmethod
        def partitionId():
            return 0

    rows = pa.record_batch([pa.array(["a.tsv"] * 3), pa.array([0, 1, 1]), pa.array(["H\n", "1", "2"])], ["place", "kind", "text"])
    writer = sink.FileWriter({"path": str(tmp_path), "form": "tsv"})
    given, sink.TaskContext = sink.TaskContext, type("T", (), {"get": staticmethod(lambda: Task)})
    try:
        writer.write(iter([rows]))  # lost
        kept = writer.write(iter([rows]))
        again = sink.FileWriter({"path": str(tmp_path), "form": "tsv"})
        failed = again.write(iter([rows]))
    finally:
        sink.TaskContext = given
    again.abort([failed, None])
    assert not files_of(tmp_path).get("a.tsv") and kept.parts[0].last == sink.BODY
    after = rows.slice(1)
    sink.TaskContext = type("T", (), {"get": staticmethod(lambda: type("U", (), {"partitionId": staticmethod(lambda: 1)}))})
    try:
        more = writer.write(iter([after]))
    finally:
        sink.TaskContext = given
    writer.commit([more, None, kept])
    assert files_of(tmp_path) == {"a.tsv": b"H\n1\n2\n1\n2"}


def test_a_failed_job_changes_nothing(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("old")
    cards = deck(spark, ["s", "t"], 5).withColumn("front", F.when(F.col("source_file") == "t", F.raise_error(F.lit("broken"))).otherwise(F.col("front")))
    with pytest.raises(Exception, match="broken"):
        sink.write_cards(cards, str(tmp_path), "tsv")
    assert files_of(tmp_path) == {"s.tsv": b"old"}


def test_no_cards(spark, tmp_path):
    sink.write_cards(deck(spark, ["s"], 0), str(tmp_path / "o"), "both")
    assert not (tmp_path / "o").exists() or files_of(tmp_path / "o") == {}


@pytest.mark.parametrize(
    ("sources", "want"),
    [
        (["a.md"], ["a"]),
        (["/in/a.md", "/in/b.tar.gz", "/in/.rc"], ["a", "b.tar", ".rc"]),
        (["/in/x/a.md", "/in/y/a.md", "/in/b.md"], ["x/a", "y/a", "b"]),
        (["/in/a.md", "/in/a.txt", "/in/d/a.md.pdf"], ["a.md", "a.txt", "d/a.md"]),
        (["a.md", "d/a.md"], ["a.md", "d/a"]),
        (["no name", "no/name.x/y"], ["no name", "y"]),
    ],
)
def test_places(spark, sources, want):
    got = {r.source_file: r.place for r in sink.places(spark.createDataFrame([(s,) for s in sources * 2], "source_file string")).collect()}
    assert len(set(got.values())) == len(sources)
    assert [got[s] for s in sources] == want


def test_media(spark, tmp_path):
    images = spark.createDataFrame([("_media/1.png", b"one"), ("_media/2.png", b""), ("3.png", b"\x00\n")], "name string, image_bytes binary")
    sink.write_media(images, str(tmp_path / "o"))
    assert files_of(tmp_path / "o") == {"_media/1.png": b"one", "3.png": b"\x00\n"}
    for name in ("3.png", "../out.png", "/out.png"):
        bad = images.unionByName(spark.createDataFrame([(name, b"x")], images.schema))
        with pytest.raises(Exception, match="named|outside"):
            sink.write_media(bad, str(tmp_path / "p"))
        assert files_of(tmp_path / "p") == {}


def test_fields_of_cards_are_all_written(spark, tmp_path):
    sink.write_cards(deck(spark, ["s"], 1), str(tmp_path), "json", "m", NOW)
    assert list(json.loads((tmp_path / "s.json").read_text())["cards"][0]) == list(CARD_FIELDS)
