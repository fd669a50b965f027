"""Files, cache, configuration, requests and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cardloom.functions.cost import MID
from cardloom.operators import requests
from cardloom.plans.convert import plan_requests, preview
from cardloom.sources import cache, config, files
from cardloom.streaming.ingest import spending_by_window, stream_documents


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    (path / "below").mkdir(parents=True)
    (path / "b.MD").write_text("# Head\n\nA body that is certainly longer than fifty characters in all.\n", encoding="utf-8")
    (path / "a.txt").write_text("\x00 plain  \n", encoding="utf-8")
    (path / "c.csv").write_text("x")
    (path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (path / "d.pdf").write_bytes(b"%PDF some bytes")
    (path / "below/e.txt").write_text("no")
    return path


def test_listing_and_loading(spark, folder):
    listed = files.list_files(spark, str(folder))
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed.collect()) == ["a.txt", "b.MD", "bad.txt", "d.pdf"]
    assert files.list_files(spark, str(folder), largest=5).count() == 1
    with pytest.raises(ValueError):
        files.list_files(spark, str(folder / "c.csv"))
    got = {files.stem(r.source_path): r for r in files.load_documents(listed).collect()}
    assert got["a"].text == "plain" and got["a"].chunks == ["plain"] and got["b"].file_type == "md" and got["b"].error is None
    assert got["bad"].text is None and got["bad"].error.startswith("not UTF-8") and got["d"].error.startswith("no converter")


def test_converter_and_ocr(spark, folder):
    def convert(content, ocr, language):
        return f"# Scan {language}" if ocr else " " * 60 + "short"

    listed = files.list_files(spark, str(folder))
    plain, scanned = (files.load_documents(listed, convert, ocr=flag).where("file_type = 'pdf'").first() for flag in (False, True))
    assert (plain.text, plain.used_ocr) == ("short", False) and (scanned.text, scanned.used_ocr) == ("# Scan jpn+eng", True)

    def broken(content, ocr, language):
        raise OSError("cut short")

    assert files.load_documents(listed, broken).where("file_type = 'pdf'").first().error == "OSError: cut short"
    assert spark.createDataFrame([("　" * 60,), ("x" * 50,)], "t string").select(files.needs_ocr(F.col("t"), True)).collect() == [(True,), (False,)]


def test_cache(spark, folder, tmp_path):
    listed, path, calls = files.list_files(spark, str(folder)), f"file://{tmp_path}/cache", []

    def load(rows):
        calls.append(rows.count())
        return files.load_documents(rows)

    first = cache.load_with_cache(listed, path, load)
    assert calls == [4] and sorted(r.error is None for r in first.collect()) == [False, False, True, True]  # no file is lost
    (folder / "b.MD").rename(folder / "renamed.md")
    found = cache.load_with_cache(files.list_files(spark, str(folder)), path, load).collect()
    again = {r.source_path.rsplit("/", 1)[1] for r in found if r.error is None}
    assert len(found) == 4 and again == {"a.txt", "b.MD"} and calls == [4, 2]  # the content's hash is the key: the old name comes back
    (tmp_path / "cache" / "part-broken.parquet").write_bytes(b"no parquet")
    assert cache.read_cache(spark, path).count() == 2  # a file that can't be read is a miss
    key = cache.read_cache(spark, path).first().cache_key
    assert cache.invalidate(spark, path, key) == 1 and cache.invalidate(spark, path) == 1 and cache.invalidate(spark, f"{path}-none") == 0
    assert not (tmp_path / "cache-next").exists()
    hashes = [r.h for r in spark.createDataFrame([("x",)], "c string").select(F.col("c").alias("h")).collect()]
    assert hashes == ["x"] and cache.load_with_cache(files.list_files(spark, str(folder)), path, load, enabled=False).count() == 4
    by = cache.cache_key(by_settings=True, ocr=True)
    one, two = spark.range(1).select(by(F.lit("h")).alias("a"), cache.cache_key()(F.lit("h")).alias("b")).first()
    assert len(one) == 64 and two == "h"


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("model: m\nquality:\n  confidence_threshold: 0.5\ncards:\n  max_cards: 7\n  card_types: [qa]\nunknown: 1\nmodel_overridden: true\n")
    got = config.load_config(str(path), {"CARDLOOM_BUDGET_LIMIT": "2.5"})
    assert (got.model, got.quality_confidence_threshold, got.cards_max_cards, got.cards_card_types, got.cost_budget_limit, got.model_overridden) == ("m", 0.5, 7, ("qa",), 2.5, False)
    assert config.load_config(str(path), {"CARDLOOM_MODEL": "e"}).model == "e" and config.load_config(None, {}, model="x").model_overridden
    assert config.load_config(None, {}) == config.Config() and config.Config().cards_card_types == config.DEFAULT_TYPES
    path.write_text("- a list")
    assert config.load_config(str(path), {}) == config.Config()
    path.write_text("a: [1")
    with pytest.raises(ValueError):
        config.load_config(str(path), {})
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none"), {})
    assert not config.quality_level(config.Config(), "off").quality_enable_critique and config.quality_level(config.Config(), "full") == config.Config()


def test_dataset(spark, tmp_path):
    path = tmp_path / "d.yaml"
    path.write_text("name: n\nversion: '1'\ncases:\n- {id: c, text: t, expected_cards: [{front_keywords: [a], back_keywords: [b, c], card_type: qa}, {front_keywords: [], back_keywords: []}]}\n")
    name, version, cases, expected = config.load_dataset(spark, str(path))
    assert (name, version, cases.first().description) == ("n", "1", "") and [(r.exp_idx, r.wanted_type, r.back_keywords) for r in expected.collect()] == [(0, "qa", ["b", "c"]), (1, None, [])]
    path.write_text(path.read_text().replace("qa", "riddle"))
    with pytest.raises(ValueError):
        config.load_dataset(spark, str(path))
    path.write_text("name: n")
    with pytest.raises(KeyError):
        config.load_dataset(spark, str(path))


def test_preview(spark):
    row = preview(spark.createDataFrame([("x" * 4000,)], "text string"), token_limit=400).first()
    assert (row.tokens, row.n_chars_clean, row.n_chunks, len(row.excerpt)) == (1000, 4000, 3, 500) and row.cost_usd == pytest.approx(1000 / 1e6 * 3 + 250 / 1e6 * 15)


def answer(model, system, prompt, max_tokens):
    if "second" in prompt:
        raise ConnectionError("down")
    card = {"front": "What?", "back": "That.", "card_type": "qa", "bloom_level": "apply", "tags": ["t"]}
    return {"model": model, "input_tokens": 10, "output_tokens": 5, "text": json.dumps([card, {"front": ""}])}


def test_requests_to_cards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(requests, "with_retry", lambda call, retryable, **k: _once(call, retryable))
    body = "a body that is long enough to be asked about, surely so"
    docs = spark.createDataFrame([("/in/book.md", f"# one\n{body}\n# second\n{body} second\n# three\nx")], "source_path string, text string")
    asked = plan_requests(docs, focus=["x"], bloom=["apply"], card_types=["qa"], extra_tags=["e"])
    rows = asked.orderBy("section_pos").collect()
    assert [r.custom_id for r in rows] == ["section-0", "section-1"] and plan_requests(docs, batch=True).count() == 3
    assert rows[0].user_prompt.startswith("Document: book\nSection: book > one\n\nWrite at most 20 cards.\n\nTag path: book::one\n\nCard types: qa\n\nFocus on: x") and rows[0].model == "low-tier"
    answers = requests.call_provider(asked, _provider, str(tmp_path / "answers"))
    assert sorted(r.status for r in answers.collect()) == ["errored", "succeeded"]
    found = requests.collect_cards(asked, answers).collect()
    assert [(r.source_file, r.section_id, r.card_idx, r.tags) for r in found] == [("/in/book.md", "section-0", 0, ["t", "_section::section-0"])]
    assert requests.usage(answers).count() == 1
    assert spark.range(1).select(requests.user_prompt(F.lit(""), 5)).first()[0] is None


def _provider(model, system, prompt, max_tokens):
    if "second" in prompt:
        raise RuntimeError("no answer after 3 attempts")
    return answer(model, system, prompt, max_tokens)


def _once(call, retryable):
    return call()


def test_retry_poll_and_vision():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return {"ok": 1}

    assert requests.with_retry(call, (ConnectionError,), sleep=waits.append) == {"ok": 1} and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        requests.with_retry(lambda: (_ for _ in ()).throw(ConnectionError()), (ConnectionError,), sleep=waits.append)
    with pytest.raises(KeyError):
        requests.with_retry(lambda: {}["x"], (ConnectionError,), sleep=waits.append)
    states, clock = iter(["going", "going", "ended"]), iter(range(100))
    requests.poll(lambda: next(states), 1, 50, sleep=waits.append, clock=lambda: next(clock))
    with pytest.raises(TimeoutError):
        requests.poll(lambda: "going", 1, 3, sleep=waits.append, clock=lambda: next(clock))
    parts = requests.vision_messages("t", [{"media_type": "image/png", "data": "x"}, {"media_type": "image/png", "data": ""}])
    assert [p["type"] for p in parts] == ["image", "text"] and parts[1]["text"].startswith("2 images")


def test_streams(spark, folder, tmp_path):
    (folder / "copy.txt").write_bytes((folder / "a.txt").read_bytes())
    run = stream_documents(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.text[:5] for r in spark.table("arrived").collect()) == ["# Hea", "plain"]
    usage = spark.sql(f"SELECT timestamp'2024-01-01 00:10:00' AS ts, '{MID}' AS model, 1000000L AS input_tokens, 0L AS output_tokens, false AS batch UNION ALL SELECT timestamp'2024-01-01 01:10:00', '{MID}', 0L, 0L, true")
    assert [(r.cost_usd, r.calls) for r in spending_by_window(usage).orderBy("start").collect()] == [(3.0, 1), (0.0, 1)]
