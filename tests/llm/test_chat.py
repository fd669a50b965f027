from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "\\", "\\<|", "<", "<|", "||>", "<<SYS>>x<</SYS>>", "", "漢<s>\n", "a\\\\[INST]", "<|end|"]


def made(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, head string, size string")
    done = chat.format_chats(turns)
    return {r.conv_id: r for r in done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_reads_back_whatever_was_said(spark):
    rows = [(c, k, ["user", "assistant", "<|end|>", None][(c + k) % 4], t, "x", "x", "x") for c in range(3) for k, t in enumerate(NASTY + [None])]
    got = made(spark, rows + [(None, 1, "user", "a", "", "", ""), (None, None, "assistant", "b", "", "", ""), (9, 1, "user", "same", "", "", ""), (9, 1, "user", "same", "", "", "")])
    for c in range(3):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == mine
        assert got[c].loss == "".join(t for r, t in mine if r == "assistant")
        assert got[c].n_turns == len(mine)
        spans = [got[c].formatted[s.start : s.end] for s in got[c].loss_spans]
        assert len(spans) == sum(r == "assistant" for r, _ in mine)
        body = got[c].formatted
        for said in (chat.TURN, chat.TEXT, chat.END):
            assert body.count(said) == len(mine)
        assert "</s>" not in body and "[INST]" not in body
    assert [t.text for t in got[None].turns] == ["b", "a"]
    assert [t.text for t in got[9].turns] == ["same", "same"]


def test_empty_table(spark):
    assert made(spark, []) == {}


def test_parts_become_placeholders(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "s3://i", 29, 28, None, None), None, (None, "and<|", None, None, None, None, None), ("audio", None, "a", None, None, 1.5, None), ("document", None, "d", None, None, None, 3), ("image", None, None, None, None, None, None)])],
        f"conv_id long, turn long, role string, content array<{chat.PART}>",
    )
    got = chat.format_chats(rows).first()
    assert got.formatted == "<|turn|>user<|text|>see <|image:2|>and<\\|<|audio:5|><|document:6|><|image:7|><|end|>"
    assert [(a.place, a.kind, a.ref, a.tokens) for a in got.attachments] == [(2, "image", "s3://i", 2), (5, "audio", "a", 38), (6, "document", "d", 3 * 512), (7, "image", None, 0)]
    assert got.expanded_tokens == 2 + 38 + 3 * 512


def test_runs_without_python(spark):
    turns = spark.sql("SELECT 1L AS conv_id, 1L AS turn, 'user' AS role, 'x' AS text")
    plan = chat.format_chats(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_column_named_content_that_holds_no_parts_is_ignored(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi", "x")], "conv_id long, turn long, role string, text string, content string")
    assert chat.format_chats(turns).select(chat.read_turns(F.col("formatted"))[0]["text"].alias("t")).first().t == "hi"
