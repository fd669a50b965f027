"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn's content is an array of parts.  A visitor flattens them in order: text is escaped, any other
part becomes a numbered placeholder, and its reference and the tokens it expands to are recorded.  The
formatted string marks each turn

    <|turn|>role<|text|>content<|end|>

and every control string inside roles and texts is escaped, so the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a tokenizer could take for control tokens, those of common chat templates included.
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>")
ESCAPE = "\\"
#: Tokens that parts expand to: a square patch of an image, a second of audio, a page of a document.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escaped(text: Column) -> Column:
    """Doubles the escape character and puts one behind the first character of each control string."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text stands for; unknown sizes count as 0."""
    image = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    by_kind = F.when(part["kind"] == "image", image).when(part["kind"] == "audio", F.ceil(part["seconds"] * PER_SECOND))
    return F.coalesce(by_kind.when(part["kind"] == "document", part["pages"] * PER_PAGE), F.lit(0)).cast("long")


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def flattened(parts: Column) -> Column:
    """The content of a turn: escaped texts and placeholders, in order.  A null part adds nothing."""
    place = lambda p, i: F.concat(F.lit("<|"), escaped(p["kind"]), F.lit(":"), (i + 1).cast("string"), F.lit("|>"))
    each = F.transform(parts, lambda p, i: F.when(p.isNull(), F.lit("")).when(is_text(p), escaped(p["text"])).otherwise(place(p, i)))
    return F.coalesce(F.array_join(each, ""), F.lit(""))


def attachments(parts: Column) -> Column:
    """place (1-based, within the turn), kind, ref and expanded tokens of the parts other than text."""
    listed = F.transform(parts, lambda p, i: F.when(p.isNotNull() & ~is_text(p), F.struct((i + 1).cast("int").alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))))
    return F.coalesce(F.filter(listed, lambda x: x.isNotNull()), F.array().cast("array<struct<place:int,kind:string,ref:string,tokens:bigint>>"))


def text_parts(text: Column) -> Column:
    """A single text part."""
    return F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("kind"))), PART).withField("text", text))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    turns: conv_id, turn, role and content (array of parts), or text where no column content is an array.  Turns are
    ordered by turn, ties by role, then content; repeated rows are turns of their own.  Nulls: an
    unknown role or text is empty, a null turn comes first, rows with a null conv_id form one
    conversation.  loss_spans (start, end; code points, end exclusive) are the contents of loss_role's
    turns, escaped as they stand.  Other columns are ignored; an empty table gives no rows.  A
    conversation becomes one string, so all its turns meet in one row, however many they are.
    """
    parted = "content" in turns.columns and isinstance(turns.schema["content"].dataType, T.ArrayType)
    content = F.col("content") if parted else text_parts(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", flattened(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("files"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.select("conv_id", "turn", "role", "files", "body", head.alias("head"), (F.length(head) + F.length("body") + len(END)).cast("long").alias("size"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("seq", F.row_number().over(w)).withColumn("at", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    start = F.col("at") + F.length("head")
    loss = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    packed = F.struct("seq", F.concat("head", "body", F.lit(END)).alias("marked"), loss.alias("loss"), "files")
    met = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(packed)).alias("t"), F.count("*").alias("n_turns"))
    spans = F.filter(F.transform("t", lambda x: x["loss"]), lambda x: x.isNotNull())
    files = F.flatten(F.transform("t", lambda x: F.transform(x["files"], lambda f: f.withField("seq", x["seq"]))))
    tokens = F.aggregate(files, F.lit(0).cast("long"), lambda n, f: n + f["tokens"])
    return met.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: x["marked"]), "").alias("formatted"), spans.alias("loss_spans"), files.alias("attachments"), tokens.alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted string; placeholders come back as they stand."""
    marked = F.slice(F.split(formatted, r"\Q" + END + r"\E"), F.lit(1), F.size(F.split(formatted, r"\Q" + END + r"\E")) - 1)
    halves = F.transform(marked, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"\Q" + TEXT + r"\E", 2))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(spans, lambda s: unescaped(cut(s))), "")
