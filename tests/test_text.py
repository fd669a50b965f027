"""Normalisation, sizes, chunks and sections against plain versions and by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import chunks
from cardloom.operators.sections import page_ranges, sections, with_page_ranges

ALPHABET = list("ab \n\t\r#.。第章１一三十、（）結論漢ア한é😀\x00\x0b\x7f　\x85\xa0") + ["\n\n", "# ", "## ", "序論", "\n \n\n"]


def strings(n, seed, k=30):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, k))) for _ in range(n)]


def clean(t):
    t = "".join(c for c in t if not (ord(c) < 32 and c not in "\t\n\r") and ord(c) != 127)
    return re.sub(r"\n\s*\n(\s*\n)+", "\n\n", t).strip()


def n_tokens(t):
    cjk = sum(0x4E00 <= ord(c) <= 0x9FFF or 0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF for c in t)
    return int(cjk / 2.5 + (len(t) - cjk) / 4.0)


def packed(parts, size, limit, separator, width):
    """Pieces in order; the separator counts from before a run closes."""
    out, run, used = [], [], 0
    for p in parts:
        extra = separator if run else 0
        if run and used + extra + size(p) > limit:
            out.append("\n\n".join(run))
            run, used = [], 0
        if size(p) > limit and not run:
            w = width(p)
            out += [p[k : k + w] for k in range(0, len(p), w)]
        else:
            run.append(p)
            used += extra + size(p)
    return out + (["\n\n".join(run)] if run else [])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string")


def test_preprocess_and_tokens(spark):
    texts = strings(1500, 1) + ["", "　a　", "a\n\nb", "a\n\n\nb", "a\n \n\t\nb"]
    rows = frame(spark, texts).select("k", T.preprocessed(F.col("text")).alias("t"), T.estimated_tokens(F.col("text")).alias("n")).collect()
    assert {r.k: (r.t, r.n) for r in rows} == {k: (clean(t), n_tokens(t)) for k, t in enumerate(texts)}


@pytest.mark.parametrize("limit", [1, 5, 12])
def test_chunks(spark, limit):
    texts = ["\n\n".join(strings(6, s, 40)) for s in range(150)]

    def want(t):
        t = t.strip()
        if not t:
            return []
        if n_tokens(t) <= limit:
            return [t]
        return packed(t.split("\n\n"), n_tokens, limit, 1, lambda p: int(limit * (len(p) / n_tokens(p))))

    rows = frame(spark, texts).select("k", chunks.split_into_chunks(F.regexp_replace("text", "[\x1c-\x1f]", ""), limit).alias("c")).collect()
    assert {r.k: r.c for r in rows} == {k: want(t) for k, t in enumerate(texts)}
    with pytest.raises(ValueError):
        chunks.split_into_chunks(F.col("text"), 0)


@pytest.mark.parametrize("limit", [7, 25])
def test_section_parts(spark, limit):
    texts = ["\n\n".join(strings(6, s, 30)) for s in range(150)]

    def want(t):
        parts = [t] if len(t) <= limit else packed(t.split("\n\n"), len, limit, 2, lambda p: limit)
        return parts if len(parts) > 1 else [t]

    rows = frame(spark, texts).select("k", chunks.split_section(F.col("text"), limit).alias("c")).collect()
    assert {r.k: r.c for r in rows} == {k: want(t) for k, t in enumerate(texts)}


def found(spark, text, **options):
    rows = spark.createDataFrame([(1, text, "Book")], "k int, text string, title string")
    got = sections(rows, "k", title="title", **options).orderBy("section_pos", "part").collect()
    return [(r.id, r.level, r.heading, r.breadcrumb, r.text) for r in got]


def test_markdown(spark):
    text = "intro\n# A\none\n### A3\n## A2\n### A23\ntwo\n# B\n#### not\n### B3"
    assert found(spark, text) == [
        ("section-0", 0, "", "Book", "intro"),
        ("section-1", 1, "A", "Book > A", "# A\none"),
        ("section-2", 3, "A3", "Book > A > A3", "### A3"),
        ("section-3", 2, "A2", "Book > A > A2", "## A2"),
        ("section-4", 3, "A23", "Book > A > A2 > A23", "### A23\ntwo"),
        ("section-5", 1, "B", "Book > B", "# B\n#### not"),
        ("section-6", 3, "B3", "Book > B > B3", "### B3"),
    ]


def test_bare_mark_takes_the_next_line(spark):
    assert found(spark, "#\n\nnext\nrest") == [("section-0", 1, "next", "Book > next", "#\n\nnext\nrest")]


def test_japanese(spark):
    text = "前\n第1章 始\na\n（２）項\n第十章\n序論\n序論文\n三、次\n4. 点\n結論"
    assert [(level, heading, crumb) for _, level, heading, crumb, _ in found(spark, text)] == [
        (0, "", "Book"), (1, "第1章 始", "Book > 第1章 始"), (2, "（２）項", "Book > 第1章 始 > （２）項"), (1, "第十章", "Book > 第十章"), (1, "序論", "Book > 序論"),
        (2, "三、次", "Book > 序論 > 三、次"), (2, "4. 点", "Book > 序論 > 4. 点"), (1, "結論", "Book > 結論"),
    ]


def test_no_heading_and_parts(spark):
    assert found(spark, "  ") == []
    assert found(spark, "aaaa\n\nbbbb", max_chars=5) == [("section-0-0", 0, "", "Book", "aaaa"), ("section-0-1", 0, " (cont.)", "Book", "bbbb")]


def test_page_ranges(spark):
    rows = spark.createDataFrame([(1, 4, [("A", None), ("B", 9), ("", 1)]), (1, 7, [("A", 6)])], "k int, page int, toc_items array<struct<title:string,page:int>>")
    ranges = page_ranges(rows, "k")
    assert {r.heading: r.page_range for r in ranges.collect()} == {"A": "pp.4-6", "B": "p.9"}
    heads = sections(spark.createDataFrame([(1, "# A\nx\n# C")], "k int, text string"), "k")
    assert {r.heading: r.page_range for r in with_page_ranges(heads, ranges, "k").collect()} == {"A": "pp.4-6", "C": ""}


def test_images_and_options(spark):
    rows = spark.createDataFrame([(1092, 1092, b"a" * 100), (3136, 100, b""), (100, 100, None)], "w int, h int, b binary")
    got = rows.select(T.image_tokens(F.col("w"), F.col("h")), F.round(T.image_scale(F.col("w"), F.col("h")), 6), T.image_base64(F.col("b"))).collect()
    assert [tuple(r)[:2] for r in got] == [(1589, 0.982033), (418, 0.5), (13, 1.0)]
    assert "\n" not in got[0][2] and len(got[0][2]) == 136 and got[1][2] == got[2][2] == ""
    assert T.parse_csv_option(None) is None and T.parse_csv_option("a, ,b") == ["a", "", "b"]
