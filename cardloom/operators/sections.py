"""Heading-aware sections with breadcrumbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.text import breadcrumb, stripped
from cardloom.operators.chunks import SECTION_CHARS, numbered, split_section
from cardloom.operators.scan import scanned

MARKS = ("\u0001", "\u0002")
HEADING = r"(#{1,3})\s+(.+)"
# Japanese heading rules and their levels, in the order in which they claim a line.
JAPANESE = (
    (r"第\d+章.*", 1),
    (r"第[一二三四五六七八九十百]+章.*", 1),
    (r"(?:序論|本論|結論)", 1),
    (r"\d+\.\s+.+", 2),
    (r"（\d+）.*", 2),
    (r"[一二三四五六七八九十]、.*", 2),
)


def _marked(text: Column) -> tuple[Column, Column, Column]:
    """(text with a mark before each Markdown heading, the same for Japanese ones, whether there are Markdown ones)."""
    markdown = F.regexp_replace(text, rf"(?mdU)^{HEADING}$", MARKS[0] + "$0")
    japanese = text
    for rule, level in JAPANESE:
        japanese = F.regexp_replace(japanese, rf"(?mdU)^(?![\u0001\u0002]){rule}$", MARKS[level - 1] + "$0")
    return markdown, japanese, text.rlike(rf"(?mdU)^{HEADING}$")


def _japanese_heading(body: Column) -> Column:
    """The match of the first rule that matches at the start."""
    found = F.lit("")
    for rule, _ in reversed(JAPANESE):
        hit = F.regexp_extract(body, rf"(?mdU)\A({rule})$", 1)
        found = F.when(hit != "", hit).otherwise(found)
    return found


def sections(docs: DataFrame, key: str, text: str = "text", title: str | None = None, max_chars: int = SECTION_CHARS) -> DataFrame:
    """One row for each section of each text, in order.

    key, section_pos, part, id, heading, level, breadcrumb, text, page_range, char_count.  Markdown
    headings cut a text; failing those, Japanese ones; failing those, it is one section of level 0.
    title names the column that begins breadcrumbs.  Empty texts give no rows.
    """
    name = F.coalesce(F.col(title).cast("string"), F.lit("")) if title else F.lit("")
    # U+0001 and U+0002 mark headings, so they can't stay in the text; normalised text has none.
    rows = docs.select(F.col(key), name.alias("title"), F.regexp_replace(stripped(F.col(text)), "[\u0001\u0002]", "").alias("whole")).where("whole <> ''")
    markdown, japanese, has = _marked(F.col("whole"))
    rows = rows.withColumn("is_md", has).withColumn("marked", F.when(F.col("is_md"), markdown).otherwise(japanese))
    pieces = F.filter(F.split("marked", "(?=[\u0001\u0002])", -1), lambda p: stripped(p) != "")
    rows = rows.select(key, "title", "is_md", F.posexplode(pieces).alias("section_pos", "piece"))
    mark = F.substring("piece", 1, 1)
    rows = rows.withColumn("mark", F.when(mark.isin(*MARKS), mark)).withColumn("body", F.regexp_replace("piece", "[\u0001\u0002]", ""))
    hashes, after = (F.regexp_extract("body", rf"(?dU)\A{HEADING}", k) for k in (1, 2))
    level = F.when(F.col("mark").isNull(), 0).when(F.col("is_md"), F.length(hashes)).when(F.col("mark") == MARKS[0], 1).otherwise(2)
    heading = F.when(F.col("mark").isNull(), "").when(F.col("is_md"), stripped(after)).otherwise(stripped(_japanese_heading(F.col("body"))))
    rows = rows.select(key, "title", "section_pos", level.cast("int").alias("level"), heading.alias("heading"), stripped(F.col("body")).alias("text"))
    rows = heading_trail(rows, key, "section_pos")
    parts = rows.select("*", F.posexplode(numbered(split_section(F.col("text"), max_chars))).alias("part", "p")).select("*", "p.*")
    split = F.col("n_parts") > 1
    base = F.concat(F.lit("section-"), F.col("section_pos").cast("string"))
    return parts.select(
        key,
        "section_pos",
        "part",
        F.when(split, F.concat(base, F.lit("-"), F.col("part").cast("string"))).otherwise(base).alias("id"),
        F.when(split & (F.col("part") > 0), F.concat("heading", F.lit(" (cont.)"))).otherwise(F.col("heading")).alias("heading"),
        "level",
        "breadcrumb",
        F.col("part_text").alias("text"),
        F.lit("").alias("page_range"),
        F.length("part_text").alias("char_count"),
    )


def heading_trail(rows: DataFrame, key: str, order: str, spread: bool = False) -> DataFrame:
    """Rows (level, heading, title) with breadcrumb: of each level the last heading so far, unless one of a smaller level came after it.

    Sections of a document are few; spread scans keys of any size in many tasks (scan.py).
    """
    mine = {f"h{n}": F.when(F.col("level") == n, F.struct(F.col(order).alias("pos"), "heading")) for n in (1, 2, 3)}
    if spread:
        rows = scanned(rows, [key], [order], lasts=mine)
    else:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({name: F.last(value, True).over(w) for name, value in mine.items()})
    pos = lambda n: F.col(f"h{n}.pos")
    lives = lambda n: pos(n).isNotNull() & ~F.coalesce(F.greatest(F.lit(None), *[pos(m) for m in range(1, n)]) > pos(n), F.lit(False)) if n > 1 else pos(1).isNotNull()
    title = F.when(F.col("title") != "", F.col("title"))
    trail = F.array(title, *[F.when(lives(n), F.col(f"h{n}.heading")) for n in (1, 2, 3)])
    trail = F.when(F.col("level") == 0, F.array(title)).otherwise(trail)
    return rows.withColumn("breadcrumb", breadcrumb(F.filter(trail, lambda x: x.isNotNull()))).drop("h1", "h2", "h3")


def page_ranges(pages: DataFrame, key: str) -> DataFrame:
    """The pages of each heading in tables of contents.

    pages: key, page (int), toc_items (array of struct of title, page).  An item without a page takes its
    chunk's; items without a title are left out.
    """
    items = pages.select(key, "page", F.explode("toc_items").alias("item"))
    items = items.select(key, F.col("item.title").alias("heading"), F.coalesce("item.page", "page", F.lit(0)).alias("at")).where("heading <> ''")
    first, last = F.col("first_page").cast("string"), F.col("last_page").cast("string")
    found = items.groupBy(key, "heading").agg(F.min("at").alias("first_page"), F.max("at").alias("last_page"))
    return found.withColumn("page_range", F.when(F.col("first_page") == F.col("last_page"), F.concat(F.lit("p."), first)).otherwise(F.concat(F.lit("pp."), first, F.lit("-"), last)))


def with_page_ranges(found: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Sections with the page range of their heading."""
    known = ranges.select(key, "heading", F.col("page_range").alias("known"))
    return found.join(known, [key, "heading"], "left").withColumn("page_range", F.coalesce("known", "page_range")).drop("known")
