"""The queries over the driver's tables, and their SQL.

The tables hold no cards, so queries derive them: neighbouring user and assistant turns are front and
back, and types, levels, tags and shapes follow from ids.  Texts get headings from line numbers in the
same way.  The rules are spelled out twice, in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import similarity
from cardloom.functions.cost import MID, estimated_cost, selected_model
from cardloom.functions.text import cjk_count, estimated_tokens, image_scale, image_tokens, preprocessed, shortened
from cardloom.operators import chunks, critique, duplicates, export, images, ledger, matching, requests, review
from cardloom.operators import sections as sectioning
from cardloom.operators.cards import by_bloom, by_type, parse_responses, score_cards, valid_cards
from cardloom.operators.edges import score_edges
from cardloom.operators.scan import numbered_rows
from cardloom.plans.convert import critique_requests, preview, run_quality
from cardloom.schemas import BLOOM_LEVELS, CARD, CARD_TYPES, WEIGHTS
from cardloom.settling import remove, settle, work_path
from cardloom.sources import files, sink
from cardloom.sources.cache import cache_misses
from cardloom.streaming.ingest import spending_by_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Conversations, or benchmark items, of a deck: decks stay as large as they are, and grow in number.
DECK = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _few(table: DataFrame) -> bool:
    """Whether a table has fewer partitions than there are cores, so that most would stay idle."""
    return table._jdf.queryExecution().toRdd().getNumPartitions() < table.sparkSession.sparkContext.defaultParallelism


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a small table is dealt out to all cores, a large one stays as it is."""
    docs = _table(spark, sf_dir, "documents")
    return docs.repartition(spark.sparkContext.defaultParallelism) if _few(docs) else docs


def _names(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- documents: sizes, chunks, sections -------------------------------------------------------

CLEAN = r"""clean AS (
    SELECT doc_id, lang, source, text, regexp_replace(regexp_replace(regexp_replace(text,
        '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n\s*\n(\s*\n)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t
    FROM documents
), sized AS (
    SELECT *, length(regexp_replace(t, '[^\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]', '', 'g')) AS cjk FROM clean
), tokened AS (
    SELECT *, trunc(cjk / 2.5::DOUBLE + (length(t) - cjk) / 4.0::DOUBLE)::INTEGER AS tokens FROM sized
)"""


@query(f"""WITH {CLEAN}
    SELECT lang, count(*) AS n_docs, sum(length(t))::BIGINT AS n_chars, sum(tokens)::BIGINT AS n_tokens,
           round(sum(tokens / 1e6 * 3.0 + (tokens // 4) / 1e6 * 15.0), 6) AS cost_usd, max(tokens) AS largest,
           count(*) FILTER (WHERE tokens > 2000) AS n_split
    FROM tokened GROUP BY lang""")
def doc_preview_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preview(_documents(spark, sf_dir), token_limit=2000)
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_chars_clean").alias("n_chars"),
        F.sum("tokens").alias("n_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.max("tokens").alias("largest"),
        F.count_if(F.col("n_chunks") > 1).alias("n_split"),
    )


@query(f"WITH {CLEAN} SELECT doc_id, length(t) AS n_chars_clean, cjk, tokens FROM tokened")
def doc_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", preprocessed(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars_clean"), cjk_count(F.col("t")).cast("long").alias("cjk"), estimated_tokens(F.col("t")).alias("tokens"))


@query(f"WITH {CLEAN} SELECT source, sum(length(text))::BIGINT AS before, sum(length(t))::BIGINT AS after FROM clean GROUP BY source")
def doc_preprocess_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("source", F.length("text").alias("a"), F.length(preprocessed(F.col("text"))).alias("b"))
    return rows.groupBy("source").agg(F.sum("a").alias("before"), F.sum("b").alias("after"))


@query(f"""WITH {CLEAN}
    SELECT CASE WHEN length(t) >= 10000 OR doc_id % 40 >= 30 THEN 'mid-tier' ELSE 'low-tier' END AS model, count(*) AS n_docs,
           sum(tokens)::BIGINT AS n_tokens, min(doc_id) AS first_doc
    FROM tokened GROUP BY 1""")
def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", preprocessed(F.col("text")).alias("t"))
    rows = rows.withColumn("model", selected_model(F.length("t"), F.col("doc_id") % 40))
    return rows.groupBy("model").agg(F.count("*").alias("n_docs"), F.sum(estimated_tokens(F.col("t"))).alias("n_tokens"), F.min("doc_id").alias("first_doc"))


def _fold_sql(limit: int, separator: int, size: str, width: str) -> str:
    """The packing of paragraphs as a recursion over paragraph numbers."""
    return f"""WITH RECURSIVE whole AS (
        SELECT doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), chr(10) || chr(10)) AS w FROM documents
    ), paragraphs AS (
        SELECT doc_id, w, p, i FROM (SELECT doc_id, w, unnest(string_split(w, chr(10) || chr(10))) AS p, generate_subscripts(string_split(w, chr(10) || chr(10)), 1) AS i FROM whole WHERE w <> '')
    ), sizes AS (SELECT *, ({size})::BIGINT AS n FROM paragraphs
    ), steps AS (
        SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS done, false AS open, 0::BIGINT AS used, -1::BIGINT AS grp, false AS alone FROM whole WHERE w <> ''
        UNION ALL
        SELECT doc_id, i, CASE WHEN on_ THEN done WHEN big THEN done2 + 1 ELSE done2 END, NOT big,
               CASE WHEN big THEN 0 ELSE (CASE WHEN shut THEN 0 ELSE used END) + sep + n END, CASE WHEN on_ THEN done ELSE done2 END, big
        FROM (
            SELECT *, n > {limit} AND NOT on_ AS big FROM (
                SELECT *, open AND NOT shut AS on_, done + CASE WHEN shut THEN 1 ELSE 0 END AS done2 FROM (
                    SELECT s.doc_id, z.i, s.done, s.open, s.used, z.n, CASE WHEN s.open THEN {separator} ELSE 0 END AS sep,
                           s.open AND s.used + CASE WHEN s.open THEN {separator} ELSE 0 END + z.n > {limit} AS shut
                    FROM steps s JOIN sizes z ON z.doc_id = s.doc_id AND z.i = s.i + 1)))
    ), runs AS (
        SELECT s.doc_id, grp, bool_or(alone) AS alone, string_agg(p, chr(10) || chr(10) ORDER BY s.i) AS body
        FROM steps s JOIN paragraphs USING (doc_id, i) GROUP BY s.doc_id, grp
    ), cut AS (
        SELECT doc_id, grp, 0 AS k, body FROM runs WHERE NOT alone
        UNION ALL
        SELECT doc_id, grp, k, substr(body, (k * ({width}) + 1)::BIGINT, ({width})::BIGINT) FROM (SELECT *, unnest(range(0, (length(body) - 1) // ({width}) + 1)) AS k FROM runs WHERE alone)
    )"""


_TOKENS = "trunc(length(p) / 4.0::DOUBLE)"  # these texts hold no CJK


@query(
    _fold_sql(200, 1, _TOKENS, "greatest(1, trunc(200.0::DOUBLE * (length(body) / trunc(length(body) / 4.0::DOUBLE)))::BIGINT)")
    + """, small AS (SELECT doc_id, w FROM whole WHERE w <> '' AND trunc(length(w) / 4.0::DOUBLE) <= 200)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, k) - 1 AS chunk_idx, length(body) AS n_chars, md5(body) AS digest
    FROM cut WHERE doc_id NOT IN (SELECT doc_id FROM small)
    UNION ALL SELECT doc_id, 0, length(w), md5(w) FROM small"""
)
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.regexp_replace("text", r"\A\s+|\s+\z", ""), F.lit("\n"), F.lit("\n\n"))
    rows = chunks.chunk_rows(_documents(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id", token_limit=200)
    return rows.select("doc_id", F.col("chunk_idx").cast("long"), F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@query(
    _fold_sql(600, 2, "length(p)", "600")
    + """, parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, k) - 1 AS part, count(*) OVER (PARTITION BY doc_id) AS n FROM cut
        WHERE doc_id IN (SELECT doc_id FROM whole WHERE length(w) > 600))
    SELECT doc_id, 'section-0-' || part AS id, length(body) AS char_count, md5(body) AS digest FROM parts WHERE n > 1
    UNION ALL SELECT doc_id, 'section-0', length(w), md5(w) FROM whole WHERE w <> '' AND doc_id NOT IN (SELECT doc_id FROM parts WHERE n > 1)"""
)
def subsplit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.regexp_replace("text", r"\A\s+|\s+\z", ""), F.lit("\n"), F.lit("\n\n"))
    docs = _documents(spark, sf_dir).select("doc_id", text.alias("text")).where("text <> ''")
    parts = docs.select("doc_id", F.posexplode(chunks.numbered(chunks.split_section(F.col("text"), 600))).alias("part", "p"))
    parts = parts.select("doc_id", "part", F.col("p.part_text").alias("t"), F.col("p.n_parts").alias("n"))
    name = F.when(F.col("n") > 1, F.concat(F.lit("section-0-"), F.col("part").cast("string"))).otherwise("section-0")
    return parts.select("doc_id", name.alias("id"), F.length("t").cast("long").alias("char_count"), F.md5("t").alias("digest"))


def _headed(docs: DataFrame, marks: dict[int, str]) -> DataFrame:
    """Lines that aren't blank, those at some places modulo 5 as headings."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    mark = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in marks.items() for v in kv]), (i % 5).cast("int")), F.lit(""))
    with_marks = F.transform(lines, lambda x, i: F.concat(F.replace(mark(i), F.lit("N"), (i + 1).cast("string")), F.trim(x)))
    return docs.select("doc_id", "source", F.array_join(with_marks, "\n\n").alias("text"))


def _headed_sql(marks: dict[int, str], levels: dict[int, int], strip: str) -> str:
    case = " ".join(f"WHEN {k} THEN replace('{v}', 'N', i::VARCHAR)" for k, v in marks.items())
    level = " ".join(f"WHEN {k} THEN {v}" for k, v in levels.items())
    return f"""WITH listed AS (
        SELECT doc_id, source, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS l FROM documents
    ), lines AS (
        SELECT doc_id, source, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM listed
    ), marked AS (
        SELECT doc_id, source, i, CASE (i - 1) % 5 {case} ELSE '' END || raw AS line, raw, CASE (i - 1) % 5 {level} ELSE 0 END AS level FROM lines
    ), counted AS (
        SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM marked
    ), found AS (
        SELECT doc_id, source, pos, max(level) AS level, string_agg(line, chr(10) || chr(10) ORDER BY i) AS body, coalesce(arg_min({strip}, i) FILTER (WHERE level > 0), '') AS heading
        FROM counted GROUP BY doc_id, source, pos
    ), trail AS (
        SELECT *, {", ".join(f"last_value(CASE WHEN level = {n} THEN heading END IGNORE NULLS) OVER w AS h{n}, coalesce(max(CASE WHEN level = {n} THEN pos END) OVER w, -1) AS p{n}" for n in (1, 2, 3))}
        FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
    )
    SELECT doc_id, 'section-' || pos AS id, heading, level::INTEGER AS level, length(body) AS char_count, md5(body) AS digest,
           concat_ws(' > ', source, CASE WHEN level > 0 AND p1 > -1 THEN h1 END, CASE WHEN level > 0 AND p2 > p1 THEN h2 END,
                     CASE WHEN level > 0 AND p3 > greatest(p1, p2) THEN h3 END) AS breadcrumb
    FROM trail"""


_MD = {1: "# ", 3: "## ", 4: "### "}
_JP = {1: "第N章 ", 3: "（N） "}


def _sections(spark: SparkSession, sf_dir: str, marks: dict[int, str]) -> DataFrame:
    rows = sectioning.sections(_headed(_documents(spark, sf_dir), marks), "doc_id", title="source", max_chars=10_000_000)
    return rows.select("doc_id", "id", "heading", "level", F.col("char_count").cast("long").alias("char_count"), F.md5("text").alias("digest"), "breadcrumb")


@query(_headed_sql(_MD, {1: 1, 3: 2, 4: 3}, "raw"))
def section_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir, _MD)


@query(_headed_sql(_JP, {1: 1, 3: 2}, "line"))
def japanese_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir, _JP)


@query("""
    WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h, list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: trim(replace(x, chr(10), ' '))) AS ps FROM pages)
    SELECT page_id, trim(replace(h, chr(10), ' ')) AS heading, len(list_filter(ps, lambda x: x <> '')) AS n_paragraphs,
           length('# ' || trim(replace(h, chr(10), ' ')) || coalesce(list_aggregate(list_transform(list_filter(ps, lambda x: x <> ''), lambda x: chr(10) || chr(10) || x), 'string_agg', ''), '')) AS char_count
    FROM p""")
def sections_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))
    head = flat(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    body = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1), flat), lambda x: x != "")
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("# "), head, F.array_join(F.transform(body, lambda x: F.concat(F.lit("\n\n"), x)), "")).alias("text"), F.size(body).cast("long").alias("n_paragraphs"))
    rows = sectioning.sections(pages, "page_id", max_chars=10_000_000)
    return rows.join(pages.select("page_id", "n_paragraphs"), "page_id").select("page_id", "heading", "n_paragraphs", F.col("char_count").cast("long").alias("char_count"))


@query("""SELECT source, 't' || (doc_id % 7) AS heading, min(n_chars % 300)::INTEGER AS first_page, max(n_chars % 300)::INTEGER AS last_page,
           CASE WHEN min(n_chars % 300) = max(n_chars % 300) THEN 'p.' || min(n_chars % 300) ELSE 'pp.' || min(n_chars % 300) || '-' || max(n_chars % 300) END AS page_range
    FROM documents GROUP BY 1, 2""")
def toc_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.col("n_chars") % 300).cast("int")
    titled = F.struct(F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 0, page).alias("page"))
    untitled = F.struct(F.lit("").alias("title"), page.alias("page"))
    return sectioning.page_ranges(_table(spark, sf_dir, "documents").select("source", page.alias("page"), F.array(titled, untitled).alias("toc_items")), "source")


@query("""SELECT sha256(text) AS content_hash, count(*) AS n_copies, min(doc_id) AS first_doc FROM documents GROUP BY 1""")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id, sha256(text) AS cache_key FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""")
def cache_miss_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("cache_key"))
    return cache_misses(docs, docs.where("doc_id % 3 = 0"))


# ---- spending ---------------------------------------------------------------------------------

USAGE = """usage AS (
    SELECT event_id, ts, user_id, CASE event_id % 4 WHEN 0 THEN 'mid-tier' WHEN 1 THEN 'low-tier' WHEN 2 THEN 'top-tier' ELSE 'unknown' END AS model,
           200 + event_id % 5000 AS input_tokens, 50 + event_id % 700 AS output_tokens, event_id % 3 = 0 AS batch FROM events
), ledger AS (
    SELECT *, input_tokens / 1e6 * ((CASE model WHEN 'mid-tier' THEN 3.0 WHEN 'low-tier' THEN 0.8 ELSE 15.0 END)::DOUBLE * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
            + output_tokens / 1e6 * ((CASE model WHEN 'mid-tier' THEN 15.0 WHEN 'low-tier' THEN 4.0 ELSE 75.0 END)::DOUBLE * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS cost_usd
    FROM usage
)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    model = F.when(e % 4 == 0, "mid-tier").when(e % 4 == 1, "low-tier").when(e % 4 == 2, "top-tier").otherwise("unknown")
    return _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", model.alias("model"), (e % 5000 + 200).alias("input_tokens"), (e % 700 + 50).alias("output_tokens"), (e % 3 == 0).alias("batch"))


@query(f"""WITH {USAGE} SELECT model, batch, count(*) AS calls, sum(input_tokens)::BIGINT AS tokens_in, round(sum(cost_usd), 6) AS cost_usd FROM ledger GROUP BY ALL""")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.with_cost(_usage(spark, sf_dir))
    return rows.groupBy("model", "batch").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens_in"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query(f"""WITH {USAGE} SELECT user_id % 50 AS team, round(sum(cost_usd), 6) AS total_cost, count(*) AS request_count, round(1.5 - sum(cost_usd), 6) AS budget_remaining, sum(cost_usd) <= 1.5 AS within_budget
    FROM ledger GROUP BY 1""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.with_cost(_usage(spark, sf_dir)).withColumn("team", F.col("user_id") % 50)
    found = ledger.totals(rows, "team", budget=1.5)
    return found.select("team", F.round("total_cost", 6).alias("total_cost"), "request_count", F.round("budget_remaining", 6).alias("budget_remaining"), "within_budget")


def _gate_sql(partition: str, budget: float) -> str:
    over = f"OVER ({f'PARTITION BY {partition}' if partition else ''} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    first = f"OVER ({f'PARTITION BY {partition}' if partition else ''})"
    return f"""WITH {USAGE}, gated AS (SELECT *, coalesce(sum(cost_usd) {over}, 0) AS spent FROM ledger)
    SELECT event_id, round(spent, 6) AS spent_before, spent <= {budget} AS allowed,
           coalesce(event_id = min(CASE WHEN spent <= {budget} AND spent >= {0.8 * budget} THEN event_id END) {first}, false) AS warns
    FROM gated"""


@query(_gate_sql("user_id % 20", 2.0))
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.with_cost(_usage(spark, sf_dir)).withColumn("team", F.col("user_id") % 20)
    found = ledger.budget_gate(rows, ["event_id"], budget=2.0, partition=["team"])
    return found.select("event_id", F.round("spent_before", 6).alias("spent_before"), "allowed", "warns")


@query(_gate_sql("", 40.0))
def budget_gate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.budget_gate(ledger.with_cost(_usage(spark, sf_dir)), ["event_id"], budget=40.0)
    return found.select("event_id", F.round("spent_before", 6).alias("spent_before"), "allowed", "warns")


HOT = "CASE WHEN event_id % 10 < 9 THEN 0 ELSE user_id % 20 END"


def _hot_team() -> Column:
    """A key that holds nine of ten events."""
    return F.when(F.col("event_id") % 10 < 9, F.lit(0).cast("long")).otherwise(F.col("user_id") % 20)


@query(_gate_sql(HOT, 30.0))
def budget_gate_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, W3 where one key holds nine of ten calls."""
    rows = ledger.with_cost(_usage(spark, sf_dir)).withColumn("team", _hot_team())
    found = ledger.budget_gate(rows, ["event_id"], budget=30.0, partition=["team"])
    return found.select("event_id", F.round("spent_before", 6).alias("spent_before"), "allowed", "warns")


@query(f"""WITH e AS (SELECT event_id, {HOT} AS team, ts FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY team ORDER BY ts, event_id) - 1 AS n FROM e""")
def numbering_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 where one key holds nine of ten rows."""
    rows = _table(spark, sf_dir, "events").select("event_id", "ts", _hot_team().alias("team"))
    return numbered_rows(rows, "n", ["team"], ["ts", "event_id"]).select("event_id", "n")


@query(f"""WITH e AS (SELECT event_id, {HOT} AS team, user_id % 4 AS level, 'h' || event_id AS heading FROM events
    ), l AS (SELECT *, {", ".join(f"max(CASE WHEN level = {n} THEN event_id END) OVER (PARTITION BY team ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p{n}" for n in (1, 2, 3))} FROM e)
    SELECT event_id, CASE WHEN level = 0 THEN 'top' ELSE concat_ws(' > ', 'top', 'h' || p1, CASE WHEN p2 > coalesce(p1, -1) THEN 'h' || p2 END,
        CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN 'h' || p3 END) END AS breadcrumb FROM l""")
def heading_trail_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 where one key holds nine of ten headings."""
    rows = _table(spark, sf_dir, "events").select("event_id", _hot_team().alias("team"), (F.col("user_id") % 4).cast("int").alias("level"), F.concat(F.lit("h"), "event_id").alias("heading"), F.lit("top").alias("title"))
    return sectioning.heading_trail(rows, "team", "event_id", spread=True).select("event_id", "breadcrumb")


@query(f"""WITH {USAGE} SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", round(sum(cost_usd), 6) AS cost_usd, count(*) AS calls FROM ledger GROUP BY 1, 2""")
def spending_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spending_by_window(_usage(spark, sf_dir))
    return found.select("start", "end", F.round("cost_usd", 6).alias("cost_usd"), "calls")


@query("""WITH s AS (SELECT conv_id, turn, length(text) % 30 AS n, sum(length(text) % 30) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations)
    SELECT conv_id, turn, coalesce(b, 0)::BIGINT AS cards_before, coalesce(b, 0) < 50 AS allowed FROM s""")
def card_cap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 30).alias("n_cards"))
    return ledger.card_cap_gate(rows, ["turn"], ["conv_id"]).select("conv_id", "turn", "cards_before", "allowed")


@query("""SELECT conv_id, coalesce(arg_min(role, turn) FILTER (WHERE role <> 'system'), 'none') AS model_used FROM conversations GROUP BY 1""")
def first_model_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).otherwise("").alias("model"))
    return ledger.model_used(calls, "conv_id", "turn", "none")


# ---- cards ------------------------------------------------------------------------------------

CARDS = f"""turns AS (
    SELECT conv_id, turn, role, text, lead(role) OVER w AS role2, lead(text) OVER w AS text2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), cards AS (
    SELECT 'deck-' || (conv_id // {DECK}) AS source_file, row_number() OVER (PARTITION BY conv_id // {DECK} ORDER BY conv_id, turn) - 1 AS card_idx,
        CASE WHEN conv_id % 8 = 3 AND turn % 4 = 0 THEN '{{{{c1::' || substr(text, 1, 30) || '}}}} ' || substr(text, 31, 40)
             WHEN conv_id % 7 = 1 THEN substr(text, 1, 8) WHEN conv_id % 7 = 2 THEN substr(text, 1, 120) || '?' ELSE text END AS front,
        CASE WHEN conv_id % 8 = 3 AND turn % 4 = 0 THEN '' WHEN conv_id % 5 = 0 THEN substr(text2, 1, 60) WHEN conv_id % 5 = 1 THEN substr(text2, 1, 3)
             WHEN conv_id % 11 = 0 THEN '1. ' || substr(text2, 1, 20) || ' 2. ' || substr(text2, 21, 20) ELSE text2 END AS back,
        {_names(CARD_TYPES)}[conv_id % 8 + 1] AS card_type, {_names(BLOOM_LEVELS)}[turn % 6 + 1] AS bloom_level,
        CASE conv_id % 3 WHEN 0 THEN ['topic::t' || (conv_id % 4), 'turns'] WHEN 1 THEN ['turns'] ELSE ['topic::t' || (conv_id % 4)] END AS tags
    FROM turns WHERE role = 'user' AND role2 = 'assistant'
)"""


def cards_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, card_idx and a card for each pair of turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    table = _table(spark, sf_dir, "conversations")
    turns = table.withColumns({"role2": F.lead("role").over(w), "text2": F.lead("text").over(w)})
    rows = turns.where("role = 'user' AND role2 = 'assistant'")
    c, t, a, b = F.col("conv_id"), F.col("turn"), F.col("text"), F.col("text2")
    cloze = (c % 8 == 3) & (t % 4 == 0)
    front = F.when(cloze, F.concat(F.lit("{{c1::"), a.substr(1, 30), F.lit("}} "), a.substr(31, 40))).when(c % 7 == 1, a.substr(1, 8)).when(c % 7 == 2, F.concat(a.substr(1, 120), F.lit("?"))).otherwise(a)
    listed = F.concat(F.lit("1. "), b.substr(1, 20), F.lit(" 2. "), b.substr(21, 20))
    back = F.when(cloze, F.lit("")).when(c % 5 == 0, b.substr(1, 60)).when(c % 5 == 1, b.substr(1, 3)).when(c % 11 == 0, listed).otherwise(b)
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    topic = F.concat(F.lit("topic::t"), (c % 4).cast("string"))
    tags = F.when(c % 3 == 0, F.array(topic, F.lit("turns"))).when(c % 3 == 1, F.array(F.lit("turns"))).otherwise(F.array(topic))
    number = F.row_number().over(Window.partitionBy(F.floor(c / DECK)).orderBy("conv_id", "turn")) - 1
    empty = F.array().cast("array<string>")
    cards = rows.select(
        F.concat(F.lit("deck-"), F.floor(c / DECK).cast("string")).alias("source_file"),
        number.alias("card_idx"),
        front.alias("front"),
        back.alias("back"),
        pick(CARD_TYPES, c % 8).alias("card_type"),
        pick(BLOOM_LEVELS, t % 6).alias("bloom_level"),
        tags.alias("tags"),
        empty.alias("related_concepts"),
        F.lit(None).cast("string").alias("mnemonic_hint"),
        empty.alias("media"),
    )
    return cards.repartition(spark.sparkContext.defaultParallelism, "source_file", "card_idx") if _few(table) else cards


@query(f"WITH {CARDS} SELECT source_file, card_idx, md5(front) AS front, md5(back) AS back, card_type, bloom_level, array_to_string(tags, ' ') AS tags FROM cards")
def cards_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards_of(spark, sf_dir)
    return rows.select("source_file", F.col("card_idx").cast("long"), F.md5("front").alias("front"), F.md5("back").alias("back"), "card_type", "bloom_level", F.array_join("tags", " ").alias("tags"))


SCORED = (
    CARDS
    + r""", measured AS (
    SELECT *, length(front) AS nf, length(back) AS nb, regexp_matches(front, '[？?]') AS asks, regexp_matches(front, '\{\{c\d+::') AS marked,
        len(regexp_extract_all(front, '\{\{c\d+::')) AS n_cloze,
        greatest(1, len(list_filter(string_split_regex(back, '[。．.！!]\s*'), lambda x: regexp_matches(x, '\S')))) AS n_sentences FROM cards
), dims AS (
    SELECT *,
        CASE WHEN card_type = 'cloze' THEN CASE WHEN marked THEN CASE WHEN nf >= 10 THEN 1.0 ELSE 0.7 END ELSE 0.4 END::DOUBLE
             WHEN card_type IN ('reversible', 'term_definition') AND nf >= 1 THEN CASE WHEN nf <= 80 THEN 1.0 ELSE 0.8 END::DOUBLE
             WHEN nf < 10 THEN greatest(0.3::DOUBLE, nf / 10.0::DOUBLE * 0.6::DOUBLE)
             ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.7::DOUBLE + CASE WHEN asks THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN nf <= 200 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END)) END AS front_quality,
        CASE WHEN card_type = 'cloze' THEN CASE WHEN nb = 0 THEN 1.0 ELSE 0.8 END::DOUBLE WHEN nb = 0 THEN 0.0::DOUBLE WHEN nb < 5 THEN 0.4::DOUBLE
             WHEN nb > 200 THEN greatest(0.2::DOUBLE, 0.7::DOUBLE - least(0.5::DOUBLE, (nb - 200) / 200.0::DOUBLE)) WHEN nb >= 10 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS back_quality,
        CASE card_type WHEN 'cloze' THEN CASE WHEN marked THEN 1.0 ELSE 0.3 END WHEN 'qa' THEN CASE WHEN marked THEN 0.5 ELSE 1.0 END
             WHEN 'summary_point' THEN CASE WHEN marked THEN 0.5 ELSE 1.0 END WHEN 'term_definition' THEN CASE WHEN nf <= 50 AND nb > 0 THEN 1.0 ELSE 0.7 END
             WHEN 'reversible' THEN CASE WHEN nf <= 80 AND nb > 0 THEN 1.0 ELSE 0.7 END
             WHEN 'compare_contrast' THEN CASE WHEN regexp_matches(front, '違い|比較|差|differ|compar') THEN 1.0 ELSE 0.7 END
             WHEN 'sequence' THEN CASE WHEN regexp_matches(front, '次|後|ステップ|step|after|before') THEN 1.0 ELSE 0.7 END ELSE 0.8 END::DOUBLE AS card_type_fit,
        0.9::DOUBLE AS bloom_level_fit,
        CASE WHEN len(tags) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN len(list_filter(tags, lambda x: contains(x, '::'))) > 0 THEN 0.3::DOUBLE ELSE 0 END
             + CASE WHEN len(tags) >= 2 THEN 0.2::DOUBLE ELSE 0 END) END AS tags_quality,
        CASE WHEN card_type = 'cloze' THEN CASE WHEN n_cloze <= 3 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - (n_cloze - 3) * 0.1::DOUBLE) END
             WHEN nb = 0 THEN 0.9::DOUBLE WHEN n_sentences <= 1 THEN 1.0::DOUBLE WHEN n_sentences = 2 THEN 0.8::DOUBLE WHEN n_sentences = 3 THEN 0.6::DOUBLE
             WHEN regexp_matches(back, 'また[、,]|さらに|加えて|そして|および|ならびに') THEN greatest(0.2::DOUBLE, greatest(0.3::DOUBLE, 1.0::DOUBLE - n_sentences * 0.15::DOUBLE) - 0.15::DOUBLE)
             ELSE greatest(0.3::DOUBLE, 1.0::DOUBLE - n_sentences * 0.15::DOUBLE) END AS atomicity
    FROM measured
), scored AS (
    SELECT *, front_quality * 0.25::DOUBLE + back_quality * 0.25::DOUBLE + card_type_fit * 0.15::DOUBLE + bloom_level_fit * 0.1::DOUBLE + tags_quality * 0.1::DOUBLE + atomicity * 0.15::DOUBLE AS weighted_total,
        array_to_string(list_filter([
            CASE WHEN card_type NOT IN ('cloze', 'reversible', 'term_definition') AND (nf < 10 OR (NOT asks AND front_quality < 0.7::DOUBLE)) THEN 'vague_question' END,
            CASE WHEN nb > 200 THEN 'too_long_answer' END,
            CASE WHEN card_type IN ('qa', 'summary_point') AND (regexp_matches(back, '(?:\d+[.、．]|[・\-*])\s*\S.*(?:\n|\s+)(?:\d+[.、．]|[・\-*])\s*\S') OR regexp_matches(front, '挙げ|列挙|リスト|すべて|全て|3つ|三つ|4つ|四つ|5つ|五つ')) THEN 'list_not_cloze' END
        ], lambda x: x IS NOT NULL), ',') AS flags FROM dims
)"""
)


@query(f"WITH {SCORED} SELECT source_file, card_idx, {', '.join(f'round({d}, 9) AS {d}' for d in WEIGHTS)}, round(weighted_total, 9) AS weighted_total FROM scored")
def score_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_cards(cards_of(spark, sf_dir))
    return rows.select("source_file", F.col("card_idx").cast("long"), *[F.round(d, 9).alias(d) for d in (*WEIGHTS, "weighted_total")])


@query(f"WITH {SCORED} SELECT card_type, count(*) AS n_cards, round(avg(weighted_total), 6) AS mean_total, round(min(weighted_total), 9) AS least, round(max(weighted_total), 9) AS most FROM scored GROUP BY 1")
def score_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_cards(cards_of(spark, sf_dir))
    return rows.groupBy("card_type").agg(F.count("*").alias("n_cards"), F.round(F.avg("weighted_total"), 6).alias("mean_total"), F.round(F.min("weighted_total"), 9).alias("least"), F.round(F.max("weighted_total"), 9).alias("most"))


@query(f"WITH {SCORED} SELECT source_file, card_idx, flags FROM scored")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_cards(cards_of(spark, sf_dir))
    return rows.select("source_file", F.col("card_idx").cast("long"), F.array_join("flags", ",").alias("flags"))


def _jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both} / (len({a}) + len({b}) - {both})::DOUBLE END"


def _bigrams_sql(s: str) -> str:
    return f"CASE WHEN length({s}) >= 2 THEN list_distinct(list_transform(range(1, length({s})), lambda i: substr({s}, i::BIGINT, 2))) WHEN length({s}) = 1 THEN [{s}] ELSE []::VARCHAR[] END"


PAIRS = (
    SCORED
    + rf""", featured AS (
    SELECT source_file, card_idx, card_type, back, list_sort(list_distinct(tags)) AS tag_set, {_bigrams_sql("front")} AS f, {_bigrams_sql("back")} AS b,
        list_distinct(list_filter(string_split_regex(front, '[\s\x{{3000}}\x{{3001}}\x{{3002}}\x{{FF1F}}?\x{{FF01}}!,.\-:\x{{FF1A}}]+'), lambda x: length(x) >= 2)) AS t FROM cards
), compared AS (
    SELECT x.source_file, x.card_idx AS i, y.card_idx AS j, x.card_type = y.card_type AS typed, x.tag_set = y.tag_set AS tagged, x.back <> '' AND y.back <> '' AS backed,
        {_jaccard_sql("x.f", "y.f")} AS fs, {_jaccard_sql("x.t", "y.t")} AS ts, {_jaccard_sql("x.b", "y.b")} AS bs
    FROM featured x JOIN featured y ON x.source_file = y.source_file AND x.card_idx < y.card_idx
), pairs AS (
    SELECT * FROM compared WHERE (typed AND fs > 0.7) OR (tagged AND fs > 0.5) OR (typed AND ts > 0.5) OR (typed AND backed AND bs > 0.4 AND fs > 0.1) OR (typed AND backed AND tagged AND bs > 0.35)
)"""
)


@query(f"WITH {PAIRS} SELECT source_file, i, j FROM pairs")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates.similar_pairs(cards_of(spark, sf_dir))
    return found.select("source_file", F.col("i").cast("long"), F.col("j").cast("long"))


@query(f"WITH {PAIRS} SELECT source_file, count(*) AS n_pairs, round(avg(fs), 9) AS front_mean, round(max(bs), 9) AS back_most, round(avg(ts), 9) AS token_mean FROM compared GROUP BY 1")
def pair_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicates.featured(cards_of(spark, sf_dir))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.source_file") == F.col("b.source_file")) & (F.col("a.card_idx") < F.col("b.card_idx")))
    s = [similarity.jaccard(F.col(f"a.{n}"), F.col(f"b.{n}")).alias(n) for n in "ftb"]
    return met.select(F.col("a.source_file").alias("source_file"), *s).groupBy("source_file").agg(F.count("*").alias("n_pairs"), F.round(F.avg("f"), 9).alias("front_mean"), F.round(F.max("b"), 9).alias("back_most"), F.round(F.avg("t"), 9).alias("token_mean"))


@query(
    f"""WITH {PAIRS}, members AS (SELECT source_file, i AS card_idx FROM pairs UNION SELECT source_file, j FROM pairs)
    SELECT source_file, card_idx, concat_ws(',', CASE WHEN flags <> '' THEN flags END, CASE WHEN m.card_idx IS NOT NULL THEN 'duplicate_concept' END) AS flags
    FROM scored LEFT JOIN members m USING (source_file, card_idx)"""
)
def duplicate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cards_of(spark, sf_dir)
    rows = duplicates.flag_duplicates(score_cards(cards), duplicates.similar_pairs(cards))
    return rows.select("source_file", F.col("card_idx").cast("long"), F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {SCORED} SELECT source_file, card_idx, weighted_total >= 0.9 AS passed, CASE WHEN weighted_total < 0.9 THEN row_number() OVER (PARTITION BY source_file, weighted_total >= 0.9 ORDER BY card_idx) - 1 END AS low_idx FROM scored""")
def threshold_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = critique.route(score_cards(cards_of(spark, sf_dir)))
    return rows.select("source_file", F.col("card_idx").cast("long"), "passed", F.col("low_idx").cast("long"))


LOW = SCORED + ", low AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY card_idx) - 1 AS low_idx FROM scored WHERE weighted_total < 0.9)"
#: Cards that fall short are removed, improved, split in two, or left without a review, by their index.
MERGED = (
    LOW
    + """, merged AS (
    SELECT source_file, 0 AS kind, low_idx AS pos, 0 AS item, low_idx, 'better ' || front AS front FROM low WHERE low_idx % 5 IN (1, 2)
    UNION ALL SELECT source_file, 0, low_idx, 1, low_idx, 'second ' || front FROM low WHERE low_idx % 5 = 2
    UNION ALL SELECT source_file, 0, low_idx, 0, low_idx, front FROM low WHERE low_idx % 5 = 3
    UNION ALL SELECT source_file, 1, low_idx, 0, low_idx, front FROM low WHERE low_idx % 5 = 4
)"""
)


def _reviews(routed: DataFrame) -> DataFrame:
    """Answers to critique requests, as a model would write them, with a review that can't be used."""
    low = routed.where("NOT passed")
    card = lambda word: F.struct(F.concat(F.lit(word), "front").alias("front"), "back", "card_type", "bloom_level", "tags")
    bad = F.struct(F.lit("").alias("front"), "back", "card_type", "bloom_level", "tags")
    n = F.col("low_idx") % 5
    action = F.when(n == 0, "remove").when(n == 1, "improve").when(n == 2, "split").when(n == 3, "keep")
    new = F.when(n == 1, F.array(card("better "), bad)).when(n == 2, F.array(card("better "), card("second ")))
    one = F.struct(F.col("low_idx").alias("card_index"), action.alias("action"), new.alias("improved_cards"))
    met = low.where(n != 4).groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("low_idx", F.to_json(one).alias("r")))).alias("r"))
    said = F.concat(F.lit("Here it is:\n```json\n["), F.array_join(F.transform("r", lambda x: x["r"]), ","), F.lit(', {"note": "no index"}, 7]\n```'))
    return critique.parse_reviews(met.select("source_file", said.alias("text")))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    routed = settle(critique.route(score_cards(cards_of(spark, sf_dir))))  # every use of it reads the scores
    return routed, critique.merge_reviews(routed.where("NOT passed"), _reviews(routed))


@query(f"WITH {MERGED} SELECT source_file, kind, item, low_idx, md5(front) AS front FROM merged")
def critique_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, merged = _merged(spark, sf_dir)
    return merged.select("source_file", "kind", "item", "low_idx", F.md5("front").alias("front"))


REPORT = f"""WITH {MERGED}, a AS (
    SELECT source_file, count(*) AS total_cards, count(*) FILTER (WHERE weighted_total >= 0.9) AS passed_cards FROM scored GROUP BY 1
), m AS (SELECT source_file, count(*) AS after FROM merged GROUP BY 1
), report AS (
    SELECT source_file, total_cards, passed_cards, total_cards - passed_cards AS critiqued_cards, greatest(0, total_cards - passed_cards - coalesce(after, 0)) AS removed_cards,
        least(coalesce(after, 0), total_cards - passed_cards) AS improved_cards, greatest(0, coalesce(after, 0) - total_cards + passed_cards) AS split_cards, passed_cards + coalesce(after, 0) AS final_card_count
    FROM a LEFT JOIN m USING (source_file)
)"""


@query(REPORT + " SELECT *, round(passed_cards / total_cards, 9) AS pass_rate FROM report")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.quality_report(*_merged(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 9))


@query(REPORT + f" SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in critique.COUNTERS)}, round(sum(passed_cards) / sum(total_cards), 9) AS pass_rate FROM report")
def quality_report_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.merge_reports(critique.quality_report(*_merged(spark, sf_dir))).withColumn("pass_rate", F.round("pass_rate", 9))


@query(
    f"""WITH {MERGED}, every AS (
        SELECT source_file, -1 AS kind, card_idx AS pos, 0 AS item, front FROM scored WHERE weighted_total >= 0.9 UNION ALL SELECT source_file, kind, pos, item, front FROM merged)
    SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY kind, pos, item) - 1 AS card_idx, md5(front) AS front FROM every"""
)
def final_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cards_of(spark, sf_dir)
    final, _ = run_quality(cards, _reviews(critique.route(score_cards(cards))))
    return final.select("source_file", F.col("card_idx").cast("long"), F.md5("front").alias("front"))


@query(
    f"""WITH {CARDS} SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY card_idx) - 1 AS card_idx, md5(front) AS front, CASE WHEN card_idx % 6 = 1 THEN md5('') ELSE md5(back) END AS back,
        array_to_string(tags, ' ') AS tags FROM cards WHERE card_idx % 6 < 2"""
)
def parse_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth card is whole, the next lacks a back; the others are wrong in front, type, tags or shape."""
    n = F.col("card_idx") % 6
    front, kind = F.when(n == 2, "").otherwise(F.col("front")), F.when(n == 3, "riddle").otherwise(F.col("card_type"))
    tags = F.when(n == 4, F.array().cast("array<string>")).otherwise(F.col("tags"))
    item = F.to_json(F.struct(front.alias("front"), F.when(n != 1, F.col("back")).alias("back"), kind.alias("card_type"), "bloom_level", tags.alias("tags"), "related_concepts"))
    rows = cards_of(spark, sf_dir).withColumn("said", F.when(n == 5, F.to_json(F.struct("front"))).otherwise(item))
    met = rows.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("card_idx", "said"))).alias("s"))
    text = F.concat(F.lit("```json\n["), F.array_join(F.transform("s", lambda x: x["said"]), ",\n"), F.lit(',"a string", 5]\n```'))
    found = valid_cards(parse_responses(met.select("source_file", text.alias("text")), "source_file"), "source_file")
    return found.select("source_file", F.col("card_idx").cast("long"), F.md5("front").alias("front"), F.md5("back").alias("back"), F.array_join("tags", " ").alias("tags"))


# ---- evaluation -------------------------------------------------------------------------------

EXPECTED = f"""{CARDS}, expected AS (
    SELECT 'deck-' || (item_id // {DECK}) AS case_id, row_number() OVER (PARTITION BY item_id // {DECK} ORDER BY item_id) - 1 AS exp_idx,
        list_transform(string_split(text, ' ')[1:4], lambda x: lower(x)) AS fk, list_transform(string_split(text, ' ')[5:9], lambda x: lower(x)) AS bk,
        CASE WHEN item_id % 2 = 0 THEN {_names(CARD_TYPES)}[item_id % 8 + 1] END AS wanted FROM benchmark
), scores AS (
    SELECT case_id, exp_idx, card_idx, CASE WHEN wanted IS NOT NULL THEN f * 0.4::DOUBLE + b * 0.4::DOUBLE + CASE WHEN card_type = wanted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.2::DOUBLE ELSE f * 0.5::DOUBLE + b * 0.5::DOUBLE END AS score
    FROM (SELECT case_id, exp_idx, card_idx, wanted, card_type, CASE WHEN len(fk) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(fk, lambda x: contains(front, x))) / len(fk)::DOUBLE END AS f,
        CASE WHEN len(bk) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(bk, lambda x: contains(back, x))) / len(bk)::DOUBLE END AS b FROM expected JOIN cards ON source_file = case_id)
)"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("item_id")
    case = F.concat(F.lit("deck-"), F.floor(i / DECK).cast("string"))
    number = F.row_number().over(Window.partitionBy(F.floor(i / DECK)).orderBy("item_id")) - 1
    words = F.transform(F.split("text", " "), F.lower)
    wanted = F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(t) for t in CARD_TYPES]), (i % 8 + 1).cast("int")))
    expected = _table(spark, sf_dir, "benchmark").select(case.alias("case_id"), number.alias("exp_idx"), F.slice(words, 1, 4).alias("front_keywords"), F.slice(words, 5, 5).alias("back_keywords"), wanted.alias("wanted_type"))
    return expected, cards_of(spark, sf_dir).withColumnRenamed("source_file", "case_id")


@query(f"WITH {EXPECTED} SELECT case_id, exp_idx, card_idx, round(score, 9) AS score FROM scores")
def keyword_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = matching.score_matrix(*_cases(spark, sf_dir))
    rows = matrix.select("case_id", "exp_idx", F.explode(F.arrays_zip("gen", "scores")).alias("x"))
    return rows.select("case_id", F.col("exp_idx").cast("long"), F.col("x.gen").cast("long").alias("card_idx"), F.round("x.scores", 9).alias("score"))


MATCHED = (
    "WITH RECURSIVE "
    + EXPECTED
    + """, matrix AS (
    SELECT case_id, exp_idx, coalesce(list(score ORDER BY card_idx) FILTER (WHERE card_idx IS NOT NULL), []::DOUBLE[]) AS s FROM expected LEFT JOIN scores USING (case_id, exp_idx) GROUP BY ALL
), picks AS (
    SELECT case_id, -1::BIGINT AS exp_idx, []::BIGINT[] AS used, NULL::BIGINT AS gen_idx, 0.0::DOUBLE AS similarity FROM (SELECT DISTINCT case_id FROM matrix)
    UNION ALL
    SELECT case_id, exp_idx, CASE WHEN hit THEN list_append(used, place) ELSE used END, CASE WHEN hit THEN place - 1 END, CASE WHEN hit THEN best ELSE 0.0::DOUBLE END
    FROM (SELECT *, best > 0 AND best >= 0.3::DOUBLE AS hit, list_position(free, best)::BIGINT AS place FROM (SELECT *, coalesce(list_max(free), 0.0::DOUBLE) AS best FROM (
        SELECT m.case_id, m.exp_idx, p.used, list_transform(m.s, lambda x, i: CASE WHEN list_contains(p.used, i) THEN -1.0::DOUBLE ELSE x END) AS free FROM picks p JOIN matrix m ON m.case_id = p.case_id AND m.exp_idx = p.exp_idx + 1)))
), matched AS (SELECT case_id, exp_idx, gen_idx, similarity FROM picks WHERE exp_idx >= 0)"""
)


@query(MATCHED + " SELECT case_id, exp_idx, gen_idx, round(similarity, 9) AS similarity FROM matched")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.greedy_match(*_cases(spark, sf_dir))
    return found.select("case_id", F.col("exp_idx").cast("long"), F.col("gen_idx").cast("long"), F.round("similarity", 9).alias("similarity"))


@query(
    MATCHED
    + """, t AS (SELECT count(*) AS total_expected, count(gen_idx) AS total_matched, coalesce(sum(similarity) FILTER (WHERE gen_idx IS NOT NULL), 0) AS s, (SELECT count(*) FROM cards) AS total_generated FROM matched
    ), r AS (SELECT *, total_matched / total_expected::DOUBLE AS r, total_matched / total_generated::DOUBLE AS p FROM t)
    SELECT round(r, 9) AS recall, round(p, 9) AS precision, round(CASE WHEN r + p > 0 THEN 2.0 * r * p / (r + p) ELSE 0 END, 9) AS f1, round(CASE WHEN total_matched > 0 THEN s / total_matched ELSE 0 END, 9) AS avg_similarity,
        0.25::DOUBLE AS total_cost_usd, total_expected, total_generated, total_matched FROM r"""
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, generated = _cases(spark, sf_dir)
    found = matching.metrics(matching.greedy_match(expected, generated), generated, cost_usd=0.25)
    return found.select(*[F.round(c, 9).alias(c) if c in ("recall", "precision", "f1", "avg_similarity") else F.col(c) for c in found.columns])


@query(
    MATCHED
    + """ SELECT m.case_id, count(gen_idx) AS n_matched, count(*) AS n_expected, coalesce(any_value(g.n), 0) AS n_generated, round(count(gen_idx) / count(*), 9) AS recall
    FROM matched m LEFT JOIN (SELECT source_file, count(*) AS n FROM cards GROUP BY 1) g ON g.source_file = m.case_id GROUP BY 1"""
)
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, generated = _cases(spark, sf_dir)
    return matching.case_recall(matching.greedy_match(expected, generated), generated).withColumn("recall", F.round("recall", 9))


@query(MATCHED + " SELECT source_file AS case_id, card_idx FROM cards WHERE source_file IN (SELECT case_id FROM matched) AND (source_file, card_idx) NOT IN (SELECT (case_id, gen_idx) FROM matched WHERE gen_idx IS NOT NULL)")
def eval_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, generated = _cases(spark, sf_dir)
    cases = expected.select("case_id").distinct()
    rest = matching.unmatched(generated.join(cases, "case_id", "left_semi"), matching.greedy_match(expected, generated))
    return rest.select("case_id", F.col("card_idx").cast("long"))


#: Conversations, or benchmark items, of a case whose cards are whole turns and whose keywords are all words of the items.
CASE = 2
WHOLE = f"""turns AS (
    SELECT conv_id, turn, role, text, lead(role) OVER w AS role2, lead(text) OVER w AS text2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), cards AS (
    SELECT 'case-' || (conv_id // {CASE}) AS source_file, row_number() OVER (PARTITION BY conv_id // {CASE} ORDER BY conv_id, turn) - 1 AS card_idx,
        text AS front, text2 AS back, {_names(CARD_TYPES)}[conv_id % 8 + 1] AS card_type
    FROM turns WHERE role = 'user' AND role2 = 'assistant'
), expected AS (
    SELECT 'case-' || (item_id // {CASE}) AS case_id, row_number() OVER (PARTITION BY item_id // {CASE} ORDER BY item_id) - 1 AS exp_idx,
        list_filter(w, lambda x, i: i % 2 = 1) AS fk, list_filter(w, lambda x, i: i % 2 = 0) AS bk, CASE WHEN item_id % 2 = 0 THEN {_names(CARD_TYPES)}[item_id % 8 + 1] END AS wanted
    FROM (SELECT item_id, list_transform(string_split(text, ' '), lambda x: lower(x)) AS w FROM benchmark)
), {EXPECTED[EXPECTED.index("scores AS ("):]}"""


def _whole_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i, c = F.col("item_id"), F.col("conv_id")
    case = lambda n: F.floor(n / CASE)
    pick = lambda n: F.element_at(F.array(*map(F.lit, CARD_TYPES)), (n % 8 + 1).cast("int"))
    number = lambda n, *by: (F.row_number().over(Window.partitionBy(case(n)).orderBy(*by)) - 1)
    words = F.transform(F.split("text", " "), F.lower)
    items = _table(spark, sf_dir, "benchmark").select(i, words.alias("w"))
    nth = lambda r: F.filter("w", lambda x, k: k % 2 == r)
    expected = items.select(F.concat(F.lit("case-"), case(i)).alias("case_id"), number(i, "item_id").alias("exp_idx"), nth(0).alias("front_keywords"), nth(1).alias("back_keywords"), F.when(i % 2 == 0, pick(i)).alias("wanted_type"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = _table(spark, sf_dir, "conversations").withColumns({"role2": F.lead("role").over(w), "back": F.lead("text").over(w)}).where("role = 'user' AND role2 = 'assistant'")
    return expected, turns.select(F.concat(F.lit("case-"), case(c)).alias("case_id"), number(c, "conv_id", "turn").alias("card_idx"), F.col("text").alias("front"), "back", pick(c).alias("card_type"))


@query(f"WITH {WHOLE} SELECT case_id, exp_idx, card_idx, round(score, 9) AS score FROM scores WHERE score > 0")
def keyword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, A13, A14 as sparse edges: whole texts, read once by an automaton over a case's keywords."""
    found = score_edges(*_whole_cases(spark, sf_dir))
    return found.select("case_id", F.col("exp_idx").cast("long"), F.col("card_idx").cast("long"), F.round("score", 9).alias("score"))


@query(
    MATCHED.replace(EXPECTED, WHOLE, 1)
    + """ SELECT m.case_id, count(gen_idx) AS n_matched, count(*) AS n_expected, coalesce(any_value(g.n), 0) AS n_generated, round(count(gen_idx) / count(*), 9) AS recall, coalesce(sum(gen_idx), -1)::BIGINT AS taken,
        round(sum(similarity), 9) AS similarity
    FROM matched m LEFT JOIN (SELECT source_file, count(*) AS n FROM cards GROUP BY 1) g ON g.source_file = m.case_id GROUP BY 1"""
)
def whole_text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, A6 by whole texts: what each case matched, and how well."""
    expected, generated = _whole_cases(spark, sf_dir)
    matches = settle(matching.greedy_match(expected, generated))  # read twice
    added = matches.groupBy("case_id").agg(F.coalesce(F.sum("gen_idx"), F.lit(-1)).cast("long").alias("taken"), F.round(F.sum("similarity"), 9).alias("similarity"))
    found = matching.case_recall(matches, generated).withColumn("recall", F.round("recall", 9))
    return found.join(added, "case_id")


DOCUMENT_CARDS = """cards AS (
    SELECT doc_id, doc_id::VARCHAR AS source_file, 0 AS card_idx, 'What does ' || source || ' say?' AS front, text AS back, 'summary_point' AS card_type, 'understand' AS bloom_level, [lang, 'doc::' || source] AS tags FROM documents
)"""


@query(f"""WITH {SCORED.replace(CARDS, DOCUMENT_CARDS, 1)} SELECT quality, weighted_total >= 0.8 AS passed, count(*) AS n FROM scored JOIN labels USING (doc_id) GROUP BY ALL""")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heuristic scores of whole documents, as the backs of cards, against the labels of quality."""
    front = F.concat(F.lit("What does "), "source", F.lit(" say?"))
    docs = _documents(spark, sf_dir).select("doc_id", front.alias("front"), F.col("text").alias("back"), F.lit("summary_point").alias("card_type"), F.array(F.col("lang"), F.concat(F.lit("doc::"), "source")).alias("tags"))
    passed = score_cards(docs).select("doc_id", (F.col("weighted_total") >= 0.8).alias("passed"))
    return passed.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "passed").agg(F.count("*").alias("n"))


# ---- export, review, images -------------------------------------------------------------------


def _tsv(x: str) -> str:
    return f"replace(replace({x}, chr(9), ' '), chr(10), '<br>')"


@query(
    f"""WITH {CARDS}, r AS (SELECT source_file, card_idx, card_type, {_tsv("front")} AS f, {_tsv("back")} AS b, array_to_string(list_concat(tags, ['bloom::' || bloom_level, 'extra']), ' ') AS t FROM cards)
    SELECT source_file, card_idx, 0 AS row_idx, md5(f || chr(9) || b || chr(9) || t) AS row FROM r
    UNION ALL SELECT source_file, card_idx, 1, md5(b || chr(9) || f || chr(9) || t) FROM r WHERE card_type = 'reversible'"""
)
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.tsv_rows(cards_of(spark, sf_dir), ["extra"])
    return rows.select("source_file", F.col("card_idx").cast("long"), "row_idx", F.md5("row").alias("row"))


@query(
    f"""WITH {CARDS}, r AS (SELECT source_file, card_idx, card_type, {_tsv("front")} AS f, {_tsv("back")} AS b, array_to_string(list_concat(tags, ['bloom::' || bloom_level]), ' ') AS t FROM cards
    ), w AS (SELECT source_file, card_idx, 0 AS k, f || chr(9) || b || chr(9) || t AS row FROM r UNION ALL SELECT source_file, card_idx, 1, b || chr(9) || f || chr(9) || t FROM r WHERE card_type = 'reversible')
    SELECT source_file, md5('#separator:tab' || chr(10) || '#html:true' || chr(10) || '#tags column:3' || chr(10) || string_agg(row, chr(10) ORDER BY card_idx, k)) AS tsv FROM w GROUP BY 1"""
)
def tsv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.tsv_documents(cards_of(spark, sf_dir)).withColumn("tsv", F.md5("tsv"))


@query(
    f"""WITH {CARDS}, r AS (SELECT source_file, card_idx, card_type, {_tsv("front")} AS f, {_tsv("back")} AS b, array_to_string(list_concat(tags, ['bloom::' || bloom_level]), ' ') AS t FROM cards
    ), w AS (SELECT source_file, card_idx, 0 AS k, f || chr(9) || b || chr(9) || t AS row FROM r UNION ALL SELECT source_file, card_idx, 1, b || chr(9) || f || chr(9) || t FROM r WHERE card_type = 'reversible')
    SELECT source_file || '.tsv' AS file, md5('#separator:tab' || chr(10) || '#html:true' || chr(10) || '#tags column:3' || chr(10) || string_agg(row, chr(10) ORDER BY card_idx, k)) AS content FROM w GROUP BY source_file"""
)
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K6, K8: files that tasks wrote, read back whole.  Writes, reads and removes a folder when it is called."""
    path = work_path(spark, "files")
    sink.write_cards(cards_of(spark, sf_dir), path, "tsv")
    found = spark.read.format("binaryFile").load(path)
    found = settle(found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.md5("content").alias("content")))
    remove(spark, path)
    return found


@query(
    f"""WITH {CARDS} SELECT source_file, card_idx, CASE card_type WHEN 'cloze' THEN 'Cloze' WHEN 'reversible' THEN 'Basic (and reversed card)' ELSE 'Basic' END AS model,
        CASE WHEN card_type = 'cloze' THEN 'Extra,Text' ELSE 'Back,Front' END AS fields, len(tags) + 1 AS n_tags FROM cards"""
)
def note_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.notes(cards_of(spark, sf_dir), "deck")
    fields = F.array_join(F.array_sort(F.map_keys("note.fields")), ",")
    return rows.select("source_file", F.col("card_idx").cast("long"), F.col("note.modelName").alias("model"), fields.alias("fields"), F.size("note.tags").cast("long").alias("n_tags"))


@query(
    f"""WITH {CARDS} SELECT source_file, '1.0' AS schema_version, '2026-01-01T00:00:00+00:00' AS generated_at, count(*) AS card_count, md5(string_agg(concat_ws(chr(31), front, back, card_type, bloom_level, array_to_string(tags, ' '), 'null', '0', '0'), chr(30) ORDER BY card_idx)) AS cards FROM cards GROUP BY 1"""
)
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the JSON: its metadata and every field of every card, nulls and empty lists included."""
    made = export.json_documents(cards_of(spark, sf_dir), "mid-tier", "2026-01-01T00:00:00+00:00")
    v = F.parse_json("json")
    each = F.from_json(F.get_json_object("json", "$.cards"), f"array<{CARD}>")
    # A null that is there reads as VARIANT null, one that is left out as no value at all.
    hint = F.when(F.expr("schema_of_variant(try_variant_get(parse_json(json), '$.cards[0].mnemonic_hint', 'variant'))") == "VOID", F.lit("null"))
    size = lambda x: F.size(x).cast("string")
    said = F.transform(each, lambda c: F.concat_ws(chr(31), c["front"], c["back"], c["card_type"], c["bloom_level"], F.array_join(c["tags"], " "), hint, size(c["related_concepts"]), size(c["media"])))
    return made.select("source_file", F.try_variant_get(v, "$._meta.schema_version", "string").alias("schema_version"), F.try_variant_get(v, "$._meta.generated_at", "string").alias("generated_at"), F.size(each).cast("long").alias("card_count"), F.md5(F.array_join(said, chr(30))).alias("cards"))


@query(f"""WITH {CARDS}, n AS (SELECT row_number() OVER (ORDER BY source_file, card_idx) AS place FROM cards) SELECT count(*) AS total, count(*) FILTER (WHERE place % 9 <> 0) AS added, count(*) FILTER (WHERE place % 9 = 0) AS failed,
    string_agg('Card ' || place || ' failed to add', ';' ORDER BY place) FILTER (WHERE place % 9 = 0) AS errors FROM n""")
def push_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = numbered_rows(cards_of(spark, sf_dir).select("source_file", "card_idx"), "position", [], ["source_file", "card_idx"])  # a push goes card by card
    place = F.col("position") + 1
    answers = placed.select("position", F.when(place % 9 != 0, place).alias("note_id"))
    return export.push_report(answers).withColumn("errors", F.array_join("errors", ";"))


REVIEW = f"""WITH {CARDS}, items AS (
    SELECT source_file, card_idx, CASE card_idx % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN card_idx % 8 = 0 THEN 'edited' ELSE front END AS front FROM cards)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, n = cards_of(spark, sf_dir), F.col("card_idx")
    decided = cards.where(n % 4 < 2).select("source_file", "card_idx", F.when(n % 4 == 0, "accepted").otherwise("rejected").alias("status"), F.when(n % 8 == 0, "edited").alias("new_front"), F.lit(None).cast("string").alias("new_back"))
    return review.review_items(cards, decided)


@query(REVIEW + " SELECT source_file, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "accepted", "rejected")) + " FROM items GROUP BY 1")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.stats(_items(spark, sf_dir), "source_file")


@query(REVIEW + " SELECT source_file, card_idx, md5(front) AS front FROM items WHERE status = 'accepted'")
def accepted_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.accepted(_items(spark, sf_dir)).select("source_file", F.col("card_idx").cast("long"), F.md5("front").alias("front"))


BOXES = """boxes AS (
    SELECT doc_id // 8 AS doc_id, doc_id % 8 AS page_num, k AS idx, (n_chars % 50 + k * 37)::DOUBLE AS x0, (n_chars % 70)::DOUBLE AS y0, (n_chars % 50 + k * 37 + n_chars % 190 - 15)::DOUBLE AS x1,
        (n_chars % 70 + 30 + doc_id % 300)::DOUBLE AS y1, 595.0::DOUBLE AS page_width, 842.0::DOUBLE AS page_height, 100 + n_chars % 3000 AS width, 100 + doc_id % 2000 AS height
    FROM documents, range(0, 7) r(k)
), pages_ AS (
    SELECT doc_id, page_num, count(*) AS n_images, sum(greatest((x1 - x0) * (y1 - y0), 0)) / (595.0::DOUBLE * 842.0::DOUBLE) AS coverage FROM boxes GROUP BY ALL
)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n, k = F.col("doc_id"), F.col("n_chars"), F.col("idx")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("idx"))
    left, low = n % 50 + k * 37, n % 70
    box = [left.cast("double").alias("x0"), low.cast("double").alias("y0"), (left + n % 190 - 15).cast("double").alias("x1"), (low + 30 + d % 300).cast("double").alias("y1")]
    page = [F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), (n % 3000 + 100).alias("width"), (d % 2000 + 100).alias("height")]
    return rows.select(F.floor(d / 8).alias("doc_id"), (d % 8).alias("page_num"), "idx", *box, *page)


@query(f"WITH {BOXES} SELECT doc_id, page_num, n_images, round(coverage, 9) AS coverage, coverage >= 0.2 AS significant FROM pages_")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.page_coverage(_boxes(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


@query(
    f"""WITH {BOXES}, n AS (SELECT b.*, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY idx) AS nth FROM boxes b JOIN pages_ USING (doc_id, page_num) WHERE coverage >= 0.2)
    SELECT doc_id, page_num, idx, (width * height) // 750 AS tokens, round(least(CASE WHEN greatest(width, height) > 1568 THEN 1568.0::DOUBLE / greatest(width, height) ELSE 1.0 END,
        CASE WHEN width * height > 1150000 THEN sqrt(1150000.0::DOUBLE / (width * height)) ELSE 1.0 END), 9) AS scale FROM n WHERE nth <= 5"""
)
def chosen_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.chosen_images(_boxes(spark, sf_dir))
    return found.select("doc_id", "page_num", "idx", image_tokens(F.col("width"), F.col("height")).alias("tokens"), F.round(image_scale(F.col("width"), F.col("height")), 9).alias("scale"))


@query(f"WITH {CLEAN} SELECT doc_id, tokens, round(tokens / 1e6 * 3.0 + (tokens // 4) / 1e6 * 15.0, 9) AS cost_usd FROM tokened")
def projected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", estimated_tokens(preprocessed(F.col("text"))).alias("tokens"))
    cost: Column = estimated_cost(F.lit(MID), F.col("tokens"), F.floor(F.col("tokens") / 4))
    return rows.withColumn("cost_usd", F.round(cost, 9))


# ---- requests, limits, cards and reviews by their plain forms ---------------------------------


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("user_prompt", F.md5("user_prompt"))


@query(
    """SELECT doc_id::VARCHAR AS source_file, CASE WHEN length(text) >= 10000 THEN 'mid-tier' ELSE 'low-tier' END AS model,
        md5('Document: ' || source || chr(10) || 'Section: ' || source || ' > ' || lang || chr(10) || 'Pages: p.' || (doc_id % 9) || chr(10) || chr(10) || 'Write at most 20 cards.' || chr(10) || chr(10)
            || 'Tag path: ' || source || '::' || lang || chr(10) || chr(10) || 'Card types: qa, cloze' || chr(10) || chr(10) || 'Text:' || chr(10) || text) AS user_prompt
    FROM documents WHERE length(text) >= 50"""
)
def section_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one section of its source; short ones are left out."""
    page = F.concat(F.lit("p."), (F.col("doc_id") % 9).cast("string"))
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_file"), F.lit("section-0").alias("id"), F.lit(0).alias("section_pos"), F.lit(0).alias("part"), F.col("source").alias("title"), F.concat_ws(" > ", "source", "lang").alias("breadcrumb"), page.alias("page_range"), "text", F.length("text").alias("char_count"))
    return _digested(requests.section_requests(rows, card_types=["qa", "cloze"])).select("source_file", "model", "user_prompt")


@query(
    """SELECT doc_id::VARCHAR AS source_file, 'mid-tier' AS model, md5('Write at most 50 cards about the text below.' || chr(10) || chr(10) || 'Focus on: names' || chr(10) || chr(10) || 'Text:' || chr(10) || text) AS user_prompt
    FROM documents WHERE length(text) > 0"""
)
def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk; the cap of 50 cards alone sends it to the middle tier."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_file"), "text", F.array("text").alias("chunks"))
    return _digested(requests.chunk_requests(rows, focus=["names"])).select("source_file", "model", "user_prompt")


ENDINGS = ("txt", "MD", "Pdf", "docx", "pdfx")


@query(f"""WITH f AS (SELECT doc_id, {_names(ENDINGS)}[doc_id % 5 + 1] AS kind, length(text) AS size FROM documents) SELECT kind, kind IN ('txt', 'MD', 'Pdf') AS supported, count(*) AS n, count(*) FILTER (WHERE size <= 1000) AS small FROM f GROUP BY ALL""")
def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, S14 by a file's name and size."""
    kind = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _documents(spark, sf_dir).select(kind.alias("kind"), files.supported(F.concat(F.lit("/in/f."), kind)).alias("supported"), F.length("text").alias("size"))
    return rows.groupBy("kind", "supported").agg(F.count("*").alias("n"), F.count_if(F.col("size") <= 1000).alias("small"))


@query(f"WITH {CARDS} SELECT source_file, card_idx, md5(substr(front, 1, 100)) AS front, md5(substr(back, 1, 100)) AS back FROM cards")
def table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return cards_of(spark, sf_dir).select("source_file", F.col("card_idx").cast("long"), F.md5(shortened(F.col("front"))).alias("front"), F.md5(shortened(F.col("back"))).alias("back"))


@query(
    f"""WITH {CARDS} SELECT source_file, count(*) FILTER (WHERE card_type = 'qa') AS n_qa, count(*) FILTER (WHERE bloom_level = 'apply') AS n_apply FROM cards GROUP BY 1"""
)
def cards_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    cards = cards_of(spark, sf_dir)
    count = lambda rows, name: rows.groupBy("source_file").agg(F.count("*").alias(name))
    found = cards.select("source_file").distinct().join(count(by_type(cards, "qa"), "n_qa"), "source_file", "left").join(count(by_bloom(cards, "apply"), "n_apply"), "source_file", "left")
    return found.fillna(0)


@query(f"""WITH {LOW}, c AS (SELECT source_file, low_idx FROM low) SELECT source_file, count(*) AS n_low, md5('Review these cards against the text.') AS said, 3000::BIGINT AS excerpt FROM c GROUP BY 1""")
def critique_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4, Q15: one request for each deck with cards that fall short; how it begins, and how much of the text it quotes."""
    routed = settle(critique.route(score_cards(cards_of(spark, sf_dir))))
    texts = routed.select("source_file").distinct().withColumn("text", F.repeat(F.lit("t"), 5000))
    asked = critique_requests(routed, texts)
    prompt = F.split("user_prompt", "\n\nText:\n")
    n_low = F.size(F.from_json(F.element_at(F.split(prompt[0], "Cards:\n"), -1), f"array<{CARD}>")).cast("long")
    return asked.select("source_file", n_low.alias("n_low"), F.md5(F.split("user_prompt", "\n")[0]).alias("said"), F.length(prompt[1]).cast("long").alias("excerpt"))


@query(f"""WITH {CARDS}, d AS (SELECT source_file, card_idx, CASE card_idx % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'accepted' END AS status FROM cards)
    SELECT source_file, card_idx, coalesce(status, 'pending') AS status, CASE WHEN card_idx % 6 = 0 THEN 'new' END AS new_front FROM d WHERE status IS NOT NULL OR card_idx % 6 = 0""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.13: statuses and edits as transitions of the table of decisions; a later status replaces an earlier one."""
    cards, n = cards_of(spark, sf_dir).select("source_file", "card_idx"), F.col("card_idx")
    none = spark.createDataFrame([], "source_file string, card_idx int, status string, new_front string, new_back string")
    made = review.set_status(none, cards.where(n % 2 == 0), "rejected")
    made = review.set_status(made, cards.where(n % 4 == 1), "rejected")
    made = review.set_status(made, cards.where(n % 2 == 0), "accepted")
    made = review.edit_cards(made, cards.where(n % 6 == 0).withColumns({"new_front": F.lit("new"), "new_back": F.lit("")}))
    return made.select("source_file", F.col("card_idx").cast("long"), "status", "new_front")


@query(
    """WITH t AS (SELECT conv_id, turn, 1 + length(text) % 9 AS n FROM conversations WHERE length(text) >= 50
    ), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
    SELECT conv_id, count(*) AS n_calls, sum(n)::BIGINT AS n_cards, round(sum(100 / 1e6 * 0.8 + 10 / 1e6 * 4.0), 9) AS cost_usd FROM b WHERE before < 12 GROUP BY 1"""
)
def capped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, W4, G4, A1 around the calls themselves: conversations as documents, turns as sections, an answer made from the prompt."""
    turns = _table(spark, sf_dir, "conversations").where("length(text) >= 50")
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("string").alias("source_file"), F.concat(F.lit("section-"), F.col("turn").cast("string")).alias("id"), F.col("turn").alias("section_pos"), F.lit(0).alias("part"), empty.alias("title"), empty.alias("breadcrumb"), empty.alias("page_range"), "text", F.length("text").alias("char_count"))

    def provider(model: str, system: str, prompt: str, max_tokens: int) -> dict:
        said = prompt.split("Text:\n", 1)[1]
        card = '{"front": "f", "back": "b", "card_type": "qa", "bloom_level": "apply", "tags": ["t"]}'
        return {"model": "low-tier", "input_tokens": 100, "output_tokens": 10, "text": "[" + ", ".join([card] * (1 + len(said) % 9)) + "]"}

    asked = requests.section_requests(rows)
    path = work_path(spark, "answers")
    answers, _ = requests.spend(asked, provider, path, budget=1e9, max_cards=12)
    answers = settle(answers)
    remove(spark, path)
    cost = ledger.with_cost(requests.usage(answers)).groupBy("source_file").agg(F.count("*").alias("n_calls"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"))
    cards = requests.collect_cards(asked, answers).groupBy("source_file").agg(F.count("*").alias("n_cards"))
    return cost.join(cards, "source_file").select(F.col("source_file").cast("long").alias("conv_id"), "n_calls", "n_cards", "cost_usd")
