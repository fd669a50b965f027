"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of public vocabularies; a worker finds them on its own machine.
RANKS, TOKENIZER, PIECES = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.substring_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm import bpe

    trip = bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)
    return trip.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.simhash import as_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, {said} AS text UNION ALL SELECT -1L, 1L, 'assistant', {said}")
    made = chat.format_chats(turns.unionByName(more))
    back = chat.read_turns(F.col("formatted"))
    made = made.select("conv_id", "formatted", back.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm import token_records
    from cardloom.llm.common import remove, settle, work_path

    path = work_path(spark, "records")
    token_records.write_records(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    found = token_records.read_records(spark, path, ids_crc32=token_records.ids_crc32(F.col("ids")))
    found = settle(found.select("doc_id", "start", "n_tokens", "ids_crc32"))
    remove(spark, path)
    return found


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm import secret_scan

    found, spans = secret_scan.scan(table(spark, sf_dir, "documents")), F.col("spans")
    counts = [secret_scan.count_of(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(spans, only_base=True), 256).alias("base_sha256"), secret_scan.listed(spans).alias("spans"))


def op10_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm import hamming

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.whole_sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(rows).select(F.col("query_id").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "distance")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.alignment import align

    found = align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.period_runs import collapse_runs, planted

    found = collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(planted, "doc_id long, text string"))
    # The greatest length first, then the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "runs", "kept", longest.alias("best"), F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        "best.length",
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_token_records": op7_token_records,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_hamming_top_k": op10_hamming_top_k,
    "op11_alignment": op11_alignment,
    "op12_period_runs": op12_period_runs,
    "op13_minhash": op13_minhash,
}

def _op5_sql() -> str:
    """The same digests from the table itself; only formatted_chars needs the template."""
    from cardloom.llm.chat import CONTROLS, END, TEXT, TURN

    def escaped(column: str) -> str:
        out = rf"replace({column}, '\', '\\')"
        for c in CONTROLS:
            out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
        return out

    return f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), g AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   sum({len(TURN + TEXT + END)} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """


def _op9_sql() -> str:
    """Places follow from what lies between the matches; the rules are written for expressions without look-behind."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    # kind, expression, group whose length counts, its least length, whether group 1 is a character before the match.
    rules = [
        ("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, False),
        ("access", "AKIA[A-Z0-9]+", 0, 16, False),
        ("hex", "[0-9a-f]+", 0, 32, False),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
        ("web_token", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, True),
        ("hub", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
        ("chat_hook", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
        ("bearer", rf"{either('bearer')}\x20+[A-Za-z0-9._~+/-]{{20,}}", 0, 1, False),
    ]
    found = []
    for order, (kind, pattern, group, least, before) in enumerate(rules):
        quoted = "'" + pattern.replace("'", "''") + "'"
        lead = f"length(regexp_extract(m, {quoted}, 1))" if before else "0"
        found.append(f"""
            SELECT row, {order} AS ord, '{kind}' AS kind, a + {lead} AS start, a + length(m) AS stop FROM (
                SELECT row, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS a FROM (
                    SELECT row, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i
                    FROM (SELECT row, regexp_extract_all(text, {quoted}) AS ms, string_split_regex(text, {quoted}) AS gaps FROM d)
                ) WINDOW w AS (PARTITION BY row ORDER BY i)
            ) WHERE length(regexp_extract(m, {quoted}, {group})) >= {least}""")
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
        ), spans AS ({" UNION ALL ".join(found)}
        ), said AS (SELECT *, concat(kind, ':', start::BIGINT, ':', stop::BIGINT) AS span FROM spans)
        SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
               count(*) FILTER (WHERE kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE ord < 3), '')) AS base_sha256,
               coalesce(string_agg(span, ',' ORDER BY start, ord), '') AS spans
        FROM d LEFT JOIN said USING (row) GROUP BY row
    """


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), v AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
        ), again AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1
        ), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM v SEMI JOIN again USING (h)
        ), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d
        ), kept AS (
            SELECT doc_id, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS said
            FROM words LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    "op5_chat": _op5_sql(),
    "op9_secret_scan": _op9_sql(),
    "op10_hamming_top_k": """
        WITH c AS (
            SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
        ), p AS (
            SELECT q.vec_id, c.vec_id AS neighbour_id,
                   list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2])))::BIGINT AS distance
            FROM c q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM p)
        SELECT vec_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
    """,
}
