"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold.  A batch
of texts is indexed by the trigrams that some rule asks for; a rule's postings are intersected and
united as its query says, and only the candidates are searched with the expression itself.  A rule
without mandatory trigrams searches every text.
"""

from __future__ import annotations

import re
import re._parser as syntax
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import STEP, text_of
from cardloom.llm.pieces import text_chunks

SPANS = "array<struct<kind:string,start:long,end:long>>"
#: Alternatives that are followed literally before a class counts as anything.
WIDEST = 16


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least `least` characters; base rules are those of the contract."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern[bytes]:
        return re.compile(self.pattern.encode(), re.IGNORECASE if self.fold else 0)  # on bytes only ASCII letters fold

    @cached_property
    def query(self):
        return trigram_query(self.pattern)


#: In the order in which spans with one start are listed.  Each takes time in proportion to the text: what repeats
#: in a rule can't start again inside its own match, or starts only where such a run does.  A hex run of 32 or more is what is left of the
#: maximal runs [0-9a-f]+ when the shorter ones are dropped; the same holds for access keys.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, fold=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_hook", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", fold=True),
)


def _all(strings: set[str]):
    """Any of the strings: None if one of them is too short to hold a trigram."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return ("or", tuple(("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in sorted(strings)))


def _both(*queries):
    held = tuple(q for q in queries if q is not None)
    return ("and", held) if held else None


def _walk(parsed) -> tuple[set[str] | None, object]:
    """(all strings that can match, if they are few; a query that holds for any match, or None for no demand)."""
    run, query, exact = {""}, None, True
    for op, arg in parsed:
        some, demand = _node(op, arg)
        if some is not None and len(run) * len(some) <= 64:
            run = {a + b for a, b in product(run, some)}
            continue
        # What follows can't be told apart any more: keep what the run so far demands and begin a new one.
        query, exact = _both(query, _all(run), demand), False
        run = {""} if some is None else some
    return (run, query) if exact else (None, _both(query, _all(run)))


def _node(op, arg) -> tuple[set[str] | None, object]:
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, None
    if name == "AT":
        return {""}, None
    if name == "IN":
        letters: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                letters.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < WIDEST:
                letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (letters, None) if len(letters) <= WIDEST else (None, None)
    if name == "BRANCH":
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), None
        demands = [_all(s) if s is not None else q for s, q in parts]
        return None, None if any(d is None for d in demands) else ("or", tuple(demands))
    if name == "SUBPATTERN":
        return _walk(arg[-1])
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = arg
        strings, query = _walk(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        if least == 0:
            return None, None
        if strings is not None and len(strings) ** min(least, 3) <= WIDEST:
            return None, _all({"".join(x) for x in product(strings, repeat=min(least, 8))} if len(strings) == 1 else {"".join(x) for x in product(strings, repeat=min(least, 3))})
        return None, query
    return None, None


def trigram_query(pattern: str):
    """('and'|'or', parts) over lower-case trigrams that every match holds; None if there are none."""
    strings, query = _walk(syntax.parse(pattern))
    return _both(query, _all(strings)) if strings is not None else query


def trigrams(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings, for a chunk of texts, of the trigrams that rules ask for."""

    def __init__(self, wanted: set[str]):
        self.names = sorted(wanted)
        self.slot = np.zeros(1 << 24, np.int16)  # 0: not wanted; pages without a wanted trigram take no memory
        for i, t in enumerate(self.names, 1):
            a, b, c = t.encode("latin-1")
            self.slot[a << 16 | b << 8 | c] = i
        lower = np.arange(256, dtype=np.uint32)
        lower[65:91] += 32
        self.lower = lower

    def postings(self, buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """For each trigram, which texts hold it."""
        n = len(offsets) - 1
        out = {t: np.zeros(n, bool) for t in self.names}
        if len(buf) < 3:
            return out
        for start in range(0, len(buf) - 2, STEP):
            b = self.lower[buf[start : start + STEP + 2]]
            found = self.slot[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            at = np.flatnonzero(found)
            row = np.searchsorted(offsets, start + at, "right") - 1
            inside = start + at + 2 < offsets[row + 1]
            kind, row = found[at[inside]], row[inside]
            for i, t in enumerate(self.names, 1):
                out[t][row[kind == i]] = True
        return out


def holds(query, postings: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(query, str):
        return postings[query]
    return reduce(np.logical_and if query[0] == "and" else np.logical_or, (holds(q, postings) for q in query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.index = Index(set().union(*(trigrams(r.query) for r in rules)))

    def spans(self, buf: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """(kind, start, end) in code points, in order, of each text that has any."""
        postings, n = self.index.postings(buf, offsets), len(offsets) - 1
        data, found = buf.tobytes(), {}
        for order, rule in enumerate(self.rules):
            rows = range(n) if rule.query is None else np.flatnonzero(holds(rule.query, postings)).tolist()
            for row in rows:
                a, b = int(offsets[row]), int(offsets[row + 1])
                for m in rule.regex.finditer(data[a:b]):  # a text of its own: look-behind must not see the one before
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(row, []).append((a + m.start(), order, rule.kind, a + m.end()))
        out = {}
        for row, hits in found.items():
            at, point, where = int(offsets[row]), 0, {}
            for place in sorted({x for start, _, _, end in hits for x in (start, end)}):  # code points before each
                point += int(np.count_nonzero((buf[at:place] & 0xC0) != 0x80))
                at = place
                where[place] = point
            out[row] = [(kind, where[start], where[end]) for start, _, kind, end in sorted(hits)]
        return out


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of every row, by start, then kind as listed.

    Matches of a rule are leftmost and don't overlap; those of different rules may.  Null and empty texts
    have no spans; every row is scanned for itself, so null or repeated doc_ids do no harm; other columns
    are ignored; an empty table gives no rows.  A worker holds about four bytes for each byte of a long text, whose
    trigrams are posted STEP bytes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(1)):
                found = scanner(rules).spans(buf, offsets)
                rows = [[{"kind": k, "start": s, "end": e} for k, s, e in found.get(i, ())] for i in range(b - a)]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every secret replaced by its kind in brackets; spans that overlap become one, named by the first."""

    @F.arrow_udf("string")
    def hide(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for a, _, buf, offsets in text_chunks(texts):
            for row, hits in scanner(rules).spans(buf, offsets).items():
                parts, at, held = [], 0, out[a + row]
                for kind, start, end in hits:
                    if start >= at:
                        parts += [held[at:start], f"[{kind}]"]
                    at = max(at, end)
                out[a + row] = "".join([*parts, held[at:]])
        return pa.array(out, pa.string())

    return hide(text)


def listed(spans: Column, only_base: bool = False, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, joined by commas."""
    if only_base:
        spans = F.filter(spans, lambda s: s["kind"].isin(*[r.kind for r in rules if r.base]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
