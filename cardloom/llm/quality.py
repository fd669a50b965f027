"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature's values fall into bins, and boosting goes round the features in turn, giving each a
shallow tree over its bins at a small step; then round the pairs of features that the residuals favour.
The trees of a feature add up to a lookup table, so a score is a sum of table entries: vectorised bin
additions, which can be read off feature by feature.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cardloom.llm.common import SPACES, STEP, steps, text_of

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "doubled_symbols", "top_symbol", "distinct_words",
    "repeated_lines", "words_a_line", "sentence_ends", "beyond_ascii", "capitalised", "entropy", "short_words",
)
SYMBOL = np.zeros(256, bool)
SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
PLAIN = np.frombuffer(b".,", np.uint8)
CAPITAL = re.compile(rb"(?:^|[\x20\x09-\x0D])[A-Z]")
NEWLINE = re.compile(rb"\n")


def features(text: str | None) -> list[float]:
    """The features of a text; a null or empty one has defined values too.

    Holds the text as bytes, the words or lines of a stretch of STEP bytes, and eight bytes for each distinct
    word and line of a longer text; a line of any length is taken whole.
    """
    data = (text or "").encode("utf-8", "replace")
    words, short, capitals, said = 0, 0, 0, Distinct()
    for part in steps(data, SPACES):
        found = part.split()
        words += len(found)
        short += sum(len(x) < 4 for x in found)
        capitals += sum(1 for _ in CAPITAL.finditer(part))
        said.add(found)
    lines, rows = 0, Distinct()
    for part in steps(data, NEWLINE):
        filled = [x for x in part.split(b"\n") if x.strip()]
        lines += len(filled)
        rows.add(filled)
    n, w = max(1, len(data)), max(1, words)
    raw, count, doubled = np.frombuffer(data, np.uint8), np.zeros(256, np.int64), 0
    for a in range(0, len(raw), STEP):
        part = raw[a : a + STEP + 1]
        count += np.bincount(part[:STEP], minlength=256)
        doubled += int(SYMBOL[part[1:][part[1:] == part[:-1]]].sum())
    symbols = count * SYMBOL
    symbols[PLAIN] = 0
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    share = count[count > 0] / n
    return [
        math.log1p(len(data)),
        math.log1p(words),
        len(data) / w,
        float(count[65:91].sum()) / letters,
        float(count[48:58].sum()) / n,
        float(symbols.sum()) / n,
        float(doubled) / w,
        float(symbols.max()) / w,
        len(said) / w,
        1 - len(rows) / max(1, lines),
        math.log1p(w / max(1, lines)),
        float(count[46] + count[33] + count[63]) / w,
        float(count[128:].sum()) / n,
        capitals / w,
        float(-(share * np.log2(share)).sum()) if len(data) else 0.0,
        short / w,
    ]


class Distinct:
    """Counts distinct strings: one stretch's as they are, those of several by 64 bits of hash each."""

    def __init__(self):
        self.first: set[bytes] = set()
        self.hashes: np.ndarray | None = None
        self.stretches = 0

    def add(self, found: list[bytes]) -> None:
        self.stretches += 1
        if self.stretches == 1:
            self.first = set(found)
            return
        if self.hashes is None:
            self.hashes, self.first = self._hashed(self.first), set()
        self.hashes = np.union1d(self.hashes, self._hashed(set(found)))

    @staticmethod
    def _hashed(found: set[bytes]) -> np.ndarray:
        return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))

    def __len__(self) -> int:
        return len(self.first) if self.hashes is None else len(self.hashes)


@dataclass
class Model:
    """Lookup tables by feature and by pair; a score is the logistic of their sum."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for f, g, table in self.pairs:
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(grad) < 2:
        return 0.0, 0
    g, h = np.cumsum(grad), np.cumsum(hess)
    left, right = (g[:-1], h[:-1]), (g[-1] - g[:-1], h[-1] - h[:-1])
    gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - g[-1] ** 2 / (h[-1] + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _leaf(grad: np.ndarray, hess: np.ndarray) -> float:
    return float(grad.sum() / (hess.sum() + 1))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """A tree over ordered bins: the value of each bin."""
    gain, k = _split(grad, hess) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(grad), _leaf(grad, hess))
    return np.concatenate([_tree(grad[:k], hess[:k], depth - 1), _tree(grad[k:], hess[k:], depth - 1)])


def _grid_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one axis of a grid, then each side across the other."""
    best = (0.0, np.zeros_like(grad))
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        _, k = _split(g.sum(1), h.sum(1))
        if not k:
            continue
        values, gain = np.zeros_like(g), 0.0
        for part in (slice(0, k), slice(k, None)):
            a, b = g[part].sum(0), h[part].sum(0)
            values[part] = _tree(a, b, 1)
            gain += _split(a, b)[0]
        if gain > best[0]:
            best = (gain, values if axis == 0 else values.T)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, n_pairs: int = 6, step: float = 0.1) -> Model:
    """Cyclic boosting on rows x and labels y (0 or 1).  Without labels the score is 0.5 everywhere."""
    if not len(x):
        return Model()
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(intercept=float(np.log(share / (1 - share))), edges=[_cuts(c, bins) for c in x.T], coarse=[_cuts(c, coarse) for c in x.T])
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, place in enumerate(at):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            update = step * _tree(np.bincount(place, y - p, size), np.bincount(place, p * (1 - p), size), 2)
            model.tables[f] += update
            total += update[place]
    rough = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T, strict=True)]
    p = 1 / (1 + np.exp(-total))

    def grids(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.coarse[f]) + 1, len(model.coarse[g]) + 1
        cell = rough[f] * shape[1] + rough[g]
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda fg: (-_grid_tree(*grids(*fg, p)[1:])[0], fg))[:n_pairs]
    model.pairs = [(f, g, np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1))) for f, g in ranked]
    for _ in range(rounds // 3):
        for f, g, values in model.pairs:
            cell, grad, hess = grids(f, g, 1 / (1 + np.exp(-total)))
            update = step * _grid_tree(grad, hess)[1]
            values += update
            total += update.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no model learns from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = 12_000) -> Model:
    """Fits a model on at most `limit` labelled documents outside the held-out fold.

    The bound is the rows with the smallest hashes of doc_id, so it is the same whatever the partitions;
    only their features reach the driver.  Labels other than 0 and 1, null ids and labels without a
    document are left out; rows with several labels count once for each, and so do documents that share
    an id, all within the bound.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)  # at most `limit` rows: safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.select("doc_id", "quality", _features_udf(F.col("text")).alias("x"))
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(limit).collect()  # ids can repeat among documents
    found.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    return fit(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.quality for r in found], float))


@F.arrow_udf(ArrayType(DoubleType()))
def _features_udf(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))


def scored(text: Column, model: Model) -> Column:
    """The score (0 to 1) of each text; a null text counts as empty."""

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        rows: Sequence[list[float]] = [features(t.as_py()) for t in texts]
        return pa.array(model.score(np.array(rows).reshape(-1, len(FEATURES))))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5, else 0) of every row of docs.

    Nothing but the text is an input of the score.  Null texts count as empty; repeated and null ids are
    kept; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(F.col("text"), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
