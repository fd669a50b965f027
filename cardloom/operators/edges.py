"""Expected cards against generated ones by the keywords that occur, and greedy matching over those edges alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cards of a case that one row holds: each such shard gets the case's keywords once, so a large case lies in many tasks.
SHARD = 256
#: The weights of a pair's score (fixed values): keywords of each side, and the type, where one is wanted; else keywords alone.
TYPED, BONUS, PLAIN = 0.4, 0.2, 0.5
EDGES = "case_id string, exp_idx int, card_idx int, score double"


def _automaton(wanted: list[dict], side: str) -> tuple[ahocorasick.Automaton | None, dict[str, dict[int, int]]]:
    """Finds the keywords of one side; by keyword, how often each expected card (by its place) lists it."""
    listed: dict[str, dict[int, int]] = {}
    for at, one in enumerate(wanted):
        for word in one[side] or []:
            if word is not None:
                times = listed.setdefault(word, {})
                times[at] = times.get(at, 0) + 1
    made = ahocorasick.Automaton()
    for word in listed:
        if word:
            made.add_word(word, word)
    if not len(made):
        return None, listed
    made.make_automaton()
    return made, listed


def _found(text: str | None, made: ahocorasick.Automaton | None, listed: dict[str, dict[int, int]]) -> dict[int, int]:
    """How many of its keywords the text contains, for each expected card that has one there."""
    count: dict[int, int] = {}
    if text is not None:
        words = {w for _, w in made.iter(text)} if made else set()
        for word in words | ({""} & listed.keys()):  # every text contains the empty keyword
            for at, times in listed[word].items():
                count[at] = count.get(at, 0) + times
    return count


def _score(one: dict, front: int, back: int, kind: str | None) -> float:
    f = front / len(one["front"]) if one["front"] else 0.0
    b = back / len(one["back"]) if one["back"] else 0.0
    if one["kind"] is None:
        return f * PLAIN + b * PLAIN
    return f * TYPED + b * TYPED + (1.0 if kind == one["kind"] else 0.0) * BONUS


def _edges(batches: Iterator[pa.RecordBatch], by_type: bool) -> Iterator[pa.RecordBatch]:
    """The edges of shards (case_id, cards, wanted: expected cards)."""
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
    for batch in batches:
        for row in batch.to_pylist():
            wanted, out, alike = row["wanted"], [], {}
            sides = [_automaton(wanted, side) for side in ("front", "back")]
            for at, one in enumerate(wanted):
                alike.setdefault(one["kind"], set()).add(at)
            for card in row["cards"]:
                front, back = (_found(card[side], *s) for side, s in zip(("front", "back"), sides, strict=True))
                typed = alike.get(card["kind"], set()) if by_type and card["kind"] is not None else set()
                for at in front.keys() | back.keys() | typed:
                    score = _score(wanted[at], front.get(at, 0), back.get(at, 0), card["kind"])
                    if score > 0:
                        out.append((row["case_id"], wanted[at]["exp_idx"], card["card_idx"], score))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["case_id", "exp_idx", "card_idx", "score"])


def score_edges(expected: DataFrame, generated: DataFrame, by_type: bool = True) -> DataFrame:
    """case_id, exp_idx, card_idx, score of the pairs of a case that score above 0.

    expected: case_id, exp_idx, front_keywords, back_keywords, wanted_type (or null); generated: case_id, card_idx,
    front, back, card_type.  Repeated keywords count as often as they are listed; a side without keywords scores 0,
    a null text contains nothing.  by_type: also the pairs that share no keyword but the wanted type, which
    score BONUS; without it the work follows the keywords that occur.  One automaton over the keywords of a case
    reads each text once, whatever their number; the expected cards of a case meet in one row, its generated ones don't.
    """
    one = F.struct(F.col("exp_idx").cast("int").alias("exp_idx"), F.col("front_keywords").alias("front"), F.col("back_keywords").alias("back"), F.col("wanted_type").alias("kind"))
    card = F.struct(F.col("card_idx").cast("int").alias("card_idx"), "front", "back", F.col("card_type").alias("kind"))
    wanted = expected.groupBy("case_id").agg(F.collect_list(one).alias("wanted"))
    shards = generated.groupBy("case_id", F.floor(F.col("card_idx") / SHARD).alias("shard")).agg(F.collect_list(card).alias("cards"))
    return shards.join(wanted, "case_id").select("case_id", "cards", "wanted").mapInArrow(partial(_edges, by_type=by_type), EDGES)


def sparse_match(expected: DataFrame, generated: DataFrame, threshold: float) -> DataFrame:
    """case_id, exp_idx, gen_idx (null without a match), similarity (0 without a match).

    In the order of expected cards, each takes the best card not yet taken, the first of equals, if it scores above 0
    and at least the threshold.  The ones before the r-th take r - 1 cards at most, so that its r best edges decide: what
    meets in the fold of a case grows with its expected cards, not with the generated ones.
    """
    at = F.row_number().over(Window.partitionBy("case_id").orderBy("exp_idx"))
    wanted = expected.select("case_id", F.col("exp_idx").cast("int").alias("exp_idx")).withColumn("turn", at)
    edges = score_edges(expected, generated, by_type=threshold <= BONUS).where(F.col("score") >= threshold)
    best = Window.partitionBy("case_id", "exp_idx").orderBy(F.desc("score"), "card_idx")
    edges = edges.withColumn("rank", F.row_number().over(best)).join(wanted, ["case_id", "exp_idx"]).where("rank <= turn")
    choice = F.array_sort(F.collect_list(F.struct("rank", "card_idx", "score"))).alias("choice")
    rows = edges.groupBy("case_id", "exp_idx").agg(choice).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("exp_idx", "choice"))).alias("rows"))
    state = "struct<used:array<int>,out:array<struct<exp_idx:int,gen_idx:int,similarity:double>>>"

    def step(acc: Column, row: Column) -> Column:
        free = F.get(F.filter(row["choice"], lambda c: ~F.array_contains(acc["used"], c["card_idx"])), F.lit(0))
        taken = F.struct(row["exp_idx"].alias("exp_idx"), free["card_idx"].alias("gen_idx"), free["score"].alias("similarity"))
        used = F.when(free.isNotNull(), F.array_append(acc["used"], free["card_idx"])).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.when(free.isNotNull(), F.array_append(acc["out"], taken)).otherwise(acc["out"]).alias("out"))

    start = F.from_json(F.lit('{"used":[],"out":[]}'), state)
    found = rows.select("case_id", F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("m")).select("case_id", "m.*")
    return wanted.drop("turn").join(found, ["case_id", "exp_idx"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
