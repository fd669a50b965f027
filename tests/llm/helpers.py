"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of an input.
CLASHING = ("score", "key", "row", "fp", "h", "block", "idx", "name", "keep_id", "kept", "n", "ids", "spans", "hashes", "digest", "owner", "bucket")


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], clashing: bool = False) -> DataFrame:
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    if not clashing:
        return spark.createDataFrame(full, DOCS)
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in full], f"{DOCS}, {extra}")


def awkward(seed: int = 0) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, repeats within and across, nulls, empty and very long ones."""
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mé", "Nu", "漢") for b in ("ri", "sta", "'ll", "xy", "9")]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    shared, base = say(60), say(200)
    near = base.split()
    near[100] = "other"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, base.upper()), (7, " ".join(near)),
        (8, say(30) + "\n" + shared + "\t" + say(10)), (9, shared + "  " + say(50)), (10, say(20) + " " + shared + " " + shared),
        (11, say(6000)), (12, "a"), (13, "A"), (14, "x" * 5000), (15, say(34)), (16, say(35)), (None, base), (None, None),
        (4, base), (17, "  　\u0085 nbsp"), (18, "it's we'll I'd <|endoftext|> </s>"), (19, "\x1c\x1d control"), (20, "  " + base),
    ]
    return rows + [(100 + i, say(rnd.randint(0, 80))) for i in range(30)]
