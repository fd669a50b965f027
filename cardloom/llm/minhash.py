"""MinHash near-duplicates by SuperMinHash signatures, banding and a check of the whole sets.

Signatures come from superminhash.py.  Sets that share a band are candidates; near_texts.components() checks
them on the whole sets, and joins what is linked by a union-find in rounds of joins (star contraction).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import discard, lower_ascii, settle, text_of
from cardloom.llm.near_texts import PART, Similarity, bitmap, components, shingles, word_keys
from cardloom.llm.simhash import text_hash
from cardloom.llm.superminhash import band_keys, signatures


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, digest, sid (identity of the set of shingles), n (its size), bits (its bitmap) and keys (of its bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x: pa.array(list(x), pa.list_(pa.int64()))
        for batch in batches:
            for a in range(0, len(batch), PART):
                part = batch.slice(a, PART)
                sets = [shingles(words) for _, words in word_keys(part.column(1))]
                size = np.array([len(x) for x in sets])
                found = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
                sids = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
                yield pa.record_batch([part.column(0), part.column(2), sids, pa.array(size, pa.int64()), longs(map(bitmap, sets)), longs(band_keys(found))], ["doc_id", "digest", "sid", "n", "bits", "keys"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(text_of()).alias("text"), text_hash().alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest long, sid binary, n long, bits array<long>, keys array<long>")


def near_duplicates(docs: DataFrame, least: Similarity = Similarity(85, 100)) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    A text's set is that of its five-word shingles (all its words, if they are fewer), A-Z lower-cased,
    words separated by ASCII white space.  Texts are linked if the Jaccard similarity of their sets is `least`
    or more, which is checked on the whole sets of all candidates: those that share a band, by chains of
    links as explained in near_texts.  component_id: the smallest doc_id reachable over links, null
    doc_ids aside; kept: whether that is the row's own.  Null and empty texts, and those without words,
    have an empty set, are linked with nothing and kept; rows that repeat or share a doc_id are texts of
    their own; other columns are ignored; an empty table gives no rows.

    A pair shares no band with a probability of 2e-6 at a similarity of 0.85; then only a chain through other
    texts can link it.  A worker holds a text's shingles, eight bytes for each word, and a few arrays of that
    size.  Hot keys are split as skewed joins are.  Runs jobs when it is called, which leave one checkpoint.
    """
    rows = settle(_described(docs))
    found = components(docs, rows, least)
    lowest = F.when(F.col("n") > 0, F.col("in_component")).otherwise(F.col("doc_id"))
    made = found.select("doc_id", F.col("n").alias("n_shingles"), lowest.alias("component_id"), lowest.eqNullSafe(F.col("doc_id")).alias("kept"))
    discard(rows)
    return made
