"""Embeddings wider than a code are refused by the query, never cut."""

from __future__ import annotations

import pytest

from cardloom.llm.queries import op10_hamming_top_k


def test_query_refuses_what_a_code_cannot_hold(spark, tmp_path):
    for name, width in (("fits", 64), ("wide", 65)):
        rows = [(i, [1.0] * (width - 1) + [float(i) - 0.5]) for i in range(3)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/{name}/embeddings.parquet")
    got = op10_hamming_top_k(spark, f"file://{tmp_path}/fits").collect()
    assert [(r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in got] == [(0, 1, 1, 1), (0, 2, 2, 1)]
    with pytest.raises(Exception, match="65 components"):
        op10_hamming_top_k(spark, f"file://{tmp_path}/wide").collect()
