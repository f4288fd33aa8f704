"""Exact top-k against scoring every pair, with ties, repeats, odd vectors and huge components."""

import math

import pytest
from pyspark.sql import functions as F

from lithic.llm import topk
from lithic.llm.queries import op12_exact_top_k

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, chunk string"


def plain(rows, k, asked):
    """Sorted rows of the result; ``rows`` are (vec_id, vector)."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(whole):
        if not asked(q):
            continue
        scored = [(-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(v, w, strict=True)))), i is None, i or 0) for other, (i, w) in enumerate(whole) if other != at and len(w) == len(v)]
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = op12_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 5, lambda i: i % 50 == 0)


def odd_vectors():
    same = [(i, [0.5, -0.25]) for i in range(100, 160)]
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [-1.0, 0.3]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (100, []), (6, [1.0]), (150, [3.0]), (None, [0.5, -0.25]), (None, [9.0, 9.0]), (-50, [0.0, 0.0]), (7, [3e38, -3e38]), (8, [1e17, 1e17]), *same]
    return [(i, v, 1, "s", 2, "c") for i, v in rows]


@pytest.mark.parametrize("rows", [512, 3])
def test_odd_vectors(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", rows)
    df = spark.createDataFrame(odd_vectors(), SCHEMA).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=4).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == plain([r[:2] for r in odd_vectors()], 4, lambda i: i is not None and i % 50 == 0)


def test_no_rows_or_no_candidates(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "s", 2, "c")], SCHEMA)
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).collect() == []
