import numpy as np
from pyspark.sql import functions as F

from listwarden.llm import topk


def _run(spark, rows, k=5, **sizes):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score long")
    vectors = frame.select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k, **sizes)


def test_equals_brute_force_with_ties_nulls_and_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:140] = x[50]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (1101, [float("inf")] * 8), (1150, [1.0, 2.0]), (1151, [3.0, 1.0]), (1200, [])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in _run(spark, rows, block_rows=64, query_rows=5).collect()}
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    expected = {}
    for q in range(0, 600, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:5]
        expected.update({(q, n + 1): (i, scores[i]) for n, i in enumerate(order)})
    expected[(1150, 1)] = (1151, 256 * 256 * 5)
    assert got == expected


def test_rows_with_one_id_are_rows_of_their_own(spark):
    got = sorted(map(tuple, _run(spark, [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (50, [0.0, 1.0]), (None, [9.0, 9.0])]).collect()))
    one = [(50, 1, 1, 2 * 65536), (50, 2, 1, 65536), (50, 3, 2, 32768)]
    other = [(50, 1, 1, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert got == sorted(one + other)


def test_empty_table(spark):
    assert _run(spark, []).count() == 0
