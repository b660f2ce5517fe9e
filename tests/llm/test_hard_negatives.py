import numpy as np
from pyspark.sql import functions as F

from listwarden.llm import hard_negatives, topk


def _mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank int, anchor string")
    vectors = frame.select("*", topk.integers(F.col("embedding")).alias("v"))
    out = hard_negatives.mine(vectors, vectors.filter(F.col("vec_id") % 100 == 0), **sizes).collect()
    return sorted((r.anchor_id, r.positive_id, r.positive_rank, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out)


def _plain(rows, positives=5, negatives=10):
    rows = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, y in rows:
        if i % 100:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in rows if j != i and len(w) == len(v))
        for place, (p, j, _) in enumerate([o for o in others if o[2] == y][:positives], 1):
            fits = [(s, k) for s, k, z in others if z != y and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, place, n, k, -p, -s) for n, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def test_scores_equal_inner_products():
    rng = np.random.default_rng(3)
    for size, low, high in ((1, -1, 1), (7, 0, 9), (8, -300, 2), (20, -(2**33), 2**33)):
        anchors, candidates = rng.integers(low, high + 1, (5, size)), rng.integers(low, high + 1, (40, size))
        packed, planes = hard_negatives.pack(candidates)
        found = hard_negatives.scores(hard_negatives.tables(anchors), packed, planes) if size < 20 else None
        if size == 20:
            anchors = anchors % 1000
            found = hard_negatives.scores(hard_negatives.tables(anchors), packed, planes)
        assert (found == candidates @ anchors.T).all()


def test_equals_brute_force_with_ties_nulls_repeated_ids_and_many_blocks(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(3, 10))
    label = rng.integers(0, 3, 700)
    x = centers[label] + 0.8 * rng.normal(size=(700, 10))
    x[200:260] = x[100]
    rows = [(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(x, label))]
    rows += [(100, rows[3][1], 1), (100, rows[5][1], 0), (7, rows[9][1], 2), (7, rows[9][1], 2)]
    rows += [(800, None, 1), (900, [float("nan")] * 10, 1), (1000, [None] * 10, 1), (1100, rows[0][1], None), (None, rows[0][1], 1), (1200, [1.0, 2.0], 1), (1201, [2.0, 2.0], 1), (1202, [1.0, 1.0], 0), (1300, [], 1), (1301, [], 0)]
    expected = _plain(rows)
    assert len(expected) > 100 and any(r[0] == 1200 for r in expected)
    assert _mined(spark, rows, block_rows=90, anchor_rows=3) == expected
    assert _mined(spark, rows) == expected


def test_empty_table(spark):
    assert _mined(spark, []) == []
