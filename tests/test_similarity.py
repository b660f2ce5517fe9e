import random

import pyarrow as pa
from pyspark.sql import functions as F

from listwarden.config import JoinLimits
from listwarden.functions import similarity as S
from listwarden.operators import tables
from listwarden.operators.candidates import distinct_requests, name_pairs
from tests import model


def some_names(rng, count):
    syllables = ["er", "an", "ti", "on", "th", "é", "李", "le", "ou", "x"]
    return sorted({
        " ".join(sorted("".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))).upper() for _ in range(rng.randint(1, 3))))
        for _ in range(count)
    })


def test_common_subsequence_equals_dynamic_programming(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ABC É李") for _ in range(rng.randint(0, n))), "".join(rng.choice("ABC É李") for _ in range(rng.randint(0, n)))) for n in [12] * 200 + [70] * 40 + [200] * 20]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.common_subsequence("a", "b").alias("l")).collect()
    assert [r for r in got if r.l != model.lcs(r.a, r.b)] == []


def test_null_has_no_score(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) a, 'x' b").select(S.common_subsequence("a", "b").alias("l"), S.key_ratio(F.col("a"), F.col("b")).alias("s")).first()
    assert (row.l, row.s) == (None, 0.0)


def test_sketch_never_exceeds_the_bag_difference(spark):
    names = some_names(random.Random(2), 60)
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    sketched = S.with_bag_sketch(S.with_bag_sketch(df, "a", "x"), "b", "y")
    rows = sketched.select("a", "b", S.differing_bits("x", "y").alias("d")).collect()
    assert all(r.d <= len(r.a) + len(r.b) - 2 * model.lcs(r.a, r.b) for r in rows)


def test_candidate_join_loses_no_pair(spark):
    rng = random.Random(3)
    left, right = some_names(rng, 120), some_names(rng, 150)
    requests = distinct_requests(spark.createDataFrame([(n, float(t)) for n in left for t in (90, 62 if len(n) % 2 else 75)], "request_key string, min_score double"))
    names = spark.createDataFrame([(n,) for n in right], "list_key string")
    expected = {
        (a, b) for a in left for b in right if model.ratio(a, b) >= (62 if len(a) % 2 else 75) - 1e-9
    }
    assert expected
    for limits in (JoinLimits(), JoinLimits(broadcast_bytes=0, block_rows=7)):
        got = name_pairs(requests, names, limits).collect()
        assert len(got) == len(expected)
        assert {(r.request_key, r.list_key) for r in got} == expected
        assert all(abs(r.score - model.ratio(r.request_key, r.list_key)) < 1e-9 for r in got)


def test_trigrams(spark):
    S.register_sql_functions(spark)
    row = spark.sql("SELECT similarity('word', 'two words') s, similarity('', '') e").first()
    assert abs(row.s - 4 / 11) < 1e-12 and row.e == 0
    native = spark.range(1).select(S.trigram_similarity(F.lit("word"), F.lit("two words"))).first()[0]
    assert abs(native - 4 / 11) < 1e-12


def test_trigram_join_loses_no_pair(spark):
    rng = random.Random(4)
    left, right = some_names(rng, 60), some_names(rng, 60)
    a = spark.createDataFrame([(n,) for n in left], "left_text string")
    b = spark.createDataFrame([(n,) for n in right], "right_text string")
    every = a.crossJoin(b).withColumn("s", S.trigram_similarity(F.col("left_text"), F.col("right_text")))
    for threshold in (0.1, 0.3, 0.5):
        expected = {(r.left_text, r.right_text) for r in every.filter(F.col("s") > threshold).collect()}
        got = tables.similar_name_pairs(a, b, threshold).collect()
        assert {(r.left_text, r.right_text) for r in got} == expected and len(got) == len(expected)


def test_cells_of_names_lose_no_pair_of_any_length():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ABC É李") for _ in range(n))
    left = sorted({word(n) for n in [1, 2, 20, 31, 32, 33, 63, 64, 65, 130] * 4})
    least = [rng.choice((55.0, 70.0, 90.0)) for _ in left]
    for length in (1, 30, 64, 70):
        right = sorted({word(length) for _ in range(25)} | {n for n in left if len(n) == length})
        cell = S.key_pairs(pa.table({"request_key": left, "min_score": least}), pa.table({"list_key": right}))
        got = {(r["request_key"], r["list_key"]): r["score"] for r in cell.to_pylist()}
        every = {(a, b): 200.0 * model.lcs(a, b) / (len(a) + len(b)) for a in left for b in right}
        floor = dict(zip(left, least))
        assert got == {pair: s for pair, s in every.items() if s >= floor[pair[0]] - 1e-9} and len(got) == cell.num_rows


def test_best_alike_texts_keep_ties(spark):
    left = spark.createDataFrame([("abcd",), ("zz",), ("",)], "left_text string")
    right = spark.createDataFrame([("abcd",), ("abce",), ("abcf",), ("abxy",), ("",)], "right_text string")
    of = lambda best: sorted(r.right_text for r in tables.similar_name_pairs(left, right, 0.2, best).collect())
    assert of(None) == ["abcd", "abce", "abcf", "abxy"] and of(1) == ["abcd"] and of(2) == ["abcd", "abce", "abcf"]
