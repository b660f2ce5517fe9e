import random

from pyspark.sql import functions as F

from listwarden.config import DEFAULT, JoinLimits, ScreeningConfig, Weights
from listwarden.functions.similarity import Ranking
from listwarden.operators import screening, tables
from listwarden.operators.candidates import best_name_pairs, name_pairs, stored_names
from tests import model
from tests.test_screening import check, data, frames


def test_only_the_best_entities_leave_the_join(spark):
    rng = random.Random(11)
    request = "MARTINEZ ROSALINDA"
    variants = sorted({"".join(c for c in request if c == " " or rng.random() > 0.2) for _ in range(300)} - {""})
    holders = {v: ("AB"[k % 2], str(k // 3)) for k, v in enumerate(variants)}
    rows = [(v, 0, *holders[v], hash(holders[v])) for v in variants]
    names = stored_names(spark.createDataFrame(rows, "list_key string, year int, source string, entity_id string, holder long"))
    asked = spark.createDataFrame([(request, request, 0, 75.0, 75.0)], "asked string, request_key string, year int, min_score double, least_value double")
    scores = {v: 200.0 * model.lcs(request, v) / (len(request) + len(v)) for v in variants}
    reached = sorted((v for v in variants if scores[v] >= 75), key=lambda v: (-scores[v], holders[v]))
    every = name_pairs(asked.select("request_key", "min_score"), names)
    assert every.count() == len(reached) > 100
    best = list(dict.fromkeys(holders[v] for v in reached))[:10]
    for rows_at_once in (DEFAULT.limits.block_rows, 7):
        found = best_name_pairs(asked, names, Ranking(10, 1.0, 0.0, 101.0), JoinLimits(block_rows=rows_at_once)).collect()
        kept = [r.list_key for r in sorted(found, key=lambda r: (-r.score, holders[r.list_key]))]
        assert list(dict.fromkeys(holders[v] for v in kept))[:10] == best and len(found) < 40
        assert all(abs(r.score - scores[r.list_key]) < 1e-9 for r in found)


def test_ties_and_birth_years_rank_as_in_the_model(spark):
    """Many entities of few names, so that the best are decided by layer, year and entity."""
    weighted = ScreeningConfig(name_threshold=65, short_name_threshold=65, weights=Weights(name=0.7, dob=0.3), match_limit=3)
    for seed, config in ((21, DEFAULT.with_(match_limit=3, limits=JoinLimits(block_rows=4))), (22, weighted)):
        asked, listed = data(seed, 40, 160)
        for k, row in enumerate(listed):
            row.update(primary_name=f"Maria Garcia{'xyz'[k % 3]}", all_names=[f"Maria Garcia{'xyz'[k % 3]}", *row["all_names"][1:]])
        for row in asked[::2]:
            row.update(name="Garcia Maria", date_of_birth=row["date_of_birth"] or "1973")
        check(spark, asked, listed, config)


def test_an_empty_list_has_no_pairs(spark):
    names = stored_names(spark.range(0).select(F.lit("A").alias("list_key")))
    assert name_pairs(spark.createDataFrame([("A", 60.0)], "request_key string, min_score double"), names).count() == 0


def test_no_side_is_copied_for_the_comparison(spark):
    """Neither names nor texts go through an exchange once for each block of the other side."""
    names = [f"NAME {chr(65 + k % 26)}{k}" for k in range(60)]
    left = spark.createDataFrame([(n, 60.0) for n in names], "request_key string, min_score double")
    right = spark.createDataFrame([(n,) for n in names], "right_text string")
    pairs = name_pairs(left, right.withColumnRenamed("right_text", "list_key"), JoinLimits(block_rows=5))
    texts = tables.similar_name_pairs(left.select(F.col("request_key").alias("left_text")), right, 0.3)
    for found in (pairs, texts):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Generate" not in plan and found.count() >= 60


def test_best_texts_of_many_sizes(spark):
    rng = random.Random(12)
    left, right = (sorted({"".join(rng.choice("abc d") for _ in range(rng.randint(2, 14))) for _ in range(n)}) for n in (40, 400))
    a, b = spark.createDataFrame([(n,) for n in left], "left_text string"), spark.createDataFrame([(n,) for n in right], "right_text string")
    every = {}
    for r in tables.similar_name_pairs(a, b, 0.2).collect():
        every.setdefault(r.left_text, {})[r.right_text] = r.similarity
    assert sum(map(len, every.values())) > 1000
    got = {}
    for r in tables.similar_name_pairs(a, b, 0.2, 3).collect():
        got.setdefault(r.left_text, {})[r.right_text] = r.similarity
    best = {t: {u: s for u, s in found.items() if s >= sorted(found.values())[-min(3, len(found))]} for t, found in every.items()}
    assert got == best


def test_a_list_prepared_for_other_weights_gives_the_same(spark):
    weighted = ScreeningConfig(name_threshold=65, short_name_threshold=65, weights=Weights(name=0.7, dob=0.3))
    requests, entities = frames(spark, *data(23, 30, 60))
    for config, other in ((DEFAULT, weighted), (weighted, DEFAULT)):
        own, foreign = (screening.screen(requests, screening.prepare_list(entities, c), config) for c in (config, other))
        rows = [sorted(map(str, f.select(*sorted(f.columns)).collect())) for f in (own, foreign)]
        assert rows[0] == rows[1] and rows[0]


def test_a_name_of_many_birth_years_is_compared_once(spark):
    rows = [{**entity, "primary_name": "Li Wei", "all_names": ["Li Wei"], "date_of_birth": f"{1900 + k}-01-01"} for k, entity in enumerate(data(24, 1, 50)[1])]
    listed = screening.prepare_list(frames(spark, data(24, 1, 1)[0], rows)[1])
    assert listed.keys.count() == 1 and listed.index.count() == 50
