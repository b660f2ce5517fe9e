import random
from collections import defaultdict

from pyspark.sql import functions as F

from listwarden.operators import tables

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
KINDS = "source string, entity_id string, token string, weight string"


def _model(rows, asked, limit=None):
    held, wanted, found = defaultdict(dict), defaultdict(set), []
    for source, entity, token, weight in rows:
        held[source, entity][token] = max(WEIGHTS[weight], held[source, entity].get(token, 0))
    for search, token in asked:
        wanted[search].add(token)
    for search, tokens in wanted.items():
        hits = [(-round(sum(v for t, v in has.items() if t in tokens), 6), *key, len(tokens & set(has))) for key, has in held.items() if tokens & set(has)]
        found += [(search, s, e, -r, n) for r, s, e, n in sorted(hits)[:limit]]
    return sorted(found)


def _found(spark, rows, asked, *args):
    found = tables.token_search(spark.createDataFrame(rows, KINDS), spark.createDataFrame(asked, "search_id long, token string"), WEIGHTS, *args)
    return sorted((r.search_id, r.source, r.entity_id, round(r["rank"], 6), r.matched_tokens) for r in found.collect())


def _case():
    rng = random.Random(5)
    terms = ["hot", "warm"] * 20 + [f"t{k}" for k in range(90)]
    rows = [(rng.choice("ST"), str(k % 150), t, rng.choice("ABCD")) for k in range(200) for t in rng.choices(terms, k=rng.randrange(1, 7))]
    asked = [(k, t) for k in range(70) for t in rng.choices([*terms, "nothing"], k=rng.randrange(1, 5))]
    return rows, asked + [(99, t) for t in set(terms)]  # more tokens than there are bits


def test_every_entity_of_a_search_in_cells(spark):
    rows, asked = _case()
    assert _found(spark, rows, asked, None, 4) == _model(rows, asked)


def test_best_entities_of_a_search(spark):
    rows, asked = _case()
    assert _found(spark, rows, asked, 3) == _model(rows, asked, 3)
    assert _found(spark, rows, asked, 1) == _model(rows, asked, 1)


def test_a_frequent_token_is_spread_over_tasks(spark):
    mine = spark.range(400).select(F.lit("hot").alias("token"), F.col("id").alias("a"))
    theirs = spark.range(400).select(F.lit("hot").alias("token"), F.col("id").alias("b"))
    met = tables._in_cells(mine, theirs, 20)
    of_task = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(of_task) == 160_000 == met.select("a", "b").distinct().count() and max(of_task) < 20_000


def test_only_entities_that_can_be_best_meet_a_search(spark):
    # a token that all hold, searched together with many others: the rows that are ranked don't grow with searches times entities
    entities = spark.range(300).select(F.lit("S").alias("source"), F.col("id").cast("string").alias("entity_id"), F.array(F.struct(F.lit("hot").alias("token"), F.lit(1.0).alias("value")), F.struct(F.concat(F.lit("t"), F.col("id")).alias("token"), F.lit(0.4).alias("value"))).alias("held"))
    searches = spark.range(300).select(F.col("id").alias("q"), F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id"))).alias("tokens"))
    each = entities.select("source", "entity_id", F.explode("held.token").alias("token"))
    first = each.filter((F.col("token") != "hot") | F.col("entity_id").isin("0", "1", "10"))
    ranked = tables.met_entities(searches, entities, first, 3)
    assert ranked.count() <= 4 * 300
    best = {r.q: (r.entity_id, r.matched_tokens) for r in tables.best_of_held(searches, entities, first, 1).collect()}
    assert best == {k: (str(k), 2) for k in range(300)}
