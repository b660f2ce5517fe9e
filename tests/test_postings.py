import random

from pyspark.sql import functions as F

from listwarden.functions.names import normalize_name
from listwarden.operators import postings, tables

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
KINDS = "source string, entity_id string, token string, weight string"


def _tokens(rng, keys, terms):
    return [("S", str(k), t, rng.choice("ABC")) for k in keys for t in {"all", *rng.choices(terms, k=rng.randrange(1, 6))}]


def _scan(spark, rows, searches, limit):
    found = tables.token_search(spark.createDataFrame(rows, KINDS), searches, WEIGHTS, limit)
    return sorted((r.search_id, r.source, r.entity_id, round(r["rank"], 6), r.matched_tokens) for r in found.collect())


def _indexed(index, searches, limit):
    found = postings.best_by_tokens(index, searches, limit)
    return sorted((r.search_id, r.source, r.entity_id, round(r["rank"], 6), r.matched_tokens) for r in found.rows.collect()), found


def test_best_by_tokens_equals_the_scan_with_ties_and_merged_segments(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rng = random.Random(3)
    terms = [f"t{k}" for k in range(60)] + ["hot"] * 40
    rows = _tokens(rng, range(400), terms)
    rows += [(*r[:3], "C") for r in rows[:50]]  # a token twice: its best weight counts
    asked = [(k, t) for k in range(40) for t in {rng.choice(terms), rng.choice([*terms, "all", "nothing"])}] + [(50, "nothing"), (51, "hot"), (51, "hot")]
    searches = spark.createDataFrame(asked, "search_id long, token string")
    index = postings.weighted(spark.createDataFrame(rows, KINDS), WEIGHTS)
    got, found = _indexed(index, searches, 3)
    assert got == _scan(spark, rows, searches, 3) and len(got) > 60
    one = spark.createDataFrame([(1, "all")], "search_id long, token string")
    assert _indexed(index, one, 3)[0] == _scan(spark, rows, one, 3) and _indexed(index, one, 3)[1].postings_read <= 16

    gone, changed = {str(k) for k in range(0, 400, 5)}, {str(k) for k in range(1, 400, 5)}
    fresh = _tokens(rng, [k for k in range(1, 400, 5)] + list(range(1000, 1040)), terms)
    now = [r for r in rows if r[1] not in gone | changed] + fresh
    segment = postings.weighted(spark.createDataFrame(fresh, KINDS), WEIGHTS, index.segments)
    keys = spark.createDataFrame([("S", k) for k in gone | changed], "source string, entity_id string")
    newer = postings.merged(index, segment, keys)
    assert _indexed(newer, searches, 3)[0] == _scan(spark, now, searches, 3)
    back = postings.merged(newer, postings.weighted(spark.createDataFrame([], KINDS), WEIGHTS, newer.segments), spark.createDataFrame([("S", "1001")], "source string, entity_id string"))
    assert _indexed(back, searches, 3)[0] == _scan(spark, [r for r in now if r[1] != "1001"], searches, 3)


def test_lists_are_read_once_for_all_searches(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = [("S", str(k), "hot", "A") for k in range(300)] + [("S", str(1000 + k), f"t{k % 30}", "A") for k in range(1200)]
    asked = [(k, t) for k in range(30) for t in ("hot", f"t{k}")]
    searches = spark.createDataFrame(asked, "search_id long, token string")
    got, found = _indexed(postings.weighted(spark.createDataFrame(rows, KINDS), WEIGHTS), searches, 3)
    assert got == _scan(spark, rows, searches, 3) and len(got) == 90
    # the first block of each list, and the lists of forty entities whole
    assert found.postings_read <= 8 + 30 * (8 + 40)


def test_best_by_trigrams_equals_the_scan(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rng = random.Random(4)
    parts = ["anna", "annabel", "bell", "campbell", "mar", "maria", "marian", "x"]
    rows = [("S", str(k), " ".join(rng.choices(parts, k=rng.randrange(1, 4))), k % 11 == 0) for k in range(300)] + [("S", "e", "", False), ("S", "n", None, False)]
    frame = spark.createDataFrame(rows, "source string, entity_id string, primary_name string, is_deleted boolean")
    frame = frame.withColumn("normalized_name", normalize_name(F.col("primary_name")))
    index = postings.sized(frame)
    for name, threshold in (("Maria Bell", 0.3), ("annabel", 0.6), ("zzz", 0.1), ("", 0.3)):
        scan = tables.search_by_name(frame, name, threshold, 20).select("source", "entity_id", "similarity").collect()
        found = postings.best_by_trigrams(index, name, threshold, 20)
        assert [tuple(r) for r in found.rows.select("source", "entity_id", "similarity").collect()] == [tuple(r) for r in scan]


def test_empty_index_and_searches(spark):
    empty = postings.weighted(spark.createDataFrame([], KINDS), WEIGHTS)
    searches = spark.createDataFrame([(1, "a")], "search_id long, token string")
    assert postings.best_by_tokens(empty, searches, 3).rows.count() == 0
    assert postings.best_by_tokens(empty, searches.limit(0), 3).rows.count() == 0
