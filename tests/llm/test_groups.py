import random

from pyspark.sql import functions as F

from listwarden.llm.graph import bucket_groups, components


def _plain(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    links = [*zip(chain, chain[1:]), *[(5, 100 + k) for k in range(50)], (5, 5), (7, 8), (8, 7), (-3, 9), (9, 10), (10, -3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = _plain([x for x in links if x[0] != x[1]])
    assert got == expected


def test_bucket_groups_equal_all_pairs(spark):
    """Members are numbers, linked when they differ by at most 3: no star sees a whole bucket."""
    rng = random.Random(2)
    rows = {(b, rng.randrange(300)) for b in range(6) for _ in range(40)} | {(99, k) for k in range(400, 700, 2)}
    buckets = spark.createDataFrame(sorted(rows), "bucket long, id long")
    asked = []

    def check(pairs, prepared):
        asked.append(pairs.count())
        assert prepared.columns == ["id"]
        return pairs.filter(F.abs(F.col("a") - F.col("b")) <= 3)

    links = [(a, b) for x, a in rows for y, b in rows if x == y and a < b <= a + 3]
    def refine(ids, prepared):
        near = F.explode(F.array(*[F.floor((F.col("id") + k) / 4) for k in range(4)]))
        return ids.select(near.alias("bucket"), "id").distinct()

    for stars, cheap, finer in ((4, 0, None), (0, 8, None), (2, 8, None)):
        got = {r.id: r.component for r in bucket_groups(buckets, check, lambda ids: ids, finer, stars, cheap).collect()}
        assert got == _plain(links)
    # prepared columns bound the pairs of the last round; the groups stay the same
    asked.clear()
    named = lambda pairs, prepared: check(pairs, prepared.select("id"))
    bound = (["size"], F.abs(F.col("size_a") - F.col("size_b")) <= 4)
    got = bucket_groups(buckets, named, lambda ids: ids.withColumn("size", F.col("id")), stars=0, bound=bound)
    assert {r.id: r.component for r in got.collect()} == _plain(links) and sum(asked) <= len(rows) * 8
    one = spark.createDataFrame([(1, 7 * k // 2) for k in range(120)], "bucket long, id long")
    apart = [(a, b) for a in (7 * k // 2 for k in range(120)) for b in (7 * k // 2 for k in range(120)) if a < b <= a + 3]
    asked.clear()
    got = {r.id: r.component for r in bucket_groups(one, check, lambda ids: ids, refine, stars=1, cheap=0).collect()}
    assert got == _plain(apart) and sum(asked) < 1000


def test_copies_of_one_group_need_no_pairs(spark):
    buckets = spark.range(20_000).select((F.col("id") % 3).alias("bucket"), "id").union(spark.range(20_000).selectExpr("7L", "id"))
    asked = []

    def check(pairs, prepared):
        asked.append(pairs.count())
        return pairs

    got = bucket_groups(buckets, check, lambda ids: ids)
    assert got.select("component").distinct().count() == 1 and got.count() == 20_000 and sum(asked) <= 60_000
