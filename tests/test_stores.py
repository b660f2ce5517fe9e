import random

from pyspark.sql import functions as F

from listwarden.operators import tables
from listwarden.operators.paging import RankedPages
from listwarden.plans import colocated, persist, reload


def test_pages_by_rank_with_a_hot_value_and_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.choice([7, 7, 7, None, rng.randrange(100)]), k, "x") for k in range(3000)]
    frame = spark.createDataFrame(rows, "v int, id long, _other string")
    pages = RankedPages(frame, [F.col("v").desc(), F.col("id")], 16)
    expected = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert pages.total == 3000
    for offset, limit in ((0, 10), (1490, 300), (2995, 100), (3000, 5), (17, 0)):
        assert [tuple(r) for r in pages.page(offset, limit).collect()] == expected[offset : offset + limit]
    plan = pages.page(1490, 10)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]  # only the ranges of the page are read
    assert RankedPages(frame.limit(0), [F.col("id")]).page().count() == 0


def test_nesting_stored_tables_moves_no_rows(spark):
    rng = random.Random(3)
    parents = spark.createDataFrame([(k, f"p{k}") for k in range(200)], "id long, name string")
    children = spark.createDataFrame([(rng.randrange(220), k) for k in range(600)], "id long, no long")
    below = spark.createDataFrame([(r.id, r.no, rng.random()) for r in children.collect() for _ in range(rng.randrange(3))], "id long, no long, v double")
    store = colocated.Store(spark, ["id"], 4)
    try:
        for name, rows in (("parents", parents), ("children", children), ("below", below)):
            store.put(name, rows)
        nested, tree = store.nested("parents", ["children", "below"]), store.tree("parents", "children", "below", "no")
        for frame in (nested, tree):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        plain = tables.nested(parents, ["id"], {"children": children, "below": below})
        assert sorted(map(str, nested.collect())) == sorted(map(str, plain.collect()))
        held = {(r.id, c.no): sorted(x.v for x in c.below or []) for r in tree.collect() for c in r.children or []}
        expected = {(r.id, r.no): [] for r in children.collect() if r.id < 200}
        for r in below.collect():
            if (r.id, r.no) in expected:
                expected[r.id, r.no].append(r.v)
        assert held == {k: sorted(v) for k, v in expected.items()}
    finally:
        store.drop()


UN = """<CONSOLIDATED_LIST><INDIVIDUALS>{people}</INDIVIDUALS><ENTITIES></ENTITIES></CONSOLIDATED_LIST>"""
PERSON = "<INDIVIDUAL>{id}<FIRST_NAME>Ann</FIRST_NAME><SECOND_NAME>Bo</SECOND_NAME><REFERENCE_NUMBER>QDi.1</REFERENCE_NUMBER></INDIVIDUAL>"
OFAC = '<sanctionsData><entities><entity id="1"><names/></entity></entities></sanctionsData>'


def test_a_bad_second_list_is_refused(spark, tmp_path):
    ofac = tmp_path / "ofac.xml"
    ofac.write_text(OFAC)
    bad = PERSON.format(id="") * 3
    for name, people, most, errors in (
        ("none", "", None, ["the file holds no entities"]), ("unread", bad, None, ["the file holds no entities"]),
        ("few", bad + PERSON.format(id="<DATAID>5</DATAID>"), 50.0, ["3 of 4 entities have no id (75.00%)"]), ("kept", bad + PERSON.format(id="<DATAID>5</DATAID>"), None, []),
    ):
        path = tmp_path / f"{name}.xml"
        path.write_text(UN.format(people=people))
        done = reload.reload_lists(spark, str(ofac), str(path), un_malformed_percent=most)
        told = {r.source: (r.success, list(r.errors)) for r in done.report.collect()}
        assert told["UN"] == (not errors, errors) and ("UN" in done.refused) == bool(errors)
        assert done.entities.filter("source = 'UN'").count() == (0 if errors else 1)


def test_persisted_rows_are_read_by_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, True, 5.0), ("a", 2, False, 7.0)], "request_id string, result_no int, is_hit boolean, max_confidence double")
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    persist.append(rows, str(tmp_path), "screening_results", at(1))
    persist.append(rows.withColumn("max_confidence", F.lit(9.0)), str(tmp_path), "screening_results", at(2))
    whole = persist.read(spark, str(tmp_path), "screening_results")
    got = persist.read(spark, str(tmp_path), "screening_results", ["id", "result_no", "max_confidence"])
    assert got.columns == ["id", "result_no", "max_confidence"]
    assert sorted(got.collect()) == sorted(whole.select(*got.columns).collect()) and {r.max_confidence for r in got.collect()} == {9.0}


def test_buckets_follow_the_parents(spark, monkeypatch):
    monkeypatch.setattr(colocated, "BUCKET_ROWS", 10)
    store = colocated.Store(spark, ["id"], 4)
    store.put("parents", spark.range(95))
    store.put("children", spark.range(190).select((F.col("id") % 95).alias("id"), F.col("id").alias("n")))
    whole = store.nested("parents", ["children"])
    assert store.buckets == 10 and whole.count() == 95 and whole.filter(F.size("children") == 2).count() == 95
    store.drop()
