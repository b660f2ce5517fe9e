from pyspark.sql import functions as F

from listwarden.plans import persist


def test_results_are_read_without_their_ids(spark, tmp_path):
    """Rows appended twice come once, as last stamped; the ids are neither read nor dealt, and a join by ``near`` needs no further exchange."""
    folder = str(tmp_path)
    rows = [("r1", 1, True, 50.0), ("r1", 2, False, None), ("r2", 1, None, 70.0), (None, 1, True, 80.0), ("r3", None, False, 90.0)]
    first = spark.createDataFrame(rows, "request_id string, result_no int, is_hit boolean, max_confidence double")
    later = first.withColumn("max_confidence", F.col("max_confidence") + 1)
    persist.append(first, folder, "screening_results", F.lit("2024-01-01"))
    persist.append(later, folder, "screening_results", F.lit("2024-01-02"))
    columns = ["request_id", "result_no", "is_hit", "max_confidence"]
    by_id = {(r.request_id, r.result_no, r.is_hit, r.max_confidence) for r in persist.read(spark, folder, "screening_results", ["id", *columns]).collect()}
    assert by_id == {(a, b, c, None if d is None else d + 1) for a, b, c, d in rows}
    for near in (None, "request_id"):
        found = persist.read(spark, folder, "screening_results", columns, near)
        assert {tuple(r) for r in found.collect()} == by_id and found.columns == columns and found.count() == len(rows)
    plan = found.join(first.select("request_id").distinct().hint("merge"), "request_id")._jdf.queryExecution().executedPlan().toString()
    assert "unhex" not in plan and "id:string,request_id" not in plan and plan.count("RoundRobin") == 0
    assert plan.count("Exchange hashpartitioning") == 2  # of the results and of the requests, once each
    assert any(".zstd." in f for f in spark.read.parquet(f"{folder}/screening_results").inputFiles())
