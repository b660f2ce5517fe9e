from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks import catalog, views
from listwarden.operators import screening
from listwarden.streaming import monitors
from listwarden.streaming import screening as stream_screening

SCHEMA = "operation string, duration_ms double, is_error boolean, ts timestamp"
START = datetime(2024, 1, 1)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def row(minutes, error=False, ms=10.0):
    return ("q", ms, error, START + timedelta(minutes=minutes))


def test_error_rate_closes_windows_and_drops_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [row(1), row(2, True), row(30)])
    stream = monitors.error_rate_stream(monitors.read_operations(spark, folder, SCHEMA), "10 minutes", "5 minutes", "5 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        feed(spark, folder, [row(3, True), row(60)])  # minute 3 is behind the watermark now
        q.processAllAvailable()
        feed(spark, folder, [row(90)])
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.window_start: (r.calls, r.errors, r.alert) for r in spark.table("rates").collect()}
    assert got[START] == (2, 1, True)
    assert got[START + timedelta(minutes=30)] == (1, 0, False)


def test_p95_alerts(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [row(1, ms=float(i)) for i in range(1, 101)] + [row(6, ms=900.0), row(40)])
    stream = monitors.p95_stream(monitors.read_operations(spark, folder, SCHEMA))
    q = stream.writeStream.outputMode("append").format("memory").queryName("latencies").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.window_start: r for r in spark.table("latencies").collect()}
    assert abs(got[START].p95_ms - 95) <= 1 and not got[START].alert
    assert [r.window_start for r in monitors.alerts(spark.table("latencies")).collect()] == [START + timedelta(minutes=5)]


def test_stream_equals_the_table(spark, sf_dir):
    columns = ["request_id", "match_rank", "source", "entity_id", "overall"]
    stream = catalog.QUERIES["stream_screen"](spark, sf_dir).select(*columns)
    table = catalog.QUERIES["screen_full"](spark, sf_dir).select(*columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, table.collect()))


def test_duplicate_requests_count_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", None, "x", START), ("a", None, "x", START + timedelta(milliseconds=400)), ("a", None, "x", START + timedelta(seconds=2)), ("b", "1", "x", START)]
    spark.createDataFrame(rows, "name string, document_number string, analyst_id string, created_at timestamp").write.parquet(folder)
    arriving = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = stream_screening.without_duplicates(arriving).writeStream.format("memory").queryName("once_only").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("once_only").count() == 3


def test_prepared_list_is_reused(spark, sf_dir):
    prepared = screening.prepare_list(views.nested_entities(spark, sf_dir))
    assert prepared.names.filter(F.col("list_key") == "").count() == 0
    assert prepared.entities.count() == views.entities(spark, sf_dir).count()
