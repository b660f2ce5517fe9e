from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import views
from listwarden.operators import alerts, rates, screening, staging, stats
from listwarden.streaming import pairing
from listwarden.streaming import screening as stream_screening

START = datetime(2024, 1, 1)
CALLS = "operation string, duration_ms double, is_error boolean, ts timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def _evaluations(spark, minutes, operation="q"):
    rows = [("r", operation, at(m) - timedelta(microseconds=1), float(v), v > 1) for m, v in minutes]
    return spark.createDataFrame(rows, "rule string, operation string, at timestamp, value double, breached boolean")


def test_a_rule_fires_after_it_held_and_a_gap_ends_it(spark):
    held = [(m, 2) for m in range(10, 16)] + [(16, 9), (17, 1)]
    brief = [(m, 3) for m in range(30, 35)]
    twice = [(50, 2), (51, 2), (53, 2), (54, 2), (55, 2), (56, 2), (57, 2), (58, 2)]
    frame = _evaluations(spark, held + brief + twice)
    got = {r.pending_at: (r.firing_at, r.resolved_at, r.evaluations, r.peak) for r in alerts.episodes(frame, "operation").collect()}
    assert got == {
        at(10): (at(15), at(17), 7, 9.0), at(30): (None, at(35), 5, 3.0), at(50): (None, at(52), 2, 2.0), at(53): (at(58), at(59), 6, 2.0),
    }
    assert sorted(r.firing_at for r in alerts.firing(frame, "operation").collect()) == [at(15), at(16), at(58)]
    assert alerts.episodes(frame.limit(0)).count() == 0


def test_episodes_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [("a" if m % 3 else "b", 10.0, 40 <= m < 52 or m == 70, at(m) + timedelta(seconds=5)) for m in range(120)]
    whole = spark.createDataFrame(rows, CALLS)
    folder = str(tmp_path / "in")
    arriving = spark.readStream.schema(CALLS).parquet(folder) if whole.coalesce(1).write.parquet(folder) is None else None
    found = alerts.episodes(alerts.error_rate_rule(arriving.withWatermark("ts", "2 minutes")))
    q = found.writeStream.format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("a", 1.0, False, at(500))], CALLS).write.mode("append").parquet(folder)
        q.processAllAvailable()
    finally:
        q.stop()
    told = sorted(map(tuple, spark.table("episodes").collect()))
    assert told == sorted(map(tuple, alerts.episodes(alerts.error_rate_rule(whole)).collect())) and len(told) == 2
    assert told[0][2] == told[0][1] + timedelta(minutes=5)


def test_rates_with_a_reset(spark):
    samples = [("x", at(0), 100), ("x", at(1), 130), ("x", at(5), 160), ("x", at(6), 10), ("x", at(10), 25), ("y", at(6), 7), ("y", at(7), 7)]
    frame = spark.createDataFrame(samples, "name string, ts timestamp, value long")
    grown = {(r.name, r.ts): r.increase for r in rates.increases(frame, "name").collect()}
    assert [grown["x", at(m)] for m in (0, 1, 5, 6, 10)] == [None, 30, 30, 10, 15]
    got = {(r.name, r.window_start): (r.increase, r.per_second) for r in rates.rates(frame, "name").collect()}
    assert got == {("x", at(0)): (60, 0.2), ("x", at(5)): (25, 25 / 300), ("y", at(5)): (0, 0.0)}


def test_quantile_of_rates(spark):
    # buckets 1 s: 10 -> 40, 2.5 s: 20 -> 60, all: 20 -> 60, then a new process: 8, 8, 10
    rows = [("q", le, at(m), v) for m, values in ((1, (10, 20, 20)), (2, (40, 60, 60)), (7, (8, 8, 10))) for le, v in zip(("1.0", "2.5", "+Inf"), values)]
    frame = spark.createDataFrame(rows, "operation string, le string, ts timestamp, value long")
    got = {r.window_start: r.quantile_seconds for r in rates.rate_quantile(frame, 0.875, "operation").collect()}
    assert got[at(0)] == pytest.approx(1 + 1.5 * (35 - 30) / 10) and got[at(5)] == pytest.approx(2.5)  # beyond the last bound: the bound


def test_requests_without_an_answer_time_out_in_the_stream(spark, tmp_path):
    asked, answered = str(tmp_path / "asked"), str(tmp_path / "answered")
    ask, tell = "request_id string, requested_at timestamp", "request_id string, answered_at timestamp, outcome string, status_code int"
    spark.createDataFrame([("a", at(0)), ("b", at(1)), ("c", at(2)), (None, at(2)), ("d", at(50))], ask).write.parquet(asked)
    spark.createDataFrame([("a", at(1), "RESPONSE", 200), ("b", at(20), "RESPONSE", 200), ("c", at(2), "ERROR", 500), ("x", at(3), "RESPONSE", 200), (None, at(3), "RESPONSE", 200)], tell).write.parquet(answered)
    streams = spark.readStream.schema(ask).parquet(asked), spark.readStream.schema(tell).parquet(answered)
    q = pairing.pair_stream(*streams, "5 minutes", "1 minute").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("e", at(40))], ask).write.mode("append").parquet(asked)
        spark.createDataFrame([("e", at(41), "RESPONSE", 200)], tell).write.mode("append").parquet(answered)
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.request_id or "", r.outcome, r.status_code) for r in spark.table("pairs").collect())
    assert got == [("", "TIMEOUT", None), ("a", "RESPONSE", 200), ("b", "TIMEOUT", None), ("c", "ERROR", 500), ("e", "RESPONSE", 200)]  # d may still be answered


def test_fingerprints(spark):
    said = [
        "SELECT * FROM t1 WHERE id = 5 AND s = 'it''s'", "SELECT *  FROM t1\nWHERE id = 17 AND s = ''", "SELECT a FROM t WHERE id IN (1, 2,3 ) -- note 7", "SELECT a FROM t WHERE id IN ('x')",
        "/* 12 */ SELECT a FROM t WHERE id IN ($1, $2)", "SELECT 1.5, x_9", "", None,
    ]
    frame = spark.createDataFrame([(s,) for s in said], "query string")
    got = [r.query for r in stats.fingerprinted(frame).collect()]
    assert got[0] == got[1] == "SELECT * FROM t1 WHERE id = ? AND s = ?"
    assert got[2] == got[3] == got[4] == "SELECT a FROM t WHERE id IN (?)"
    assert got[5:] == ["SELECT ?, x_9", "", None]
    many = spark.range(20_000).select(F.concat(F.lit("SELECT f("), F.col("id").cast("string"), F.lit(") FROM t_"), F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.concat(F.lit("x"), F.col("id").cast("string")))).alias("query"))
    top = stats.frequent_statements(many, 1, 1024).first()
    assert top.query == "SELECT f(?) FROM t_hot" and abs(top.calls - 5000) <= 3.5 * 20_000 / 1024


def test_a_list_version_published_while_the_stream_runs(spark, sf_dir, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    now = views.nested_entities(spark, sf_dir)
    lists = {"v1": now.filter(F.col("lang") != "en") if "lang" in now.columns else now.filter("entity_type <> 'individual'"), "v2": now}
    requests = views.requests(spark, sf_dir)
    half = F.col("lang") == "en"
    requests.filter(half).coalesce(1).write.parquet(folder)
    versions, done = stream_screening.ListVersions(), []
    with pytest.raises(RuntimeError):
        versions.take()
    versions.publish("v1", lists["v1"])
    first = versions.take()
    with pytest.raises(ValueError):
        versions.publish("v1", lists["v1"])
    arriving = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = stream_screening.screen_stream_versions(arriving, versions, out, str(tmp_path / "c"), when_done=lambda b, v: done.append((b, v))).start()
    try:
        q.processAllAvailable()
        versions.publish("v2", lists["v2"])
        assert first.listed.entities.count() >= 0  # still held, so still there
        versions.give_back(first)
        with pytest.raises(Exception):
            spark.read.parquet(f"{first.folders[0]}/entities").count()
        requests.filter(~half).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
    finally:
        q.stop()
    assert done == [(0, "v1"), (1, "v2")]
    got = sorted((r.request_id, r.match_rank, r.source, r.entity_id, r.list_version) for r in spark.read.parquet(out).collect())
    expected = []
    for name, part in (("v1", half), ("v2", ~half)):
        prepared = screening.prepare_list(lists[name])
        expected += [(r.request_id, r.match_rank, r.source, r.entity_id, name) for r in screening.screen(requests.filter(part), prepared).collect()]
    assert got == sorted(expected)
    assert staging.mark() >= 0
