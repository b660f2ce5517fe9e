"""Counts, rates, latencies and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOW_MS = 1000
# Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def entity_rollup(entities: DataFrame) -> DataFrame:
    """Counts by source and type, by source, and in all; level 0 is the finest."""
    return entities.rollup("source", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")
    )


def in_range(column: str, start: Column | None, end: Column | None) -> Column:
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= start)
    if end is not None:
        test = test & (F.col(column) <= end)
    return test


def screening_stats(
    requests: DataFrame, results: DataFrame, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Requests, results, hits and hit rate of a closed range of creation times."""
    ranged = requests.filter(in_range("created_at", start, end))
    totals = ranged.agg(F.count(F.lit(1)).alias("total_requests"))
    # Results are counted per request before the join, so a request with many results is one row.
    per_request = results.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_hit").alias("hits")
    )
    if start is None and end is None:
        kept = per_request
    else:
        kept = per_request.join(ranged.select("request_id"), "request_id")
    found = kept.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_results"),
        F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("total_hits"),
    )
    rate = F.coalesce(F.try_divide(F.col("total_hits") * 100.0, F.col("total_results")), F.lit(0.0))
    # two one-row tables
    return totals.join(F.broadcast(found), F.lit(True)).withColumn("hit_rate_percent", F.round(rate, 2))


def status_breakdown(requests: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    return counts_by(requests.filter(in_range("created_at", start, end)), "status")


def query_stats(operations: DataFrame) -> DataFrame:
    """Per operation: calls, time, errors, slow calls and the last call."""
    ms = F.col("duration_ms")
    return operations.groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum(ms), 2).alias("total_time_ms"),
        F.round(F.avg(ms), 2).alias("avg_time_ms"),
        F.round(F.min(ms), 2).alias("min_time_ms"),
        F.round(F.max(ms), 2).alias("max_time_ms"),
        F.count_if("is_error").alias("errors"),
        F.count_if(ms > SLOW_MS).alias("slow_queries"),
        F.max("ts").alias("last_executed"),
    )


def slow_operations(operations: DataFrame) -> DataFrame:
    return query_stats(operations).filter(F.col("slow_queries") > 0)


def latency_histogram(operations: DataFrame) -> DataFrame:
    """Cumulative counts per bucket (le), operation and status, in one pass."""
    seconds = F.col("duration_ms") / 1000
    status = F.when(F.col("is_error"), "error").otherwise("success").alias("status")
    wide = operations.groupBy("operation", status).agg(
        *[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)],
        F.count(F.lit(1)).alias("b_all"),
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("observations")) for i, b in enumerate(BUCKETS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("b_all").alias("observations")))
    return wide.select("operation", "status", F.inline(F.array(*rows)))


ACCURACY = 10_000


def exact_quantile(df: DataFrame, value: str, quantile: float, keys: list[str]) -> DataFrame:
    """(keys, quantile, n): the interpolated quantile of each group, without a group in one buffer.

    A bounded sketch gives a bracket around the quantile's rank. The rows below it are counted, and only the
    distinct values inside it, with their counts, are ranked. Null values do not count.
    """
    rows = df.select(*keys, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    slack = 4.0 / ACCURACY
    ends = F.percentile_approx("v", [max(0.0, quantile - slack), min(1.0, quantile + slack)], ACCURACY)
    groups = rows.groupBy(*keys).agg(ends.alias("ends"), F.count(F.lit(1)).alias("n"))
    # The two values whose ranks (from 0) surround quantile * (n - 1) lie within the bracket, widened by one on each side.
    low, high = F.get("ends", F.lit(0)), F.get("ends", F.lit(1))
    placed = rows.join(groups, list(keys)) if keys else rows.join(F.broadcast(groups), F.lit(True))
    side = F.when(F.col("v") < low, -1).when(F.col("v") > high, 1).otherwise(0)
    near = placed.withColumn("side", side).groupBy(*keys, "n", "side").agg(F.count(F.lit(1)).alias("rows"), F.max("v").alias("top"), F.min("v").alias("bottom"))
    below = F.max(F.when(F.col("side") < 0, F.col("rows")))
    outside = near.groupBy(*keys, "n").agg(
        F.coalesce(below, F.lit(0)).alias("below"),
        F.max(F.when(F.col("side") < 0, F.col("top"))).alias("before"),
        F.min(F.when(F.col("side") > 0, F.col("bottom"))).alias("behind"),
    )
    inside = placed.withColumn("side", side).filter("side = 0").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = inside.join(outside, list(keys)) if keys else inside.join(F.broadcast(outside), F.lit(True))
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("last", F.col("below") + F.sum("c").over(upto) - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    rank = F.lit(float(quantile)) * (F.col("n") - 1)
    floor, ceil = F.floor(rank), F.ceil(rank)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("first") <= place) & (F.col("last") >= place), F.col("v")))

    found = ranked.groupBy(*keys, "n", "before", "behind").agg(at(floor).alias("a"), at(ceil).alias("b"))
    a, b = F.coalesce("a", "before"), F.coalesce("b", "behind")
    return found.select(*keys, (a + (b - a) * (rank - floor)).alias("quantile"), "n")


def latency_p95(operations: DataFrame, exact: bool = False, *keys: str) -> DataFrame:
    """95th percentile by operation: from a bounded sketch per group, or exact."""
    keys = keys or ("operation",)
    if exact:
        return exact_quantile(operations, "duration_ms", 0.95, list(keys)).withColumnRenamed("quantile", "p95_ms")
    p95 = F.percentile_approx("duration_ms", 0.95, ACCURACY)
    return operations.groupBy(*keys).agg(p95.alias("p95_ms"), F.count(F.lit(1)).alias("n"))


def histogram_quantile(histogram: DataFrame, quantile: float, *keys: str) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it (seconds).

    histogram: keys and cumulative (le, observations) rows, as ``latency_histogram`` gives them.
    """
    bounds = F.sort_array(
        F.collect_list(
            F.struct(
                F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double")).alias("le"),
                F.col("observations").alias("n"),
            )
        )
    )
    grouped = histogram.groupBy(*keys).agg(bounds.alias("b"))
    rank = F.element_at("b", -1)["n"] * F.lit(float(quantile))
    placed = grouped.withColumn("rank", rank).withColumn(
        "i", F.array_position(F.transform("b", lambda x: x["n"] >= F.col("rank")), F.lit(True)).cast("int") - 1
    )
    upper, before = F.get("b", F.col("i")), F.get("b", F.col("i") - 1)
    low = F.coalesce(before["le"], F.lit(0.0))
    below = F.coalesce(before["n"], F.lit(0))
    inside = F.try_divide(F.col("rank") - below, (upper["n"] - below).cast("double"))
    value = F.when(upper["le"] == float("inf"), low).otherwise(low + (upper["le"] - low) * inside)
    return placed.select(*keys, value.alias("quantile_seconds"))


def bulk_summary(results: DataFrame) -> DataFrame:
    """Screened, hits and the hit rate as text."""
    counted = results.agg(
        F.count(F.lit(1)).alias("total_screened"), F.count_if("is_hit").alias("total_hits")
    )
    percent = F.format_string("%.2f%%", F.col("total_hits") * 100.0 / F.col("total_screened"))
    return counted.withColumn("hit_rate", F.when(F.col("total_screened") > 0, percent).otherwise("0%"))


def fingerprint(query: Column) -> Column:
    """A statement's normal form: without comments, literals as ?, lists of literals as one, white space as one blank."""
    steps = [
        (r"--[^\n]*", " "), (r"(?s)/\*.*?\*/", " "), (r"'(?:[^']|'')*'", "?"), (r"\$\d+", "?"), (r"\b\d+(?:\.\d+)?\b", "?"),
        (r"\s+", " "), (r"\( ?\?(?: ?, ?\?)* ?\)", "(?)"),
    ]
    for pattern, by in steps:
        query = F.regexp_replace(query, F.lit(pattern), F.lit(by))
    return F.trim(query)


def fingerprinted(statements: DataFrame) -> DataFrame:
    """``statements`` with their normal form as ``query``, so that calls that differ in literals count together."""
    return statements.withColumn("query", fingerprint(F.col("query")))


def frequent_statements(statements: DataFrame, limit: int = 10, tracked: int = 8192) -> DataFrame:
    """(query, calls): the most frequent normal forms from a mergeable summary of at most ``tracked`` of them.

    Memory does not grow with the number of forms. Counts are exact while there are at most three quarters of ``tracked`` forms; beyond, a count may be off by
    about 3.5 / ``tracked`` of all calls. ``statement_stats`` of ``fingerprinted`` counts exactly, by a shuffle of the forms.
    """
    top = fingerprinted(statements).agg(F.expr(f"approx_top_k(query, {int(limit)}, {int(tracked)})").alias("top"))
    return top.select(F.inline("top")).toDF("query", "calls")


def statement_stats(statements: DataFrame) -> DataFrame:
    """Calls and time per statement text."""
    return statements.groupBy("query").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("exec_ms").alias("total_ms")
    )


def top_statements(statements: DataFrame, limit: int = 10) -> DataFrame:
    stats = statement_stats(statements)
    return (
        stats.select(
            "calls", F.round("total_ms", 2).alias("total_ms"),
            F.round(F.col("total_ms") / F.col("calls"), 2).alias("avg_ms"),
            F.substring("query", 1, 100).alias("query_preview"), "query",
        )
        .orderBy(F.col("calls").desc(), "query").limit(limit).drop("query")
    )


def n_plus_one(statements: DataFrame, limit: int = 10) -> DataFrame:
    """Frequent, fast SELECT statements: the sign of one query per row."""
    stats = statement_stats(statements).withColumn("avg", F.col("total_ms") / F.col("calls"))
    suspects = stats.filter((F.col("calls") > 10) & (F.col("avg") < 10) & F.col("query").contains("SELECT"))
    return (
        suspects.select("calls", F.round("avg", 2).alias("avg_ms"), F.substring("query", 1, 80).alias("query_pattern"), "query")
        .orderBy(F.col("calls").desc(), "query").limit(limit).drop("query")
    )


def discovered_codes(entities: DataFrame) -> DataFrame:
    """Distinct country codes and list types met in a list, one row each."""
    codes = entities.select(
        F.inline(
            F.array(
                F.struct(F.lit("country_code").alias("kind"), F.col("un_country_code").alias("code")),
                F.struct(F.lit("list_type").alias("kind"), F.col("un_committee").alias("code")),
            )
        )
    )
    return codes.filter(F.col("code").isNotNull()).distinct()


def error_rate_windows(
    operations: DataFrame, window: str = "5 minutes", slide: str = "1 minute", percent: float = 1.0
) -> DataFrame:
    """Share of failed operations per sliding window; works on a table and on a stream."""
    grouped = operations.groupBy(F.window("ts", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors")
    )
    rate = F.col("errors") * 100.0 / F.col("calls")
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls", "errors",
        F.round(rate, 6).alias("error_percent"), (rate > percent).alias("alert"),
    )


def p95_windows(
    operations: DataFrame, window: str = "5 minutes", slide: str | None = None, alert_ms: float = 500.0
) -> DataFrame:
    """95th percentile per window, from a bounded sketch (exact below ``ACCURACY`` calls a window)."""
    p95 = F.percentile_approx("duration_ms", 0.95, ACCURACY)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = operations.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("calls"), p95.alias("p95_ms"))
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls", "p95_ms",
        (F.col("p95_ms") > alert_ms).alias("alert"),
    )
