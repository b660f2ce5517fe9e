"""Alert rules that must hold for a time: evaluations, episodes, and what is firing. The same code works on a table and on a stream.

A rule is evaluated once each ``step``; its evaluations are rows with the time of the evaluation, whether the rule is breached, and its value. An
evaluation without data is no row and counts as not breached. A run of breached evaluations, each one step behind the one before, is
an episode: pending from its first evaluation, firing from ``hold`` later if it lasts so long, resolved at the first evaluation that is not
breached. Episodes are session windows over the breached evaluations with a gap a little above a step, so neither a table nor a stream
orders all evaluations of a rule in one place by hand, and a stream needs no state of its own making. On a stream an
episode comes out once it is over; ``firing`` tells of those that still hold.

Rows are evaluations, one for each rule, key and step, not events. Evaluations that are given twice count once in the result's times, twice in ``evaluations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.operators.stats import ACCURACY

STEP, HOLD = 60, 300


def _evaluated(operations: DataFrame, rule: str, value: Column, breached: Column, keys: tuple[str, ...], window: str, step: int) -> DataFrame:
    grouped = operations.groupBy(*keys, F.window("ts", window, f"{step} seconds").alias("w")).agg(value.alias("value"))
    # window_time carries the watermark on; it lies one microsecond before the window's end
    return grouped.select(F.lit(rule).alias("rule"), *keys, F.window_time("w").alias("at"), "value", breached.alias("breached"))


def error_rate_rule(operations: DataFrame, *keys: str, percent: float = 1.0, window: str = "5 minutes", step: int = STEP) -> DataFrame:
    """Evaluations of: more than ``percent`` of the calls fail."""
    rate = F.count_if("is_error") * 100.0 / F.count(F.lit(1))
    return _evaluated(operations, "error_rate", rate, F.col("value") > percent, keys, window, step)


def latency_rule(operations: DataFrame, *keys: str, quantile: float = 0.95, most_ms: float = 500.0, window: str = "5 minutes", step: int = STEP) -> DataFrame:
    """Evaluations of: a quantile of the latency exceeds ``most_ms`` (from a bounded sketch, exact below ``ACCURACY`` calls in a window)."""
    value = F.percentile_approx("duration_ms", quantile, ACCURACY)
    return _evaluated(operations, "latency", value, F.col("value") > most_ms, keys, window, step)


def episodes(evaluations: DataFrame, *keys: str, step: int = STEP, hold: int = HOLD) -> DataFrame:
    """(rule, keys, pending_at, firing_at, resolved_at, evaluations, peak): firing_at is null if the rule did not hold long enough."""
    runs = evaluations.filter("breached").groupBy("rule", *keys, F.session_window("at", f"{step + 1} seconds").alias("run")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("evaluations"), F.max("value").alias("peak")
    )
    whole = lambda c: F.col(c) + F.expr("interval 1 microsecond")
    later = lambda c, seconds: c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    long_enough = micros("last") - micros("first") >= hold * 1_000_000
    return runs.select(
        "rule", *keys, whole("first").alias("pending_at"), F.when(long_enough, later(whole("first"), hold)).alias("firing_at"),
        later(whole("last"), step).alias("resolved_at"), "evaluations", "peak",
    )


def firing(evaluations: DataFrame, *keys: str, step: int = STEP, hold: int = HOLD) -> DataFrame:
    """(rule, keys, firing_at): each evaluation at which a rule has been breached for ``hold`` without a gap."""
    length = f"{hold + step} seconds"
    held = evaluations.filter("breached").groupBy("rule", *keys, F.window("at", length, f"{step} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return held.filter(F.col("n") == hold // step + 1).select("rule", *keys, F.col("w.end").alias("firing_at"))
