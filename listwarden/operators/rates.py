"""Rates of monotonic counters, and quantiles of their rates.

A counter is sampled now and then; a series is what all labels but the value name. The increase of a sample is its difference to the
sample before in its series; a smaller value than before means that the counter began anew at zero, and the value itself is the
increase. A series' first sample has no increase. The rate in a window is the sum of the increases of the samples in it, by the window's seconds; nothing is
extrapolated to the window's edges, which would change all buckets of a histogram alike and no quantile.

Samples of a series are ordered within a partition of that series: as many rows as it was sampled, not as events happened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwarden.operators.stats import BUCKETS, histogram_quantile


def scraped(operations: DataFrame, life: str = "day", every: str = "1 minute") -> DataFrame:
    """(operation, le, ts, value): cumulative latency buckets as a process would show them that is started anew each ``life``.

    One sample for each operation and ``every`` in which it was called.
    """
    seconds = F.col("duration_ms") / 1000
    minute = F.window("ts", every)["end"].alias("ts")
    counts = operations.groupBy("operation", minute).agg(*[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count(F.lit(1)).alias("b_all"))
    so_far = Window.partitionBy("operation", F.date_trunc(life, F.col("ts"))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"b{i}" for i in range(len(BUCKETS))] + ["b_all"]
    grown = counts.withColumns({c: F.sum(c).over(so_far) for c in names})
    rows = [F.struct(F.lit(le).alias("le"), F.col(c).alias("value")) for le, c in zip([*map(str, BUCKETS), "+Inf"], names)]
    return grown.select("operation", F.inline(F.array(*rows)), "ts").select("operation", "le", "ts", "value")


def increases(samples: DataFrame, *series: str) -> DataFrame:
    """``samples`` (series, ts, value) with ``increase``, null for the first of a series."""
    before = F.lag("value").over(Window.partitionBy(*series).orderBy("ts"))
    grown = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return samples.withColumn("increase", grown)


def rates(samples: DataFrame, *series: str, window: str = "5 minutes") -> DataFrame:
    """(series, window_start, window_end, increase, per_second) for windows that hold an increase. A sample at a window's end belongs to it."""
    known = increases(samples, *series).filter(F.col("increase").isNotNull())
    shifted = F.col("ts") - F.expr("interval 1 microsecond")
    summed = known.withColumn("_ts", shifted).groupBy(*series, F.window("_ts", window).alias("w")).agg(F.sum("increase").alias("increase"))
    seconds = F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))
    return summed.select(*series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "increase", (F.col("increase") / seconds).alias("per_second"))


def rate_quantile(samples: DataFrame, quantile: float, *keys: str, window: str = "5 minutes") -> DataFrame:
    """(keys, window_start, window_end, quantile_seconds) from cumulative buckets (keys, le, ts, value); null in a window without increase."""
    grown = rates(samples, *keys, "le", window=window)
    return histogram_quantile(grown.withColumnRenamed("increase", "observations"), quantile, *keys, "window_start", "window_end")
