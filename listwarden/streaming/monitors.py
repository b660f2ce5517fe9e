"""Error rate and latency over event-time windows, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listwarden.operators.stats import error_rate_windows, p95_windows


def read_operations(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def error_rate_stream(
    operations: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes", slide: str = "1 minute"
) -> DataFrame:
    """Closed windows with their error rate; rows later than ``lateness`` are dropped."""
    return error_rate_windows(operations.withWatermark("ts", lateness), window, slide)


def p95_stream(
    operations: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes", slide: str | None = None,
    alert_ms: float = 500.0,
) -> DataFrame:
    return p95_windows(operations.withWatermark("ts", lateness), window, slide, alert_ms)


def alerts(windows: DataFrame) -> DataFrame:
    return windows.filter("alert")
