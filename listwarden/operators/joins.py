"""Size checks that choose between a broadcast and a shuffled join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_OVERHEAD = 64


def measured_bytes(df: DataFrame) -> int:
    """Size of a DataFrame once deserialized, measured by one aggregation (one row comes back)."""
    as_text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    row = df.agg(F.sum(F.octet_length(as_text) + F.lit(ROW_OVERHEAD)).alias("b")).first()
    return row["b"] or 0


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint when the measured size is below ``limit``; otherwise Spark's own choice stays."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def parallelism(df: DataFrame) -> int:
    """Partitions for steps whose cost is computation, not bytes."""
    spark = df.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
