"""Ordered pages, newest rows and bounded histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwarden.operators.staging import new_folder


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page. ``order`` must end in a unique key; Spark keeps only offset + limit rows per task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_with_total(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page, each row with the number of all rows. An empty page is one row of nulls with that number."""
    return total(df).join(page(df, order, offset, limit), F.lit(True), "left").select(*df.columns, "total")


def page_after(df: DataFrame, keys: list[str], after: list | None = None, limit: int = 100) -> DataFrame:
    """The page behind the last row of the one before, by ascending unique ``keys``: no task keeps the rows skipped."""
    if after is not None:
        # (a, b) > (x, y) is a > x, or a = x and b > y
        behind, equal = F.lit(False), F.lit(True)
        for key, value in zip(keys, after):
            behind = behind | (equal & (F.col(key) > F.lit(value)))
            equal = equal & (F.col(key) == F.lit(value))
        df = df.filter(behind)
    return df.orderBy(*keys).limit(limit)


class RankedPages:
    """Pages by rank, at any offset, without a task that keeps the rows before it.

    The rows are dealt once into ranges of ``order``, which Spark chooses from a sample, and written by range; the ranges' row counts
    (one number each) give their first ranks. A page reads the ranges that hold it, and sorts these alone. ``order`` must end in a unique key: then
    equal leading values, however many, still spread over ranges. Null orders as Spark does (first when ascending). A page past the end is empty.
    """

    def __init__(self, df: DataFrame, order: list[Column], ranges: int | None = None):
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        path = new_folder(df.sparkSession, "ranges")
        dealt.withColumn("_range", F.spark_partition_id()).write.option("compression", "zstd").partitionBy("_range").parquet(path)
        self._columns, self._order = df.columns, order
        self._rows = df.sparkSession.read.schema(f"{df.schema.toDDL()}, _range INT").parquet(path)
        counts = sorted((r["_range"], r["n"]) for r in self._rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
        self._ends = []
        for number, n in counts:
            self._ends.append((number, n + (self._ends[-1][1] if self._ends else 0)))
        self.total = self._ends[-1][1] if self._ends else 0

    def page(self, offset: int = 0, limit: int = 100) -> DataFrame:
        chosen, first, begin = [], 0, 0
        for number, end in self._ends:
            if begin < offset + limit and end > offset:
                first = begin if not chosen else first
                chosen.append(number)
            begin = end
        held = self._rows.filter(F.col("_range").isin(chosen) if chosen else F.lit(False)).select(*[F.col(f"`{c}`") for c in self._columns])
        return held.orderBy(*self._order).offset(max(0, offset - first)).limit(limit)


def list_by_source(
    entities: DataFrame, source: str, entity_type: str | None = None, offset: int = 0, limit: int = 100
) -> DataFrame:
    chosen = entities.filter(~F.col("is_deleted") & (F.col("source") == source))
    if entity_type is not None:
        chosen = chosen.filter(F.col("entity_type") == entity_type)
    return page_with_total(chosen, [F.col("primary_name"), F.col("entity_id")], offset, limit)


def newest(df: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)


def newest_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The last ``limit`` rows of each group; map tasks already drop the rest."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def latest_per_group(df: DataFrame, group: str, time: str) -> DataFrame:
    return df.groupBy(group).agg(F.max(time).alias("latest"), F.min(time).alias("oldest"))


def active(df: DataFrame, code: str = "code") -> DataFrame:
    return df.filter(F.col("is_active")).orderBy(code)
