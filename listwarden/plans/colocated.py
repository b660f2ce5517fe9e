"""Parent and child tables stored by one key, so that nesting children under parents moves no rows.

All tables of a store are bucketed by the same key into the same number of buckets, each bucket sorted by it. Grouping a child by a key
that begins with the store's key, and joining on the store's key, then need no exchange. One key's rows lie in one bucket: parents
with children without bound belong into ``tables.nested``, which shuffles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.operators.tables import collected


BUCKET_ROWS = 200_000


class Store:
    """Bucketed tables in the session's warehouse, which all executors must share.

    ``buckets`` is the least number of buckets. The first table put, the parents, sets it: one more for each ``BUCKET_ROWS`` rows
    beyond, so that a task's share does not grow with the tables.
    """

    def __init__(self, spark: SparkSession, key: list[str], buckets: int):
        self.spark, self.key, self.buckets, self._prefix, self._tables = spark, key, buckets, f"stored_{uuid.uuid4().hex}", {}

    def put(self, name: str, rows: DataFrame) -> None:
        """Write a table; it must have the store's key."""
        table = f"{self._prefix}_{name}"
        if not self._tables:
            self.buckets = max(self.buckets, -(-rows.count() // BUCKET_ROWS))
        # dealt as the buckets are, so that a bucket is one file
        dealt = rows.repartition(self.buckets, *self.key)
        dealt.write.bucketBy(self.buckets, *self.key).sortBy(*self.key).format("parquet").saveAsTable(table)
        self._tables[name] = table

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self._tables[name])

    def drop(self) -> None:
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()

    def nested(self, parent: str, children: list[str]) -> DataFrame:
        """As ``tables.nested`` over tables of the store."""
        result = self.get(parent)
        for name in children:
            result = result.join(collected(self.get(name), self.key, name).hint("merge"), self.key, "left")
        return result

    def tree(self, parent: str, child: str, grandchild: str, child_key: str) -> DataFrame:
        """Parents with their children, and those with their own children, which name them by ``child_key``; all bucketed by the parent's key."""
        lower = self.get(grandchild)
        below = lower.groupBy(*self.key, child_key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in lower.columns if c not in (*self.key, child_key)]))).alias(grandchild))
        by_parent = below.groupBy(*self.key).agg(F.map_from_entries(F.collect_list(F.struct(child_key, grandchild))).alias("_below"))
        upper = self.get(child)
        rest = [c for c in upper.columns if c not in self.key]
        middle = upper.groupBy(*self.key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(child))
        joined = self.get(parent).join(middle.hint("merge"), self.key, "left").join(by_parent.hint("merge"), self.key, "left")
        told = F.transform(child, lambda c: F.struct(*[c[n].alias(n) for n in rest], F.try_element_at("_below", c[child_key]).alias(grandchild)))
        return joined.withColumn(child, told).drop("_below")
