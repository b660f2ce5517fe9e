"""Fuzzy name join without loss.

The similarity threshold becomes three tests:

* the lengths of both names (a score of t needs ``200 * min(la, lb) / (la + lb) >= t``);
* the number of differing bits of two letter-bag sketches, a bound that loses no pair;
* the exact score, for what is left.

Both sides are distinct keys, so a name held by a third of all rows is compared once. The list's keys are
written to the shared folder once, in files by length. Requests are dealt to tasks by length; a task reads the
files of the lengths it needs, batch by batch, so no row of either side is copied or shuffled for the
comparison. All tests run over Arrow columns (``names_within``): no pair is a row before it is known to be a
match, and where only the best entities are asked for, a pair that others outrank never is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwarden.config import DEFAULT, JoinLimits
from listwarden.functions.similarity import OWN_BITS, Ranking, count_kinds, names_within, sketched
from listwarden.operators.joins import ROW_OVERHEAD, parallelism
from listwarden.operators.staging import materialized

_PAIRS_A_TASK, _MOST_REQUESTS = 50_000_000, 4096


def key_bytes(names: DataFrame) -> int:
    """Size of distinct list keys once they are read, by one aggregation."""
    row = names.agg(F.sum(F.octet_length("list_key") + F.lit(ROW_OVERHEAD)).alias("b")).first()
    return row["b"] or 0


def in_grid(probe: DataFrame, build: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (len, list_block, request_block); each pair of rows of one length meets in one cell."""

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("len").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    # one row for each length of a name
    sizes = F.broadcast(blocks(probe, "request_blocks").join(blocks(build, "list_blocks"), "len"))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def own(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    asked = probe.join(sizes, "len").withColumn("request_block", own("request_key", "request_blocks")).withColumn("list_block", every("list_blocks"))
    listed = build.join(sizes, "len").withColumn("list_block", own("list_key", "list_blocks")).withColumn("request_block", every("request_blocks"))
    return asked.drop("request_blocks", "list_blocks"), listed.drop("request_blocks", "list_blocks")


@dataclass(frozen=True)
class StoredNames:
    """List keys in files by length, with their sketches; letters: the (letter, occurrence) pairs that have bits of their own, by rank."""

    keys: DataFrame
    letters: DataFrame


def stored_names(names: DataFrame, store: Callable[..., DataFrame] = materialized) -> StoredNames:
    """``names``: (list_key, ...), one row per key, or per key and what ranks differently. ``store(df, name, by)`` writes a table and reads it back."""
    names = materialized(names.filter(F.col("list_key") != ""), "plain_keys")
    kinds = names.select("list_key").mapInArrow(count_kinds, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    first = kinds.orderBy(F.desc("n"), "kind").limit(OWN_BITS)
    # at most OWN_BITS rows
    letters = store(first.select("kind", F.row_number().over(Window.orderBy(F.desc("n"), "kind")).alias("rank")), "letters")
    common = _common(letters)
    schema = T.StructType([T.StructField("s0", T.LongType()), T.StructField("s1", T.LongType()), *names.schema.fields])
    drawn = names.mapInArrow(sketched(common), schema).withColumn("len", F.length("list_key"))
    # a length goes to a few files, so that a task can read one length and no more
    return StoredNames(store(drawn.repartition("len", F.pmod(F.xxhash64("list_key"), F.lit(4))), "keys", "len"), letters)


def _common(letters: DataFrame) -> list[int]:
    return [r["kind"] for r in letters.orderBy("rank").collect()]


def by_length(asked: DataFrame, listed: int, first: list[str], key: str) -> DataFrame:
    """Rows of like ``len`` in one partition; as many partitions as their comparison with ``listed`` rows asks for."""
    asked = materialized(asked, "asked")
    count = asked.count()
    work = -(-count * listed // _PAIRS_A_TASK)
    most = max(parallelism(asked), 8 * asked.sparkSession.sparkContext.defaultParallelism, -(-count // _MOST_REQUESTS))
    return asked.repartitionByRange(max(1, min(work, most)), *first, "len", F.xxhash64(key))


def files_by_length(stored: DataFrame) -> list[tuple[int, str]]:
    """The files of a table stored by ``len``."""
    return [(int(re.search(r"/len=(\d+)/", f)[1]), f) for f in stored.inputFiles()]


def _within(requests: DataFrame, names: StoredNames, limits: JoinLimits, ranking: Ranking | None, schema: str) -> DataFrame:
    asked = by_length(requests.withColumn("len", F.length("request_key")), names.keys.count(), ["year"] if ranking and ranking.dob else [], "asked")
    return asked.mapInArrow(names_within(files_by_length(names.keys), _common(names.letters), limits.block_rows, ranking), schema)


def name_pairs(
    requests: DataFrame, names: DataFrame | StoredNames, limits: JoinLimits = DEFAULT.limits
) -> DataFrame:
    """All pairs of keys whose score reaches the request's own minimum.

    requests: (request_key, min_score), one row per key. names: (list_key), one row per key.
    Returns (request_key, list_key, score).
    """
    requests = requests.filter((F.col("request_key") != "") & (F.col("min_score") <= 100))
    requests = requests.select(F.col("request_key").alias("asked"), "request_key", F.col("min_score").cast("double"))
    names = names if isinstance(names, StoredNames) else stored_names(names.select("list_key"))
    return _within(requests, names, limits, None, "asked string, list_key string, score double").withColumnRenamed("asked", "request_key")


def best_name_pairs(requests: DataFrame, names: StoredNames, ranking: Ranking, limits: JoinLimits = DEFAULT.limits) -> DataFrame:
    """Of all pairs that reach the request's minimum those that can be among its best ``ranking.limit`` entities.

    requests: (asked, request_key, year, min_score, least_value), one row per ``asked``; a pair counts if its weighted value reaches the least value.
    names: (list_key, year, source, entity_id, holder), the first entity of each key and year. Years are 0 where unknown or without weight.
    Returns (asked, list_key, year, score). A pair left out ranks behind ``limit`` other entities for every request ``asked`` stands for.
    """
    requests = requests.filter((F.col("request_key") != "") & (F.col("min_score") <= 100))
    return _within(requests, names, limits, ranking, "asked string, list_key string, year int, score double")


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per key with its lowest threshold."""
    return requests.groupBy("request_key").agg(F.min("min_score").alias("min_score"))


def best_alias(pairs: DataFrame, list_names: DataFrame) -> DataFrame:
    """Per (request_key, entity): the best score and the first list name that has it.

    list_names: (source, entity_id, position, name, list_key).
    """
    # dealt by request once, so that rows are sorted once: few rows of a request share an entity, and a partial grouping would not shrink them
    joined = pairs.join(list_names.select("list_key", "source", "entity_id", "position", "name"), "list_key").repartition("request_key")
    return joined.groupBy("request_key", "source", "entity_id").agg(
        F.max("score").alias("name_score"),
        F.max_by("name", F.struct("score", -F.col("position"))).alias("matched_name"),
    )
