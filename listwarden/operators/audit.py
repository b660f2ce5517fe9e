"""The audit trail: entries, searches and before/after records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.operators.paging import page_with_total


def audit_entries(results: DataFrame, at: Column, list_versions: DataFrame | None = None,
                  config: dict[str, str] | None = None) -> DataFrame:
    """One audit entry per screening result (``schemas.AUDIT``).

    results: request_id, the inputs, operator_id, analyst, is_hit, hit_count, max_confidence, decision.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    entries = results.select(
        F.col("request_id").cast("string").alias("screening_id"),
        at.cast("string").alias("timestamp"),
        F.struct(
            F.col("name"),
            F.col("document_number").alias("document"),
            F.col("country"),
            F.col("date_of_birth").alias("dob"),
            F.col("nationality"),
        ).alias("input"),
        F.coalesce(filled("operator_id"), filled("analyst"), F.lit("system")).alias("operator"),
        F.struct(
            F.col("is_hit"),
            F.col("hit_count").alias("match_count"),
            F.coalesce("max_confidence", F.lit(0.0)).alias("top_score"),
        ).alias("result"),
        F.col("decision"),
    )
    if list_versions is not None:
        versions = list_versions.agg(
            F.sort_array(F.collect_list(F.struct("source", "hash", "last_update", "record_count"))).alias("list_versions")
        )
        entries = entries.join(F.broadcast(versions), F.lit(True))
    if config:
        pairs = [F.lit(x) for pair in config.items() for x in pair]
        entries = entries.withColumn("config", F.create_map(*pairs))
    return entries


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def by_id(trail: DataFrame, screening_id: str) -> DataFrame:
    return trail.filter(F.col("screening_id") == screening_id).orderBy("timestamp").limit(1)


def by_range(trail: DataFrame, time: Column, start: Column, end: Column) -> DataFrame:
    return trail.filter(time.between(start, end))


def search(
    logs: DataFrame, action: str | None = None, resource_type: str | None = None, actor_id=None,
    start: Column | None = None, end: Column | None = None, offset: int = 0, limit: int = 100,
) -> DataFrame:
    """A page of log rows under any of the filters, newest first, with the number of all of them."""
    chosen = logs
    for column, value in (("action", action), ("resource_type", resource_type), ("actor_id", actor_id)):
        if value is not None:
            chosen = chosen.filter(F.col(column) == value)
    if start is not None:
        chosen = chosen.filter(F.col("timestamp") >= start)
    if end is not None:
        chosen = chosen.filter(F.col("timestamp") <= end)
    return page_with_total(chosen, [F.col("timestamp").desc(), F.col("log_id").desc()], offset, limit)


def audit_table(trail: DataFrame) -> DataFrame:
    """The flat rows of the audit page; both writers' layouts are read."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return trail.select(
        "timestamp",
        "screening_id",
        empty("input.name").alias("name"),
        empty("input.document").alias("document"),
        empty("input.country").alias("country"),
        F.coalesce("is_hit", "result.is_hit", F.lit(False)).alias("is_hit"),
        empty("decision").alias("decision"),
    )


def changed_keys(old_json: Column, new_json: Column) -> Column:
    """Map of the keys whose value differs, each with (old, new)."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = F.map_zip_with(
        as_map(old_json), as_map(new_json), lambda _, a, b: F.struct(a.alias("old"), b.alias("new"))
    )
    return F.map_filter(both, lambda _, v: ~v["old"].eqNullSafe(v["new"]))


def request_pairs(log: DataFrame) -> DataFrame:
    """Each request with its answer. log: (request_id, event, ts, status_code, path).

    One grouping instead of a self join: a request that was logged many times stays one row.
    """
    request = F.when(F.col("event") == "REQUEST", F.col("ts"))
    answer = F.when(F.col("event").isin("RESPONSE", "ERROR"), F.col("ts"))
    paired = log.groupBy("request_id").agg(
        F.min(request).alias("requested_at"),
        F.max(answer).alias("answered_at"),
        F.max_by("event", answer).alias("outcome"),
        F.max_by("status_code", answer).alias("status_code"),
    )
    return paired.filter(F.col("requested_at").isNotNull())
