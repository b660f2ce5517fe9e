"""Relational operators over the screening tables: nesting, lookups and table versions.

A change never edits rows: it takes the old version of a table and gives the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwarden.config import DEFAULT
from listwarden.functions.names import normalize_document, normalize_name
from listwarden.functions.similarity import texts_within, trigram_set_similarity, trigrams
from listwarden.operators.candidates import by_length, files_by_length
from listwarden.operators.joins import parallelism
from listwarden.operators.staging import materialized

ENTITY = ["source", "entity_id"]


def live(entities: DataFrame) -> DataFrame:
    return entities.filter(~F.col("is_deleted"))


def collected(child: DataFrame, key: list[str], name: str) -> DataFrame:
    """One sorted array of structs per key, from all other columns of a child table."""
    rest = [c for c in child.columns if c not in key]
    return child.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def nested(parent: DataFrame, key: list[str], children: dict[str, DataFrame]) -> DataFrame:
    """Parent rows with each child table as an array. Children are grouped before they are joined,
    so several of them do not multiply each other."""
    result = parent
    for name, child in children.items():
        result = result.join(collected(child, key, name), key, "left")
    return result


def request_tree(requests: DataFrame, results: DataFrame, matches: DataFrame) -> DataFrame:
    """Requests with their results, and those with their matches."""
    with_matches = nested(results, ["request_id", "result_no"], {"matches": matches})
    return nested(requests, ["request_id"], {"results": with_matches})


def entities_by_document(
    entities: DataFrame, documents: DataFrame, searches: DataFrame, limit: int | None = None
) -> DataFrame:
    """Live entities that hold a searched number; a given type must be equal, letter by letter.

    searches: (search_id, document_number, document_type). One row per (search, entity); with a limit, the first
    entities of each search, of which only so many per number and type take part in the join.
    """
    if limit is not None:
        held = documents.join(live(entities).select(*ENTITY), ENTITY, "left_semi").select(*ENTITY, "normalized_number", "document_type").distinct()
        first = Window.partitionBy("normalized_number", "document_type").orderBy(*ENTITY)
        documents = held.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).drop("n")
    wanted = searches.select(
        "search_id",
        F.col("document_type").alias("wanted_type"),
        normalize_document(F.col("document_number")).alias("normalized_number"),
    ).filter(F.col("normalized_number") != "")
    holders = documents.join(wanted, "normalized_number").filter(
        F.col("wanted_type").isNull() | (F.col("document_type") == F.col("wanted_type"))
    )
    pairs = holders.select("search_id", *ENTITY).distinct()
    if limit is not None:
        first = Window.partitionBy("search_id").orderBy(*ENTITY)
        pairs = pairs.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).drop("n")
    return pairs.join(live(entities), ENTITY)


def search_by_name(
    entities: DataFrame, name: str, threshold: float = 0.3, limit: int = 100
) -> DataFrame:
    """Live entities by trigram similarity to one name, best first."""
    wanted = trigrams(normalize_name(F.lit(name)))
    score = trigram_set_similarity(trigrams(F.col("normalized_name")), wanted)
    scored = live(entities).withColumn("similarity", score).filter(F.col("similarity") > threshold)
    return scored.orderBy(F.col("similarity").desc(), *ENTITY).limit(limit)


def similar_name_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.3, best: int | None = None) -> DataFrame:
    """All pairs of distinct texts whose trigram similarity exceeds a threshold, without loss.

    left: (left_text), right: (right_text). The right texts are written once, in files by their number of trigrams; tasks of left texts
    read them batch by batch and count shared trigrams over Arrow columns (``texts_within``), so that no row is copied and no pair is a row
    before it is a match. With ``best``, only pairs down to the similarity of a left text's ``best``-th one, ties included.
    """

    def side(texts: DataFrame, text: str) -> DataFrame:
        # every trigram has three letters, so one string holds them all
        grams = F.array_join(trigrams(F.col(text)), "")
        whole = texts.select(text).distinct().select(F.col(text).alias("text"), grams.alias("grams")).filter(F.col("grams") != "")
        return whole.withColumn("len", (F.length("grams") / 3).cast("int"))

    listed = materialized(side(right, "right_text").repartition("len", F.pmod(F.xxhash64("text"), F.lit(4))), "texts", "len")
    asked = by_length(side(left, "left_text"), listed.count(), [], "text")
    return asked.mapInArrow(texts_within(files_by_length(listed), DEFAULT.limits.block_rows, threshold, best), "left_text string, right_text string, similarity double")


def search_by_names(
    entities: DataFrame, searches: DataFrame, threshold: float = 0.3, limit: int = 100
) -> DataFrame:
    """``search_by_name`` for a table of (search_id, name): the best ``limit`` entities of each."""
    named = searches.withColumn("left_text", normalize_name(F.col("name")))
    listed = live(entities).select(*ENTITY, "primary_name", F.col("normalized_name").alias("right_text"))
    pairs = similar_name_pairs(named.select("left_text"), listed.select("right_text"), threshold, limit)
    # Entities that share a name rank alike: the first ``limit`` of them stand for the rest.
    same_name = Window.partitionBy("right_text").orderBy(*ENTITY)
    few = listed.withColumn("n", F.row_number().over(same_name)).filter(F.col("n") <= limit).drop("n")
    by_text = Window.partitionBy("left_text").orderBy(F.col("similarity").desc(), *ENTITY)
    best = (
        pairs.join(few, "right_text")
        .withColumn("rank", F.row_number().over(by_text))
        .filter(F.col("rank") <= limit)
    )
    return named.select("search_id", "left_text").join(best, "left_text").drop("left_text", "right_text")


def by_ids(df: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``df`` whose key is among ``ids``; repeated ids don't repeat rows."""
    return df.join(ids.select(*key), key, "left_semi")


def _held(valued: DataFrame) -> DataFrame:
    """(source, entity_id, held): what each entity holds, a sorted array of (token, value)."""
    return valued.groupBy(*ENTITY).agg(F.sort_array(F.collect_list(F.struct("token", "value"))).alias("held"))


def _shared() -> Column:
    """The part of ``held`` that the search ``tokens`` ask for."""
    return F.filter("held", lambda h: F.array_contains("tokens", h["token"]))


def _rank(values: Column) -> Column:
    """The sum of the values, in one order, so that equal values give equal sums."""
    return F.aggregate(F.sort_array(values), F.lit(0.0), lambda total, v: total + v)


def _bits(tokens: Column) -> Column:
    """One of 64 bits for each token."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(t).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(bit(t)))


def _in_cells(searched: DataFrame, listed: DataFrame, rows: int) -> DataFrame:
    """Join on token of two tables. A token with many rows is cut into cells of at most about ``rows`` by ``rows``, spread over all tasks."""
    sides = (("mine", searched), ("theirs", listed))
    counts = [side.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name)).filter(F.col(name) > 1) for name, side in sides]
    # only tokens of several cells, at most one for each ``rows`` rows
    sizes = F.broadcast(materialized(counts[0].join(counts[1], "token", "full"), "cells"))

    def laid(side: DataFrame, own: str, other: str) -> DataFrame:
        n = [F.coalesce(c, F.lit(1)) for c in (own, other)]
        dealt = side.join(sizes, "token", "left").withColumn(f"{own}_block", F.pmod(F.xxhash64(*side.columns), n[0]).cast("int"))
        return dealt.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), n[1] - 1))).drop(own, other)

    cell = ["token", "mine_block", "theirs_block"]
    tasks = max(parallelism(searched), 8 * searched.sparkSession.sparkContext.defaultParallelism)
    return laid(searched, "mine", "theirs").repartition(tasks, *cell).join(laid(listed, "theirs", "mine").repartition(tasks, *cell), cell)


def met_entities(searches: DataFrame, held: DataFrame, first: DataFrame, limit: int) -> DataFrame:
    """(q, source, entity_id, rank, matched_tokens) of all entities that can be among the best ``limit`` of a search, each once.

    searches: (q, tokens), tokens sorted. held: (source, entity_id, held) of all entities that can be among the best. first:
    (token, source, entity_id), of each token at least the best ``limit`` of its holders by value, ties by entity.
    An entity that holds one of the searched tokens is among the best only if it is among the first of that token; those that hold
    several meet the search by a pair of tokens. Of entities that hold the same, the first ``limit`` stand for the rest.
    """
    alike = Window.partitionBy("held").orderBy(*ENTITY)
    kept = materialized(held.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= limit).drop("_n"), "held")
    asked = searches.select("q", "tokens", F.explode("tokens").alias("token"))
    alone = asked.join(first.join(kept, ENTITY), "token").withColumn("shared", _shared()).filter(F.size("shared") == 1)

    def pairs(tokens: Column) -> Column:
        """Every two of the tokens, the lesser one first."""
        return F.explode(F.flatten(F.transform(tokens, lambda a, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))

    several = searches.select("q", "tokens", pairs(F.col("tokens")).alias("pair"))
    holders = kept.filter(F.size("held") > 1).select(*ENTITY, "held", pairs(F.transform("held", lambda h: h["token"])).alias("pair"))
    together = several.join(holders, "pair").withColumn("shared", _shared())
    # an entity and a search that share three tokens meet by three pairs; the first one counts
    together = together.filter((F.get("shared", F.lit(0))["token"] == F.col("pair.a")) & (F.get("shared", F.lit(1))["token"] == F.col("pair.b")))
    met = alone.select("q", *ENTITY, "shared").unionByName(together.select("q", *ENTITY, "shared"))
    return met.select("q", *ENTITY, _rank(F.transform("shared", lambda h: h["value"])).alias("rank"), F.size("shared").cast("long").alias("matched_tokens"))


def best_of_held(searches: DataFrame, held: DataFrame, first: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` entities of each search by summed weight, out of ``met_entities``."""
    ranked = met_entities(searches, held, first, limit)
    best = Window.partitionBy("q").orderBy(F.round("rank", 9).desc(), *ENTITY)
    return ranked.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= limit).drop("_n")


def token_search(
    tokens: DataFrame, searches: DataFrame, weights: dict[str, float], limit: int | None = None, cell_rows: int = 1000
) -> DataFrame:
    """Rank of entities per search: the summed weight of the searched tokens they hold.

    tokens: (source, entity_id, token, weight); searches: (search_id, token). Without a limit, every search meets every entity that
    holds one of its tokens, so the result grows with both; the rank is found where they meet. With a limit, the best entities of each
    search; searches for the same tokens are answered once and only entities that can be among the best meet them (``best_of_held``).
    """
    value = F.lit(0.0)
    for letter, number in weights.items():
        value = F.when(F.col("weight") == letter, number).otherwise(value)
    # One row per entity and token first: a token counts with its best weight.
    asked = searches.groupBy("search_id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    asked = materialized(asked, "asked")
    wanted = asked.select(F.explode("tokens").alias("token")).distinct()
    valued = tokens.groupBy(*ENTITY, "token").agg(F.max(value).alias("value")).join(wanted, "token", "left_semi")
    valued = materialized(valued, "valued")
    if limit is not None:
        order = Window.partitionBy("token").orderBy(F.desc("value"), *ENTITY)
        first = valued.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select("token", *ENTITY)
        distinct = asked.select("tokens").distinct().select(F.col("tokens").alias("q"), "tokens")
        return asked.join(best_of_held(distinct, _held(valued), first, limit).withColumnRenamed("q", "tokens"), "tokens").drop("tokens")
    listed = _held(valued).withColumn("list_bits", _bits(F.transform("held", lambda h: h["token"]))).withColumn("h", F.explode("held"))
    listed = materialized(listed.select(F.col("h.token").alias("token"), *ENTITY, "held", "list_bits", F.col("h.value").alias("value")), "listed")
    bits = _bits(F.col("tokens"))
    # without bits of their own the tokens of a search are compared
    asked = asked.withColumn("bits", F.when(F.bit_count(bits) == F.size("tokens"), bits)).withColumn("token", F.explode("tokens"))
    found = _in_cells(asked, listed, cell_rows)
    # An entity and a search that share several tokens meet at each of them; the first one counts.
    one = F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("list_bits"))) == 1, F.lit(False))
    found = found.withColumn("shared", F.when(~one, _shared())).filter(one | (F.get("shared", F.lit(0))["token"] == F.col("token")))
    rank = F.when(one, F.col("value")).otherwise(_rank(F.transform("shared", lambda h: h["value"])))
    matched = F.when(one, F.lit(1).cast("long")).otherwise(F.size("shared").cast("long"))
    return found.select("search_id", *ENTITY, rank.alias("rank"), matched.alias("matched_tokens"))


def program_members(programs: DataFrame, memberships: DataFrame, entities: DataFrame) -> DataFrame:
    """Members per active program through the junction table (unique pairs of program and entity)."""
    active = memberships.filter(F.col("is_active")).select("program_code", "entity_id").distinct()
    counted = active.join(entities.select("entity_id"), "entity_id", "left_semi").groupBy("program_code").agg(
        F.count(F.lit(1)).alias("members")
    )
    return programs.filter(F.col("is_active")).join(counted, "program_code", "left").withColumn(
        "members", F.coalesce("members", F.lit(0).cast("long"))
    )


def related_entities(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationship edges with the name of the other end; dangling ids stay, without a name."""
    other = entities.select(
        F.col("entity_id").alias("related_entity_id"), F.col("primary_name").alias("related_name")
    )
    return relationships.join(other, "related_entity_id", "left")


def insert_absent(
    existing: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Old rows and the new rows whose key is not there yet; columns only one side has are null.

    Of new rows with one key the first by ``order`` is taken, by default the one with the smallest values.
    """
    columns = [F.col(c) for c in new.columns if c not in key]
    rank = F.struct(*(order or columns)) if order or columns else F.lit(0)
    first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), rank).alias("first")).select("first.*")
    return existing.unionByName(first.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def insert_or_reject(
    existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of new rows under a unique key: the first of a key that is not there yet."""
    first = Window.partitionBy(*key).orderBy(*order)
    taken = existing.select(*key).distinct().withColumn("taken", F.lit(True))
    marked = (
        new.join(taken, key, "left")
        .withColumn("n", F.row_number().over(first))
        .withColumn("ok", F.col("taken").isNull() & (F.col("n") == 1))
    )
    return (
        marked.filter("ok").drop("taken", "n", "ok"),
        marked.filter("NOT ok").drop("taken", "n", "ok"),
    )


def apply_updates(
    entities: DataFrame, updates: DataFrame, key: list[str], fields: list[str], at: Column,
    order: list[str], cleared: str | None = None,
) -> DataFrame:
    """New version after all updates of a key, applied by ``order``; a renamed entity gets its normalized name.

    An update sets the fields it has a value for, and sets to null those named in its array ``cleared``. Only
    live rows change; each update raises ``version`` by one, and ``updated_at`` becomes ``at``.
    """
    rank = F.struct(*order)

    def is_set(field: str) -> Column:
        named = F.coalesce(F.array_contains(cleared, field), F.lit(False)) if cleared else F.lit(False)
        return F.col(field).isNotNull() | named

    # The last update that sets a field decides it; no update that sets it leaves null here.
    last = [F.max_by(F.struct(F.col(f).alias("v")), F.when(is_set(f), rank)).alias(f"new_{f}") for f in fields]
    per_key = updates.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n_updates"), *last)
    joined = entities.join(per_key, key, "left")
    changed = F.col("n_updates").isNotNull() & ~F.col("is_deleted")
    for f in fields:
        given = changed & F.col(f"new_{f}").isNotNull()
        joined = joined.withColumn(f, F.when(given, F.col(f"new_{f}.v")).otherwise(F.col(f)))
    if "primary_name" in fields:
        rename = changed & F.col("new_primary_name").isNotNull()
        joined = joined.withColumn(
            "normalized_name",
            F.when(rename, normalize_name(F.col("primary_name"))).otherwise(F.col("normalized_name")),
        )
    return joined.withColumns(
        {
            "version": F.col("version") + F.when(changed, F.col("n_updates")).otherwise(0),
            "updated_at": F.when(changed, at).otherwise(F.col("updated_at")),
        }
    ).drop("n_updates", *[f"new_{f}" for f in fields])


def soft_delete(entities: DataFrame, keys: DataFrame, key: list[str], at: Column) -> DataFrame:
    marked = entities.join(keys.select(*key).distinct().withColumn("gone", F.lit(True)), key, "left")
    now = F.coalesce("gone", F.lit(False)) & ~F.col("is_deleted")
    return marked.withColumns(
        {"deleted_at": F.when(now, at).otherwise(F.col("deleted_at")), "is_deleted": F.col("is_deleted") | now}
    ).drop("gone")


def finish_requests(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Requests completed or failed by their last outcome; a request without one stays as it is.

    outcomes: (request_id, processing_end, error_code, error_message), and algorithm_version and
    thresholds_used where known; no error means completed. Completion sets the time in milliseconds and
    the algorithm's version and thresholds, failure sets the error; columns that ``requests`` lacks are null before.
    """
    known = ["algorithm_version", "thresholds_used"]
    outcomes = outcomes.withColumns({c: F.lit(None).cast("string") for c in known if c not in outcomes.columns})
    parts = ["processing_end", "error_code", "error_message", *known]
    last = outcomes.groupBy("request_id").agg(F.max(F.struct(*parts)).alias("o"))
    joined = requests.join(last, "request_id", "left")
    failed = F.col("o.error_code").isNotNull()
    completed = F.col("o").isNotNull() & ~failed
    elapsed = F.timestamp_diff("MILLISECOND", F.col("processing_start"), F.col("o.processing_end"))

    def old(column: str, kind: str) -> Column:
        return F.col(column) if column in requests.columns else F.lit(None).cast(kind)

    return joined.withColumns(
        {
            "status": F.when(failed, "failed").when(completed, "completed").otherwise(F.col("status")),
            "processing_end": F.coalesce("o.processing_end", old("processing_end", "timestamp")),
            "processing_time_ms": F.when(completed, elapsed).otherwise(old("processing_time_ms", "bigint")),
            "error_code": F.when(failed, F.col("o.error_code")).otherwise(old("error_code", "string")),
            "error_message": F.when(failed, F.col("o.error_message")).otherwise(old("error_message", "string")),
            **{c: F.when(completed, F.col(f"o.{c}")).otherwise(old(c, "string")) for c in known},
        }
    ).drop("o")


def source_status(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """Sources with time, status and entity count of their latest finished update."""
    finished = updates.filter(F.col("completed_at").isNotNull())
    latest = finished.groupBy("source_code").agg(
        F.max_by(F.struct("completed_at", "status", "total_entities"), F.struct("completed_at", "update_id")).alias("u")
    )
    return sources.join(latest, F.col("code") == F.col("source_code"), "left").select(
        *sources.columns,
        F.col("u.completed_at").alias("last_update"),
        F.col("u.status").alias("last_update_status"),
        F.col("u.total_entities").alias("last_entity_count"),
    )


def list_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Keys that were added, removed or updated between two versions of a list."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.sha2(F.to_json(F.struct(*fields)), 256).alias(name))

    joined = digest(old, "old_hash").join(digest(new, "new_hash"), key, "full_outer")
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "updated")
    )
    return joined.select(*key, change.alias("change")).filter(F.col("change").isNotNull())


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("source").agg(
        *[F.count_if(F.col("change") == c).alias(f"entities_{c}") for c in ("added", "updated", "removed")]
    )


def cascade_delete(child: DataFrame, deleted: DataFrame, key: list[str]) -> DataFrame:
    """Children whose parent stays."""
    return child.join(deleted.select(*key), key, "left_anti")


def set_null_on_delete(child: DataFrame, deleted: DataFrame, column: str, parent_key: str) -> DataFrame:
    """Children with a null key where their parent is deleted. Null keys stay out of the join, where they would meet in one task."""
    gone = deleted.select(F.col(parent_key).alias(column)).distinct().withColumn("gone", F.lit(True))
    joined = child.filter(F.col(column).isNotNull()).join(gone, column, "left")
    linked = joined.withColumn(column, F.when(F.col("gone").isNull(), F.col(column))).select(*child.columns)
    return linked.unionByName(child.filter(F.col(column).isNull()))


def first_per_request(requests: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first request of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return requests.withColumn("n", F.row_number().over(w)).filter(F.col("n") == 1).drop("n")
