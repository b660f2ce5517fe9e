"""Screening: requests against the list by exact document and by fuzzy name.

Work is done on distinct screening profiles (all inputs of a request) and on distinct name keys, so
neither a repeated request nor a repeated name is compared twice. Only the best ``match_limit``
matches per request leave; list rows that can never be among them are cut on the list side first:
of entities that share a name key (or document number), year and countries, every request ranks all
in the same order, so the first ``match_limit`` of them stand for the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig
from listwarden.functions import names as N
from listwarden.functions.similarity import Ranking, differing_bits, key_ratio, with_bag_sketch
from listwarden.operators import decision as D
from listwarden.operators.candidates import StoredNames, best_name_pairs, key_bytes, stored_names
from listwarden.operators.joins import measured_bytes
from listwarden.operators.staging import materialized

INPUTS = ["name", "document_number", "document_type", "date_of_birth", "nationality", "country"]
ENTITY = ["source", "entity_id"]


def _text_or_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def profile_id() -> Column:
    """Equal for requests with equal inputs."""
    return F.md5(F.to_json(F.struct(*INPUTS)))


def profiles(requests: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Distinct inputs with everything the matching needs to know about them."""
    w = config.weights
    distinct = requests.select(*INPUTS).distinct()
    named = distinct.withColumn("normalized", N.normalize_name(F.col("name")))
    described = named.select(
        profile_id().alias("profile_id"),
        "document_type",
        N.name_key(F.col("normalized")).alias("request_key"),
        F.coalesce(N.short_name(F.col("name")), F.lit(False)).alias("is_short"),
        N.common_name(F.col("normalized"), config).alias("is_common"),
        N.adaptive_threshold(F.col("name"), config).alias("adaptive"),
        _text_or_null("document_number").isNotNull().alias("has_document"),
        F.nullif(N.normalize_document(F.col("document_number")), F.lit("")).alias("doc_key"),
        N.dob_year(F.col("date_of_birth")).alias("request_year"),
        D.wanted_countries(F.col("nationality"), F.col("country")).alias("wanted"),
    )
    threshold = F.when(F.col("is_short"), F.col("adaptive.threshold")).otherwise(
        F.lit(float(config.name_threshold))
    )
    most_dob = F.when(F.col("request_year").isNotNull(), 100.0 * w.dob).otherwise(F.lit(0.0))
    low = F.lit(float(config.layers.low))
    if w.name > 0:
        # The lowest name score that can still reach the threshold without a document match.
        needed = F.greatest(low, (F.col("threshold") - most_dob) / F.lit(float(w.name)))
    else:
        needed = F.when(most_dob >= F.col("threshold"), low).otherwise(F.lit(101.0))
    return (
        described.withColumn("threshold", threshold)
        .withColumn("reason", F.when(F.col("is_short"), F.col("adaptive.reason")).otherwise("default"))
        .withColumn("min_score", needed)
        .drop("adaptive")
    )


def _first_per_group(df: DataFrame, group: list[str], count: int) -> DataFrame:
    """The first rows of each group by entity key; pruned before the shuffle by Spark's group limit."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*ENTITY))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")


def _list_columns(entities: DataFrame) -> DataFrame:
    """The narrow part of the list that matching reads."""
    documents = F.transform(
        F.filter("identity_documents", lambda d: F.coalesce(d["number"], F.lit("")) != ""),
        lambda d: F.struct(
            F.upper(d["type"]).alias("type"),
            d["number"].alias("number"),
            N.normalize_document(d["number"]).alias("doc_key"),
        ),
    )
    slim = entities.select(
        *ENTITY,
        "entity_type",
        "primary_name",
        "all_names",
        F.coalesce(documents, F.array().cast("array<struct<type:string,number:string,doc_key:string>>")).alias("documents"),
        _text_or_null("vessel_imo").alias("vessel_imo"),
        N.dob_year(F.col("date_of_birth")).alias("entity_year"),
        D.listed_countries(F.col("countries"), F.col("nationality"), F.col("citizenship")).alias("listed"),
    )
    imo_key = N.normalize_document(F.col("vessel_imo"))
    keys = F.array_append(F.transform("documents", lambda d: d["doc_key"]), imo_key)
    return slim.withColumn("imo_key", imo_key).withColumn(
        "doc_keys", F.filter(F.array_distinct(keys), lambda k: k != "")
    )


def list_names(entities: DataFrame) -> DataFrame:
    """One row per list name: (entity columns, position, name, list_key)."""
    exploded = entities.select("*", F.posexplode("all_names").alias("position", "alias")).drop("all_names")
    return exploded.withColumnRenamed("alias", "alias_text").withColumn(
        "list_key", N.name_key(N.normalize_name(F.col("alias_text")))
    )


def _known_year(column: str) -> Column:
    """The year, 0 where it is unknown or counts for nothing."""
    return F.when(F.col(column) > 0, F.col(column)).otherwise(0).cast("int")


def _first_holders(names: DataFrame, by_year: bool) -> DataFrame:
    """(list_key, year, source, entity_id, holder): the first entity of each name, or of each name and birth year where the year has a weight."""
    year = _known_year("entity_year") if by_year else F.lit(0)
    first = names.groupBy("list_key", year.alias("year")).agg(F.min(F.struct(*ENTITY)).alias("first"))
    return first.select("list_key", "year", "first.*", F.xxhash64("first").alias("holder"))


@dataclass(frozen=True)
class PreparedList:
    """A list ready for matching, kept as tables of the shared folder, with the sizes that choose a join.

    entities: the narrow entity rows; names: one row per list name with its key; index: the names that can be
    among the best ``match_limit`` of a request; keys: the distinct keys; documents: one row per document key, of alike ones
    the first ``match_limit``; document_names: one row per document key and name, likewise.
    """

    entities: DataFrame
    names: DataFrame
    index: DataFrame
    keys: DataFrame
    letters: DataFrame
    documents: DataFrame
    document_names: DataFrame
    match_limit: int
    index_bytes: int
    key_bytes: int
    by_year: int


def prepare_list(entities: DataFrame, config: ScreeningConfig = DEFAULT, folder: str | None = None) -> PreparedList:
    """Normalize a list once; any number of screenings can then use it. With a folder, the list is stored there for ``read_prepared``."""

    def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        if folder is None:
            return materialized(df, name, by)
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=by)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    slim = table(_list_columns(entities), "entities")
    names = table(list_names(slim).drop("documents", "vessel_imo", "imo_key", "primary_name"), "names")
    index = table(_first_per_group(names, ["list_key", "entity_year", "listed"], config.match_limit), "index")
    by_year = bool(config.weights.dob)
    keys = stored_names(_first_holders(names, by_year), table)
    whole = materialized(document_index(slim), "whole")
    documents = table(first_documents(whole, config.match_limit), "documents")
    by_name = table(document_names(whole, config.match_limit), "document_names")
    sizes = measured_bytes(index), key_bytes(keys.keys)
    prepared = PreparedList(slim, names, index, keys.keys, keys.letters, documents, by_name, config.match_limit, *sizes, int(by_year))
    if folder is not None:
        _write_sizes(prepared, folder)
    return prepared


TABLES = ("entities", "names", "index", "keys", "letters", "documents", "document_names")
KEYS = "s0 long, s1 long, list_key string, year int, source string, entity_id string, holder long, len int"
SIZES = ("match_limit", "index_bytes", "key_bytes", "by_year")


def write_prepared(prepared: PreparedList, folder: str) -> None:
    """Store a prepared list under a folder of its own, for any number of sessions."""
    for name in TABLES:
        getattr(prepared, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}", partitionBy="len" if name == "keys" else None)
    _write_sizes(prepared, folder)


def _write_sizes(prepared: PreparedList, folder: str) -> None:
    spark = prepared.entities.sparkSession
    sizes = spark.createDataFrame([tuple(getattr(prepared, n) for n in SIZES)], ", ".join(f"{n} long" for n in SIZES))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/sizes")


def read_prepared(spark: SparkSession, folder: str) -> PreparedList:
    """A stored prepared list; nothing of it is computed again."""
    sizes = spark.read.parquet(f"{folder.rstrip('/')}/sizes").first()
    # keys of an empty list have no file to tell their columns
    read = lambda name: (spark.read.schema(KEYS) if name == "keys" else spark.read).parquet(f"{folder.rstrip('/')}/{name}")
    return PreparedList(*map(read, TABLES), *[sizes[n] for n in SIZES])


def document_index(slim: DataFrame) -> DataFrame:
    """One row per (entity, document key): its documents of that key and the vessel number, if equal."""
    return slim.withColumn("doc_key", F.explode("doc_keys")).select(
        *ENTITY,
        "entity_type",
        "primary_name",
        "all_names",
        "entity_year",
        "listed",
        "doc_key",
        F.filter("documents", lambda d: d["doc_key"] == F.col("doc_key")).alias("same"),
        F.when(F.col("imo_key") == F.col("doc_key"), F.col("vessel_imo")).alias("imo"),
    )


def _kinds() -> Column:
    return F.sort_array(F.array_distinct(F.transform("same", lambda d: d["type"])))


def first_documents(index: DataFrame, limit: int) -> DataFrame:
    """Of rows that every request finds or misses alike, the first ``limit``."""
    kinds = index.withColumn("kinds", _kinds()).withColumn("is_imo", F.col("imo").isNotNull())
    return _first_per_group(kinds, ["doc_key", "kinds", "is_imo"], limit).drop("kinds", "is_imo")


def document_names(index: DataFrame, limit: int) -> DataFrame:
    """Names of the entities that hold a document number, for requests with that number under another type.

    Entities alike in all that decides rank in one order for every request: the first ``limit`` of them stand for the rest.
    """
    listed = list_names(index.filter(F.size("same") > 0)).select(
        *ENTITY, "entity_type", "entity_year", "listed", F.col("doc_key").alias("list_doc_key"), "same",
        "imo", "position", "alias_text", "list_key", F.length("list_key").alias("llen"), _kinds().alias("kinds"), F.col("imo").isNotNull().alias("is_imo"),
    )
    alike = ["list_doc_key", "kinds", "is_imo", "list_key", "entity_year", "listed"]
    return with_bag_sketch(_first_per_group(listed, alike, limit).drop("kinds", "is_imo"), "list_key", "ls")


def _type_matches(document: Column) -> Column:
    wanted = F.col("document_type")
    return wanted.isNull() | (document["type"] == F.upper(wanted))


def _exact() -> Column:
    return F.exists("same", _type_matches) | F.col("imo").isNotNull()


def _exact_number() -> Column:
    return F.coalesce(F.get(F.filter("same", _type_matches), F.lit(0))["number"], F.col("imo"))


def document_matches(prof: DataFrame, index: DataFrame, limit: int | None = None) -> DataFrame:
    """Layer 1: equal normalized number and, if asked for, equal type."""
    if limit is not None:
        index = first_documents(index, limit)
    asked = prof.filter(F.col("doc_key").isNotNull()).select("profile_id", "document_type", "doc_key")
    hundred = F.lit(100.0)
    return asked.join(index, "doc_key").filter(_exact()).select(
        "profile_id",
        *ENTITY,
        "entity_type",
        F.col("primary_name").alias("matched_name"),
        _exact_number().alias("matched_document"),
        hundred.alias("overall"),
        hundred.alias("name_score"),
        hundred.alias("document_score"),
        F.lit(0.0).alias("dob_score"),
        F.lit(1).alias("match_layer"),
        F.array(F.lit("DOCUMENT_EXACT_MATCH")).alias("flags"),
        F.lit("AUTO_ESCALATE").alias("recommendation"),
    )


def _other_type_pairs(prof: DataFrame, listed: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Entities with the asked number under another type (``document_names``): they enter by name, with document score 100."""
    low = float(config.layers.low)
    asked = prof.filter(
        F.col("doc_key").isNotNull() & F.col("document_type").isNotNull() & (F.col("request_key") != "")
    ).select("profile_id", "document_type", "doc_key", "request_key", F.length("request_key").alias("rlen"))
    asked = with_bag_sketch(asked, "request_key", "rs")
    both = F.col("rlen") + F.col("llen")
    may_reach = differing_bits("rs", "ls") <= both - 2 * F.ceil(low * both / 200.0 - 1e-9)
    pairs = asked.join(listed, (asked["doc_key"] == listed["list_doc_key"]) & may_reach).filter(~_exact())
    scored = pairs.withColumn("score", key_ratio(F.col("request_key"), F.col("list_key"))).filter(
        F.col("score") >= low
    )
    return scored.groupBy("profile_id", *ENTITY).agg(
        F.max("score").alias("name_score"),
        F.max_by("alias_text", F.struct("score", -F.col("position"))).alias("matched_name"),
        F.any_value("entity_type").alias("entity_type"),
        F.any_value("entity_year").alias("entity_year"),
        F.any_value("listed").alias("listed"),
        F.any_value(F.get("same", F.lit(0))["number"]).alias("matched_document"),
    )


def _name_matches(prof: DataFrame, prepared: PreparedList, config: ScreeningConfig) -> DataFrame:
    """Name pairs that may pass and be among the best, without the entities that share the request's document number."""
    w = config.weights
    # what profiles ask of names: the key, and the birth year where it has a weight
    by_year = bool(w.dob)
    year = _known_year("request_year") if by_year else F.lit(0)
    prof = prof.withColumn("asked", F.concat_ws("\n", "request_key", year.cast("string")) if by_year else F.col("request_key"))
    asking = prof.groupBy("asked", "request_key", year.alias("year")).agg(
        F.min("min_score").cast("double").alias("min_score"), F.min("threshold").cast("double").alias("least_value")
    )
    ranking = Ranking(config.match_limit, float(w.name), float(w.dob), float(config.layers.high))
    names = StoredNames(prepared.keys, prepared.letters)
    if by_year != bool(prepared.by_year):  # prepared for other weights
        names = stored_names(_first_holders(prepared.names, by_year))
    pairs = best_name_pairs(asking, names, ranking, config.limits)
    small = prepared.index_bytes <= config.limits.broadcast_bytes
    index = prepared.index.withColumn("year", _known_year("entity_year") if by_year else F.lit(0))
    # dealt by what is asked once: grouping, ranking and the join with the profiles need no other order
    found = pairs.join(F.broadcast(index) if small else index, ["list_key", "year"]).repartition("asked")
    best = found.groupBy("asked", *ENTITY).agg(
        F.max("score").alias("name_score"),
        F.max_by("alias_text", F.struct("score", -F.col("position"))).alias("matched_name"),
        F.any_value("entity_type").alias("entity_type"),
        F.any_value("entity_year").alias("entity_year"),
        F.any_value("listed").alias("listed"),
        F.any_value("doc_keys").alias("doc_keys"),
    )
    # Entities of one birth year and countries differ for a request by name score alone, so the best of them
    # suffice, and a name that many requests share is reduced before it meets them. An entity left out below for its
    # document number comes back through the document branches, at least as high, so it keeps its place here.
    order = Window.partitionBy("asked", "entity_year", "listed").orderBy(F.col("name_score").desc(), *ENTITY)
    best = best.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= config.match_limit).drop("_rank")
    same_document = F.coalesce(F.array_contains("doc_keys", F.col("doc_key")), F.lit(False))
    return (
        best.join(prof, "asked")
        .filter((F.col("name_score") >= F.col("min_score") - 1e-9) & ~same_document)
        .drop("doc_keys", "asked")
        .withColumn("matched_document", F.lit(None).cast("string"))
        .withColumn("document_score", F.lit(0.0))
    )


def _decided(pairs: DataFrame, config: ScreeningConfig) -> DataFrame:
    name, document = F.col("name_score"), F.col("document_score")
    scored = (
        pairs.withColumn("dob_score", D.dob_score(F.col("request_year"), F.col("entity_year")))
        .withColumn("overall", D.overall_score(name, document, F.col("dob_score"), config))
        .filter((F.col("overall") >= F.col("threshold")) | (document == 100))
        .withColumn("nat_flag", D.nationality_flag(F.col("wanted"), F.col("listed")))
    )
    return scored.select(
        "profile_id",
        *ENTITY,
        "entity_type",
        "matched_name",
        "matched_document",
        "overall",
        "name_score",
        "document_score",
        "dob_score",
        D.match_layer(name, document, F.col("dob_score"), F.col("nat_flag"), config).alias("match_layer"),
        D.match_flags(
            document, F.col("has_document"), F.col("is_short"), F.col("reason"), F.col("is_common"),
            F.col("nat_flag"), F.col("entity_type"),
        ).alias("flags"),
        D.recommendation(F.col("overall"), F.col("is_common"), document, config).alias("recommendation"),
    )


def top_matches(matches: DataFrame, key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(
        F.col("overall").desc(), F.col("match_layer"), F.col("source"), F.col("entity_id")
    )
    return matches.withColumn("match_rank", F.row_number().over(order)).filter(F.col("match_rank") <= limit)


def screen_profiles(
    prof: DataFrame, prepared: PreparedList, config: ScreeningConfig = DEFAULT
) -> DataFrame:
    """Best matches per profile, all layers."""
    if config.match_limit > prepared.match_limit:
        raise ValueError(f"the list is prepared for {prepared.match_limit} matches, {config.match_limit} are asked for")
    exact = document_matches(prof, prepared.documents)
    other_type = (
        _other_type_pairs(prof, prepared.document_names, config)
        .join(prof, "profile_id")
        .withColumn("document_score", F.lit(100.0))
    )
    by_name = _name_matches(prof, prepared, config)
    decided = _decided(by_name.unionByName(other_type), config)
    return top_matches(exact.unionByName(decided), "profile_id", config.match_limit)


def screen(
    requests: DataFrame, listed: DataFrame | PreparedList, config: ScreeningConfig = DEFAULT
) -> DataFrame:
    """Best matches of every request: (request_id, match_rank, entity, scores, flags, recommendation).

    requests: request_id and the six inputs; they are taken as valid (see ``quality.validated``).
    listed: entities with the columns of ``schemas.SCREENED_ENTITY``, or an already prepared list.
    """
    prepared = listed if isinstance(listed, PreparedList) else prepare_list(listed, config)
    # two branches read the requests, which may be costly to make
    requests = materialized(requests.select("request_id", *INPUTS), "requests")
    prof = materialized(profiles(requests, config), "profiles")
    matches = screen_profiles(prof, prepared, config)
    # Equal rows under one request_id are one request; they share its matches.
    keyed = requests.select("request_id", profile_id().alias("profile_id")).distinct()
    return keyed.join(matches, "profile_id").drop("profile_id")


def rounded(matches: DataFrame) -> DataFrame:
    """Scores with two digits, for output only."""
    scores = ["overall", "name_score", "document_score", "dob_score"]
    return matches.withColumns({c: F.round(c, 2) for c in scores})


def screen_by_document(
    requests: DataFrame, entities: DataFrame, config: ScreeningConfig = DEFAULT, limit: int | None = None
) -> DataFrame:
    """Layer 1 alone: all matches, or the first ``limit`` of each request."""
    prof = profiles(requests, config)
    found = document_matches(prof, document_index(_list_columns(entities)), limit)
    if limit is not None:
        found = top_matches(found, "profile_id", limit).drop("match_rank")
    keyed = requests.select("request_id", profile_id().alias("profile_id")).distinct()
    return keyed.join(found, "profile_id").drop("profile_id")


def screening_results(requests: DataFrame, matches: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """One row per request: hit or not, how many, the best score, and the matches best first."""
    per_request = matches.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("hit_count"),
        F.max("overall").alias("max_confidence"),
        F.min_by("recommendation", "match_rank").alias("recommendation"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    "match_rank", "source", "entity_id", "entity_type", "matched_name", "matched_document",
                    "overall", "name_score", "document_score", "dob_score", "match_layer", "flags",
                    "recommendation",
                )
            )
        ).alias("matches"),
    )
    joined = requests.join(per_request, "request_id", "left")
    return joined.withColumns(
        {
            "hit_count": F.coalesce("hit_count", F.lit(0).cast("long")),
            "is_hit": F.col("hit_count").isNotNull(),
            "max_confidence": F.coalesce("max_confidence", F.lit(0.0)),
            "algorithm_version": F.lit(config.algorithm_version),
            "threshold_name": F.lit(float(config.name_threshold)),
            "threshold_short_name": F.lit(float(config.short_name_threshold)),
        }
    )
