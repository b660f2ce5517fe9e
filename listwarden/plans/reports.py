"""Report documents, the results export and the bulk summary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig
from listwarden.functions.names import report_name


def configuration(config: ScreeningConfig = DEFAULT) -> Column:
    w, r = config.weights, config.recommendations
    number = lambda v: F.lit(float(v))
    return F.struct(
        F.lit(config.algorithm_version).alias("algorithm_version"),
        F.lit(config.algorithm_name).alias("algorithm_name"),
        number(config.name_threshold).alias("name_threshold"),
        number(config.short_name_threshold).alias("short_name_threshold"),
        F.struct(
            number(w.name).alias("name"), number(w.document).alias("document"), number(w.dob).alias("dob"),
            number(w.nationality).alias("nationality"), number(w.address).alias("address"),
        ).alias("weights"),
        F.struct(
            number(r.clear).alias("auto_clear"), number(r.review).alias("manual_review"),
            number(r.escalate).alias("auto_escalate"),
        ).alias("recommendation_thresholds"),
    )


DETAILS = ["last_name", "first_name", "nationality", "title", "citizenship", "date_of_birth", "place_of_birth", "gender"]


def detailed_matches(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """The kept matches with the entity fields a report shows.

    Only the few kept matches per request take part, so the wide entity rows are read late.
    """
    wanted = ["program", "countries", "all_names", "identity_documents", "addresses", *DETAILS]
    have = [c for c in wanted if c in entities.columns]
    return matches.join(entities.select("source", "entity_id", *have), ["source", "entity_id"], "left")


def json_reports(
    results: DataFrame, matches: DataFrame, at: Column, list_metadata: DataFrame | None = None,
    config: ScreeningConfig = DEFAULT,
) -> DataFrame:
    """(request_id, file_name, report): one JSON document per request.

    results: request_id, the inputs, is_hit, hit_count. matches: rows of ``detailed_matches``.
    """
    have = set(matches.columns)
    shown = [c for c in ("program", "countries", "all_names") if c in have]
    match = F.struct(
        F.col("match_rank"),
        F.col("matched_name"),
        F.round("overall", 2).alias("match_score"),
        F.col("entity_id"),
        F.col("source"),
        F.col("entity_type"),
        *[F.col(c) for c in shown],
        F.struct(
            F.round("overall", 2).alias("overall"), F.round("name_score", 2).alias("name"),
            F.round("document_score", 2).alias("document"), F.round("dob_score", 2).alias("dob"),
            F.lit(0.0).alias("nationality"),
        ).alias("confidence_breakdown"),
        F.col("flags"),
        F.col("recommendation"),
        F.col("match_layer"),
        F.struct(*[F.col(c) for c in DETAILS if c in have]).alias("details"),
        *[F.col(c).alias(n) for c, n in (("identity_documents", "identifications"), ("addresses", "addresses")) if c in have],
    )
    per_request = matches.groupBy("request_id").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    joined = results.drop("matches").join(per_request, "request_id", "left")
    lists = F.lit(None).cast("string").alias("lists_metadata")
    if list_metadata is not None:
        versions = list_metadata.agg(F.sort_array(F.collect_list(F.struct(*list_metadata.columns))).alias("lists"))
        joined = joined.join(F.broadcast(versions), F.lit(True))
        lists = F.col("lists").alias("lists_metadata")
    optional = lambda c: (F.col(c) if c in results.columns else F.lit(None).cast("string")).alias(c)
    document = F.struct(
        F.struct(
            F.col("request_id").alias("screening_id"),
            F.col("name").alias("input_name"),
            F.col("document_number").alias("input_document"),
            F.col("country").alias("input_country"),
            F.col("date_of_birth").alias("input_dob"),
            F.col("nationality").alias("input_nationality"),
            at.cast("string").alias("screening_date"),
            optional("analyst"),
            optional("operator_id"),
            F.col("is_hit"),
            F.col("hit_count").alias("match_count"),
        ).alias("screening_info"),
        configuration(config).alias("screening_configuration"),
        F.coalesce(F.col("matches"), F.expr("array()")).alias("matches"),
        F.struct(optional("decision"), optional("notes")).alias("decision"),
        lists,
        F.struct(
            at.cast("string").alias("generated_at"), F.lit("2.0").alias("report_version"),
            F.col("request_id").alias("screening_id"),
        ).alias("report_metadata"),
    )
    return joined.select(
        "request_id",
        F.concat(report_name(F.col("name"), at), F.lit(".json")).alias("file_name"),
        F.to_json(document).alias("report"),
    )


def export_rows(results: DataFrame) -> DataFrame:
    """The rows of the results export; ``recommendation`` is that of the best match."""
    return results.select(
        F.coalesce("name", F.lit("")).alias("Nombre"),
        F.coalesce("document_number", F.lit("")).alias("Documento"),
        F.coalesce("country", F.lit("")).alias("País"),
        F.when(F.col("is_hit"), "COINCIDENCIA").otherwise("LIMPIO").alias("Resultado"),
        F.col("hit_count").alias("Coincidencias"),
        F.when(F.col("is_hit"), F.coalesce("recommendation", F.lit("APPROVE"))).otherwise("APPROVE").alias("Recomendación"),
    )


def write_export(results: DataFrame, path: str) -> None:
    """CSV with quotes only where a field needs them."""
    export_rows(results).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")
