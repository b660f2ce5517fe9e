"""The relational tables: their columns, and rows appended to them as Parquet.

Every table has an ``id`` that is a digest of its natural key, so the same row written twice has the same id and a
child finds its parent without a lookup. Columns a caller does not give are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.functions.names import normalize_document, normalize_name

# Columns of each table beside id, created_at and updated_at; then the natural key of its id.
TABLES: dict[str, tuple[str, list[str]]] = {
    "sanctioned_entities": (
        "external_id string, source string, entity_type string, primary_name string, normalized_name string, first_name string, last_name string, "
        "middle_name string, date_of_birth string, place_of_birth string, nationality string, citizenship string, gender string, title string, "
        "vessel_type string, vessel_flag string, vessel_tonnage string, vessel_imo string, vessel_mmsi string, vessel_call_sign string, raw_data string, "
        "search_vector array<struct<token:string,weight:string>>, is_deleted boolean, deleted_at timestamp, version int",
        ["external_id", "source"],
    ),
    "entity_aliases": (
        "entity_id string, alias_name string, normalized_alias string, alias_type string, alias_quality string, language string, is_primary boolean",
        ["entity_id", "alias_name"],
    ),
    "identity_documents": (
        "entity_id string, document_type string, document_number string, normalized_number string, issuing_country string, issuing_authority string, "
        "issue_date string, expiration_date string, notes string",
        ["entity_id", "document_type", "document_number"],
    ),
    "entity_addresses": (
        "entity_id string, address_line1 string, address_line2 string, city string, state_province string, postal_code string, country string, "
        "full_address string, address_type string, is_primary boolean",
        ["entity_id", "address_line1", "address_line2", "city", "state_province", "postal_code", "country"],
    ),
    "entity_features": ("entity_id string, feature_type string, feature_value string, normalized_value string", ["entity_id", "feature_type", "feature_value"]),
    "sanctions_programs": ("code string, name string, description string, authority string, is_active boolean", ["code"]),
    "entity_programs": ("entity_id string, program_id string, listed_date string, listing_reason string, is_active boolean", ["entity_id", "program_id"]),
    "screening_requests": (
        "request_key string, request_type string, status string, input_data string, screened_name string, screened_document string, analyst_name string, "
        "analyst_id string, api_key_id string, ip_address string, user_agent string, processing_start timestamp, processing_end timestamp, "
        "processing_time_ms bigint, error_message string, error_code string, algorithm_version string, thresholds_used string",
        ["request_key"],
    ),
    "screening_results": (
        "request_id string, result_no int, input_name string, input_document string, input_country string, is_hit boolean, hit_count bigint, "
        "max_confidence double, recommendation string, flags array<string>",
        ["request_id", "result_no"],
    ),
    "screening_matches": (
        "result_id string, entity_id string, matched_name string, matched_document string, match_layer int, overall_confidence double, "
        "name_confidence double, document_confidence double, dob_confidence double, nationality_confidence double, address_confidence double, "
        "flags array<string>, recommendation string, entity_snapshot string",
        ["result_id", "entity_id"],
    ),
    "audit_logs": (
        "log_key string, timestamp timestamp, action string, resource_type string, resource_id string, actor_id string, actor_name string, actor_ip string, "
        "details string, old_value string, new_value string, success boolean, error_message string",
        ["log_key"],
    ),
    "data_sources": (
        "code string, name string, source_type string, download_url string, file_format string, is_active boolean, update_frequency_days int, "
        "last_update timestamp, last_update_status string, last_entity_count bigint, validate_xsd boolean, xsd_url string, expected_hash string",
        ["code"],
    ),
    "data_updates": (
        "source_id string, started_at timestamp, completed_at timestamp, status string, entities_added bigint, entities_updated bigint, "
        "entities_removed bigint, total_entities bigint, validation_errors int, validation_warnings int, validation_details string, file_hash string, "
        "file_size_bytes bigint, error_message string",
        ["source_id", "started_at"],
    ),
}


def key(table: str, *parts: Column) -> Column:
    """The id of the row of ``table`` with this natural key; null parts count as a mark of their own."""
    texts = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(table), *texts), 256)


def shaped(rows: DataFrame, table: str, at: Column) -> DataFrame:
    """``rows`` with exactly the table's columns; names, aliases and numbers get their normal forms."""
    declared, natural = TABLES[table]
    schema = rows.sparkSession.createDataFrame([], declared).schema
    derived = {
        "normalized_name": lambda: normalize_name(F.col("primary_name")),
        "normalized_alias": lambda: normalize_name(F.col("alias_name")),
        "normalized_number": lambda: normalize_document(F.col("document_number")),
        "version": lambda: F.lit(1),
        "is_deleted": lambda: F.lit(False),
    }

    def value(name: str) -> Column:
        if name in rows.columns:
            return F.col(name)
        return derived[name]() if name in derived else F.lit(None)

    columns = [value(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    stamped = rows.select(*columns).select("*", at.cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"))
    return stamped.select(key(table, *[F.col(c) for c in natural]).alias("id"), "*")


def append(rows: DataFrame, folder: str, table: str, at: Column) -> None:
    # digests hold half a byte a letter, which only a compression with an entropy coder sees
    shaped(rows, table, at).write.mode("append").option("compression", "zstd").parquet(f"{folder.rstrip('/')}/{table}")


def _told_by_key(rows: DataFrame, natural: list[str]) -> bool:
    """Whether the natural key tells rows apart exactly as their ids do: its text is unambiguous with one string among whole numbers."""
    kinds = [rows.schema[c].dataType.typeName() for c in natural]
    return kinds.count("string") <= 1 and all(k in ("string", "integer", "long", "boolean") for k in kinds)


def read(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None, near: str | None = None) -> DataFrame:
    """The table's rows, or these columns of them; of rows appended twice the one stamped last.

    ``near``, a part of the natural key, keeps rows that share it in one partition, in which a join by it finds them.
    """
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{table}")
    natural = TABLES[table][1]
    if columns and "id" not in columns and _told_by_key(rows, natural):
        # ids need not travel, nor be read
        rest = [c for c in columns if c not in natural]
        keyed = rows.select(*natural, "updated_at", F.struct(*rest).alias("r") if rest else F.lit(0).alias("r"))
        if near:
            keyed = keyed.repartition(near)
        last = keyed.groupBy(*natural).agg(F.max_by("r", "updated_at").alias("r"))
        return last.select(*[F.col(f"r.{c}") if c in rest else F.col(c) for c in columns])
    rest = [c for c in columns or rows.columns if c != "id"]
    # Ids travel as bytes, half as long.
    keyed = rows.select(F.unhex("id").alias("_id"), "updated_at", F.struct(*rest).alias("r"))
    last = keyed.groupBy("_id").agg(F.max_by("r", "updated_at").alias("r")).select(F.lower(F.hex("_id")).alias("id"), "r.*")
    return last.select(*(columns or rows.columns))
