"""Watch-list shaped views of the driver's tables. Every view keeps every row of its table.

Names come from the whole text: the distinct words of a document, longest first, ties by code
point. Copies and near copies of a document therefore share names, which gives scores of all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.functions.names import name_key, normalize_document, normalize_name, once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


NAME_WORDS = 6


def ranked_words(text: Column) -> Column:
    """The six longest distinct words of the whole text."""
    words = F.array_remove(F.array_distinct(F.split(text, r"[^\p{L}]+")), "")

    def longest(words: Column) -> Column:
        """The words as long as the sixth longest; sorting lengths is cheaper than sorting words."""
        sizes = F.sort_array(F.transform(words, lambda w: F.length(w)), asc=False)
        return once(F.coalesce(F.get(sizes, F.lit(NAME_WORDS - 1)), F.lit(0)), lambda least: F.filter(words, lambda w: F.length(w) >= least))

    # plain strings sort faster than structs: the seven digits put longer words first
    keyed = F.transform(once(words, longest), lambda w: F.concat((F.lit(9_999_999) - F.length(w)).cast("string"), w))
    return F.transform(F.slice(F.sort_array(keyed), 1, NAME_WORDS), lambda k: F.substring(k, 8, 9_999_999))


def lettered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a letter; without one there is no name to read."""
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\p{L}"))


def _joined(words: Column, first: int, count: int) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def _pick(key: Column, values: list[str | None]) -> Column:
    """values[key % n], written as a case expression."""
    chosen = None
    for i, value in enumerate(values[:-1]):
        test = F.pmod(key, F.lit(len(values))) == i
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(values[-1])


COUNTRIES = ["Panama", "Russia", "Iran", "Cuba", "Germany"]
SOURCES = ["OFAC", "UN", "EU", "UK", "OTHER"]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list entity per document."""
    doc = F.col("doc_id")
    docs = lettered(spark, sf_dir).select(
        "doc_id", "lang", "source", "n_chars", F.explode(F.array(ranked_words(F.col("text")))).alias("w")
    )
    source_no = F.substring("source", 4, 9).cast("int")
    flat = docs.select(
        doc,
        doc.cast("string").alias("entity_id"),
        _pick(source_no, SOURCES).alias("source"),
        F.when(F.col("lang") == "en", "individual").when(F.col("lang") == "de", "entity")
        .when(F.col("lang") == "fr", "vessel").otherwise("aircraft").alias("entity_type"),
        _joined(F.col("w"), 1, 2).alias("primary_name"),
        F.nullif(_joined(F.col("w"), 3, 2), F.lit("")).alias("alias_name"),
        F.get("w", F.lit(0)).alias("first_name"),
        F.get("w", F.lit(1)).alias("last_name"),
        F.concat((F.lit(1940) + doc % 60).cast("string"), F.lit("-01-15")).alias("date_of_birth"),
        _pick(doc, COUNTRIES).alias("nationality"),
        _pick(doc, [None, None, "Iran", None, None, "Cuba", None]).alias("citizenship"),
        F.concat(F.lit("PA-"), F.floor(doc / 2).cast("string"), F.lit("-0")).alias("document_number"),
        _pick(doc, ["Passport", "National ID", "Passport"]).alias("document_type"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("IMO "), (F.lit(9000000) + doc).cast("string")))
        .alias("vessel_imo"),
        F.concat(F.lit("PRG-"), (F.col("n_chars") % 9).cast("string")).alias("program"),
        (doc % 40 == 0).alias("is_deleted"),
    )
    return flat.select(
        "*",
        F.array_distinct(F.array_compact(F.array("primary_name", "alias_name"))).alias("all_names"),
        F.array_distinct(F.array_compact(F.array("nationality", "citizenship"))).alias("countries"),
    )


def nested_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entities`` with the document array the screening operators read."""
    return entities(spark, sf_dir).withColumn(
        "identity_documents",
        F.array(F.struct(F.col("document_type").alias("type"), F.col("document_number").alias("number"))),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One screening request per document: its own words, spelled as a clerk might."""
    doc = F.col("doc_id")
    docs = lettered(spark, sf_dir).select(
        "doc_id", "lang", F.explode(F.array(ranked_words(F.col("text")))).alias("w")
    )
    w = F.col("w")
    name = (
        F.when(doc % 5 == 0, F.lower(F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(0)))))
        .when(doc % 5 == 1, F.concat(_joined(w, 1, 2), F.lit("e")))
        .when(doc % 5 == 2, _joined(w, 1, 1))
        .when(doc % 5 == 3, F.concat_ws(", ", F.get(w, F.lit(2)), F.get(w, F.lit(1))))
        .otherwise(_joined(w, 5, 2))
    )
    number = F.floor(doc / 2).cast("string")
    return docs.select(
        doc.alias("request_id"),
        name.alias("name"),
        F.when(doc % 4 == 1, F.concat(F.lit("pa "), number, F.lit(" 0")))
        .when(doc % 4 == 3, F.concat(F.lit("ZZ."), number)).alias("document_number"),
        _pick(doc, [None, "passport", "NATIONAL ID"]).alias("document_type"),
        F.when(doc % 2 == 1, (F.lit(1940) + doc % 60 + doc % 3).cast("string")).alias("date_of_birth"),
        _pick(doc, ["PANAMA", "Rus", "Iran", None, None]).alias("nationality"),
        _pick(doc, [None, None, "Federal Germany"]).alias("country"),
        F.col("lang"),
    )


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select(
        "source", "entity_id", F.col("document_type"), F.col("document_number"),
        normalize_document(F.col("document_number")).alias("normalized_number"),
    )


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, entity_id, position, name, list_key): one row per list name."""
    named = entities(spark, sf_dir).select(
        "source", "entity_id", F.posexplode("all_names").alias("position", "name")
    )
    return named.withColumn("list_key", name_key(normalize_name(F.col("name"))))


def screening_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing")
        .otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("analyst_id"),
        F.col("o_orderpriority").alias("request_type"),
        F.col("o_totalprice").alias("total"),
    )


def screening_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("result_no"),
        (F.col("l_returnflag") == "R").alias("is_hit"),
        (F.col("l_quantity") * 2).alias("max_confidence"),
        F.col("l_partkey").alias("entity_key"),
        F.col("l_suppkey").alias("supplier_key"),
        F.col("l_shipdate").alias("finished_at"),
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("action"),
        F.when(F.col("value") > 50, "entity").otherwise("request").alias("resource_type"),
        F.col("user_id").alias("actor_id"),
        F.col("value"),
        F.col("props"),
        (F.col("event_type") != "error").alias("success"),
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"),
        (F.col("value") * 4).alias("duration_ms"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("ts"),
        F.col("user_id"),
    )
