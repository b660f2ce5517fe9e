"""Registered queries: key -> (spark, sf_dir) -> DataFrame, each over whole tables.

Arrays are joined to text and times are formatted in the last projection, so that both engines give
plain columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views as V
from listwarden import schemas
from listwarden.config import DEFAULT, FALLBACK, AdaptiveThresholds, Weights
from listwarden.functions import fields as P
from listwarden.functions import names as N
from listwarden.functions import similarity as S
from listwarden.functions import text as X
from listwarden.operators import alerts, audit, decision, paging, postings, quality, rates, rescreening, screening, stats, tables
from listwarden.operators.candidates import best_alias, distinct_requests, name_pairs
from listwarden.operators.staging import materialized, shared_folder
from listwarden.plans import colocated, persist, reload, reports
from listwarden.sources import files, seeds, xml_lists
from listwarden.streaming import pairing
from listwarden.streaming import screening as stream_screening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def joined(column, separator: str = "|") -> Column:
    return F.array_join(F.col(column) if isinstance(column, str) else column, separator)


def docs(spark, d) -> DataFrame:
    return V.table(spark, d, "documents")


# --- lists held as XML -----------------------------------------------------------------------

def _tag(name: str, *content) -> Column:
    return F.concat(F.lit(f"<{name}>"), *content, F.lit(f"</{name}>"))


def ofac_xml(spark, d) -> DataFrame:
    """One <entity> per list entity; some without id, some with repeated names and features."""
    doc = F.col("doc_id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = lambda full, first, last: _tag(
        "name",
        _tag("translations", _tag("translation", _tag("formattedFullName", F.lit(" "), full, F.lit(" ")),
             _tag("formattedFirstName", first), _tag("formattedLastName", last))),
    )
    feature = lambda kind, type_id, value: F.concat(
        F.lit(f'<feature><type featureTypeId="{type_id}">{kind}</type><value>'), value, F.lit("</value></feature>")
    )
    identity = F.when(doc % 50 == 0, F.lit("<entity>")).otherwise(
        F.concat(F.lit('<entity id="'), F.col("entity_id"), F.lit('">'))
    )
    xml = F.concat(
        identity,
        F.when(doc % 9 == 0, F.lit("")).otherwise(_tag("entityType", F.initcap("entity_type"))),
        _tag("names",
             name(text("primary_name"), text("first_name"), text("last_name")),
             F.when(F.col("alias_name").isNotNull(), name(text("alias_name"), F.lit(""), F.lit("x"))).otherwise(F.lit("")),
             F.when(doc % 3 == 0, name(text("primary_name"), F.lit("y"), F.lit("z"))).otherwise(F.lit(""))),
        _tag("identityDocuments", _tag("identityDocument", _tag("type", text("document_type")),
             _tag("documentNumber", text("document_number")), _tag("issuingCountry", text("nationality")))),
        _tag("idDocuments", _tag("idDocument", F.when(doc % 4 == 0, _tag("number", F.lit("ID "), F.col("entity_id"))).otherwise(F.lit("")))),
        _tag("features",
             feature("Date of Birth", 8, F.lit("1900-01-01")),
             feature("DOB", 8, text("date_of_birth")),
             feature("Place of Birth", 9, text("nationality")),
             feature("Nationality Country", 10, text("nationality")),
             feature("Citizenship Country", 11, text("citizenship")),
             F.when(F.col("vessel_imo").isNotNull(), feature("IMO Number", 12, text("vessel_imo"))).otherwise(F.lit("")),
             feature("Digital Currency Address", 13, text("entity_id"))),
        F.concat(F.lit('<relationships><relationship><relatedEntity entityId="'), (doc + 4).cast("string"),
                 F.lit('">n</relatedEntity>'),
                 F.when(doc % 2 == 0, _tag("relationshipType", F.lit("Associate"))).otherwise(F.lit("")),
                 F.lit("</relationship></relationships>")),
        _tag("addresses", _tag("address", _tag("city", F.lit("City "), (doc % 10).cast("string")), _tag("country", text("nationality"))),
             F.lit("<address></address>")),
        _tag("sanctionsPrograms", _tag("sanctionsProgram", text("program")),
             F.when(doc % 2 == 0, _tag("sanctionsProgram", F.lit(" SDN "))).otherwise(F.lit(""))),
        F.lit("</entity>"),
    )
    return V.entities(spark, d).select("doc_id", xml.alias("xml"))


def raw_ofac(spark, d) -> DataFrame:
    return xml_lists.parse_rows(ofac_xml(spark, d), "xml", schemas.OFAC_ENTITY, "entity")


def ofac(spark, d) -> DataFrame:
    return xml_lists.ofac_entities(raw_ofac(spark, d))


def un_person_xml(spark, d) -> DataFrame:
    doc = F.col("doc_id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    xml = F.concat(
        F.lit("<INDIVIDUAL>"),
        _tag("DATAID", F.col("entity_id")),
        _tag("FIRST_NAME", text("first_name")),
        _tag("SECOND_NAME", text("last_name")),
        F.when(doc % 3 == 0, _tag("THIRD_NAME", text("alias_name"))).otherwise(F.lit("")),
        _tag("REFERENCE_NUMBER", V._pick(doc, ["QDi.", "TAi.", "KPe.", "bad-", "IRi."]), doc.cast("string")),
        _tag("UN_LIST_TYPE", V._pick(doc, ["Al-Qaida", "Taliban", "DPRK"])),
        _tag("DATE_OF_BIRTH", text("date_of_birth")),
        _tag("NATIONALITY", _tag("VALUE", text("nationality")), _tag("VALUE", F.lit("Other"))),
        _tag("INDIVIDUAL_ALIAS", _tag("ALIAS_NAME", text("alias_name")), _tag("QUALITY", F.lit("Good"))),
        _tag("INDIVIDUAL_ALIAS", _tag("ALIAS_NAME", text("first_name"))),
        _tag("INDIVIDUAL_DOCUMENT", _tag("TYPE_OF_DOCUMENT", text("document_type")), _tag("NUMBER", text("document_number"))),
        _tag("INDIVIDUAL_ADDRESS", _tag("CITY", F.lit("Town")), _tag("COUNTRY", text("citizenship"))),
        F.lit("</INDIVIDUAL>"),
    )
    return V.entities(spark, d).select("doc_id", xml.alias("xml"))


def un_people(spark, d) -> DataFrame:
    raw = xml_lists.parse_rows(un_person_xml(spark, d), "xml", schemas.UN_INDIVIDUAL, "INDIVIDUAL")
    return xml_lists.un_individuals(raw)


@query
def xml_ofac_entities(spark, d):
    return ofac(spark, d).select(
        "source", "entity_id", "entity_type", "primary_name", joined("all_names").alias("all_names"),
        joined("aliases").alias("aliases"), "date_of_birth", "place_of_birth", "nationality", "citizenship",
        "vessel_imo", joined("crypto_addresses").alias("crypto"), "program",
        F.size("identity_documents").alias("documents"),
    )


@query
def xml_un_entities(spark, d):
    return un_people(spark, d).select(
        "source", "entity_id", "entity_type", "primary_name", joined("all_names").alias("all_names"),
        "date_of_birth", "nationality", "un_list_type", "un_country_code", "un_committee",
        joined("countries").alias("countries"), F.size("identity_documents").alias("documents"),
    )


@query
def entity_names(spark, d):
    return ofac(spark, d).select(
        "entity_id", "entity_type", "primary_name", F.posexplode("all_names").alias("position", "name")
    )


@query
def entity_first_last(spark, d):
    return ofac(spark, d).select("entity_id", "first_name", "last_name")


@query
def entity_documents(spark, d):
    return ofac(spark, d).select("entity_id", F.inline("identity_documents")).select(
        "entity_id", "type", "number", "issuing_country"
    )


@query
def entity_features(spark, d):
    return ofac(spark, d).select("entity_id", F.inline("features")).select("entity_id", "type", "value", "type_id")


@query
def feature_pivot(spark, d):
    """The pivot over exploded feature rows: the last feature of each kind."""
    rows = ofac(spark, d).select("entity_id", F.posexplode("features").alias("pos", "f"))
    kinds = [k for k in P.FEATURE_KINDS if k not in ("gender", "title", "crypto", "aircraft_registration")]
    kind = P.feature_kind(F.col("f.type"))
    return rows.groupBy("entity_id").agg(
        *[F.max_by("f.value", F.when(kind == k, F.col("pos"))).alias(k) for k in kinds]
    )


@query
def relationships(spark, d):
    return ofac(spark, d).select("entity_id", F.inline("relationships")).select(
        "entity_id", "related_entity_id", "relationship_type"
    )


@query
def related_entities(spark, d):
    found = ofac(spark, d)
    edges = found.select("entity_id", F.inline("relationships")).select("entity_id", "related_entity_id", "relationship_type")
    return tables.related_entities(edges, found.select("entity_id", "primary_name"))


@query
def entity_addresses(spark, d):
    return ofac(spark, d).select("entity_id", F.inline("addresses")).select("entity_id", "city", "country")


@query
def entity_countries(spark, d):
    return ofac(spark, d).select("entity_id", joined("countries").alias("countries"))


@query
def entity_programs_text(spark, d):
    return ofac(spark, d).select("entity_id", "program")


@query
def un_names(spark, d):
    return un_people(spark, d).select(
        "entity_id", "primary_name", "first_name", "last_name", joined("aliases").alias("aliases")
    )


@query
def un_reference(spark, d):
    return un_people(spark, d).select(
        "entity_id", "un_reference_number", "un_list_type", "un_country_code", "un_committee"
    )


@query
def un_discovered(spark, d):
    return stats.discovered_codes(un_people(spark, d))


def _tokens(spark, d) -> DataFrame:
    e = V.entities(spark, d)
    tokens = P.search_tokens([
        (F.col("primary_name"), "A"), (N.normalize_name(F.col("primary_name")), "A"), (F.col("first_name"), "B"),
        (F.col("last_name"), "B"), (F.col("nationality"), "C"), (F.col("date_of_birth"), "D"),
    ])
    return e.select("source", "entity_id", F.inline(tokens))


@query
def search_tokens(spark, d):
    return _tokens(spark, d)


@query
def token_search(spark, d):
    """For every request, the list entities that share a whole token with its name, by weight."""
    r = V.requests(spark, d)
    words = F.split(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "), " ")
    searches = r.select(F.col("request_id").alias("search_id"), F.explode(F.filter(words, lambda w: w != "")).alias("token"))
    found = tables.token_search(_tokens(spark, d), searches, {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1})
    return found.withColumn("rank", F.round("rank", 6))


@query
def token_search_best(spark, d):
    """The best three entities of every search."""
    r = V.requests(spark, d)
    words = F.split(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "), " ")
    searches = r.select(F.col("request_id").alias("search_id"), F.explode(F.filter(words, lambda w: w != "")).alias("token"))
    found = tables.token_search(_tokens(spark, d), searches, {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}, 3)
    return found.withColumn("rank", F.round("rank", 6))


# --- files -----------------------------------------------------------------------------------

def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/checks/{uuid.uuid4().hex}/{name}"


@query
def csv_requests(spark, d):
    """Requests written as CSV and read back with the source's rules."""
    path = _fresh(spark, "requests.csv")
    V.requests(spark, d).select(
        F.concat(F.lit(" "), "name", F.lit(" ")).alias("Nombre "), F.col("document_number").alias("cedula"),
        F.col("country").alias(" PAIS"),
    ).write.csv(path, header=True)
    return files.read_requests(spark, path).select("name", "document_number", "country")


@query
def csv_line_breaks(spark, d):
    """Whole texts, with their line breaks and quotes, as the name column of a request file."""
    path = _fresh(spark, "texts.csv")
    rows = docs(spark, d).select(F.col("text").alias("nombre"), F.col("doc_id").cast("string").alias("cedula"))
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    read = files.read_requests(spark, path)
    return read.select(F.col("document_number").cast("bigint").alias("doc_id"), F.sha2("name", 256).alias("name_hash"))


@query
def jsonl_audit(spark, d):
    path = _fresh(spark, "audit.jsonl")
    log = V.audit_logs(spark, d)
    log.select(
        F.col("log_id").cast("string").alias("screening_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.struct(F.col("action").alias("name"), F.col("props").alias("document")).alias("input"),
        F.struct(F.col("success").alias("is_hit"), F.col("value").alias("top_score")).alias("result"),
    ).write.json(path)
    return files.read_audit(spark, path).select(
        "screening_id", "timestamp", F.col("input.name").alias("name"), F.col("input.document").alias("document"),
        F.col("result.is_hit").alias("is_hit"), F.col("result.top_score").alias("top_score"),
    )


@query
def file_sha256(spark, d):
    return files.file_digests(spark, f"{d.rstrip('/')}/*.parquet").select("file_name", "size_bytes", "sha256")


@query
def data_files(spark, d):
    return files.list_files(spark, d, "*.parquet").select("file_name", "size_bytes")


@query
def hash_verify(spark, d):
    """Digests of every document text against the digests kept under its copy's name."""
    texts = docs(spark, d)
    now = texts.select(F.col("doc_id").cast("string").alias("file_name"), F.sha2("text", 256).alias("sha256"))
    known = texts.filter(F.col("n_chars") > 500).select(
        F.col("doc_id").cast("string").alias("file_name"),
        F.sha2(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.upper("text")), 256).alias("known_hash"),
    )
    return files.hash_verification(now, known)


@query
def list_metadata(spark, d):
    """A list file for each source; the counts must be those of each file."""
    path = _fresh(spark, "lists")
    rows = V.entities(spark, d).select(F.col("entity_id").alias("_id"), "primary_name", F.col("source").alias("of"))
    # a partition for each source, so that each has one file
    parts = rows.repartition(1).sortWithinPartitions("of")
    parts.write.format("xml").option("rootTag", "sanctions").option("rowTag", "entity").partitionBy("of").save(path)
    found = files.list_metadata(spark, f"{path}/*/*.xml", "LIST", ["entity"], root_tag="sanctions")
    return found.select(
        F.regexp_extract("path", "of=([A-Z]+)/", 1).alias("source"), "record_count",
        (F.col("size_bytes") > 0).alias("has_size"), F.length("sha256").alias("hash_length"), F.col("last_update").isNotNull().alias("has_date"),
    )


@query
def seed_programs(spark, d):
    """Programs present in the parts table plus the seed rows that are missing."""
    have = V.table(spark, d, "part").select(F.upper("p_type").alias("code")).distinct().unionByName(
        V.table(spark, d, "nation").select(F.when(F.col("n_nationkey") == 0, "IRAN").otherwise(F.upper("n_name")).alias("code"))
    ).withColumn("name", F.lower("code"))
    return seeds.seed_programs(have).select("code", "name", "authority", "is_active")


@query
def active_entities(spark, d):
    return tables.live(V.entities(spark, d)).select("source", "entity_id", "entity_type", "primary_name")


# --- names and text, over whole documents ------------------------------------------------------

@query
def normalize_name(spark, d):
    return docs(spark, d).select("doc_id", N.normalize_name(F.col("text")).alias("normalized"))


@query
def normalize_document(spark, d):
    return V.table(spark, d, "customer").select(
        "c_custkey", N.normalize_document(F.concat_ws("-", "c_name", F.col("c_acctbal").cast("decimal(12,2)").cast("string"), "c_mktsegment")).alias("normalized")
    )


@query
def name_script(spark, d):
    return docs(spark, d).select(
        "doc_id", N.name_script(F.translate("text", "aeiou", "аеио中")).alias("script"), N.name_script(F.col("text")).alias("plain_script")
    )


def _each_word(spark, d) -> DataFrame:
    """Distinct words of all documents."""
    words = F.split(F.regexp_replace("text", r"[^\p{L}.]+", " "), " ")
    return docs(spark, d).select(F.explode(words).alias("word")).filter(F.col("word") != "").distinct()


@query
def latin_initials(spark, d):
    return _each_word(spark, d).select("word", N.latin_initials(F.upper("word")).alias("upper_form"), N.latin_initials(F.col("word")).alias("initials"))


@query
def short_name(spark, d):
    """Every line of every document as a name."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", N.short_name(F.col("line")).alias("is_short"))


@query
def common_name(spark, d):
    """Every pair of neighbouring words of every document against the list of its most common words."""
    words = F.split(F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")), " ")
    listed = docs(spark, d).select(F.explode(F.array(words)).alias("w"))
    pairs = listed.select(
        F.explode(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).alias("name")
    ).filter(F.col("name").isNotNull())
    config = DEFAULT.with_(common_names=("Is And", "the thé", "Et la", "der die", "of the", "the of", "and the"))
    hits = pairs.filter(N.common_name(N.normalize_name(F.col("name")), config))
    return hits.groupBy(F.upper("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query
def adaptive_threshold(spark, d):
    got = N.adaptive_threshold(F.col("name"), FALLBACK)
    return _each_word(spark, d).select(
        F.col("word"), F.when(F.length("word") > 4, F.translate("word", "aeiou", "аеио中")).otherwise(F.upper("word")).alias("name")
    ).select("word", got["threshold"].alias("threshold"), got["reason"].alias("reason"))


@query
def dob_year(spark, d):
    return V.table(spark, d, "events").select("event_id", N.dob_year(F.concat_ws("/", F.col("props"), F.date_format("ts", "MM/dd/yyyy"), F.col("user_id").cast("string"))).alias("year"))


@query
def sanitize_text(spark, d):
    return docs(spark, d).select("doc_id", X.sanitize_text(F.col("text")).alias("clean"), X.sanitize_input(F.col("text")).alias("short_form"))


@query
def sanitize_context(spark, d):
    context = F.create_map(F.lit("role\n"), F.col("role"), F.lit("text"), F.col("text"), F.lit(""), F.lit(None).cast("string"))
    clean = V.table(spark, d, "conversations").select("conv_id", "turn", X.sanitize_context(context).alias("c"))
    return clean.select(
        "conv_id", "turn", F.try_element_at("c", F.lit("role")).alias("role"), F.try_element_at("c", F.lit("text")).alias("text"),
        F.map_contains_key("c", "unknown").alias("has_unknown"),
    )


@query
def sanitize_nested(spark, d):
    """Context of nested maps, lists, numbers and booleans."""
    kind = T.StructType.fromDDL("role STRING, inner MAP<STRING, STRING>, tags ARRAY<STRING>, turn BIGINT, odd BOOLEAN, numbers ARRAY<BIGINT>")
    value = F.struct(
        F.col("role"), F.create_map(F.lit("text\t"), F.col("text")).alias("inner"), F.split("text", "\n").alias("tags"),
        F.col("turn"), (F.col("turn") % 2 == 1).alias("odd"), F.array("conv_id", "turn").alias("numbers"),
    )
    clean = V.table(spark, d, "conversations").select("conv_id", "turn", X.sanitize_context(F.create_map(F.lit("a\nb"), value), kind).alias("c"))
    c = F.try_element_at("c", F.lit("a b"))
    return clean.select(
        "conv_id", "turn", c["role"].alias("role"), F.try_element_at(c["inner"], F.lit("text")).alias("text"), joined(c["tags"]).alias("tags"),
        c["odd"].alias("odd"), F.get(c["numbers"], F.lit(1)).alias("number"),
    )


@query
def report_name(spark, d):
    return V.requests(spark, d).select(
        "request_id", N.report_name(F.concat("name", F.lit("/*"), F.coalesce("document_number", F.lit("")) , F.lit("?")), day("2024-02-03 04:05:06")).alias("file_name")
    )


# --- validation and quality ---------------------------------------------------------------------

def _conversation_requests(spark, d) -> DataFrame:
    """Every turn as a request; its whole text is the name."""
    conv = F.col("conv_id")
    return V.table(spark, d, "conversations").select(
        F.concat_ws("-", conv.cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.when(conv % 4 == 0, F.regexp_replace("text", "\n", " "))
        .when(conv % 4 == 1, F.concat(F.lit("<"), "text"))
        .when(conv % 4 == 2, F.element_at(F.split("text", " "), -1))
        .otherwise(F.col("text")).alias("name"),
        V._pick(conv, [None, "12-34.5", "a/b", None, "x" * 60]).alias("document_number"),
        V._pick(F.col("turn"), ["1980", "1980-01", "01/02/1980", None]).alias("date_of_birth"),
    )


@query
def validate_requests(spark, d):
    return quality.with_validation(_conversation_requests(spark, d)).select("request_id", "error_code", "error_field", "suggestion")


@query
def security_events(spark, d):
    return quality.security_events(quality.rejects(_conversation_requests(spark, d)))


@query
def malformation_rate(spark, d):
    return quality.malformation_rate(raw_ofac(spark, d), "_id").withColumn("malformed_percent", F.round("malformed_percent", 6))


def _messages(spark, d) -> DataFrame:
    """Every event as a schema message."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", "Element x: Missing required attribute id")
        .when(kind == "click", "Unexpected element y")
        .when(kind == "view", "Value is NOT ALLOWED here; deprecated")
        .when(kind == "purchase", "Deprecated field").otherwise(F.concat(F.lit("note "), "props"))
    )
    return V.table(spark, d, "events").select(text.alias("message"))


@query
def xsd_severity(spark, d):
    counted = quality.schema_messages(_messages(spark, d))
    return counted.join(F.broadcast(quality.validation_totals(_messages(spark, d))), F.lit(True))


@query
def report_validation(spark, d):
    lines = V.table(spark, d, "lineitem")
    matches = lines.groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
            F.when(F.col("l_discount") > 0.02, F.col("l_returnflag")).otherwise("").alias("matched_name"),
            F.when(F.col("l_tax") > 0.01, F.col("l_linestatus")).alias("entity_id"),
            (F.col("l_returnflag") != "N").alias("has_breakdown"),
        ))).alias("matches")
    )
    results = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("input_name"),
        F.col("o_orderdate").alias("screening_date"), (F.col("o_totalprice") > 1000).alias("is_hit"),
        F.when(F.col("o_custkey") % 2 == 0, "x").alias("screening_id"),
    ).join(matches, "request_id", "left")
    shaped = F.transform("matches", lambda m: F.struct(m["matched_name"].alias("matched_name"), m["entity_id"].alias("entity_id"), m["has_breakdown"].alias("has_breakdown")))
    checked = quality.report_validation(results.withColumn("matches", shaped))
    return checked.select(
        "request_id", "is_valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"),
        F.get("errors", F.lit(0)).alias("first_error"), F.get("warnings", F.lit(0)).alias("first_warning"),
    )


@query
def stale_sources(spark, d):
    """Customers as lists, their last order as the last update."""
    last = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderdate").alias("last_update"))
    return quality.stale_sources(last, day("2000-06-30 12:00:00"), 90)


@query
def constraint_violations(spark, d):
    r = V.screening_results(spark, d)
    e = V.entities(spark, d)
    q = V.screening_requests(spark, d)
    parts = quality.violation_counts(r, {
        "confidence_range": ~F.col("max_confidence").between(0, 90), "request_not_null": F.col("request_id").isNull(),
    }).unionByName(quality.violation_counts(e, {
        "entity_type_allowed": quality.not_allowed("entity_type", schemas.ALLOWED["entity_type"]),
        "source_allowed": quality.not_allowed("source", ["OFAC", "UN", "EU"]),
        "name_length": F.length("primary_name") > 30,
    })).unionByName(quality.violation_counts(q, {
        "status_allowed": quality.not_allowed("status", ["pending", "completed"]),
    }))
    return parts.unionByName(quality.duplicate_keys(r, ["request_id", "result_no"], "result_unique")).unionByName(
        quality.duplicate_keys(e, ["source", "entity_id"], "entity_unique")
    )


@query
def fk_orphans(spark, d):
    t = lambda n: V.table(spark, d, n)
    return quality.orphan_counts([
        ("results.request_id", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("requests.analyst", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("results.supplier", t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"),
        ("labels.doc_id", t("labels"), "doc_id", t("documents"), "doc_id"),
        ("events.user_id", t("events"), "user_id", t("supplier"), "s_suppkey"),
        ("parts.size", t("part"), "p_size", t("nation"), "n_nationkey"),
    ])


@query
def table_counts(spark, d):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    return quality.table_counts({n: V.table(spark, d, n) for n in names})


# --- matching -------------------------------------------------------------------------------------

def _lists(spark, d) -> screening.PreparedList:
    return screening.prepare_list(V.nested_entities(spark, d))


def _screened(spark, d, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests, matches), both written once: several parts of a query read them."""
    requests = materialized(quality.validated(V.requests(spark, d)), "requests")
    listed = _lists(spark, d) if entities is None else screening.prepare_list(entities)
    return requests, materialized(screening.rounded(screening.screen(requests, listed)), "matches")


@query
def screen_document(spark, d):
    found = screening.screen_by_document(V.requests(spark, d), V.nested_entities(spark, d))
    return found.select(
        "request_id", "source", "entity_id", "matched_name", "matched_document", "overall", "match_layer",
        joined("flags").alias("flags"), "recommendation",
    )


@query
def screen_document_best(spark, d):
    """The first three document matches of every request, numbers shared by many."""
    shared = F.concat(F.lit("PA-"), (F.col("doc_id") % 7).cast("string"))
    listed = V.nested_entities(spark, d).withColumn("identity_documents", F.array(F.struct(F.col("document_type").alias("type"), shared.alias("number"))))
    requests = V.requests(spark, d).withColumn("document_number", F.concat(F.lit("pa "), (F.col("request_id") % 5).cast("string")))
    found = screening.screen_by_document(requests, listed, limit=3)
    return found.select("request_id", "source", "entity_id", "matched_document")


def _request_keys(spark, d, score: float) -> DataFrame:
    keys = V.requests(spark, d).select(N.name_key(N.normalize_name(F.col("name"))).alias("request_key"))
    return distinct_requests(keys.withColumn("min_score", F.lit(float(score))))


@query
def fuzzy_name_pairs(spark, d):
    """All pairs of distinct names that score at least 60."""
    keys = V.entity_names(spark, d).select("list_key").distinct()
    pairs = name_pairs(_request_keys(spark, d, DEFAULT.layers.low), keys)
    return pairs.withColumn("score", F.round("score", 6))


@query
def fuzzy_name_pairs_75(spark, d):
    """The same join at the default screening threshold."""
    keys = V.entity_names(spark, d).select("list_key").distinct()
    pairs = name_pairs(_request_keys(spark, d, DEFAULT.name_threshold), keys)
    return pairs.withColumn("score", F.round("score", 6))


@query
def best_alias_per_entity(spark, d):
    names = materialized(V.entity_names(spark, d), "names")
    pairs = name_pairs(_request_keys(spark, d, 75.0), names.select("list_key").distinct())
    return best_alias(pairs, names).withColumn("name_score", F.round("name_score", 6))


QUERIES["best_alias"] = QUERIES.pop("best_alias_per_entity")


def _own_pairs(spark, d) -> DataFrame:
    """Each request beside the list entity of the same document and the next one."""
    r = V.requests(spark, d).withColumn("doc_id", F.explode(F.array(F.col("request_id"), F.col("request_id") + 1)))
    e = V.entities(spark, d).select(
        "doc_id", "entity_id", "entity_type", "primary_name", F.col("date_of_birth").alias("entity_dob"),
        F.col("nationality").alias("entity_nationality"), F.col("citizenship").alias("entity_citizenship"),
        "countries", F.col("document_number").alias("entity_document"),
    )
    return r.join(e, "doc_id")


@query
def token_sort_ratio(spark, d):
    score = S.token_sort_ratio(N.normalize_name(F.col("name")), N.normalize_name(F.col("primary_name")))
    return _own_pairs(spark, d).select("request_id", "entity_id", F.round(score, 6).alias("score"))


@query
def trigram_similarity(spark, d):
    """All pairs of distinct normalized names above the default similarity."""
    left = V.requests(spark, d).select(N.normalize_name(F.col("name")).alias("left_text"))
    right = V.entities(spark, d).select(N.normalize_name(F.col("primary_name")).alias("right_text"))
    return tables.similar_name_pairs(left, right, 0.3).withColumn("similarity", F.round("similarity", 6))


def _normalized_entities(spark, d) -> DataFrame:
    return V.entities(spark, d).withColumn("normalized_name", N.normalize_name(F.col("primary_name")))


@query
def repo_name_search(spark, d):
    found = tables.search_by_name(_normalized_entities(spark, d), "Oferonren enllementaux", 0.05, 100)
    return found.select("source", "entity_id", "primary_name", F.round("similarity", 6).alias("similarity"))


@query
def repo_name_search_bulk(spark, d):
    searches = V.requests(spark, d).select(F.col("request_id").alias("search_id"), "name")
    found = tables.search_by_names(_normalized_entities(spark, d), searches, 0.3, 5)
    return found.select("search_id", "source", "entity_id", F.round("similarity", 6).alias("similarity"), "rank")


@query
def repo_document_search(spark, d):
    searches = V.requests(spark, d).select(
        F.col("request_id").alias("search_id"), "document_number",
        F.when(F.col("request_id") % 3 == 1, "Passport").alias("document_type"),
    )
    found = tables.entities_by_document(V.entities(spark, d), V.entity_documents(spark, d), searches)
    return found.select("search_id", "source", "entity_id", "primary_name")


@query
def repo_document_best(spark, d):
    """The first two live entities of every search, numbers shared by many."""
    documents = V.entity_documents(spark, d).withColumn("normalized_number", F.concat(F.lit("PA"), (F.col("entity_id").cast("bigint") % 11).cast("string")))
    searches = V.requests(spark, d).select(
        F.col("request_id").alias("search_id"), F.concat(F.lit("pa "), (F.col("request_id") % 13).cast("string")).alias("document_number"),
        F.when(F.col("request_id") % 3 == 1, "Passport").alias("document_type"),
    )
    found = tables.entities_by_document(V.entities(spark, d), documents, searches, 2)
    return found.select("search_id", "source", "entity_id", "primary_name")


@query
def nationality_flag(spark, d):
    flag = decision.nationality_flag(
        decision.wanted_countries(F.col("nationality"), F.col("country")),
        decision.listed_countries(F.col("countries"), F.col("entity_nationality"), F.col("entity_citizenship")),
    )
    return _own_pairs(spark, d).select("request_id", "entity_id", flag.alias("flag"))


def _scored_pairs(spark, d) -> DataFrame:
    same = N.normalize_document(F.col("document_number")) == N.normalize_document(F.col("entity_document"))
    pairs = _own_pairs(spark, d).withColumns({
        "normalized": N.normalize_name(F.col("name")),
        "document_score": F.when(same, 100.0).otherwise(0.0),
        "dob_score": decision.dob_score(N.dob_year(F.col("date_of_birth")), N.dob_year(F.col("entity_dob"))),
        "nat_flag": decision.nationality_flag(
            decision.wanted_countries(F.col("nationality"), F.col("country")),
            decision.listed_countries(F.col("countries"), F.col("entity_nationality"), F.col("entity_citizenship")),
        ),
        "has_document": F.col("document_number").isNotNull(),
        "is_short": N.short_name(F.col("name")),
    })
    scored = pairs.withColumn("name_score", S.token_sort_ratio(F.col("normalized"), N.normalize_name(F.col("primary_name"))))
    config = DEFAULT.with_(weights=FALLBACK.weights)
    return scored.withColumn(
        "overall", decision.overall_score(F.col("name_score"), F.col("document_score"), F.col("dob_score"), config)
    )


@query
def doc_score(spark, d):
    return _scored_pairs(spark, d).select(
        "request_id", "entity_id", "document_score", F.when(F.col("document_score") == 100, F.col("entity_document")).alias("matched_document")
    )


@query
def dob_score(spark, d):
    return _scored_pairs(spark, d).select("request_id", "entity_id", "dob_score")


@query
def overall_score(spark, d):
    return _scored_pairs(spark, d).select("request_id", "entity_id", F.round("overall", 6).alias("overall"))


@query
def match_layer(spark, d):
    layer = decision.match_layer(F.col("name_score"), F.col("document_score"), F.col("dob_score"), F.col("nat_flag"))
    return _scored_pairs(spark, d).select("request_id", "entity_id", layer.alias("match_layer"))


@query
def match_flags(spark, d):
    common = F.col("request_id") % 6 == 0
    reason = F.when(F.col("is_short"), "cyrillic_name").otherwise("default")
    flags = decision.match_flags(
        F.col("document_score"), F.col("has_document"), F.col("is_short"), reason, common, F.col("nat_flag"), F.col("entity_type")
    )
    return _scored_pairs(spark, d).select("request_id", "entity_id", joined(flags).alias("flags"))


@query
def recommendation(spark, d):
    common = F.col("request_id") % 6 == 0
    rec = decision.recommendation(F.col("name_score"), common, F.col("document_score"))
    return _scored_pairs(spark, d).select("request_id", "entity_id", rec.alias("recommendation"))


@query
def confidence_band(spark, d):
    r = V.screening_results(spark, d)
    return r.groupBy(
        decision.confidence_band(F.col("max_confidence")).alias("band"), decision.sub_score_band(F.col("max_confidence")).alias("sub_band")
    ).agg(F.count(F.lit(1)).alias("n"))


MATCH_COLUMNS = [
    "request_id", "match_rank", "source", "entity_id", "entity_type", "matched_name", "matched_document", "overall",
    "name_score", "document_score", "dob_score", "match_layer", "recommendation",
]


@query
def screen_full(spark, d):
    """The flagship: every request against the whole list, best ten matches each."""
    matches = screening.rounded(screening.screen(quality.validated(V.requests(spark, d)), _lists(spark, d)))
    return matches.select(*MATCH_COLUMNS, joined("flags").alias("flags"))


@query
def screen_full_weighted(spark, d):
    """Name, document and birth year together, at a lower threshold."""
    config = DEFAULT.with_(name_threshold=70, short_name_threshold=70, weights=Weights(name=0.7, document=0.1, dob=0.2), adaptive=AdaptiveThresholds(False))
    listed = screening.prepare_list(V.nested_entities(spark, d), config)
    matches = screening.rounded(screening.screen(quality.validated(V.requests(spark, d)), listed, config))
    return matches.select(*MATCH_COLUMNS, joined("flags").alias("flags"))


def stored_list(spark, d) -> str:
    """Folder of the prepared list, as a list version leaves it behind."""
    folder = _fresh(spark, "prepared")
    screening.prepare_list(V.nested_entities(spark, d), folder=folder)
    return folder


def shortest_names(spark, d) -> DataFrame:
    """The hundred requests of the shortest names, ties by id."""
    return V.requests(spark, d).orderBy(F.length("name"), "request_id").limit(100)


def screened_from(spark, requests: DataFrame, folder: str) -> DataFrame:
    matches = screening.rounded(screening.screen(quality.validated(requests), screening.read_prepared(spark, folder)))
    return matches.select(*MATCH_COLUMNS, joined("flags").alias("flags"))


@query
def screen_small(spark, d):
    """The hundred requests of the shortest names against the whole list, stored before: the interactive form."""
    return screened_from(spark, shortest_names(spark, d), stored_list(spark, d))


def _former_list(spark, d, now: DataFrame | None = None) -> DataFrame:
    """The list as it was: without the aircraft, the vessels under other names and countries, and the pages, which are gone since."""
    now = V.nested_entities(spark, d) if now is None else now
    vessel = F.col("entity_type") == "vessel"
    old_name = F.when(vessel, F.col("last_name")).otherwise(F.col("primary_name"))
    kept = now.filter(F.col("entity_type") != "aircraft").withColumns({
        "primary_name": old_name, "all_names": F.when(vessel, F.array(F.col("last_name"))).otherwise(F.col("all_names")),
        "nationality": F.when(vessel, F.lit("Nauru")).otherwise(F.col("nationality")),
    })
    pages = V.table(spark, d, "pages").select(F.lit("UN").alias("source"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("entity_id"), F.lit("entity").alias("entity_type"), F.col("url").alias("primary_name"), F.array("url").alias("all_names"))
    return kept.unionByName(pages, allowMissingColumns=True)


def _carried(spark, d, reserve: int) -> tuple[DataFrame, rescreening.ScreeningState, rescreening.ScreeningState]:
    requests = materialized(quality.validated(V.requests(spark, d)), "requests")
    new = materialized(V.nested_entities(spark, d), "new_list")
    old = materialized(_former_list(spark, d, new), "old_list")
    before = rescreening.start(requests, old, reserve=reserve)
    return requests, before, rescreening.carry_over(before, rescreening.changes(old, new), new)


@query
def screen_delta(spark, d):
    """Every request against the whole list, carried over from a run on the former list; equal to ``screen_full``."""
    requests, _, after = _carried(spark, d, rescreening.RESERVE)
    return screening.rounded(rescreening.best_matches(requests, after)).select(*MATCH_COLUMNS, joined("flags").alias("flags"))


@query
def screen_delta_no_reserve(spark, d):
    """The same without a reserve: profiles that lose a match and had more than ten are screened anew."""
    requests, _, after = _carried(spark, d, 0)
    return screening.rounded(rescreening.best_matches(requests, after)).select(*MATCH_COLUMNS, joined("flags").alias("flags"))


@query
def screen_results(spark, d):
    requests, matches = _screened(spark, d)
    return screening.screening_results(requests, matches).select(
        "request_id", "is_hit", "hit_count", "max_confidence", "recommendation", "algorithm_version",
        "threshold_name", "threshold_short_name",
        joined(F.transform("matches", lambda m: F.concat_ws("/", m["source"], m["entity_id"]))).alias("matches"),
    )


@query
def screen_repeated_rows(spark, d):
    """Every request twice under one id: each row has the matches once."""
    once = materialized(quality.validated(V.requests(spark, d)), "requests")
    requests = once.unionByName(once)
    matches = materialized(screening.rounded(screening.screen(requests, _lists(spark, d))), "matches")
    return screening.screening_results(requests, matches).select("request_id", "is_hit", "hit_count", "max_confidence")


@query
def bulk_summary(spark, d):
    requests, matches = _screened(spark, d)
    return stats.bulk_summary(screening.screening_results(requests, matches))


@query
def export_rows(spark, d):
    requests, matches = _screened(spark, d)
    rows = reports.export_rows(screening.screening_results(requests, matches))
    return rows.toDF("nombre", "documento", "pais", "resultado", "coincidencias", "recomendacion")


@query
def audit_entries(spark, d):
    requests, matches = _screened(spark, d)
    results = screening.screening_results(requests, matches).withColumns({
        "operator_id": F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("op"), F.col("request_id").cast("string"))),
        "analyst": F.when(F.col("request_id") % 3 == 1, F.col("lang")).otherwise(""),
        "decision": F.col("recommendation"),
    })
    entries = audit.audit_entries(results, F.lit("2024-01-01T00:00:00"))
    return entries.select(
        "screening_id", "timestamp", F.col("input.name").alias("name"), F.col("input.document").alias("document"), "operator",
        F.col("result.is_hit").alias("is_hit"), F.col("result.match_count").alias("match_count"),
        F.col("result.top_score").alias("top_score"), "decision",
    )


@query
def report_json(spark, d):
    """JSON documents, read back by path so that both engines can compare them."""
    entities = materialized(V.nested_entities(spark, d), "entities")
    requests, matches = _screened(spark, d, entities)
    detailed = reports.detailed_matches(matches, entities)
    made = reports.json_reports(screening.screening_results(requests, matches), detailed, F.lit("2024-01-01"))
    at = lambda p: F.get_json_object("report", p)
    return made.select(
        "request_id",
        at("$.screening_info.input_name").alias("input_name"),
        at("$.screening_info.match_count").cast("long").alias("match_count"),
        at("$.matches[0].matched_name").alias("first_name"),
        at("$.matches[0].details.date_of_birth").alias("first_dob"),
        at("$.matches[0].program").alias("first_program"),
        at("$.screening_configuration.algorithm_version").alias("algorithm_version"),
    )


@query
def stream_screen(spark, d):
    """The requests, each sent twice within a second, as a stream of files screened batch by batch."""
    folder, out, state = _fresh(spark, "incoming"), _fresh(spark, "out"), _fresh(spark, "state")
    start = F.lit("2024-01-01 10:00:00").cast("timestamp")
    sent = V.requests(spark, d).withColumns({"analyst_id": F.col("request_id").cast("string"), "created_at": start})
    again = sent.withColumn("created_at", F.timestamp_add("MILLISECOND", F.lit(300), start))
    sent.unionByName(again).write.parquet(folder)
    arriving = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    writer = stream_screening.screen_stream(arriving, _lists(spark, d), out, state)
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out).select(*MATCH_COLUMNS, joined("flags").alias("flags"))


# --- relational ------------------------------------------------------------------------------------

@query
def entity_nested(spark, d):
    e = V.entities(spark, d)
    names = V.entity_names(spark, d).select("source", "entity_id", "position", "name")
    documents = V.entity_documents(spark, d).select("source", "entity_id", "document_type", "document_number")
    tokens = _tokens(spark, d)
    whole = tables.nested(
        tables.live(e).select("source", "entity_id", "primary_name"), ["source", "entity_id"],
        {"aliases": names, "documents": documents, "tokens": tokens},
    )
    return whole.select(
        "source", "entity_id", "primary_name", joined(F.transform("aliases", lambda a: a["name"])).alias("aliases"),
        joined(F.transform("documents", lambda x: x["document_number"])).alias("documents"), F.size("tokens").alias("tokens"),
    )


@query
def request_nested(spark, d):
    requests = V.screening_requests(spark, d).select("request_id", "status")
    results = V.screening_results(spark, d).groupBy("request_id", "result_no").agg(F.max("max_confidence").alias("confidence"))
    matches = V.screening_results(spark, d).select("request_id", "result_no", "entity_key", "supplier_key")
    tree = tables.request_tree(requests, results, matches)
    return tree.select(
        "request_id", "status", F.coalesce(F.size("results"), F.lit(0)).alias("results"),
        F.aggregate(
            F.coalesce("results", F.expr("array()")), F.lit(0).cast("long"),
            lambda acc, r: acc + F.aggregate(r["matches"], F.lit(0).cast("long"), lambda a, m: a + m["entity_key"]),
        ).alias("entity_key_sum"),
    )


@query
def screening_stats(spark, d):
    return stats.screening_stats(
        V.screening_requests(spark, d), V.screening_results(spark, d), day("1996-01-01"), day("1998-12-31")
    )


@query
def status_breakdown(spark, d):
    return stats.status_breakdown(V.screening_requests(spark, d), day("1996-01-01"), day("1998-12-31"))


@query
def program_members(spark, d):
    region, nation, supplier = (V.table(spark, d, n) for n in ("region", "nation", "supplier"))
    programs = region.select(F.col("r_regionkey").alias("program_code"), F.col("r_name").alias("program"), (F.col("r_name") != "ASIA").alias("is_active"))
    memberships = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("program_code"), F.col("s_suppkey").alias("entity_id"), (F.col("s_acctbal") > 0).alias("is_active")
    )
    return tables.program_members(programs, memberships, supplier.select(F.col("s_suppkey").alias("entity_id"))).select("program", "members")


@query
def count_by_source(spark, d):
    return stats.counts_by(tables.live(V.entities(spark, d)), "source", "entity_type")


@query
def entity_rollup(spark, d):
    return stats.entity_rollup(tables.live(V.entities(spark, d)))


@query
def list_by_source(spark, d):
    page = paging.list_by_source(V.entities(spark, d), "UN", "individual", 3, 25)
    return page.select("entity_id", "primary_name", "total")


@query
def page_past_end(spark, d):
    """A page behind the last row still tells how many rows there are."""
    page = paging.list_by_source(V.entities(spark, d), "UN", None, 100_000_000, 25)
    return page.select("entity_id", "primary_name", "total")


@query
def page_after_key(spark, d):
    """The page behind a row, by key instead of offset."""
    orders = V.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return paging.page_after(orders, ["o_custkey", "o_orderkey"], [10, 200], 50)


@query
def query_stats(spark, d):
    s = stats.query_stats(V.operations(spark, d))
    return s.withColumn("last_executed", F.date_format("last_executed", "yyyy-MM-dd HH:mm:ss"))


@query
def slow_operations(spark, d):
    return stats.slow_operations(V.operations(spark, d)).select("operation", "slow_queries")


@query
def latency_histogram(spark, d):
    return stats.latency_histogram(V.operations(spark, d))


@query
def latency_p95(spark, d):
    return stats.latency_p95(V.operations(spark, d), True).withColumn("p95_ms", F.round("p95_ms", 6))


@query
def latency_p95_sketch(spark, d):
    """The form that monitoring uses; with few calls per user the sketch is exact."""
    return stats.latency_p95(V.operations(spark, d), False, "operation", "user_id").withColumn("p95_ms", F.round("p95_ms", 6))


@query
def latency_quantile(spark, d):
    q = stats.histogram_quantile(stats.latency_histogram(V.operations(spark, d)), 0.95, "operation", "status")
    return q.withColumn("quantile_seconds", F.round("quantile_seconds", 6))


def _statements(spark, d) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.select(
        F.concat(F.when(F.col("event_type") == "view", "UPDATE").otherwise("SELECT"), F.lit(" * FROM t_"), F.col("user_id").cast("string"), F.lit(" -- "), "event_type").alias("query"),
        F.col("value").alias("exec_ms"),
    )


@query
def top_statements(spark, d):
    return stats.top_statements(_statements(spark, d))


@query
def nplus1(spark, d):
    cheap = _statements(spark, d).withColumn("exec_ms", F.col("exec_ms") / 8)
    return stats.n_plus_one(cheap)


@query
def hash_history(spark, d):
    """The last ten file digests kept per file: orders as files of a customer."""
    kept = paging.newest_per_group(
        V.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"],
        [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 10,
    )
    return kept.select("o_custkey", "o_orderkey")


@query
def last_events(spark, d):
    return paging.newest(V.audit_logs(spark, d), "timestamp", "log_id", 100).select("log_id", "action")


@query
def latest_update(spark, d):
    per = paging.latest_per_group(V.audit_logs(spark, d), "action", "timestamp")
    return per.select("action", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("latest", "oldest")])


@query
def active_sources(spark, d):
    sources = V.table(spark, d, "supplier").select(F.col("s_name").alias("code"), (F.col("s_acctbal") > 5000).alias("is_active"))
    return paging.active(sources).select("code")


@query
def all_entities(spark, d):
    both = ofac(spark, d).unionByName(un_people(spark, d))
    return both.select("source", "entity_id", "entity_type", "primary_name", "un_committee")


@query
def dedup_requests(spark, d):
    """Equal requests of one analyst within one second: each event twice, the copy some hundred milliseconds later."""
    log = V.audit_logs(spark, d)
    late = log.withColumns({"log_id": -F.col("log_id") - 1, "timestamp": F.timestamp_add("MILLISECOND", F.lit(400), F.col("timestamp"))})
    both = log.unionByName(late).withColumn("second", F.date_trunc("second", "timestamp"))
    first = tables.first_per_request(both, ["action", "props", "actor_id", "second"], [F.col("timestamp"), F.col("log_id")])
    return first.select("log_id", "action", "actor_id", F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("second"))


# --- table versions ----------------------------------------------------------------------------------

@query
def upsert_insert(spark, d):
    """Suppliers as the old table, customers as the new rows, names cut to their numbers as the key."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    old = V.table(spark, d, "supplier").select(number("s_name").alias("code"), F.col("s_suppkey").alias("id"))
    new = V.table(spark, d, "customer").select((number("c_name") - number("c_name") % 3).alias("code"), F.col("c_custkey").alias("id"))
    accepted, rejected = tables.insert_or_reject(old, new, ["code"], [F.col("id")])
    return accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))


def _versioned(spark, d) -> DataFrame:
    return _normalized_entities(spark, d).select(
        "source", "entity_id", "primary_name", "normalized_name", "nationality", "is_deleted",
        F.lit(1).alias("version"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


@query
def apply_updates(spark, d):
    """One update for most entities; two for persons and for vessels, whose second one clears a field."""
    entity = V.entities(spark, d)
    none = F.lit(None).cast("string")
    person, vessel = F.col("entity_type") == "individual", F.col("entity_type") == "vessel"
    first = entity.filter(F.col("entity_type") != "aircraft").select(
        "source", "entity_id", F.when(person, F.concat("primary_name", F.lit(" é"))).alias("primary_name"),
        F.upper("nationality").alias("nationality"), F.array().cast("array<string>").alias("cleared"), F.lit(1).alias("n"),
    )
    second = entity.filter(person | vessel).select(
        "source", "entity_id", none.alias("primary_name"), F.when(person, F.lower("nationality")).alias("nationality"),
        F.when(vessel, F.array(F.lit("nationality"))).alias("cleared"), F.lit(2).alias("n"),
    )
    updates = second.unionByName(first)
    changed = tables.apply_updates(
        _versioned(spark, d), updates, ["source", "entity_id"], ["primary_name", "nationality"], day("2024-01-01"), ["n"], "cleared"
    )
    return changed.select("source", "entity_id", "primary_name", "normalized_name", "nationality", "version", F.col("updated_at").isNotNull().alias("touched"))


@query
def soft_delete(spark, d):
    keys = V.entities(spark, d).filter(F.col("entity_type") == "vessel")
    gone = tables.soft_delete(_versioned(spark, d), keys, ["source", "entity_id"], day("2024-01-01"))
    return gone.select("source", "entity_id", "is_deleted", F.col("deleted_at").isNotNull().alias("deleted_now"))


@query
def request_completion(spark, d):
    """Events as requests: most end some milliseconds later, errors fail, purchases had ended before and have no new outcome."""
    events = V.table(spark, d, "events")
    bought, failed = F.col("event_type") == "purchase", F.col("event_type") == "error"
    after = lambda ms: F.timestamp_add("MILLISECOND", ms, F.col("ts"))
    took = F.floor("value").cast("int")
    requests = events.select(
        F.col("event_id").alias("request_id"), F.when(bought, "completed").otherwise("processing").alias("status"), F.col("ts").alias("processing_start"),
        F.when(bought, after(F.lit(7))).alias("processing_end"), F.when(bought, F.lit(7)).cast("bigint").alias("processing_time_ms"),
        F.when(bought, "old").alias("error_message"),
    )
    outcomes = events.filter(~bought).select(
        F.col("event_id").alias("request_id"), after(took).alias("processing_end"), F.when(failed, "FAILED").alias("error_code"),
        F.when(failed, F.col("props")).alias("error_message"), F.lit("2.0.0").alias("algorithm_version"),
    )
    early = outcomes.withColumn("processing_end", F.timestamp_add("MILLISECOND", F.lit(-1), F.col("processing_end"))).withColumn("error_code", F.lit("EARLY"))
    done = tables.finish_requests(requests, outcomes.unionByName(early))
    return done.select("request_id", "status", "processing_time_ms", "error_code", "error_message", "algorithm_version", F.date_format("processing_end", "HH:mm:ss.SSS").alias("ended"))


@query
def source_status(spark, d):
    sources = V.table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    updates = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("update_id"), F.col("o_custkey").alias("source_code"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("completed_at"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_entities"),
    )
    s = tables.source_status(sources, updates)
    return s.select("code", "name", F.date_format("last_update", "yyyy-MM-dd").alias("last_update"), "last_update_status", "last_entity_count")


@query
def list_diff(spark, d):
    """The list against a next version: some entities gone, some changed, the pages added."""
    old = V.entities(spark, d).select("source", "entity_id", "primary_name", "nationality")
    kept = V.entities(spark, d).filter(F.col("entity_type") != "aircraft").select(
        "source", "entity_id", "primary_name", F.when(F.col("entity_type") == "vessel", F.lit("Nauru")).otherwise(F.col("nationality")).alias("nationality")
    )
    added = V.table(spark, d, "pages").select(
        F.lit("UN").alias("source"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("entity_id"), F.col("url").alias("primary_name"), F.lit("Chad").alias("nationality")
    )
    return tables.list_diff(old, kept.unionByName(added), ["source", "entity_id"], ["primary_name", "nationality"])


@query
def list_diff_counts(spark, d):
    return tables.diff_counts(list_diff(spark, d))


@query
def cascade_delete(spark, d):
    deleted = V.table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("request_id"))
    stay = tables.cascade_delete(V.screening_results(spark, d), deleted, ["request_id"])
    nulled = tables.set_null_on_delete(stay, V.table(spark, d, "part").filter(F.col("p_size") > 25), "entity_key", "p_partkey")
    return nulled.groupBy("request_id").agg(F.count(F.lit(1)).alias("results"), F.count("entity_key").alias("linked"))


@query
def reload_report(spark, d):
    """Both lists written as XML files, loaded as a new version, compared with the live table."""
    ofac_path, un_path = _fresh(spark, "ofac.xml"), _fresh(spark, "un.xml")
    raw_people = xml_lists.parse_rows(un_person_xml(spark, d), "xml", schemas.UN_INDIVIDUAL, "INDIVIDUAL")
    for rows, root, tag, path in (
        (raw_ofac(spark, d), "sanctions", "entity", ofac_path), (raw_people, "INDIVIDUALS", "INDIVIDUAL", un_path)
    ):
        writer = rows.write.format("xml").option("rootTag", root).option("rowTag", tag)
        writer.option("attributePrefix", "_").option("valueTag", "_VALUE").save(path)
    done = reload.reload_lists(spark, ofac_path, un_path, config=DEFAULT.with_(malformed_percent=5.0))
    return done.report.withColumns({"errors": F.size("errors"), "warnings": F.size("warnings")})


# --- relational tables ----------------------------------------------------------------------------------

def _persisted(spark, rows: DataFrame, name: str, columns: list[str] | None = None, near: str | None = None) -> DataFrame:
    """Written twice, as a repeated job would, and read back."""
    folder = _fresh(spark, "tables")
    persist.append(rows, folder, name, day("2024-01-01"))
    persist.append(rows, folder, name, day("2024-01-02"))
    return persist.read(spark, folder, name, columns, near)


def _entity_id() -> Column:
    return persist.key("sanctioned_entities", F.col("entity_id"), F.col("source"))


@query
def persist_entities(spark, d):
    rows = V.entities(spark, d).withColumnRenamed("entity_id", "external_id")
    return _persisted(spark, rows, "sanctioned_entities").select(
        "id", "external_id", "source", "entity_type", "primary_name", "normalized_name", "vessel_imo", "is_deleted", "version", F.date_format("updated_at", "yyyy-MM-dd").alias("updated")
    )


@query
def persist_aliases(spark, d):
    names = V.entity_names(spark, d)
    rows = names.select(_entity_id().alias("entity_id"), F.col("name").alias("alias_name"), (F.col("position") == 0).alias("is_primary"))
    return _persisted(spark, rows, "entity_aliases").select("id", "entity_id", "alias_name", "normalized_alias", "is_primary")


@query
def persist_documents(spark, d):
    rows = V.entity_documents(spark, d).select(_entity_id().alias("entity_id"), "document_type", "document_number")
    return _persisted(spark, rows, "identity_documents").select("id", "entity_id", "document_type", "normalized_number", "issuing_country")


@query
def persist_requests(spark, d):
    rows = V.screening_requests(spark, d).select(
        F.col("request_id").cast("string").alias("request_key"), "status", "request_type", F.col("analyst_id").cast("string").alias("analyst_id"),
        F.col("created_at").alias("processing_start"),
    )
    return _persisted(spark, rows, "screening_requests").select("id", "request_key", "status", "analyst_id", F.date_format("processing_start", "yyyy-MM-dd").alias("started"), "error_code")


@query
def persist_results(spark, d):
    """Results and their requests, joined again by id."""
    request = persist.key("screening_requests", F.col("request_id").cast("string"))
    all_results = V.screening_results(spark, d).withColumn("result_no", F.row_number().over(Window.partitionBy("request_id").orderBy("result_no", "entity_key", "supplier_key")))
    results = all_results.select(request.alias("request_id"), F.col("result_no").cast("int").alias("result_no"), "is_hit", "max_confidence")
    kept = _persisted(spark, results, "screening_results", ["request_id", "result_no", "is_hit", "max_confidence"], "request_id")
    requests = V.screening_requests(spark, d).select(persist.key("screening_requests", F.col("request_id").cast("string")).alias("request_id"), F.col("request_id").alias("request_no"))
    return kept.join(requests, "request_id").select("request_no", "result_no", "is_hit", "max_confidence")


@query
def persist_audit(spark, d):
    rows = V.audit_logs(spark, d).select(
        F.col("log_id").cast("string").alias("log_key"), "timestamp", "action", "resource_type", F.col("actor_id").cast("string").alias("actor_id"), F.col("props").alias("details"), "success",
    )
    return _persisted(spark, rows, "audit_logs").select("id", "log_key", "action", "actor_id", "details", "success", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def persist_sources(spark, d):
    """Reference rows of the installation beside the suppliers as further sources."""
    more = V.table(spark, d, "supplier").select(F.col("s_name").alias("code"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("is_active"))
    return _persisted(spark, seeds.seed_data_sources(more), "data_sources").select("id", "code", "name", "source_type", "file_format", "is_active", "update_frequency_days", "validate_xsd")


# --- audit -------------------------------------------------------------------------------------------

@query
def audit_search(spark, d):
    found = audit.search(
        V.audit_logs(spark, d), action="click", resource_type="request", start=day("2024-01-05"), end=day("2024-01-25"), offset=5, limit=50
    )
    return found.select("log_id", "actor_id", "total")


def _trail(spark, d) -> DataFrame:
    return V.audit_logs(spark, d).select(
        F.concat(F.lit("S"), F.col("log_id").cast("string")).alias("screening_id"), F.col("timestamp"),
        F.struct(F.col("action").alias("name"), F.col("props").alias("document"), F.lit(None).cast("string").alias("country")).alias("input"),
        F.when(F.col("actor_id") % 2 == 0, F.col("success")).alias("is_hit"), F.struct(F.col("success").alias("is_hit")).alias("result"),
        F.col("resource_type").alias("decision"),
    )


@query
def audit_by_id(spark, d):
    return audit.by_id(_trail(spark, d), "S77").select("screening_id", "decision")


@query
def audit_by_range(spark, d):
    return audit.by_range(_trail(spark, d), F.col("timestamp"), day("2024-01-10"), day("2024-01-12")).select("screening_id", "decision")


@query
def audit_table(spark, d):
    return audit.audit_table(_trail(spark, d)).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query
def audit_changes(spark, d):
    """Old and new row of every order as JSON; the keys that changed."""
    o = V.table(spark, d, "orders")
    old = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit("1").alias("v")))
    new = F.to_json(F.struct(F.lit("F").alias("status"), F.regexp_replace("o_orderpriority", "LOW", "NONE").alias("priority"), F.lit("2").alias("w")))
    keys = F.sort_array(F.map_keys(audit.changed_keys(old, new)))
    return o.select("o_orderkey", joined(keys).alias("changed"))


@query
def request_pairs(spark, d):
    """Orders as requests, their shipments as answers."""
    asked = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit("REQUEST").alias("event"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("int").alias("status_code"))
    answered = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ts"), F.max("l_linenumber").alias("c")).select(
        F.col("l_orderkey").alias("request_id"), F.when(F.col("c") > 6, "ERROR").otherwise("RESPONSE").alias("event"), "ts", F.col("c").alias("status_code")
    )
    pairs = audit.request_pairs(asked.unionByName(answered))
    return pairs.select("request_id", "outcome", "status_code", F.datediff("answered_at", "requested_at").alias("days"))


# --- windows ------------------------------------------------------------------------------------------

@query
def error_rate_5m(spark, d):
    w = stats.error_rate_windows(V.operations(spark, d))
    return w.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


@query
def p95_5m(spark, d):
    w = stats.p95_windows(V.operations(spark, d))
    return w.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}).withColumn("p95_ms", F.round("p95_ms", 6))


def _told_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


@query
def alert_episodes(spark, d):
    """When the error rate and the latency of each operation broke their rule, and whether long enough to page."""
    operations = V.operations(spark, d)
    evaluations = alerts.error_rate_rule(operations, "operation", percent=0).unionByName(alerts.latency_rule(operations, "operation"))
    return _told_times(alerts.episodes(evaluations, "operation"), "pending_at", "firing_at", "resolved_at").withColumn("peak", F.round("peak", 6))


@query
def alert_firing(spark, d):
    """The minutes at which the error rate over all operations has been too high for five minutes."""
    return _told_times(alerts.firing(alerts.error_rate_rule(V.operations(spark, d))).drop("rule"), "firing_at")


@query
def alert_episodes_stream(spark, d):
    """The error rate over all operations as a stream of files; a later call ends the last episode."""
    folder, out, state = _fresh(spark, "calls"), _fresh(spark, "episodes"), _fresh(spark, "state")
    calls = V.operations(spark, d).select("operation", "is_error", F.col("ts").cast("timestamp").alias("ts"))
    last = calls.agg(F.lit("end").alias("operation"), F.lit(False).alias("is_error"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    calls.unionByName(last).write.parquet(folder)
    arriving = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder).withWatermark("ts", "10 minutes")
    found = alerts.episodes(alerts.error_rate_rule(arriving))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    told = _told_times(spark.read.schema(found.schema).parquet(out), "pending_at", "firing_at", "resolved_at")
    return told.withColumn("peak", F.round("peak", 6))


@query
def rate_quantile_5m(spark, d):
    """95th percentile from the rates of cumulative buckets, sampled each minute and begun anew each day."""
    found = rates.rate_quantile(rates.scraped(V.operations(spark, d)), 0.95, "operation")
    return _told_times(found, "window_start", "window_end").withColumn("quantile_seconds", F.round("quantile_seconds", 9))


@query
def counter_rates_5m(spark, d):
    samples = rates.scraped(V.operations(spark, d)).filter(F.col("le") == "+Inf")
    found = rates.rates(samples, "operation")
    return _told_times(found, "window_start", "window_end").withColumn("per_second", F.round("per_second", 9))


def _asked_and_answered(spark, d) -> tuple[DataFrame, DataFrame]:
    asked = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("requested_at"))
    shipped = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("answered_at"), F.max("l_linenumber").alias("status_code"))
    outcome = F.when(F.col("status_code") > 6, "ERROR").otherwise("RESPONSE").alias("outcome")
    return asked, shipped.select(F.col("l_orderkey").alias("request_id"), "answered_at", outcome, "status_code")


def _told_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("request_id", "outcome", "status_code", F.datediff("answered_at", "requested_at").alias("days"))


@query
def request_pairs_within(spark, d):
    """Orders as requests, their last shipments as answers if within sixty days."""
    return _told_pairs(pairing.pairs_within(*_asked_and_answered(spark, d), "60 days"))


@query
def request_pairs_stream(spark, d):
    """The same from two streams of files; a later row without an id on each side makes the last ones time out."""
    asked, answered = _asked_and_answered(spark, d)
    folders = [_fresh(spark, "asked"), _fresh(spark, "answered")]
    end = F.expr("timestamp '2100-01-01 00:00:00'")
    for frame, folder, at in zip((asked, answered), folders, ("requested_at", "answered_at")):
        late = frame.agg(*[end.alias(c) if c == at else F.lit(None).cast(t).alias(c) for c, t in frame.dtypes])
        frame.unionByName(late).write.parquet(folder)
    arriving = [spark.readStream.schema(spark.read.parquet(f).schema).parquet(f) for f in folders]
    out, state = _fresh(spark, "pairs"), _fresh(spark, "state")
    paired = pairing.pair_stream(*arriving, "60 days", "1 day")
    paired.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return _told_pairs(spark.read.schema(paired.schema).parquet(out))


def _literal_statements(spark, d) -> DataFrame:
    """A statement for each order: the same few forms with its own literals, lists, comments and white space."""
    o, number = V.table(spark, d, "orders"), F.col("o_custkey").cast("string")
    one = F.concat(F.lit("SELECT * FROM entities WHERE id = "), number, F.lit(" AND priority = '"), "o_orderpriority", F.lit("'"))
    ending = F.when(F.col("o_orderkey") % 2 == 0, F.lit(", 7 )")).otherwise(F.lit(")"))
    many = F.concat(F.lit("SELECT  name FROM t_2\n WHERE id IN ("), number, F.lit(", "), F.col("o_orderkey").cast("string"), ending, F.lit(" -- order "), number)
    write = F.concat(F.lit("UPDATE requests SET total = "), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(" WHERE note = 'it''s "), number, F.lit("'"))
    said = F.when(F.col("o_orderstatus") == "O", one).when(F.col("o_orderstatus") == "F", many).otherwise(write)
    return o.select(said.alias("query"), (F.col("o_orderkey") % 16).cast("double").alias("exec_ms"))


@query
def nplus1_literals(spark, d):
    """Frequent, fast statements that differ in their literals only."""
    return stats.n_plus_one(stats.fingerprinted(_literal_statements(spark, d)))


@query
def top_fingerprints(spark, d):
    return stats.top_statements(stats.fingerprinted(_literal_statements(spark, d)))


@query
def frequent_statements(spark, d):
    return stats.frequent_statements(_literal_statements(spark, d))


@query
def stream_screen_versions(spark, d):
    """The requests in two files; between the micro batches the current list takes the place of the former one."""
    folder, out, state = _fresh(spark, "incoming"), _fresh(spark, "out"), _fresh(spark, "state")
    requests = V.requests(spark, d)
    requests.filter(F.col("lang") == "en").coalesce(1).write.mode("append").parquet(folder)
    versions = stream_screening.ListVersions()
    versions.publish("former", _former_list(spark, d))
    arriving = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    writer = stream_screening.screen_stream_versions(arriving, versions, out, state)
    writer.trigger(availableNow=True).start().awaitTermination()
    requests.filter(F.coalesce(F.col("lang") != "en", F.lit(True))).coalesce(1).write.mode("append").parquet(folder)
    versions.publish("current", V.nested_entities(spark, d))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("list_version").agg(F.countDistinct("request_id").alias("requests"), F.count(F.lit(1)).alias("matches"))


WEIGHTS_OF_TOKENS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def _token_searches(spark, d) -> DataFrame:
    words = F.split(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "), " ")
    return V.requests(spark, d).select(F.col("request_id").alias("search_id"), F.explode(F.filter(words, lambda w: w != "")).alias("token"))


@query
def token_search_topk(spark, d):
    """The best three entities of every search, from stored postings."""
    found = postings.best_by_tokens(postings.weighted(_tokens(spark, d), WEIGHTS_OF_TOKENS), _token_searches(spark, d), 3)
    return found.rows.withColumn("rank", F.round("rank", 6))


@query
def token_search_merged(spark, d):
    """The same from the postings of a former list, without aircraft and with other names of vessels, and a segment of what has changed."""
    now = materialized(_tokens(spark, d), "tokens")
    kind = materialized(V.entities(spark, d).select("source", "entity_id", "entity_type"), "kinds")
    of_kind = lambda *kinds: now.join(kind.filter(F.col("entity_type").isin(*kinds)), ["source", "entity_id"], "left_semi")
    renamed = of_kind("vessel").withColumn("token", F.reverse("token"))
    former = postings.weighted(of_kind("individual", "entity").unionByName(renamed), WEIGHTS_OF_TOKENS)
    fresh = postings.weighted(of_kind("vessel", "aircraft"), WEIGHTS_OF_TOKENS, former.segments)
    index = postings.merged(former, fresh, kind.filter(F.col("entity_type") == "vessel"))
    return postings.best_by_tokens(index, _token_searches(spark, d), 3).rows.withColumn("rank", F.round("rank", 6))


@query
def repo_name_search_indexed(spark, d):
    found = postings.best_by_trigrams(postings.sized(_normalized_entities(spark, d)), "Oferonren enllementaux", 0.05, 100).rows
    return found.select("source", "entity_id", "primary_name", F.round("similarity", 6).alias("similarity"))


@query
def page_by_rank(spark, d):
    """A page from the middle of all lines, by price, and one past the end."""
    lines = V.table(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    pages = paging.RankedPages(lines, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")])
    return pages.page(pages.total // 2, 250).withColumn("part", F.lit("middle")).unionByName(pages.page(pages.total - 7, 250).withColumn("part", F.lit("end")))


@query
def entity_nested_colocated(spark, d):
    """``entity_nested`` from tables that are stored by the entity's key."""
    store = colocated.Store(spark, ["source", "entity_id"], 8)
    e = V.entities(spark, d)
    store.put("parents", tables.live(e).select("source", "entity_id", "primary_name"))
    store.put("aliases", V.entity_names(spark, d).select("source", "entity_id", "position", "name"))
    store.put("documents", V.entity_documents(spark, d).select("source", "entity_id", "document_type", "document_number"))
    store.put("tokens", _tokens(spark, d))
    whole = materialized(store.nested("parents", ["aliases", "documents", "tokens"]), "nested")
    store.drop()
    return whole.select(
        "source", "entity_id", "primary_name", joined(F.transform("aliases", lambda a: a["name"])).alias("aliases"),
        joined(F.transform("documents", lambda x: x["document_number"])).alias("documents"), F.size("tokens").alias("tokens"),
    )


@query
def request_nested_colocated(spark, d):
    """``request_nested`` from tables that are stored by the request's id."""
    store = colocated.Store(spark, ["request_id"], 8)
    results = V.screening_results(spark, d)
    store.put("requests", V.screening_requests(spark, d).select("request_id", "status"))
    store.put("results", results.groupBy("request_id", "result_no").agg(F.max("max_confidence").alias("confidence")))
    store.put("matches", results.select("request_id", "result_no", "entity_key", "supplier_key"))
    tree = materialized(store.tree("requests", "results", "matches", "result_no"), "tree")
    store.drop()
    return tree.select(
        "request_id", "status", F.coalesce(F.size("results"), F.lit(0)).alias("results"),
        F.aggregate(
            F.coalesce("results", F.expr("array()")), F.lit(0).cast("long"),
            lambda acc, r: acc + F.aggregate(r["matches"], F.lit(0).cast("long"), lambda a, m: a + m["entity_key"]),
        ).alias("entity_key_sum"),
    )
