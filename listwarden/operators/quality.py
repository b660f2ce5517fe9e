"""Input validation, list completeness, report checks, freshness and table constraints."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig
from listwarden.functions.text import sanitize_input

# Fixed values: (error code, field, suggestion); the numbers come from the input rules.
SUGGESTIONS = [
    ("NAME_TOO_SHORT", "name", "Provide a name with at least {min} characters"),
    ("NAME_TOO_LONG", "name", "Shorten the name to {max} characters or less"),
    ("BLOCKED_CHARACTERS", "name", "Remove special characters like < > { } [ ] | \\ ; ` $"),
    ("CONTROL_CHARACTER", "name", "Remove invisible or control characters from the name"),
    ("INVALID_FORMAT", "name", "Use Latin characters only (A-Z, a-z, À-ÿ)"),
    ("INVALID_DOB_FORMAT", "date_of_birth", "Use format YYYY, YYYY-MM, or YYYY-MM-DD"),
    ("DOCUMENT_TOO_LONG", "document_number", "Shorten to {doc} characters or less"),
    ("INVALID_DOCUMENT_FORMAT", "document_number", "Use only alphanumeric characters, spaces, hyphens, and periods"),
]

# Accepted forms.
LATIN_NAME = r"^[A-Za-z\u00c0-\u00ff\s\-.',\u0600-\u06ff\u0400-\u04ff\u4e00-\u9fff]{2,200}$"
DOB_FORM = r"^\d{4}(-\d{2}(-\d{2})?)?$"
DOCUMENT_FORM = r"^[A-Za-z0-9\-\s.]{1,50}$"


def error_code(config: ScreeningConfig = DEFAULT) -> Column:
    """The first rule a request breaks; null when it breaks none."""
    rules = config.input_rules
    name = F.coalesce("name", F.lit(""))
    dob = F.coalesce("date_of_birth", F.lit(""))
    number = F.coalesce("document_number", F.lit(""))
    trimmed = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    without_blocked = F.translate(name, rules.blocked_characters, "")
    code = (
        F.when(F.length(trimmed) < rules.name_min_length, "NAME_TOO_SHORT")
        .when(F.length(name) > rules.name_max_length, "NAME_TOO_LONG")
        .when(F.length(without_blocked) < F.length(name), "BLOCKED_CHARACTERS")
    )
    if rules.allow_unicode_names:
        code = code.when(name.rlike(r"\p{C}"), "CONTROL_CHARACTER")
    else:
        code = code.when(~name.rlike(LATIN_NAME), "INVALID_FORMAT")
    return (
        code.when((dob != "") & ~dob.rlike(DOB_FORM), "INVALID_DOB_FORMAT")
        .when(F.length(number) > rules.document_max_length, "DOCUMENT_TOO_LONG")
        .when((number != "") & ~number.rlike(DOCUMENT_FORM), "INVALID_DOCUMENT_FORMAT")
    )


def with_validation(requests: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    rules = config.input_rules
    coded = requests.withColumn("error_code", error_code(config))
    field, suggestion = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, where, text in reversed(SUGGESTIONS):
        for name, number in (
            ("{min}", rules.name_min_length), ("{max}", rules.name_max_length), ("{doc}", rules.document_max_length)
        ):
            text = text.replace(name, str(number))
        field = F.when(F.col("error_code") == code, where).otherwise(field)
        suggestion = F.when(F.col("error_code") == code, text).otherwise(suggestion)
    return coded.withColumns({"error_field": field, "suggestion": suggestion})


def validated(requests: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """The requests that may be screened."""
    return requests.filter(error_code(config).isNull())


def rejects(requests: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    return with_validation(requests, config).filter(F.col("error_code").isNotNull())


class InvalidRequests(ValueError):
    """Raised by a bulk run that must stop at the first invalid row."""


def require_valid(requests: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    refused = rejects(requests, config).select("name", "error_code", "request_id")
    first = refused.orderBy("request_id", "name").first()
    if first is not None:
        raise InvalidRequests(f"{first['error_code']}: {first['name']!r}")
    return requests


def security_events(rejected: DataFrame, source: str = "screening") -> DataFrame:
    """Rejected requests as structured events, with the offending text cleaned."""
    offending = (
        F.when(F.col("error_field") == "name", F.col("name"))
        .when(F.col("error_field") == "date_of_birth", F.col("date_of_birth"))
        .otherwise(F.col("document_number"))
    )
    return rejected.select(
        "request_id",
        F.lit("VALIDATION_FAILED").alias("event_type"),
        F.lit("WARNING").alias("severity"),
        F.col("error_field").alias("field_name"),
        "error_code",
        sanitize_input(offending).alias("sanitized_input"),
        F.lit(source).alias("source"),
    )


def malformation_rate(raw: DataFrame, id_column: str, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Rows of a list, rows without id, their share, and whether that is too much."""
    missing = F.coalesce(F.col(id_column).cast("string"), F.lit("")) == ""
    counted = raw.agg(
        F.count(F.lit(1)).alias("entity_count"), F.count_if(missing).alias("malformed_count")
    )
    rate = F.coalesce(F.try_divide(F.col("malformed_count") * 100.0, F.col("entity_count")), F.lit(0.0))
    return counted.withColumn("malformed_percent", rate).withColumn(
        "is_error", F.col("malformed_percent") > config.malformed_percent
    )


# Parts of schema messages that set their severity.
CRITICAL_PARTS = ["missing required", "mandatory", "not allowed", "invalid content", "root element"]
WARNING_PARTS = ["unexpected element", "missing optional", "deprecated"]


def _any_part(text: Column, parts: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def severity(message: Column) -> Column:
    text = F.lower(message)
    return (
        F.when(_any_part(text, CRITICAL_PARTS), "CRITICAL")
        .when(_any_part(text, WARNING_PARTS), "WARNING")
        .otherwise("INFO")
    )


def outcome(severity_level: Column, strictness: str) -> Column:
    """error, warning or info for a severity under a strictness."""
    if strictness == "strict":
        return F.when(severity_level.isNotNull(), "error")
    critical = "warning" if strictness == "lenient" else "error"
    return (
        F.when(severity_level == "CRITICAL", critical).when(severity_level == "WARNING", "warning").otherwise("info")
    )


def schema_messages(messages: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Counts by severity and outcome. messages: (message)."""
    rated = messages.select(severity(F.col("message")).alias("severity"))
    return (
        rated.withColumn("outcome", outcome(F.col("severity"), config.xsd_strictness))
        .groupBy("severity", "outcome")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def validation_totals(messages: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    rated = messages.select(outcome(severity(F.col("message")), config.xsd_strictness).alias("outcome"))
    return rated.agg(
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "warning").alias("warnings"),
    )


def report_validation(results: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """Errors and warnings of screening results before they are reported.

    results: request_id, input_name, screening_date, is_hit, screening_id and ``matches`` of
    (matched_name, entity_id, has_breakdown). stale: the few out-of-date lists (source, days_old).
    """
    matches = F.coalesce("matches", F.expr("array()").cast("array<struct<matched_name:string,entity_id:string,has_breakdown:boolean>>"))
    numbered = F.transform(matches, lambda m, i: F.struct((i + 1).cast("string").alias("n"), m.alias("m")))

    def per_match(test, text: str) -> Column:
        return F.transform(
            F.filter(numbered, lambda p: test(p["m"])),
            lambda p: F.concat(F.lit("Match "), p["n"], F.lit(text)),
        )

    def missing(column: str) -> Column:
        return F.when(F.col(column).isNull(), f"Missing required field: {column}")

    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    errors = F.concat(
        F.array_compact(F.array(missing("input_name"), missing("screening_date"), missing("is_hit"))),
        per_match(lambda m: empty(m["matched_name"]), " has empty matched_name"),
    )
    warnings = F.concat(
        F.array_compact(F.array(F.when(empty(F.col("screening_id")), "No screening_id provided, generating one"))),
        per_match(lambda m: ~F.coalesce(m["has_breakdown"], F.lit(False)), " missing confidence breakdown"),
        per_match(lambda m: empty(m["entity_id"]), " has no entity_id"),
    )
    checked = results.select("request_id", errors.alias("errors"), warnings.alias("warnings"))
    if stale is not None:
        notes = stale.agg(
            F.sort_array(
                F.collect_list(F.concat(F.lit("STALE DATA: "), "source", F.lit(" is "), F.col("days_old").cast("string"), F.lit(" days old")))
            ).alias("notes")
        )
        checked = checked.join(F.broadcast(notes), F.lit(True)).withColumn(
            "warnings", F.concat("warnings", "notes")
        ).drop("notes")
    return checked.withColumn("is_valid", F.size("errors") == 0)


def stale_sources(sources: DataFrame, now: Column, days: int = DEFAULT.freshness_days) -> DataFrame:
    """Lists whose last update is more than ``days`` old at ``now``."""
    old = sources.filter(F.col("last_update") < now - F.expr(f"INTERVAL {days} DAYS"))
    return old.select("source", F.floor(seconds_between(F.col("last_update"), now) / 86400).alias("days_old"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row rules, in one pass. A rule is a condition that must not hold."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def not_allowed(column: str, allowed: list[str]) -> Column:
    return ~F.col(column).isin(allowed)


def duplicate_keys(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    """(rule, violations): rows beyond the first of each key."""
    extra = df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("long").alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )


def orphan_counts(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(foreign_key, orphans) for each (name, child, child column, parent, parent column)."""
    parts = []
    for name, child, child_key, parent, parent_key in checks:
        keys = child.select(F.col(child_key).alias("k")).filter(F.col("k").isNotNull())
        # Count children per key first, so that a hot parent key is one row in the join.
        counted = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        orphans = counted.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
        parts.append(
            orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphans")).select(
                F.lit(name).alias("foreign_key"), "orphans"
            )
        )
    return functools.reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)
