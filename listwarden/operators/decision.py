"""Scores, layers, flags and recommendations of candidate pairs: projections only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig

EXACT_NATIONALITY = "NATIONALITY_EXACT_MATCH_INFO"
SUBSTRING_NATIONALITY = "NATIONALITY_SUBSTRING_MATCH_INFO"
MIN_SUBSTRING = 4


def dob_score(request_year: Column, entity_year: Column) -> Column:
    """100 less 20 per year apart, not below 0; 0 when a year is missing or zero."""
    score = F.greatest(F.lit(0.0), F.lit(100.0) - 20.0 * F.abs(request_year - entity_year))
    known = (request_year > 0) & (entity_year > 0)
    return F.when(known, score).otherwise(F.lit(0.0))


def wanted_countries(nationality: Column, country: Column) -> Column:
    filled = F.filter(F.array(nationality, country), lambda c: c.isNotNull() & (c != ""))
    return F.array_distinct(F.transform(filled, lambda c: F.upper(c)))


def listed_countries(countries: Column, nationality: Column, citizenship: Column) -> Column:
    every = F.concat(F.coalesce(countries, F.array().cast("array<string>")), F.array(nationality, citizenship))
    filled = F.filter(every, lambda c: c.isNotNull() & (c != ""))
    return F.sort_array(F.array_distinct(F.transform(filled, lambda c: F.upper(c))))


def _affix(a: Column, b: Column) -> Column:
    long_enough = F.least(F.length(a), F.length(b)) >= MIN_SUBSTRING
    return long_enough & (b.startswith(a) | b.endswith(a) | a.startswith(b) | a.endswith(b))


def nationality_flag(wanted: Column, listed: Column) -> Column:
    """Exact overlap first, then a prefix or suffix of at least four characters; null if neither."""
    near = F.exists(wanted, lambda a: F.exists(listed, lambda b: _affix(a, b)))
    return F.when(F.arrays_overlap(wanted, listed), EXACT_NATIONALITY).when(near, SUBSTRING_NATIONALITY)


def overall_score(name: Column, document: Column, dob: Column, config: ScreeningConfig = DEFAULT) -> Column:
    w = config.weights
    total = name * w.name + document * w.document + dob * w.dob
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def match_layer(
    name: Column, document: Column, dob: Column, nat_flag: Column, config: ScreeningConfig = DEFAULT
) -> Column:
    layers = config.layers
    backed = nat_flag.isNotNull() | (dob >= 60)
    return (
        F.when(document == 100, 1)
        .when((name >= layers.high) & backed, 2)
        .when(name >= layers.moderate, 3)
        .otherwise(4)
    )


def match_flags(
    document: Column, has_document: Column, is_short: Column, reason: Column,
    is_common: Column, nat_flag: Column, entity_type: Column,
) -> Column:
    adaptive = is_short & ~reason.isin("default", "latin_default")
    return F.array_compact(
        F.array(
            F.when(document == 100, "DOCUMENT_MATCH"),
            F.when(is_short, "SHORT_NAME_QUERY"),
            F.when(adaptive, F.concat(F.lit("ADAPTIVE_THRESHOLD_"), F.upper(reason))),
            F.when(is_common, "COMMON_NAME"),
            nat_flag,
            F.when((document == 0) & has_document, "NO_DOCUMENT_MATCH"),
            F.when(entity_type == "entity", "ENTITY_MATCH"),
            F.when(is_common & (document == 0), "COMMON_NAME_REQUIRES_SECONDARY_VALIDATION"),
        )
    )


def recommendation(
    overall: Column, is_common: Column, document: Column, config: ScreeningConfig = DEFAULT
) -> Column:
    r = config.recommendations
    capped = is_common & (document == 0)
    return (
        F.when((overall >= r.escalate) & ~capped, "AUTO_ESCALATE")
        .when(overall >= r.review, "MANUAL_REVIEW")
        .when(overall >= r.clear, "LOW_CONFIDENCE_REVIEW")
        .otherwise("AUTO_CLEAR")
    )


def confidence_band(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "medium").otherwise("low")


def sub_score_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")
