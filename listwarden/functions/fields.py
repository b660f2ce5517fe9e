"""Entity fields from the raw rows of the two XML lists: column expressions over nested arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURE_KINDS = [
    "date_of_birth", "place_of_birth", "nationality", "citizenship", "gender", "title",
    "vessel_imo", "aircraft_registration", "crypto",
]


def _array(column: Column, element: str) -> Column:
    return F.coalesce(column, F.array().cast(f"array<{element}>"))


def present(text: Column) -> Column:
    """Trimmed text; null when empty."""
    return F.when(text != "", F.trim(text))


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def translations(names: Column) -> Column:
    """All name translations of an entity, in document order."""
    kind = "struct<formattedFullName:string,formattedFirstName:string,formattedLastName:string>"
    groups = F.transform(
        _array(names["name"], f"struct<translations:struct<translation:array<{kind}>>>"),
        lambda n: _array(n["translations"]["translation"], kind),
    )
    return F.flatten(groups)


def all_names(translated: Column) -> Column:
    """Full names, trimmed, repeats dropped, first order kept."""
    filled = F.filter(translated, lambda t: F.coalesce(t["formattedFullName"], F.lit("")) != "")
    return F.array_distinct(F.transform(filled, lambda t: F.trim(t["formattedFullName"])))


def first_filled(translated: Column, part: str) -> Column:
    return _first(F.filter(F.transform(translated, lambda t: present(t[part])), lambda v: v.isNotNull()))


def entity_type(raw: Column) -> Column:
    return F.lower(F.coalesce(raw, F.lit("entity")))


def identity_documents(first_spelling: Column, second_spelling: Column) -> Column:
    """Documents of both spellings; a document without a number is dropped."""
    one = F.transform(
        _array(first_spelling, "struct<type:string,number:string,issuedByCountry:string,issueDate:string,expirationDate:string,note:string>"),
        lambda d: F.struct(
            d["type"].alias("type"), present(d["number"]).alias("number"),
            present(d["issuedByCountry"]).alias("issuing_country"), present(d["issueDate"]).alias("issue_date"),
            present(d["expirationDate"]).alias("expiration_date"), present(d["note"]).alias("note"),
        ),
    )
    two = F.transform(
        _array(second_spelling, "struct<type:string,documentNumber:string,issuingCountry:string,issueDate:string,expirationDate:string>"),
        lambda d: F.struct(
            present(d["type"]).alias("type"), present(d["documentNumber"]).alias("number"),
            present(d["issuingCountry"]).alias("issuing_country"), present(d["issueDate"]).alias("issue_date"),
            present(d["expirationDate"]).alias("expiration_date"), F.lit(None).cast("string").alias("note"),
        ),
    )
    numbered = F.filter(F.concat(one, two), lambda d: d["number"].isNotNull())
    return F.transform(
        numbered, lambda d: d.withField("type", F.coalesce(F.nullif(d["type"], F.lit("")), F.lit("Unknown")))
    )


def features(raw: Column) -> Column:
    typed = F.filter(
        _array(raw, "struct<type:struct<_VALUE:string,_featureTypeId:string>,value:string,reliability:string>"),
        lambda f: f["type"].isNotNull(),
    )
    return F.transform(
        typed,
        lambda f: F.struct(
            F.coalesce(F.nullif(f["type"]["_VALUE"], F.lit("")), F.lit("Unknown")).alias("type"),
            F.trim(F.coalesce(f["value"], F.lit(""))).alias("value"),
            f["type"]["_featureTypeId"].alias("type_id"),
            present(f["reliability"]).alias("reliability"),
        ),
    )


def feature_kind(feature_type: Column) -> Column:
    """The field a feature fills: the first rule that its upper-case type meets; null for none."""
    t = F.upper(feature_type)
    has = t.contains
    return (
        F.when(has("DOB") | (has("DATE") & has("BIRTH")), "date_of_birth")
        .when(has("POB") | (has("PLACE") & has("BIRTH")), "place_of_birth")
        .when(has("NATIONAL"), "nationality")
        .when(has("CITIZEN"), "citizenship")
        .when(has("GENDER"), "gender")
        .when(has("TITLE"), "title")
        .when(has("IMO") | has("VESSEL"), "vessel_imo")
        .when(has("AIRCRAFT") | has("REGISTRATION"), "aircraft_registration")
        .when(has("DIGITAL") | has("CRYPTO") | has("WALLET"), "crypto")
    )


def values_of(feature_array: Column, kind: str) -> Column:
    mine = F.filter(feature_array, lambda f: feature_kind(f["type"]) == kind)
    return F.transform(mine, lambda f: f["value"])


def last_value(feature_array: Column, kind: str) -> Column:
    """The last feature of a kind wins."""
    values = values_of(feature_array, kind)
    return F.get(values, F.size(values) - 1)


def relationships(raw: Column) -> Column:
    linked = F.filter(
        _array(raw, "struct<relatedEntity:struct<_VALUE:string,_entityId:string>,relationshipType:string,fromDate:string,toDate:string>"),
        lambda r: r["relatedEntity"].isNotNull(),
    )
    return F.transform(
        linked,
        lambda r: F.struct(
            F.coalesce(r["relatedEntity"]["_entityId"], F.lit("")).alias("related_entity_id"),
            F.coalesce(r["relationshipType"], F.lit("Unknown")).alias("relationship_type"),
            present(r["fromDate"]).alias("from_date"),
            present(r["toDate"]).alias("to_date"),
        ),
    )


def addresses(raw: Column) -> Column:
    """Addresses with at least one filled field."""
    shaped = F.transform(
        _array(raw, "struct<addressLine1:string,addressLine2:string,city:string,stateProvince:string,postalCode:string,country:string,region:string>"),
        lambda a: F.struct(
            present(a["addressLine1"]).alias("line1"), present(a["addressLine2"]).alias("line2"),
            present(a["city"]).alias("city"), present(a["stateProvince"]).alias("state_province"),
            present(a["postalCode"]).alias("postal_code"), present(a["country"]).alias("country"),
            present(a["region"]).alias("region"),
        ),
    )
    return F.filter(shaped, some_address_field)


def some_address_field(a: Column) -> Column:
    return F.coalesce(
        a["line1"], a["line2"], a["city"], a["state_province"], a["postal_code"], a["country"], a["region"]
    ).isNotNull()


def un_addresses(raw: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return F.transform(
        _array(raw, "struct<STREET:string,CITY:string,STATE_PROVINCE:string,COUNTRY:string>"),
        lambda a: F.struct(
            present(a["STREET"]).alias("line1"), nothing.alias("line2"), present(a["CITY"]).alias("city"),
            present(a["STATE_PROVINCE"]).alias("state_province"), nothing.alias("postal_code"),
            present(a["COUNTRY"]).alias("country"), nothing.alias("region"),
        ),
    )


def countries(feature_array: Column, address_array: Column) -> Column:
    """Nationalities, citizenships and address countries, distinct and sorted."""
    every = F.concat(
        values_of(feature_array, "nationality"),
        values_of(feature_array, "citizenship"),
        F.transform(address_array, lambda a: a["country"]),
    )
    return F.sort_array(F.array_distinct(F.filter(every, lambda c: F.coalesce(c, F.lit("")) != "")))


def programs(raw: Column) -> Column:
    return F.transform(
        F.filter(_array(raw, "string"), lambda p: F.coalesce(p, F.lit("")) != ""), lambda p: F.trim(p)
    )


def programs_text(program_array: Column) -> Column:
    return F.nullif(F.array_join(program_array, "; "), F.lit(""))


def un_full_name(first: Column, second: Column, third: Column, fourth: Column) -> Column:
    return F.nullif(F.concat_ws(" ", present(first), present(second), present(third), present(fourth)), F.lit(""))


def un_last_name(second: Column, third: Column, fourth: Column) -> Column:
    filled = [F.nullif(present(c), F.lit("")) for c in (fourth, third, second)]
    return F.coalesce(*filled, F.lit(""))


def un_aliases(raw: Column, field: str = "ALIAS_NAME") -> Column:
    """Alias names in order; repeats stay."""
    names = F.transform(raw, lambda a: present(a[field]))
    return F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>"))


UN_REFERENCE = r"^([A-Z]{2})([ie])\.(\d+)$"


def un_reference(reference: Column) -> Column:
    """struct(list_type, country_code) of a well-formed reference number; null fields otherwise."""
    well_formed = reference.rlike(UN_REFERENCE)
    code = F.regexp_extract(reference, UN_REFERENCE, 1)
    return F.struct(
        F.when(well_formed, F.concat(code, F.regexp_extract(reference, UN_REFERENCE, 2))).alias("list_type"),
        F.when(well_formed, code).alias("country_code"),
    )


def search_tokens(weighted: list[tuple[Column, str]]) -> Column:
    """Distinct (token, weight) pairs of several texts, the simple text-search form."""

    def of(text: Column, weight: str) -> Column:
        words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
        return F.transform(
            F.filter(words, lambda w: w != ""), lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight"))
        )

    return F.array_distinct(F.concat(*[of(text, weight) for text, weight in weighted]))


