"""The two XML watch-lists as entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from listwarden import schemas
from listwarden.functions import fields as P
from listwarden.operators.staging import materialized


def _reader(spark: SparkSession, row_tag: str, schema: str):
    return (
        spark.read.format("xml").schema(schema).option("rowTag", row_tag)
        .option("ignoreNamespace", True).option("attributePrefix", "_").option("valueTag", "_VALUE")
    )


def read_ofac_raw(spark: SparkSession, path: str) -> DataFrame:
    return _reader(spark, "entity", schemas.OFAC_ENTITY).load(path)


def ofac_entities(raw: DataFrame) -> DataFrame:
    """Raw rows (``schemas.OFAC_ENTITY``) as ``schemas.ENTITY``; rows without id or name are dropped."""
    shaped = raw.filter(F.coalesce("_id", F.lit("")) != "").select(
        F.lit("OFAC").alias("source"),
        F.col("_id").alias("entity_id"),
        P.entity_type(F.col("entityType")).alias("entity_type"),
        P.translations(F.col("names")).alias("_names"),
        P.identity_documents(F.col("idDocuments.idDocument"), F.col("identityDocuments.identityDocument"))
        .alias("identity_documents"),
        P.features(F.col("features.feature")).alias("features"),
        P.relationships(F.col("relationships.relationship")).alias("relationships"),
        P.addresses(F.col("addresses.address")).alias("addresses"),
        P.programs(F.col("sanctionsPrograms.sanctionsProgram")).alias("sanctions_programs"),
    )
    named = shaped.withColumn("all_names", P.all_names(F.col("_names"))).filter(F.size("all_names") > 0)
    person = F.col("entity_type") == "individual"
    known = F.col("features")
    filled = named.withColumns(
        {
            "primary_name": F.get("all_names", F.lit(0)),
            "aliases": F.slice("all_names", 2, F.greatest(F.size("all_names"), F.lit(1))),
            "first_name": F.when(person, P.first_filled(F.col("_names"), "formattedFirstName")),
            "last_name": F.when(person, P.first_filled(F.col("_names"), "formattedLastName")),
            **{kind: P.last_value(known, kind) for kind in P.FEATURE_KINDS if kind != "crypto"},
            "crypto_addresses": P.values_of(known, "crypto"),
            "countries": P.countries(known, F.col("addresses")),
            "program": P.programs_text(F.col("sanctions_programs")),
        }
    )
    return as_entities(filled)


def read_un_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        _reader(spark, "INDIVIDUAL", schemas.UN_INDIVIDUAL).load(path),
        _reader(spark, "ENTITY", schemas.UN_ENTITY).load(path),
    )


def _un_common(raw: DataFrame, kind: str, name: Column, aliases: Column, addresses: Column) -> DataFrame:
    reference = P.un_reference(F.col("REFERENCE_NUMBER"))
    return raw.withColumns(
        {
            "source": F.lit("UN"),
            "entity_id": P.present(F.col("DATAID")),
            "entity_type": F.lit(kind),
            "primary_name": name,
            "aliases": aliases,
            "addresses": addresses,
            "un_list_type": reference["list_type"],
            "un_country_code": reference["country_code"],
            "un_committee": P.present(F.col("UN_LIST_TYPE")),
            "un_reference_number": P.present(F.col("REFERENCE_NUMBER")),
            "remarks": P.present(F.col("COMMENTS1")),
            "program": F.lit("UN"),
        }
    ).filter((F.coalesce("entity_id", F.lit("")) != "") & (F.coalesce("primary_name", F.lit("")) != ""))


def un_individuals(raw: DataFrame) -> DataFrame:
    rows = _un_common(
        raw,
        "individual",
        P.un_full_name(*[F.col(f"{n}_NAME") for n in ("FIRST", "SECOND", "THIRD", "FOURTH")]),
        P.un_aliases(F.col("INDIVIDUAL_ALIAS")),
        P.un_addresses(F.col("INDIVIDUAL_ADDRESS")),
    )
    numbered = F.filter(
        F.coalesce(
            "INDIVIDUAL_DOCUMENT",
            F.array().cast("array<struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string,DATE_OF_ISSUE:string,NOTE:string>>"),
        ),
        lambda d: F.coalesce(P.present(d["NUMBER"]), F.lit("")) != "",
    )
    documents = F.transform(
        numbered,
        lambda d: F.struct(
            F.coalesce(F.nullif(P.present(d["TYPE_OF_DOCUMENT"]), F.lit("")), F.lit("Unknown")).alias("type"),
            P.present(d["NUMBER"]).alias("number"),
            P.present(d["ISSUING_COUNTRY"]).alias("issuing_country"),
            P.present(d["DATE_OF_ISSUE"]).alias("issue_date"),
            F.lit(None).cast("string").alias("expiration_date"),
            P.present(d["NOTE"]).alias("note"),
        ),
    )
    nationality = F.get(F.filter("NATIONALITY.VALUE", lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    return as_entities(
        rows.withColumns(
            {
                "first_name": F.coalesce(P.present(F.col("FIRST_NAME")), F.lit("")),
                "last_name": P.un_last_name(F.col("SECOND_NAME"), F.col("THIRD_NAME"), F.col("FOURTH_NAME")),
                "identity_documents": documents,
                "date_of_birth": P.present(F.col("DATE_OF_BIRTH")),
                "nationality": P.present(nationality),
            }
        )
    )


def un_organisations(raw: DataFrame) -> DataFrame:
    return as_entities(
        _un_common(
            raw,
            "entity",
            P.present(F.col("FIRST_NAME")),
            P.un_aliases(F.col("ENTITY_ALIAS")),
            P.un_addresses(F.col("ENTITY_ADDRESS")),
        )
    )


def as_entities(rows: DataFrame) -> DataFrame:
    """Exactly the columns of ``schemas.ENTITY``; what a source lacks is null or an empty array."""
    target = StructType.fromDDL(schemas.ENTITY)
    if "all_names" not in rows.columns:
        rows = rows.withColumn("all_names", F.concat(F.array("primary_name"), F.col("aliases")))
    if "countries" not in rows.columns:
        every = F.transform("addresses", lambda a: a["country"])
        if "nationality" in rows.columns:
            every = F.concat(F.array("nationality"), every)
        rows = rows.withColumn(
            "countries", F.sort_array(F.array_distinct(F.filter(every, lambda c: F.coalesce(c, F.lit("")) != "")))
        )
    columns = []
    for field in target.fields:
        if field.name in rows.columns:
            column = F.col(field.name)
        else:
            column = F.array() if isinstance(field.dataType, ArrayType) else F.lit(None)
        columns.append(column.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def read_ofac(spark: SparkSession, path: str) -> DataFrame:
    return ofac_entities(read_ofac_raw(spark, path))


def read_un(spark: SparkSession, path: str) -> DataFrame:
    """Individuals, then organisations."""
    people, organisations = read_un_raw(spark, path)
    return un_individuals(people).unionByName(un_organisations(organisations))


def invalid_rows(spark: SparkSession, path: str, row_tag: str, xsd: str) -> DataFrame:
    """(record, message) of the rows of an XML file that its row schema refuses."""
    rows = (
        spark.read.format("xml").schema("_id STRING, _corrupt_record STRING").option("rowTag", row_tag)
        .option("ignoreNamespace", True).option("rowValidationXSDPath", xsd).option("mode", "PERMISSIVE").load(path)
    )
    # The mark of a refused row can only be queried once the rows are written.
    refused = materialized(rows, "checked").filter(F.col("_corrupt_record").isNotNull())
    return refused.select(F.col("_corrupt_record").alias("record"), F.lit("invalid content: the row does not follow its schema").alias("message"))


def read_lists(spark: SparkSession, ofac_path: str, un_path: str) -> DataFrame:
    """Both lists, one after the other, without removing duplicates."""
    return read_ofac(spark, ofac_path).unionByName(read_un(spark, un_path))


def parse_rows(df: DataFrame, xml: str, schema: str, row_tag: str) -> DataFrame:
    """Rows held as XML text in a column of a table."""
    options = {"rowTag": row_tag, "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}
    # A generator keeps the optimizer from parsing the text again for every field that is read.
    return df.select(F.inline(F.array(F.from_xml(F.col(xml), schema, options))))
