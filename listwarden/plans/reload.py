"""List reload: check, parse, compare with the last version, then make the new version visible."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig
from listwarden.operators import quality, tables
from listwarden.operators.staging import materialized
from listwarden.sources import xml_lists


@dataclass(frozen=True)
class Reload:
    """entities: the new version; report: a row per source with success, errors and warnings; refused: the sources
    whose new file was not accepted, of which ``entities`` holds the previous rows."""

    entities: DataFrame
    report: DataFrame
    refused: tuple[str, ...]


def reload_lists(
    spark: SparkSession, ofac_path: str, un_path: str, previous: DataFrame | None = None,
    config: ScreeningConfig = DEFAULT, un_malformed_percent: float | None = None,
) -> Reload:
    """Both lists as one table and a report row per source.

    A list is refused when its file holds no row with an id. The first list is refused, too, when too many of its rows have none; fewer are a
    warning. Such rows of the second list are passed over without a word, unless ``un_malformed_percent`` sets how many may be. Each file is parsed once.
    """
    raw = materialized(xml_lists.read_ofac_raw(spark, ofac_path), "raw")
    people, organisations = (materialized(part, "raw") for part in xml_lists.read_un_raw(spark, un_path))
    un_ids = people.select("DATAID").unionByName(organisations.select("DATAID"))
    checks = {"OFAC": quality.malformation_rate(raw, "_id", config).first(), "UN": quality.malformation_rate(un_ids, "DATAID", config).first()}
    told, refused = [], []
    most = {"OFAC": config.malformed_percent, "UN": un_malformed_percent}
    for source, check in checks.items():
        checked, bad = most[source] is not None, check["malformed_count"]
        share = f"{check['malformed_count']} of {check['entity_count']} entities have no id ({check['malformed_percent']:.2f}%)"
        errors = [share] if checked and check["malformed_percent"] > most[source] else ["the file holds no entities"] if check["entity_count"] == bad else []
        told.append((source, not errors, errors, [share] if checked and bad and not errors else []))
        refused += [source] if errors else []
    un = xml_lists.un_individuals(people).unionByName(xml_lists.un_organisations(organisations))
    parsed = materialized(xml_lists.ofac_entities(raw).unionByName(un).filter(~F.col("source").isin(refused)), "parsed")
    old = previous if previous is not None else parsed.limit(0)
    if refused:
        parsed = parsed.unionByName(old.filter(F.col("source").isin(refused)), allowMissingColumns=True)
    counts = parsed.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_if(F.col("entity_type") == "individual").alias("individuals"),
    )
    fields = [c for c in parsed.columns if c not in ("source", "entity_id")]
    changes = tables.diff_counts(tables.list_diff(old, parsed, ["source", "entity_id"], fields))
    sources = spark.createDataFrame(told, "source STRING, success BOOLEAN, errors ARRAY<STRING>, warnings ARRAY<STRING>")
    # a handful of rows per table
    report = sources.join(F.broadcast(counts), "source", "left").join(F.broadcast(changes), "source", "left")
    return Reload(parsed, report.na.fill(0), tuple(refused))


POINTER = "CURRENT"


def publish_reload(done: Reload, folder: str, version: str, accept_refused: bool = False) -> str:
    """Publish a reload; one with a refused source only by explicit choice."""
    if done.refused and not accept_refused:
        raise ValueError(f"refused: {', '.join(done.refused)}; their previous rows would be published again")
    return publish(done.entities, folder, version)


def publish(entities: DataFrame, folder: str, version: str) -> str:
    """Write a version, then point to it. Readers see the old version until the write is complete."""
    spark = entities.sparkSession
    path = f"{folder.rstrip('/')}/version={version}"
    entities.write.mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{POINTER}")
    fs = target.getFileSystem(conf)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{POINTER}.new")
    out = fs.create(fresh, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, target, overwrite)
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The published version."""
    row = spark.read.text(f"{folder.rstrip('/')}/{POINTER}").first()
    return spark.read.parquet(f"{folder.rstrip('/')}/version={row['value']}")
