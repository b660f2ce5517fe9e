"""Request files, audit trails and the inventory of list files."""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden import schemas

# Executors need no copy of this package: what runs there travels with its helper functions.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# header of the request file -> request column
CSV_COLUMNS = {
    "nombre": "name",
    "cedula": "document_number",
    "pais": "country",
    "fecha_nacimiento": "date_of_birth",
    "nacionalidad": "nationality",
}


class HeaderError(ValueError):
    """The request file has no header or lacks the name column."""


def checked_headers(columns: list[str]) -> list[str]:
    cleaned = [c.strip().lower() for c in columns]
    if not columns:
        raise HeaderError("CSV file is empty")
    if "nombre" not in cleaned:
        raise HeaderError(f"Missing required header: 'nombre'. Found: {columns}")
    return cleaned


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Screening requests of a CSV file. Values are trimmed; rows without a name are skipped.

    A quoted value may hold line breaks, so a file is read by one task; many files are read by many.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"')
    return as_requests(raw.toDF(*checked_headers(raw.columns)))


def as_requests(raw: DataFrame) -> DataFrame:
    def value(header: str) -> Column:
        if header not in raw.columns:
            return F.lit(None).cast("string")
        return F.nullif(F.trim(F.col(header).cast("string")), F.lit(""))

    shaped = raw.select(*[value(h).alias(c) for h, c in CSV_COLUMNS.items()]).filter(F.col("name").isNotNull())
    inputs = ["name", "document_number", "date_of_birth", "nationality", "country"]
    # The content and the place of the row: equal rows are requests of their own.
    content = F.sha2(F.to_json(F.struct(*inputs)), 256)
    place = F.monotonically_increasing_id().cast("string")
    return shaped.withColumn("request_id", F.concat_ws("-", content, place)).withColumn(
        "document_type", F.lit(None).cast("string")
    )


def read_audit(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Audit lines; malformed ones fail when ``strict``, else they are skipped."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schemas.AUDIT).json(path, mode=mode)


def list_files(spark: SparkSession, folder: str, patterns: str = "*.{xml,XML,zip,ZIP}") -> DataFrame:
    """Name, size and modification time of the list files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


#: Suffixes by which Spark's line reader would unpack a file.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")
_MARK, _PIECE_LINES = b"\xef\xbb\xbf", 2_000


def _pieces(batches):
    """Lines (file, start, line) as pieces (file, start, seq, content) of many lines, each line with its feed."""
    seq = 0
    for batch in batches:
        for at in range(0, batch.num_rows, _PIECE_LINES):
            rows = batch.slice(at, _PIECE_LINES)
            place = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
            lines, begin = rows.column(2).to_pylist(), 0
            for end in range(1, len(lines) + 1):
                if end == len(lines) or place[end] != place[begin]:
                    content = b"\n".join(lines[begin:end]) + b"\n"
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*place[begin], seq, content)], names=["file", "start", "seq", "content"])
                    seq, begin = seq + 1, end


def _digests(batches):
    """(file, read, digests) of a file's pieces in order: as they are and after a byte order mark, each without and with the last line feed."""

    def told():
        return pa.RecordBatch.from_pylist([{"file": file, "read": size, "digests": [h.hexdigest() for h in (*ended(plain), *ended(marked))]}], schema=schema)

    def ended(state):
        cut, whole = state.copy(), state.copy()
        cut.update(last[:-1])
        whole.update(last)
        return cut, whole

    schema = pa.schema([("file", pa.string()), ("read", pa.int64()), ("digests", pa.list_(pa.string()))])
    file = None
    for batch in batches:
        for row in range(batch.num_rows):
            name, content = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
            if name != file:
                if file is not None:
                    yield told()
                file, size, plain, marked, last = name, 0, hashlib.sha256(), hashlib.sha256(_MARK), b""
            plain.update(last)
            marked.update(last)
            last, size = content, size + len(content)
    if file is not None:
        yield told()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, path, size, time and SHA-256 of files of any size, wherever Spark can read them.

    A file is read as lines by many tasks; one task digests its lines in order, piece by piece. Spark's line reader leaves out a byte order
    mark and does not tell whether the last line has a feed: the bytes it has read beside the file's size tell both. Files with a
    suffix by which it would unpack them are read whole.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.col("_metadata.file_path").alias("file")
    )
    packed = rf"(?i)\.({'|'.join(PACKED)})$"
    lines = spark.read.option("lineSep", "\n").text(path).filter(~F.col("_metadata.file_path").rlike(packed))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_pieces, "file string, start long, seq long, content binary")
    in_order = pieces.repartition("file").sortWithinPartitions("file", "start", "seq")
    read = in_order.mapInArrow(_digests, "file string, read long, digests array<string>")
    # bytes too many: 1 without a last feed, 0 with one; 3 less after a byte order mark
    way = F.col("read") - F.col("size_bytes")
    sha = F.get("digests", F.when(way == 1, 0).when(way == 0, 1).when(way == -2, 2).when(way == -3, 3))
    by_lines = files.join(read, "file").withColumn("sha256", F.coalesce(sha, F.raise_error(F.concat(F.lit("file changed while it was read: "), "path"))))
    whole = spark.read.format("binaryFile").load(path, pathGlobFilter="*.{" + ",".join(x for s in PACKED for x in (s, s.upper())) + "}")
    whole = whole.select("path", F.sha2("content", 256).alias("sha256"))
    columns = ["file_name", "path", "size_bytes", "modified_at", "sha256"]
    return by_lines.select(*columns).unionByName(files.filter(F.col("file").rlike(packed)).join(whole, "path").select(*columns))


def hash_verification(digests: DataFrame, known: DataFrame) -> DataFrame:
    """new (no known hash), ok or mismatch per file. known: (file_name, known_hash)."""
    joined = digests.join(known, "file_name", "left")
    status = (
        F.when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") == F.col("sha256"), "ok")
        .otherwise("mismatch")
    )
    return joined.select(
        "file_name", "sha256", status.alias("status"), (status != "mismatch").alias("is_valid")
    )


def _one_spelling(path: Column) -> Column:
    """Sources write local paths with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def list_metadata(
    spark: SparkSession, path: str, source: str, row_tags: list[str], published_tag: str | None = None,
    root_tag: str | None = None, version: str | None = None,
) -> DataFrame:
    """One row for each list file: size, hash, number of its records, its publication date (else file time)."""

    def tagged(tag: str, schema: str) -> DataFrame:
        rows = spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", True).load(path)
        return rows.withColumn("file", _one_spelling(F.col("_metadata.file_path")))

    counts = None
    for tag in row_tags:
        one = tagged(tag, "_id STRING").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    records = counts.groupBy("file").agg(F.sum("n").alias("record_count"))
    if published_tag:
        header = tagged(published_tag, schemas.OFAC_HEADER).select("file", F.col("publishDate").alias("published"))
    else:
        header = tagged(root_tag, "_dateGenerated STRING").select("file", F.col("_dateGenerated").alias("published"))
    published = header.groupBy("file").agg(F.max("published").alias("published"))
    found = file_digests(spark, path).withColumn("file", _one_spelling(F.col("path"))).join(records, "file", "left").join(published, "file", "left")
    return found.select(
        F.lit(source).alias("source"),
        "file_name",
        "path",
        "size_bytes",
        "sha256",
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
        F.coalesce(F.regexp_replace("published", "Z$", "").try_cast("timestamp"), F.col("modified_at")).alias("last_update"),
        F.lit(version).cast("string").alias("version"),
    )
