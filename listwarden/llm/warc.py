"""WARC archives: write, normalise to one gzip member a record with an offset index, and read back by offset.

``write`` makes archives as some crawlers leave them: one gzip stream around the whole file, so that no record can
be reached without inflating all before it. ``normalise`` inflates each such stream once, in pieces of bounded
size, rewrites every record as a gzip member of its own and writes the offsets beside the archive (``.idx``, one JSON
object a line). ``read`` seeks each record by that index. An archive is one task's work, so ``write`` starts a new one after
``archive_bytes`` of payload.

Tasks write under names of their own attempt and report them as rows; only reported names are read later, so a lost or
repeated task leaves at most an unread file. Files go to the shared folder by pyarrow's file systems.

Cases: a null payload counts as empty. Rows with a null id are written too; the smallest id of a group of equal payloads never
is null while one of them has an id. Rows with equal id and payload are all responses if the id is the smallest of the
group, else all revisit it. An empty table writes no archive and reads as an empty result. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.common import staged
from listwarden.operators.staging import new_folder

GZIP = 16 + zlib.MAX_WBITS
CHUNK = 1 << 20
LIMIT = 64 << 20
URN = "urn:page:"
BREAK = b"\r\n"


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def record(kind: str, record_id: str, target: str, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    """One record: WARC headers, the HTTP header, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{record_id}>", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers}>"]
    return "\r\n".join(head).encode() + BREAK * 2 + block + BREAK * 2


def _header(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(BREAK)[1:])
    return {name.decode().strip().lower(): value.decode("utf-8", "replace").strip() for name, _, value in pairs}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of inflated chunks; holds one record and one chunk at a time."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        piece = next(chunks, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        searched = 0
        while (end := held.find(BREAK * 2, searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if bytes(held).strip():
                    raise ValueError("the archive ends within a record")
                return
        headers = _header(bytes(held[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield headers, bytes(held[:size])
        del held[:size]


def inflated(file) -> Iterator[bytes]:
    """The inflated content of a gzip file, in pieces of at most ``CHUNK`` bytes; further members are read on."""
    unzip = zlib.decompressobj(GZIP)
    while data := file.read(CHUNK):
        while data:
            yield unzip.decompress(data, CHUNK)
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(GZIP)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of a smaller id has; digest is hexadecimal."""
    digests = staged(pages.select("page_id", "payload", F.sha1("payload").alias("digest")).select("page_id", "digest"), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = staged(first.filter("n > 1").drop("n"), "first")
    again = digests.join(first, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))
    return staged(again.filter(F.col("refers_to").isNotNull()).distinct(), "revisits")


def write(pages: DataFrame, archive_bytes: int = LIMIT, level: int = 1) -> DataFrame:
    """Archives of ``pages`` (page_id, url, payload as binary or null): a staged table (archive) of their URIs."""
    whole = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    again = revisits(whole).withColumnRenamed("page_id", "_id").withColumnRenamed("digest", "_digest")
    with_digest = whole.withColumn("digest", F.sha1("payload"))
    typed = with_digest.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    folder = new_folder(pages.sparkSession, "archives")

    def store_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        attempt, made, out, zipped, used = TaskContext.get().taskAttemptId(), [], None, None, 0
        for batch in batches:
            for row in batch.astype({"page_id": object, "refers_to": object}).itertuples(index=False):
                if out is None:
                    name = f"{attempt}-{len(made)}-{uuid.uuid4().hex}.warc.gz"
                    out, zipped, used = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, wbits=GZIP), 0
                    made.append(f"{folder}/{name}")
                kind = "response" if pd.isna(row.refers_to) else "revisit"
                digest = base64.b32encode(bytes.fromhex(row.digest)).decode()
                page_id = "" if pd.isna(row.page_id) else int(row.page_id)
                target = " ".join((row.url or "").split())
                refers = None if kind == "response" else int(row.refers_to)
                out.write(zipped.compress(record(kind, str(page_id), target, digest, len(row.payload), row.payload, refers)))
                used += len(row.payload)
                if used >= archive_bytes:
                    out.write(zipped.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(zipped.flush())
            out.close()
        yield pd.DataFrame({"archive": made}, dtype=object)

    columns = typed.select("page_id", "url", "payload", "digest", "refers_to")
    return staged(columns.mapInPandas(store_all, "archive string"), "written")


def _one_each(archives: DataFrame) -> DataFrame:
    """Archive names dealt out so that about one lies in a partition."""
    return archives.repartition(max(1, archives.count()), "archive")


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Rewrites each archive: a staged table (archive, records) of the new ones, an index beside each."""
    folder = new_folder(archives.sparkSession, "normalised")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for source in batch["archive"]:
                (store, path), (target, base) = _open(source), _open(folder)
                target.create_dir(base, recursive=True)
                name, at, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with (
                    store.open_input_stream(path, compression=None) as file,
                    target.open_output_stream(f"{base}/{name}", compression=None) as out,
                    target.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                ):
                    for headers, whole in records(inflated(file)):
                        zipped = zlib.compressobj(level, wbits=GZIP)
                        member = zipped.compress(whole) + zipped.flush()
                        out.write(member)
                        entry = {"offset": at, "length": len(member), "type": headers["warc-type"], "id": headers["warc-record-id"], "uri": headers["warc-target-uri"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, count = at + len(member), count + 1
                done.append((f"{folder}/{name}", count))
            yield pd.DataFrame(done, columns=["archive", "records"])

    return staged(_one_each(archives).mapInPandas(rewrite, "archive string, records long"), "normalised")


def read(archives: DataFrame) -> DataFrame:
    """Records of normalised archives, each sought by its index: page_id, url, record_type, payload (null for a
    revisit), payload_bytes, payload_digest, refers_to, archive, offset, length.

    A response's size and digest are computed from its payload; a revisit has those of its headers.
    """

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(urn: str | None) -> int | None:
            digits = (urn or "").strip("<>").removeprefix(URN)
            return int(digits) if digits else None

        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "archive", "offset", "length"]
        for batch in batches:
            for archive in batch["archive"]:
                store, path = _open(archive)
                rows, held = [], 0
                with store.open_input_stream(f"{path}.idx", compression=None) as lines, store.open_input_file(path) as file:
                    rest = b""
                    while piece := lines.read(CHUNK):
                        *entries, rest = (rest + piece).split(b"\n")
                        for entry in map(json.loads, entries):
                            file.seek(entry["offset"])
                            whole = zlib.decompress(file.read(entry["length"]), GZIP)
                            head, _, block = whole.partition(BREAK * 2)
                            headers = _header(head)
                            http, _, payload = block[: int(headers["content-length"])].partition(BREAK * 2)
                            kind = headers["warc-type"]
                            if kind == "response":
                                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            else:
                                size, digest = int(_header(http)["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                            rows.append((
                                number(headers["warc-record-id"]), headers["warc-target-uri"], kind, payload if kind == "response" else None, size, digest,
                                number(headers.get("warc-refers-to")), archive, entry["offset"], entry["length"],
                            ))
                            held += size
                            if held >= 8 * CHUNK:
                                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                                rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = (
        "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
        "refers_to long, archive string, offset long, length long"
    )
    return _one_each(archives.select("archive")).mapInPandas(seek, schema)
