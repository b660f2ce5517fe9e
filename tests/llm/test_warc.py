import base64
import gzip
import hashlib
import io
import json

from pyarrow import fs

from listwarden.llm import warc

SCHEMA = "page_id long, url string, payload binary, digest string, archive string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_round_trip_with_nulls_copies_and_long_payloads(spark):
    long = b"\x00<p>\r\n\r\nWARC/1.1\r\n" * 200_000
    rows = [(1, "http://a/1", b"same"), (2, None, b"same"), (3, "http://a/3", None), (4, "http://a/4", b""), (5, "http://a/\n5", long), (2, None, b"same"), (None, "u", b"same")]
    archives = warc.normalise(warc.write(_pages(spark, rows), archive_bytes=1000))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read(archives).collect()]
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    same, none = digest(b"same"), digest(b"")
    expected = [
        (1, 4, same, "response", None, b"same"), (2, 4, same, "revisit", 1, None), (2, 4, same, "revisit", 1, None), (None, 4, same, "revisit", 1, None),
        (3, 0, none, "response", None, b""), (4, 0, none, "revisit", 3, None), (5, len(long), digest(long), "response", None, long),
    ]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_every_record_is_a_member_at_its_offset(spark):
    archives = warc.normalise(warc.write(_pages(spark, [(k, f"http://a/{k}", b"x" * k) for k in range(20)])))
    seen = 0
    for row in archives.collect():
        store, path = fs.FileSystem.from_uri(row.archive)
        whole = store.open_input_stream(path, compression=None).read()
        index = [json.loads(x) for x in store.open_input_stream(f"{path}.idx").read().splitlines()]
        assert row.records == len(index)
        assert sum(e["length"] for e in index) == len(whole)
        for entry in index:
            record = gzip.decompress(whole[entry["offset"] : entry["offset"] + entry["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and entry["id"].encode() in record
            seen += 1
    assert seen == 20


def test_stream_of_many_members_and_broken_ends():
    one = warc.record("response", "1", "u", "D", 3, b"abc", None)
    assert [r for _, r in warc.records(warc.inflated(io.BytesIO(gzip.compress(one) + gzip.compress(one + one))))] == [one] * 3
    try:
        list(warc.records(iter([one[:-10]])))
    except ValueError:
        return
    raise AssertionError("a cut record must not pass")


def test_empty_table(spark):
    assert warc.read(warc.normalise(warc.write(_pages(spark, [])))).count() == 0
