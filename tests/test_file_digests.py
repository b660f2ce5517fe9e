import gzip
import hashlib
import os

from listwarden.sources import files


def test_digests_of_files_read_in_parts(spark, tmp_path):
    """Files that take many tasks, with and without a last line feed and a byte order mark, packed ones, and one without any feed."""
    mark = b"\xef\xbb\xbf"
    contents = {
        "a.xml": mark + b"<a>\r\n\n\xff\xfe</a>\n", "b.xml": mark + b"<b/>", "c.xml": b"one\n\n", "d.xml": b"\n", "e.bin": os.urandom(300_000),
        "f.bin": os.urandom(200_000) + b"\n", "g.zip": bytes(100_000), "h.gz": gzip.compress(b"packed\n"), "name with blank.xml": b"x\ny",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        made = files.file_digests(spark, str(tmp_path))
        got = {r.file_name: (r.size_bytes, r.sha256) for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    assert "MapInArrow" in plan  # no row holds a whole file
