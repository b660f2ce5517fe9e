import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from listwarden.config import FALLBACK
from listwarden.functions import names as N
from listwarden.functions import text as X
from tests import model


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, expected", [
    ("José García", "JOSE GARCIA"), ("Doe, John", "DOE JOHN"), ("Muḥammad", "MUHAMMAD"), ("Müller", "MULLER"),
    (None, ""), ("", ""), ("  a -- b_c ", "A B_C"), ("Straße", "STRASSE"), ("김정은", model.normalize("김정은")),
])
def test_normalize_name(spark, raw, expected):
    assert one(spark, raw, N.normalize_name) == expected


def test_normalize_name_equals_the_definition(spark):
    rng = random.Random(5)
    # Letters of scripts that the Java and the Python tables know alike.
    pool = [chr(p) for low, high in ((32, 0x180), (0x370, 0x400), (0x400, 0x460), (0x5D0, 0x5EB), (0x620, 0x660), (0x1E00, 0x1EFF), (0x4E00, 0x4E80), (0xAC00, 0xAD00)) for p in range(low, high) if unicodedata.category(chr(p)) not in ("Cn", "Cc")]
    rows = [("".join(rng.choice(pool) for _ in range(rng.randint(1, 20))),) for _ in range(600)]
    got = spark.createDataFrame(rows, "v string").select("v", N.normalize_name(F.col("v")).alias("r")).collect()
    assert [r.v for r in got if r.r != model.normalize(r.v)] == []


@pytest.mark.parametrize("raw, expected", [("PA 12 345 678", "PA12345678"), ("PA-8-1234", "PA81234"), ("abc123def", "ABC123DEF"), ("a.b,c/d", "ABCD"), (None, "")])
def test_normalize_document(spark, raw, expected):
    assert one(spark, raw, N.normalize_document) == expected


@pytest.mark.parametrize("name, expected", [("Li Wei", True), ("John Michael Smith", False), ("Li Chen Wang", True)])
def test_short_name(spark, name, expected):
    assert one(spark, name, N.short_name) is expected


@pytest.mark.parametrize("name", ["李明", "محمد", "Владимир", "J.D.", "John", "李a", "A.B.C.D.E", "123", "ab 李明 Вл"])
def test_adaptive_threshold(spark, name):
    got = one(spark, name, lambda c: N.adaptive_threshold(c, FALLBACK))
    assert (got["threshold"], got["reason"]) == model.short_threshold(name, FALLBACK)


@pytest.mark.parametrize("text, expected", [("1985-06-20", 1985), ("born 06/1990", 1990), ("85", None), ("", None), (None, None)])
def test_dob_year(spark, text, expected):
    assert one(spark, text, N.dob_year) == expected


def test_common_name(spark):
    rows = spark.createDataFrame([("José  García",), ("Jose Gracia",)], "v string")
    assert [r[0] for r in rows.select(N.common_name(N.normalize_name(F.col("v")))).collect()] == [True, False]


def test_sanitize(spark):
    assert one(spark, "a\nb\x00​c   d", X.sanitize_text) == "a b cd" or one(spark, "a\nb\x00​c   d", X.sanitize_text) == "a b c d"
    assert one(spark, "x" * 60, X.sanitize_input) == "x" * 50 + "...(truncated)"
    assert len(one(spark, "y" * 900, X.sanitize_text)) == 500
    context = spark.sql("SELECT map('k\n', 'v\n1', '', 'x', 'n', CAST(NULL AS STRING)) AS m").select(X.sanitize_context(F.col("m")).alias("r")).first()["r"]
    assert context == {"k": "v 1", "unknown": "x", "n": None}
