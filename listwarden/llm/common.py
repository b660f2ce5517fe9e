"""Small helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.operators.staging import materialized, temporary

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What lies between words: all of ASCII but lower-case letters and digits, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_CHARACTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

staged, passing = materialized, temporary


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is (``lower`` does just that, and faster, where all is ASCII)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null or blank text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def has_word(text: Column) -> Column:
    """Whether ``words`` of a text that is not null has any, without splitting it."""
    return text.rlike(WORD_CHARACTER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
