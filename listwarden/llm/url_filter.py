"""URL filter: a blocked Bloom filter lets possible hits through to an exact join with the list.

Two kinds of keys are listed: rules (host and path prefix) and whole canonical URLs. A URL has one
candidate key for each rule shape (number of host labels, length of path) and one for its canonical
form. The filter is a table of 512-bit blocks; a key sets one bit in each of the eight words of its
block. It is broadcast: its number of blocks is a power of two of at most ``max_blocks``, so it never
exceeds ``max_blocks * 72`` bytes, however long the list is. What passes meets the list in an exact join
on the key itself, so a crowded filter costs time but never changes a verdict.

Cases: a null URL, or one without ``://``, has empty host and path and no rule, and is allowed. Equal URLs
are judged once and equal rows come back as often as they came. An empty list allows everything, an
empty table gives an empty result. Further columns of the inputs are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.llm.common import ascii_lower, staged

WORDS = 8
BITS_PER_KEY = 16
TRACKING = r"^(utm_[^=]*|ref)(=.*)?$"


def host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(rest) + 4))
    return F.coalesce(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(rest) + 4))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without trailing slashes, query without tracking
    parameters, no fragment; null without a host."""
    place = F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    return F.when(host(url) != "", F.concat(place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("kind"), F.col("k1"), F.col("k2"))


def _block(blocks: int) -> Column:
    return _hash(1).bitwiseAND(F.lit(blocks - 1))


def _bit(word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(2, kind, k1, k2), {6 * word}) & 63 as int))")


def build_filter(keys: DataFrame, max_blocks: int = 1 << 16) -> tuple[DataFrame, int]:
    """Blocks (block, w0..w7) of the distinct ``keys`` (kind, k1, k2), and their possible number."""
    needed = max(1, keys.count() * BITS_PER_KEY // (64 * WORDS))
    blocks = min(max_blocks, 1 << (needed - 1).bit_length())
    bits = keys.select(_block(blocks).alias("block"), *[_bit(w).alias(f"w{w}") for w in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def possible(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Candidates whose bits are all set."""
    held = reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(_bit(w)) != 0 for w in range(WORDS)])
    probed = candidates.withColumn("block", _block(blocks)).join(F.broadcast(bloom), "block")
    return probed.filter(held).select(*candidates.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, max_blocks: int = 1 << 16) -> DataFrame:
    """Each row of ``pages`` (page_id, url) with host, path, canonical, rule, listed and verdict.

    rules: host, path, verdict (allow or block), unique by host and path; the longest host and path
    wins, then the longer host. listed: canonical URLs to block, for pages that no rule fits.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    keys = staged(
        rules.select(F.lit("rule").alias("kind"), F.col("host").alias("k1"), F.col("path").alias("k2"), "verdict").unionByName(
            listed.select(F.lit("url").alias("kind"), F.col("canonical").alias("k1"), F.lit("").alias("k2"), F.lit("block").alias("verdict"))
            .filter(F.col("k1").isNotNull()).distinct()
        ),
        "listed",
    )
    bloom, blocks = build_filter(keys, max_blocks)
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()

    urls = pages.select("url").filter(F.col("url").isNotNull()).distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    labels = F.split("host", r"\.")
    of_shape = [
        F.when(
            (F.col("host") != "") & (F.size(labels) >= s.labels) & (F.length("path") >= s.chars),
            F.struct(F.lit("rule").alias("kind"), F.array_join(F.slice(labels, -s.labels, s.labels), ".").alias("k1"), F.substring("path", 1, s.chars).alias("k2")),
        )
        for s in shapes
    ]
    whole = F.when(F.col("canonical").isNotNull(), F.struct(F.lit("url").alias("kind"), F.col("canonical").alias("k1"), F.lit("").alias("k2")))
    candidates = urls.select("url", F.explode(F.array_compact(F.array(*of_shape, whole))).alias("c")).select("url", "c.kind", "c.k1", "c.k2")

    hits = possible(candidates, bloom, blocks).join(keys, ["kind", "k1", "k2"])
    by_rule = F.when(F.col("kind") == "rule", F.struct(F.length(F.concat("k1", "k2")).alias("n"), F.length("k1").alias("h"), F.concat("k1", "k2").alias("rule"), F.col("verdict")))
    judged = staged(hits.groupBy("url").agg(F.max(by_rule).alias("best"), F.max(F.col("kind") == "url").alias("listed")), "judged")

    listed_url = F.coalesce("listed", F.lit(False))
    return pages.select("page_id", "url").join(judged, "url", "left").select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(listed_url, "block").otherwise("allow")).alias("verdict"),
        canonical(F.col("url")).alias("canonical"),
        listed_url.alias("listed"),
    )
