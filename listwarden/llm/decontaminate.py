"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows.

A window is ``length`` consecutive words of an item; an item with fewer words, but not none, is one window. Each
document is read as an array of word hashes; the hashes of its windows are joined with the broadcast set, and what they hit
is verified word by word against the window itself. A document word inside any occurrence of a window is hit.

The benchmark is a fixed list that does not grow with the corpus. Its windows are broadcast only while they
are at most ``broadcast_windows`` (24 bytes each); beyond that Spark joins them by shuffling. For the verification the keys of the documents
with hits (16 bytes each) pick their texts, by broadcast up to ``broadcast_documents`` of them, so that other texts are not shuffled.

Cases: words are those of ``common.words``; null and blank texts have none. Equal rows come back as often as they came, each
judged alike; rows with one doc_id and different texts are judged apart. Items that repeat a window all count. An empty
benchmark hits nothing; empty tables give an empty result. Further columns are kept by ``clean`` and not read by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.functions.names import once
from listwarden.llm.common import staged, words

LENGTH = 13


def _hashes(spoken: Column) -> Column:
    return F.transform(spoken, lambda w: F.xxhash64(w))


def _window_hashes(hashes: Column, length: int) -> Column:
    """Hash of the ``length`` words from each position on."""
    starts = F.sequence(F.lit(1), F.size(hashes) - F.lit(length - 1))
    one = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, length)))
    return F.when(F.size(hashes) >= length, one).otherwise(F.array().cast("array<bigint>"))


def _spoken(spoken: Column) -> Column:
    """Each hit with its own words only: the text's words do not leave the row."""
    return F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["n"].alias("n"), h["hash"].alias("hash"), F.slice(spoken, h["at"] + 1, h["n"]).alias("spoken")))


def windows(benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """Distinct windows: hash, n words, spoken (array of words), items (sorted ids that hold it)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(length))
    all_starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    each = items.select("item_id", F.explode(F.transform(all_starts, lambda i: F.slice("w", i, n))).alias("spoken"))
    by_window = each.groupBy("spoken").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return by_window.select(F.xxhash64(_hashes(F.col("spoken"))).alias("hash"), F.size("spoken").alias("n"), "spoken", "items")


def judge(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, broadcast_windows: int = 4_000_000, broadcast_documents: int = 1_000_000) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): doc_id, text_hash, n_words, n_hit, n_items, items (sorted as strings),
    spans (start and end word of each maximal run of hit words, end exclusive), contaminated."""
    listed = staged(windows(benchmark, length), "windows")
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())  # at most ``length`` numbers
    small = listed.count() <= broadcast_windows
    listed_hashes = listed.select("hash", "n").distinct()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_text"), _hashes(words(F.col("text"))).alias("h"))
    found = None
    for n in lengths:
        scanned = hashed.select("doc_id", "_text", F.posexplode(_window_hashes(F.col("h"), n)).alias("at", "hash"))
        one = listed_hashes.filter(F.col("n") == n)
        hit = scanned.join(F.broadcast(one) if small else one, "hash").select("doc_id", "_text", "at", "hash", "n")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = hashed.select("doc_id", "_text", F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("n")).limit(0)
    hits = found.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("at", "n", "hash")).alias("hits"))
    hits = staged(hits, "hits")

    w = words(F.col("text"))
    keys = hits.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_t"))
    keys = F.broadcast(keys) if keys.count() <= broadcast_documents else keys
    hit_document = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_t"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).join(keys, hit_document, "left_semi")
    said = (
        texts.join(hits.withColumnRenamed("doc_id", "_doc").withColumnRenamed("_text", "_t"), F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("_text").eqNullSafe(F.col("_t")))
        .select("doc_id", "_text", F.explode(once(w, _spoken)).alias("hit"))
        .select("doc_id", "_text", "hit.*")
        .distinct()
    )
    same = listed.select("hash", "spoken", "items")
    verified = said.join(F.broadcast(same) if small else same, ["hash", "spoken"])
    per_doc = verified.groupBy("doc_id", "_text").agg(
        F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("runs"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string"))).alias("items"),
    )
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<at:int,end:int>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= r["at"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["at"].alias("at"), F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )
    per_doc = staged(per_doc.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_t"), merged.alias("spans"), "items"), "verified")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["at"])), F.lit(0).cast("bigint"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.size(w).cast("bigint").alias("n_words"))
    matched = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_t")), "left")
    return matched.select(
        "doc_id", F.col("_text").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all their columns, without the contaminated documents."""
    bad = judge(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_t"))
    return docs.join(staged(bad, "contaminated"), same, "left_anti")
