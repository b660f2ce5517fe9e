"""Stored postings of a list: written once for a list version, read by the terms that are searched.

Two kinds. *Weighted* postings serve ``token_search``: of each token the entities that hold it, best weight first, ties by entity. *Sized* postings serve the
trigram search: of each trigram the names that hold it, by their number of trigrams. Both are cut into blocks of ``BLOCK`` entries; a block
knows its bounds. Blocks are kept as Parquet, sorted by term, with Bloom filters on the term, so a search reads the row groups of its terms only. Beside
them lies what an entity holds, for exact scores.

A list that changes gets a further segment with the postings of the added and updated entities; the keys of removed and updated ones are put
on a list of stale keys, and their entries in older segments are passed over. Bounds of blocks with stale entries are too
high at worst, which costs reading and no match. Once the stale keys are many, write the index anew.

**Best k by weight** (``best_by_tokens``) reads the first blocks of each searched token, as many as hold k valid entries: of entities that hold one of the
searched tokens only these can be among the best. Those that hold several are in a list that is not the longest of that search; such lists are read whole, once for
all searches, and meet them by pairs of tokens (``tables.best_of_held``). All are scored exactly, from what they hold. Searches for the same tokens are
answered once. A frequent token is many blocks, each a row of its own, so none of them gathers in one task.

**Similar names** (``best_by_trigrams``) read the rarest trigrams of the searched name only, as many as a name above the threshold must share one of, and of these
the blocks whose sizes can reach it. Names that came up are scored from their trigrams.

Cases: tokens that nothing holds give nothing; an empty search gives no row; a repeated token counts once, with its best weight; null or
empty names have no trigrams. Empty lists give empty results. ``Found.postings_read`` counts the entries that were read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwarden.functions.names import normalize_name
from listwarden.functions.similarity import trigram_set_similarity, trigrams
from listwarden.operators.staging import materialized, new_folder
from listwarden.operators.tables import ENTITY, best_of_held, live

BLOCK = 128


@dataclass(frozen=True)
class Postings:
    """An index: blocks (segment, term, block, n, entries and bounds), held (what an entity holds), stale (keys with the segment they end at)."""

    blocks: DataFrame
    held: DataFrame
    stale: DataFrame | None = None
    segments: int = 1


@dataclass(frozen=True)
class Found:
    """Rows of a search, the entries read for it and the rounds it took."""

    rows: DataFrame
    postings_read: int
    rounds: int


def _stored(df: DataFrame, name: str, term: str) -> DataFrame:
    """``df`` sorted by term, with a Bloom filter on it, written to the shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    ranged = df.repartitionByRange(F.col(term)).sortWithinPartitions(term)
    ranged.write.option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{term}", "true").parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def _blocks(postings: DataFrame, order: list[Column], entry: Column, segment: int) -> DataFrame:
    """Blocks of at most ``BLOCK`` entries in the given order of each term."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(*order)) - 1
    placed = postings.withColumn("place", place).withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    grouped = placed.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("place", entry.alias("e")))).alias("es"))
    entries = F.transform("es", lambda x: x["e"])
    return grouped.select(F.lit(segment).alias("segment"), "term", "block", F.size("es").alias("n"), entries.alias("entries"))


def weighted(tokens: DataFrame, weights: dict[str, float], segment: int = 0) -> Postings:
    """Index of tokens (source, entity_id, token, weight), valued by ``weights``."""
    value = F.lit(0.0)
    for letter, number in weights.items():
        value = F.when(F.col("weight") == letter, number).otherwise(value)
    valued = tokens.groupBy(*ENTITY, F.col("token").alias("term")).agg(F.max(value).alias("value"))
    valued = _stored(valued, "held", "entity_id")
    blocks = _blocks(valued, [F.desc("value"), *map(F.col, ENTITY)], F.struct("value", *ENTITY), segment)
    return Postings(_stored(blocks, "postings", "term"), valued.withColumn("segment", F.lit(segment)), None, segment + 1)


def merged(index: Postings, fresh: Postings, gone: DataFrame) -> Postings:
    """``index`` with the postings ``fresh`` (of segment ``index.segments``) and without the entities ``gone`` (removed or updated) in the older ones."""
    ends = gone.select(*ENTITY, F.lit(index.segments).alias("ends")).distinct()
    stale = ends if index.stale is None else index.stale.unionByName(ends)
    return replace(
        index, blocks=index.blocks.unionByName(fresh.blocks), held=index.held.unionByName(fresh.held), stale=materialized(stale, "stale"), segments=index.segments + 1
    )


def _valid_holdings(index: Postings) -> DataFrame:
    if index.stale is None:
        return index.held.drop("segment")
    ends = index.stale.groupBy(*ENTITY).agg(F.max("ends").alias("ends"))
    return index.held.join(ends, ENTITY, "left").filter(F.col("ends").isNull() | (F.col("segment") >= F.col("ends"))).drop("segment", "ends")


def _first_of_terms(index: Postings, terms: DataFrame, limit: int) -> tuple[DataFrame, int, int]:
    """(token, source, entity_id) of the best ``limit`` entities of each of the ``terms`` (term) that hold it now, the entries read and the rounds.

    Blocks of a term are read from the front, a doubling number of them each round, until it has so many valid entries.
    """
    ends = None if index.stale is None else index.stale.groupBy(*ENTITY).agg(F.max("ends").alias("ends"))
    left, valid, depth, before, read, rounds = terms, None, -(-limit // BLOCK), 0, 0, 0
    while True:
        rounds += 1
        parts = index.blocks.filter((F.col("block") >= before) & (F.col("block") < depth)).join(left, [c for c in left.columns])
        fresh = materialized(parts, "blocks")
        read += fresh.agg(F.sum("n").alias("n")).first()["n"] or 0
        each = fresh.select("segment", "term", F.explode("entries").alias("e")).select("segment", "term", "e.*")
        if ends is not None:
            each = each.join(ends, ENTITY, "left").filter(F.col("ends").isNull() | (F.col("segment") >= F.col("ends"))).drop("ends")
        each = materialized(each, "valid")
        valid = each if valid is None else valid.unionByName(each)
        if ends is None:
            break
        # a segment's term goes on if its last block was full and it has too few valid entries so far
        full = fresh.filter((F.col("block") == depth - 1) & (F.col("n") == BLOCK)).select("segment", "term")
        enough = valid.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
        left = materialized(full.join(enough, ["segment", "term"], "left_anti"), "left")
        if left.isEmpty():
            break
        before, depth = depth, depth * 2
    order = Window.partitionBy("term").orderBy(F.desc("value"), *ENTITY)
    best = valid.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    return materialized(best.select(F.col("term").alias("token"), *ENTITY), "first"), read, rounds


def best_by_tokens(index: Postings, searches: DataFrame, limit: int) -> Found:
    """(search_id, source, entity_id, rank, matched_tokens): the best ``limit`` entities of each search (search_id, token) by summed weight."""
    asked = materialized(searches.groupBy("search_id").agg(F.sort_array(F.collect_set("token")).alias("tokens")), "asked")
    distinct = materialized(asked.select("tokens").distinct().select(F.xxhash64("tokens").alias("q"), "tokens"), "searches")
    terms = materialized(distinct.select(F.explode("tokens").alias("term")).distinct(), "terms")
    first, read, rounds = _first_of_terms(index, terms, limit)

    # An entity that holds two searched tokens holds one that is not the longest list of that search: these are read whole, each once.
    length = index.blocks.select("term", "n").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("length"))
    several = distinct.filter(F.size("tokens") > 1).select("q", F.explode("tokens").alias("term")).join(length, "term")
    longest = several.groupBy("q").agg(F.max(F.struct("length", "term")).alias("longest"))
    shorter = several.join(longest, "q").filter(F.col("term") != F.col("longest.term")).select("term").distinct()
    whole = materialized(index.blocks.join(shorter, "term"), "whole")
    read += whole.agg(F.sum("n").alias("n")).first()["n"] or 0
    met = whole.select(F.explode("entries").alias("e")).select("e.source", "e.entity_id").union(first.select(*ENTITY)).distinct()

    value = F.struct(F.col("term").alias("token"), "value")
    held = _valid_holdings(index).join(terms, "term", "left_semi").join(met, ENTITY, "left_semi").groupBy(*ENTITY).agg(F.sort_array(F.collect_list(value)).alias("held"))
    best = materialized(best_of_held(distinct, held, first, limit), "best")
    found = asked.join(distinct, "tokens").join(best, "q").select("search_id", *ENTITY, "rank", "matched_tokens")
    return Found(found, read, rounds)


def sized(entities: DataFrame, segment: int = 0) -> Postings:
    """Index of the trigrams of ``normalized_name`` of live entities."""
    listed = live(entities).select(*ENTITY, "primary_name", trigrams(F.col("normalized_name")).alias("grams"))
    listed = _stored(listed.withColumn("size", F.size("grams")), "held", "entity_id")
    each = listed.select(*ENTITY, "size", F.explode("grams").alias("term"))
    blocks = _blocks(each, [F.col("size"), *map(F.col, ENTITY)], F.struct("size", *ENTITY), segment)
    bounds = [F.get("entries", F.lit(0))["size"].alias("least"), F.element_at("entries", -1)["size"].alias("most")]
    return Postings(_stored(blocks.select("*", *bounds), "postings", "term"), listed.withColumn("segment", F.lit(segment)), None, segment + 1)


def best_by_trigrams(index: Postings, name: str, threshold: float = 0.3, limit: int = 100) -> Found:
    """As ``tables.search_by_name``: (source, entity_id, primary_name, similarity) of live entities, best first."""
    spark = index.blocks.sparkSession
    wanted = spark.range(1).select(trigrams(normalize_name(F.lit(name))).alias("g")).first()["g"] or []
    size = len(wanted)
    mine = index.blocks.filter(F.col("term").isin(wanted) & (F.col("most") > threshold * size) & (F.col("least") * threshold < size))
    uses = {r["term"]: r["n"] for r in mine.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row for each trigram of the name
    # more than threshold * size trigrams are shared, so one of the rarest size - floor(that) is
    rarest = sorted(wanted, key=lambda g: (uses.get(g, 0), g))[: size - int(threshold * size + 1e-9)]
    chosen = mine.filter(F.col("term").isin(rarest))
    read = sum(uses.get(g, 0) for g in rarest)
    met = chosen.select(F.explode("entries").alias("e")).select("e.source", "e.entity_id").distinct()
    score = trigram_set_similarity(F.col("grams"), F.array(*[F.lit(g) for g in wanted]) if wanted else F.array().cast("array<string>"))
    scored = _valid_holdings(index).join(met, ENTITY, "left_semi").withColumn("similarity", score).filter(F.col("similarity") > threshold)
    best = scored.orderBy(F.col("similarity").desc(), *ENTITY).limit(limit)
    return Found(best.select(*ENTITY, "primary_name", "similarity"), read, 1)
