"""Divergence of sources: a joint walk over the quadtrees of the group-term count matrix.

A group is a (lang, source), a term a run of letters and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that
occur in at least ``LEAST_DOCUMENTS`` of its documents. A group gives each kept term p = 1 + floor(UNITS * (n + 1) / (N + V)); a group's
divergence from another is the sum over the kept terms of floor((p - q)**2 / q), all in exact integers.

The count matrix of a language is cut into tiles: terms by hash, ``TERMS`` on average, groups ``ROWS`` by ``ROWS``. A tile
holds the rows of two blocks of groups. Over it stands a quadtree: per level a bitmap of the quadrants that hold a nonzero count. A walk
goes down from the root with pairs of row quadrants and one column quadrant: where both quadrants are all zero, every pair of their
groups has the same two values at each of their terms, so the width of the quadrant is booked for the pair of quadrants and priced once at the
end; otherwise the walk goes on in the quarters, and at single cells the values are computed. The walk takes at most
``FRONTIER`` triples at a time. A task holds one tile: at most two blocks of rows by the terms of one hash block.

Counts are added up within each Arrow batch, so a language or source that holds a third of all rows sends no more than others. Every pair of groups of a
language is a row of the result, as asked. Names of groups and terms are ordered by their UTF-8 bytes.

Cases: null text, lang and source are ''. A group without terms has N = 0; a language without kept terms has V = 0, and its
pairs the value 0. Equal rows count as often as they come. Equal values are ordered by name. Empty table: empty result. Texts are
read whole. Further columns are not read. Sums fit in 63 bits while N + V is below 9 * 10**15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwarden.llm.common import staged
from listwarden.llm.spoken import pieces

LEAST_DOCUMENTS = 3
UNITS_DIGITS = 3  # of base 1000: UNITS = 10**9
TOP_TERMS = 200
TERMS, ROWS = 4096, 64
FRONTIER = 1 << 18

_OTHER = np.ones(256, bool)
_OTHER[ord("A") : ord("Z") + 1] = _OTHER[ord("a") : ord("z") + 1] = False
_OTHER[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of each Arrow batch: occurrences, and documents that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.Table.from_batches([batch.select(["lang", "source"])]).group_by(["lang", "source"], use_threads=False)
            known = names.aggregate([]).combine_chunks()
            langs, sources = (known[c].combine_chunks() if known.num_rows else pa.array([], pa.string()) for c in ("lang", "source"))
            number = {pair: k for k, pair in enumerate(zip(langs.to_pylist(), sources.to_pylist()))}
            of_row = np.array([number[pair] for pair in zip(batch["lang"].to_pylist(), batch["source"].to_pylist())], np.int64)
            for start, spoken in pieces(batch["text"], _OTHER, _LOWER):
                coded = spoken.words().dictionary_encode()
                code, terms = np.asarray(coded.indices).astype(np.int64), coded.dictionary
                if not len(code):
                    continue
                by_document, n = np.unique(spoken.document * len(terms) + code, return_counts=True)
                document, term = by_document // len(terms), by_document % len(terms)
                cell, place = np.unique(of_row[start + document] * len(terms) + term, return_inverse=True)
                said = pc.binary_slice(terms, 0, -1).cast(pa.large_string()).cast(pa.string()).take(pa.array(cell % len(terms)))
                group = pa.array(cell // len(terms))
                numbers = [pa.array(np.bincount(place, weights=n).astype(np.int64)), pa.array(np.bincount(place).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), said, *numbers], names=["lang", "source", "term", "n", "documents"])

    return docs.mapInArrow(count, "lang string, source string, term string, n long, documents long")


def share(n: str, total: str) -> Column:
    """1 + floor(10**9 * (n + 1) / total) by long division in base 1000, which does not overflow."""
    rest, quotient = f"({n} + 1)", f"(({n} + 1) div {total})"
    for _ in range(UNITS_DIGITS):
        rest = f"({rest} % {total} * 1000)"
        quotient = f"({quotient} * 1000 + {rest} div {total})"
    return F.expr(f"{quotient} + 1")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``share``, for arrays."""
    rest = n + 1
    quotient = rest // total
    for _ in range(UNITS_DIGITS):
        rest = rest % total * 1000
        quotient = quotient * 1000 + rest // total
    return quotient + 1


def bitmaps(counts: np.ndarray) -> list[np.ndarray]:
    """The quadtree's levels, single cells first: which quadrants hold a nonzero count."""
    levels = [counts != 0]
    while max(levels[-1].shape) > 1:
        rows, columns = levels[-1].shape
        even = np.zeros((rows + rows % 2, columns + columns % 2), bool)
        even[:rows, :columns] = levels[-1]
        levels.append(even[::2, ::2] | even[1::2, ::2] | even[::2, 1::2] | even[1::2, 1::2])
    return levels


def divergences(counts: np.ndarray, totals: np.ndarray, first: int, across: bool) -> np.ndarray:
    """(rows, rows) sums over all columns of floor((p - q)**2 / q), p of the row and q of the column of the result.

    ``counts`` is a tile, ``totals`` N + V of its rows. With ``across`` only pairs of one of the ``first`` rows and one of the others count.
    """
    rows, columns = counts.shape
    levels = bitmaps(counts)
    value, both_zero = np.zeros((rows, rows), np.int64), np.zeros((rows, rows), np.int64)
    p = shares(counts, totals[:, None])
    zero = shares(np.zeros(rows, np.int64), totals)
    booked = [np.zeros((len(level), len(level)), np.int64) for level in levels]

    def walk(a: np.ndarray, b: np.ndarray, column: np.ndarray, level: int) -> None:
        for start in range(0, len(a), FRONTIER):
            step(a[start : start + FRONTIER], b[start : start + FRONTIER], column[start : start + FRONTIER], level)

    def step(a: np.ndarray, b: np.ndarray, column: np.ndarray, level: int) -> None:
        bitmap = levels[level]
        held = bitmap[a, column] | bitmap[b, column]
        width = np.minimum(column + 1 << level, columns) - (column << level)
        np.add.at(booked[level], (a[~held], b[~held]), width[~held])
        a, b, column = a[held], b[held], column[held]
        if not len(a):
            return
        if level == 0:
            of_a, of_b = p[a, column], p[b, column]
            square = (of_a - of_b) ** 2
            np.add.at(value, (a, b), square // of_b)
            np.add.at(value, (b, a), square // of_a)
            return
        halves = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)])
        a, b, column = ((2 * x[:, None] + halves[None, :, k]).ravel() for k, x in enumerate((a, b, column)))
        below = levels[level - 1].shape
        fits = (a < below[0]) & (b < below[0]) & (column < below[1])
        if across:
            fits &= (a << level - 1 < first) & (b + 1 << level - 1 > first)
        else:
            fits &= a <= b
        walk(a[fits], b[fits], column[fits], level - 1)

    walk(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), len(levels) - 1)
    index = np.arange(rows)
    for level, widths in enumerate(booked):
        both_zero += widths[index[:, None] >> level, index[None, :] >> level]
    upper = index[:, None] < index[None, :]
    if across:
        upper &= (index[:, None] < first) & (index[None, :] >= first)
    both_zero = np.where(upper, both_zero, 0)
    square = (zero[:, None] - zero[None, :]) ** 2
    # the booked widths stand for (row, column of the result) and for (column, row)
    np.fill_diagonal(value, 0)
    return value + square // zero[None, :] * (both_zero + both_zero.T)


def _tile(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of one tile for its ordered pairs of groups."""
    if groups.empty:
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []}).astype({"lang": object, "a": np.int64, "b": np.int64, "value": np.int64})
    groups = groups.sort_values("number", ignore_index=True)
    across = bool(groups["low"].iloc[0] != groups["high"].iloc[0])
    numbers = groups["number"].to_numpy()
    first = int((numbers // ROWS == groups["low"].iloc[0]).sum())
    # the second block begins at a quadrant of its own
    row_of = np.where(numbers // ROWS == groups["low"].iloc[0], numbers % ROWS, ROWS + numbers % ROWS) if across else numbers % ROWS
    counts = np.zeros((int(row_of.max()) + 1, int(groups["width"].iloc[0])), np.int64)
    totals = np.ones(len(counts), np.int64)
    totals[row_of] = groups["total"]
    if len(cells):
        column = np.unique(cells["term"].to_numpy(object), return_inverse=True)[1]
        counts[row_of[np.searchsorted(numbers, cells["number"])], column] = cells["n"]
    value = divergences(counts, totals, ROWS if across else first, across)[np.ix_(row_of, row_of)]
    a, b = np.nonzero((np.arange(len(numbers))[:, None] < first) != (np.arange(len(numbers))[None, :] < first) if across else ~np.eye(len(numbers), dtype=bool))
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "a": numbers[a], "b": numbers[b], "value": value[a, b]})


def audit(docs: DataFrame, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair``, all other sources of the language, and ``term``, the best ``TOP_TERMS`` terms."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    # one exchange: rows of a term of a language lie together for the sums by group and for those by language
    counts = term_counts(named).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"known": F.sum("documents").over(of_term), "lang_n": F.sum("n").over(of_term)})
    cells = staged(counts.filter(F.col("known") >= LEAST_DOCUMENTS).select("lang", "term", "source", "n", "lang_n"), "cells")

    langs = cells.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    spoken = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = named.select("lang", "source").distinct().join(spoken, ["lang", "source"], "left").join(langs, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select(
        "lang", "source", number.cast("long").alias("number"), F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
        (F.col("lang_total") + F.col("v")).alias("lang_total"), F.ceil(F.coalesce("v", F.lit(0)) / terms).cast("int").alias("blocks"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources"),
    )
    groups = staged(groups, "groups")

    known = cells.join(groups, ["lang", "source"])
    known = staged(known.withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")), "known")
    p, q = share("n", "total"), share("lang_n", "lang_total")
    rated = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    rated = rated.withColumn("value", F.expr("(p - q) * (p - q) div q")).drop("p", "q")

    widths = known.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
    own = F.expr(f"number div {ROWS}")
    paired = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sources - 1) div {ROWS}"))).alias("other")
    tile = ["lang", "block", "low", "high"]
    place = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    rows = known.select("lang", "block", "number", "term", "n", own.alias("own"), paired).select("lang", "block", "number", "term", "n", *place)
    sides = groups.filter("v > 0").select("lang", "number", "total", own.alias("own"), paired).join(widths, "lang")
    sides = staged(sides.select("lang", "block", "number", "total", "width", *place), "sides")
    summed = rows.groupBy(*tile).cogroup(sides.groupBy(*tile)).applyInPandas(_tile, "lang string, a long, b long, value long")
    summed = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda number, source: groups.select("lang", F.col("number").alias(number), F.col("source").alias(source))
    pairs = summed.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    mute = groups.filter("v = 0").select("lang", "source")
    silent = mute.join(mute.withColumnRenamed("source", "item"), "lang").filter(F.col("source") != F.col("item")).withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", "item", "value").unionByName(silent).withColumn("part", F.lit("pair"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", rank]
    return pairs.select(*columns).unionByName(rated.select(*columns).filter(F.col("rank") <= TOP_TERMS))
