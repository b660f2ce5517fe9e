"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

A document is a weighted set of its shingles of five words (all its words, if fewer); a weight is the shingle's count
times its idf, 1 + ln(N / df) / ln(N), rounded to eighths: a shingle of one document weighs twice one of all documents. Document
frequencies come from a count-mean-min sketch over all documents, of fixed width, so that the model is small
whatever the corpus. Each of 48 samplings picks the shingle that minimises ln a = ln c - r (t - b) - r with t = floor(ln w / r + b); r and c
(Gamma(2, 1)) and b (uniform) come from a table entry that a hash of the shingle selects, and a sample is the picked shingle with its t.
Samples are banded by three into 16 buckets: a pair of similarity s meets with probability 1 - (1 - s**3)**16, 0.99998 at 0.8.

Documents of equal words are one class. Of each bucket ``graph.bucket_groups`` checks only the pairs it needs. Where many documents of a
bucket share a passage and nothing else, they are dealt anew by the rarest fifth of their shingles, of which two documents of that similarity share
one. Pairs that agree in fewer than
``MEET`` of all samples are not compared (at a similarity of 0.8 one in 10**9 does so, at 0.7 one in 10**5); the others are read. A pair is linked when
its weighted Jaccard similarity, sum of the smaller over sum of the larger weights, reaches ``least`` with TF-IDF weights or with the
counts alone (in a large group of near copies idf lowers what they share, and raises their differences). Groups are
the connected components of the links.

Cases: a null or blank text has no words; such rows are a class and a group each, with their own doc_id. Rows with one doc_id and
different texts are different documents; equal rows cannot be told apart and are judged alike. Null doc_ids count as the smallest
when a group's first document is chosen. Empty tables give empty results. Texts are read whole. Further columns are kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwarden.llm.common import staged
from listwarden.llm.graph import bucket_groups

LEAST = 0.8
SHINGLE = 5
ROWS, BANDS = 3, 16
MEET = 20
LEVELS = 8
WIDTH_BITS, DEPTH = 18, 2
ENTRY_BITS = 12
CHUNK = 1 << 20

_random = np.random.default_rng(2026)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IN_WORD = np.zeros(256, bool)
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    _IN_WORD[ord(_low) : ord(_high) + 1] = True
_IN_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACES = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = _random.integers(1, 2**63, DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLING = _random.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R, _LOG_C, _B = _random.gamma(2, 1, 1 << ENTRY_BITS), np.log(_random.gamma(2, 1, 1 << ENTRY_BITS)), _random.uniform(size=1 << ENTRY_BITS)
_powers: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    if len(_powers.get(int(base), ())) < n:
        _powers[int(base)] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, CHUNK) - 1, base, np.uint64))])
    return _powers[int(base)][:n]


def word_hashes(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its document) of concatenated UTF-8 texts that end at ``ends``."""
    n = len(text)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = _IN_WORD[text]
    border = np.zeros(n + 1, bool)
    border[np.concatenate([[0], ends])] = True
    before = np.concatenate([[False], inside[:-1]]) & ~border[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~border[1:]
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[text] * _power(_BASE, n))])
    return _mixed((total[last + 1] - total[first]) * _power(_BASE_INVERSE, n)[first]), np.searchsorted(ends, first, side="right")


def shingled(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one document's word hashes, sorted, and their counts."""
    n = min(len(words), SHINGLE)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = len(words) - n + 1
    total = np.full(starts, np.uint64(n), np.uint64)
    for k in range(n):
        total = total + words[k : k + starts] * _PLACES[k]
    ordered = np.sort(_mixed(total))
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.flatnonzero(new)
    return ordered[at], np.diff(np.append(at, len(ordered)))


def documents(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, shingles, counts) of every text, computed in pieces of about ``CHUNK`` bytes."""
    whole = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    content = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(whole):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        start = offsets[row]
        hashes, owner = word_hashes(content[start : offsets[stop]], offsets[row + 1 : stop + 1] - start)
        bounds = np.searchsorted(owner, np.arange(stop - row + 1))
        for k in range(stop - row):
            own = hashes[bounds[k] : bounds[k + 1]]
            yield row + k, own, *shingled(own)
        row = stop


def _columns(shingles: np.ndarray, row: int) -> np.ndarray:
    return (shingles * _SKETCH[row]) >> np.uint64(64 - WIDTH_BITS)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Level of idf, 0 to ``LEVELS``, of each cell of the sketch (``DEPTH`` rows of 2**``WIDTH_BITS``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, spoken = np.zeros((DEPTH, 1 << WIDTH_BITS), np.int64), 0
        for batch in batches:
            for _, words, shingles, _ in documents(batch["text"]):
                spoken += bool(len(words))
                for row in range(DEPTH):
                    np.add.at(cells[row], _columns(shingles, row), 1)
        used = np.flatnonzero(cells.ravel())
        numbers, counts = np.append(used, -1), np.append(cells.ravel()[used], spoken)
        yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(counts)], names=["cell", "n"])

    sums = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(DEPTH << WIDTH_BITS)
    known = sums[sums["cell"] >= 0]
    cells[known["cell"]] = known["n"]
    cells = cells.reshape(DEPTH, -1)
    spoken = max(2.0, float(sums["n"][sums["cell"] < 0].sum()))
    noise = (cells.sum(axis=1, keepdims=True) - cells) / (cells.shape[1] - 1)
    frequency = np.clip(cells - noise, 1, spoken)
    return np.rint(LEVELS * np.log(spoken / frequency) / np.log(spoken)).astype(np.uint8)


def levels(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The rarest estimate of the sketch's rows."""
    return np.maximum.reduce([sketch[row][_columns(shingles, row)] for row in range(DEPTH)])


def _picked(log_weight: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """ln a as an ordered 32-bit number above a 32-bit mark of t."""
    t = np.floor(log_weight / _R[entry] + _B[entry])
    bits = (_LOG_C[entry] - _R[entry] * (t - _B[entry]) - _R[entry]).astype(np.float32).view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    return ordered << np.uint64(32) | (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))


_ONCE = np.concatenate([_picked(np.full(1 << ENTRY_BITS, np.log1p(level / LEVELS)), np.arange(1 << ENTRY_BITS)) for level in range(LEVELS + 1)])


def samples(shingles: np.ndarray, counts: np.ndarray, level: np.ndarray) -> np.ndarray:
    """One 32-bit sample for each sampling; the table holds the answers for shingles that occur once."""
    more = np.flatnonzero(counts > 1)
    log_weight = np.log(counts[more] * (1 + level[more] / LEVELS))
    shelf = level.astype(np.uint64) << np.uint64(ENTRY_BITS)
    found = np.empty(len(_SAMPLING), np.uint64)
    for k, factor in enumerate(_SAMPLING):
        z = shingles * factor
        entry = z >> np.uint64(64 - ENTRY_BITS)
        key = _ONCE[shelf | entry]
        if len(more):
            key[more] = _picked(log_weight, entry[more])
        found[k] = (key ^ (z & np.uint64(0xFFFFFFFF))).min()
    return found & np.uint64(0xFFFFFFFF)


def signatures(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, id, twin, bands, samples) of every document; id and twin hash its words, null without words."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE
        for batch in batches:
            keys, bands, drawings = [], [], []
            for _, words, shingles, counts in documents(batch["text"]):
                if not len(words):
                    keys.append((None, None))
                    bands.append(None)
                    drawings.append(None)
                    continue
                keys.append(np.frombuffer(hashlib.blake2b(words.tobytes(), digest_size=16).digest(), np.int64).tolist())
                drawn = samples(shingles, counts, levels(shingles, shared.value)).reshape(BANDS, ROWS)
                drawings.append(drawn.astype("<u4").tobytes())
                key = salts.copy()
                for row in range(ROWS):
                    key = _mixed(key ^ (drawn[:, row] + _PLACES[row]))
                bands.append(key.view(np.int64))
            ids = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            columns = [batch["doc_id"], batch["text_hash"], *ids, pa.array(bands, pa.list_(pa.int64())), pa.array(drawings, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "id", "twin", "bands", "samples"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(sign, "doc_id long, text_hash long, id long, twin long, bands array<long>, samples binary")


def similarity(one: tuple, other: tuple) -> float:
    """The larger of the weighted Jaccard similarities by TF-IDF and by TF of two (shingles, counts, idf)."""
    _, here, there = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    both = np.minimum(one[1][here], other[1][there])
    best = 0.0
    for idf_one, idf_other in ((one[2], other[2]), (np.ones(len(one[1])), np.ones(len(other[1])))):
        shared = (both * idf_one[here]).sum()
        total = (one[1] * idf_one).sum() + (other[1] * idf_other).sum() - shared
        best = max(best, float(shared / total) if total else 0.0)
    return best


@F.pandas_udf(T.IntegerType())
def agreeing(one: pd.Series, other: pd.Series) -> pd.Series:
    """Number of equal samples."""
    matrix = lambda s: np.frombuffer(b"".join(s), "<u4").reshape(len(s), -1)
    return pd.Series((matrix(one) == matrix(other)).sum(axis=1) if len(one) else [], dtype="int32")


def _check(sketch: np.ndarray, least: float, drawn: DataFrame, partners: int = 512):
    """Linked pairs, by ``drawn`` (id, samples) and the texts; a task compares about ``partners`` documents with the few that they are paired with."""

    def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        shared = pairs.sparkSession.sparkContext.broadcast(sketch)
        met = pairs.join(drawn.toDF("a", "one"), "a").join(drawn.toDF("b", "other"), "b")
        pairs = staged(met.filter(agreeing("one", "other") >= MEET).select("a", "b"), "pairs")
        degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / partners).alias("parts"))
        tasks = max(1, pairs.count() // partners)
        split = pairs.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
        split = split.withColumn("task", F.pmod(F.xxhash64("a", "part"), F.lit(tasks)))
        hubs = split.select("task", "a").distinct().join(texts, F.col("a") == F.col("id")).select(F.col("task").alias("hub_task"), F.col("a").alias("hub"), F.col("text").alias("hub_text"))
        others = split.join(texts, F.col("b") == F.col("id")).select("task", "a", "b", "text")

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            def sets(frame: pd.DataFrame, name: str, text: str) -> dict:
                once = frame.drop_duplicates(name)
                found = documents(pa.array(once[text], pa.large_string()))
                return {i: (s, c, 1 + levels(s, shared.value) / LEVELS) for i, (_, _, s, c) in zip(once[name], found)}

            centers, around = sets(left, "hub", "hub_text"), sets(right, "b", "text")
            linked = [(a, b) for a, b in zip(right["a"], right["b"]) if similarity(centers[a], around[b]) >= least]
            return pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

        return hubs.groupBy("hub_task").cogroup(others.groupBy("task")).applyInPandas(compare, "a long, b long")

    return check


def _prefixes(sketch: np.ndarray, least: float):
    """Buckets of a document's rarest shingles, so many that the weight of the others, by TF-IDF and by TF, is below ``least`` of all.

    The rarest shingle that two documents of that similarity share is among them in both. Rare is what few of the documents that are
    dealt hold, counted exactly: what only one of them holds comes first and makes no bucket, so a document with enough of its own meets nobody.
    Of two such documents the lighter one shares at least 2 * least / (1 + least) of its weight: that shingle is ``core`` to it, among the rarest that leave less than so much.
    """

    def refine(ids: DataFrame, texts: DataFrame) -> DataFrame:
        shared = ids.sparkSession.sparkContext.broadcast(sketch)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [shingles for _, _, shingles, _ in documents(batch["text"])]
                marks, n = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers, marks, parts = [], [], ([], [])
                for row, _, shingles, counts in documents(batch["text"]):
                    marks.append(shingles.view(np.int64))
                    numbers.append(np.full(len(shingles), batch["id"][row].as_py(), np.int64))
                    for part, weight in zip(parts, (counts * (1 + levels(shingles, shared.value) / LEVELS), counts.astype(float))):
                        part.append((weight / weight.sum()).astype(np.float32))
                columns = [pa.array(np.concatenate(x or [np.empty(0, t)])) for x, t in ((marks, np.int64), (numbers, np.int64), (parts[0], np.float32), (parts[1], np.float32))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "id", "by_idf", "by_count"])

        left = texts.join(ids, "id", "left_semi").select("id", "text")
        held = left.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1")
        dealt = left.mapInArrow(deal, "bucket long, id long, by_idf float, by_count float").join(held, "bucket")
        others = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
        rest = F.greatest(F.sum("by_idf").over(others), F.sum("by_count").over(others))
        core = F.col("rest") >= 2 * least / (1 + least) - 1e-5
        return dealt.withColumn("rest", rest).filter(F.col("rest") >= least - 1e-5).select("bucket", "id", core.alias("core"))

    return refine


def _overlaps(n: int, owner: np.ndarray, element: np.ndarray, weights: list[np.ndarray], often: int = 32, chunk: int = 2048) -> list[np.ndarray]:
    """For each of ``weights`` of the elements: the sum over what two of ``n`` documents share, for all of them. An element comes once a document."""
    found = [np.zeros((n, n)) for _ in weights]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.empty(0, np.int64)
    held = np.diff(np.append(first, len(element)))
    dense = np.flatnonzero(held >= (often if n > 4 * often else 2))
    for start in range(0, len(dense), chunk):
        part = dense[start : start + chunk]
        matrix = np.zeros((n, len(part)))
        for_part = np.repeat(np.arange(len(part)), held[part])
        at = np.repeat(first[part] - np.cumsum(held[part]) + held[part], held[part]) + np.arange(held[part].sum())
        matrix[owner[at], for_part] = 1
        for shared, weight in zip(found, weights):
            shared += (matrix * weight[element[first[part]]]) @ matrix.T
    for size in range(2, often) if n > 4 * often else ():
        same = first[held == size]
        for start in range(0, len(same), (1 << 20) // size**2):
            part = same[start : start + (1 << 20) // size**2]
            members = owner[part[:, None] + np.arange(size)]
            cell = (members[:, :, None] * n + members[:, None, :]).ravel()
            for shared, weight in zip(found, weights):
                shared += np.bincount(cell, np.repeat(weight[element[part]], size**2), n * n).reshape(n, n)
    return found


def linked_all(sets: list[tuple], least: float) -> np.ndarray:
    """Whether ``similarity`` of two of the documents (shingles, counts, idf) reaches ``least``, for every two of them."""
    n = len(sets)
    shingles, counts, idf = (np.concatenate([s[k] for s in sets]) for k in range(3))
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    totals = [np.bincount(owner, w, n) for w in (counts * idf, counts.astype(float))]
    order = np.lexsort((counts, shingles))
    shingles, counts, idf, owner = shingles[order], counts[order], idf[order], owner[order]
    fresh = np.concatenate([[True], shingles[1:] != shingles[:-1]])
    # an element is a step of a shingle's counts: who has a count has all steps up to it, so that two share the smaller count
    step = fresh | np.concatenate([[True], counts[1:] != counts[:-1]])
    last = np.cumsum(step) - 1
    zero = last[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    at = np.flatnonzero(step)
    height = (counts[at] - np.where(fresh[at], 0, counts[np.maximum(at - 1, 0)])).astype(float)
    steps = last - zero + 1
    element = np.repeat(zero - np.cumsum(steps) + steps, steps) + np.arange(steps.sum())
    links = np.zeros((n, n), bool)
    for shared, total in zip(_overlaps(n, np.repeat(owner, steps), element, [height * idf[at], height]), totals):
        both = total[:, None] + total - shared
        links |= (shared >= least * both) & (shared / np.where(both > 0, both, 1) >= least)
    return links


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same groups, one fewer than their members."""
    fresh, found = np.ones(len(links), bool), []
    for root in range(len(links)):
        reached = [root] if fresh[root] else []
        fresh[root] = False
        while reached:
            node = reached.pop()
            near = np.flatnonzero(links[node] & fresh)
            fresh[near] = False
            found += [(node, int(k)) for k in near]
            reached += near.tolist()
    return found


def _cells(sketch: np.ndarray, least: float, block: int = 512):
    """Links among members of buckets. Buckets with one smallest component are one table of documents, cut into squares of two blocks;
    a square's similarities are sums over its shared shingles, so only links become rows."""

    def cells(inside: DataFrame, texts: DataFrame) -> DataFrame:
        shared = inside.sparkSession.sparkContext.broadcast(sketch)
        tables = inside.groupBy("bucket").agg(F.min("component").alias("table"))
        members = staged(inside.join(tables, "bucket").select("table", "id", "component").distinct(), "tables")
        blocks = members.groupBy("table").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        squares = members.join(blocks, "table").select("table", "id", "component", own.alias("own"), other)
        squares = squares.select("table", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "component")
        squares = staged(squares, "squares")
        tasks = max(1, squares.count() // (2 * block))
        dealt = squares.withColumn("task", F.pmod(F.xxhash64("table", "low", "high"), F.lit(tasks)))
        said = dealt.select(F.col("task").alias("text_task"), F.col("id").alias("text_id")).distinct()
        said = said.join(texts, F.col("text_id") == F.col("id")).select("text_task", "text_id", "text")

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = documents(pa.array(right["text"], pa.large_string()))
            sets = {i: (s, c, 1 + levels(s, shared.value) / LEVELS) for i, (_, _, s, c) in zip(right["text_id"], found)}
            linked = []
            for _, square in left.groupby(["table", "low", "high"]):
                ids, component = square["id"].to_numpy(), square["component"].to_numpy()
                links = linked_all([sets[i] for i in ids], least) & (component[:, None] != component)
                linked += [(ids[a], ids[b]) for a, b in _forest(links)]
            return pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

        return dealt.groupBy("task").cogroup(said.groupBy("text_task")).applyInPandas(compare, "a long, b long")

    return cells


def near_duplicates(docs: DataFrame, least: float = LEAST, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, class_id, group_id, keep) of each row of ``docs`` (doc_id, text).

    class_id and group_id are the smallest doc_id of the same words and of the group; keep marks the group's first document.
    """
    sketch = frequencies(docs)
    signed = staged(signatures(docs, sketch), "signatures")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    spoken = signed.filter(F.col("id").isNotNull())
    classes = staged(spoken.groupBy("id", "twin").agg(first, F.any_value("bands").alias("bands"), F.any_value("samples").alias("samples")), "classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), "id").distinct()

    def texts(ids: DataFrame) -> DataFrame:
        wanted = staged(classes.join(ids, "id").select("id", F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash")), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
        return staged(docs.select("doc_id", "text").join(wanted, same).select("id", "text").dropDuplicates(["id"]), "texts")

    linked = bucket_groups(buckets, _check(sketch, least, classes.select("id", "samples")), texts, _prefixes(sketch, least), cells=_cells(sketch, least))
    grouped = staged(classes.join(linked, "id", "left").select("id", "twin", "first", F.struct(F.coalesce("component", "id").alias("c"), F.when(F.col("component").isNull(), F.col("twin")).alias("t")).alias("g")), "grouped")
    heads = staged(grouped.groupBy("g").agg(F.min("first").alias("head")), "heads")
    of_class = staged(grouped.join(heads, "g").select("id", "twin", "first", "head"), "of_class")
    own = F.struct("doc_id", "text_hash")
    told = signed.select("doc_id", "text_hash", "id", "twin").join(of_class, ["id", "twin"], "left")
    return told.select(
        "doc_id", "text_hash",
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        (F.col("id").isNull() | own.eqNullSafe(F.col("head"))).alias("keep"),
    )


def dedup(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with all their columns, the first document of each group."""
    judged = near_duplicates(docs, least).filter(~F.col("keep")).select(F.col("doc_id").alias("_copy_doc"), F.col("text_hash").alias("_copy_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_copy_doc")) & (F.xxhash64("text") == F.col("_copy_hash"))
    return docs.join(staged(judged, "copies"), same, "left_anti")
