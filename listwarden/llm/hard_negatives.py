"""Hard negatives of labelled vectors, scored by the method of the four Russians.

A candidate's integer components are cut into bit planes: one byte holds the bits of one plane for eight dimensions (two's
complement, so the highest plane counts negatively). For each group of eight dimensions an anchor has a table of the sums of all
256 subsets of its components. A score is then looked up: per plane the sum of the tables at the candidate's bytes, and the planes
from the highest down by doubling and adding. Scores are full and exact.

Anchors and candidates are dealt into blocks by hash; one task scores one block against one block, a strip of candidates at
a time, and keeps for each anchor the best rows only. The first pass finds the positives, the second, which scores again instead of
storing scores, the negatives within the margins of each positive. What is shuffled is the packed candidates (one bit per plane
and dimension), once for each block of anchors, and at most the best rows of each block.

Cases: rows with a null vec_id or label, a null vector, or null, NaN or infinite components take no part; vectors are compared with
vectors of the same length only (length 0: all scores are 0). Rows with the anchor's vec_id count as the anchor itself; other rows with
equal ids are each a row of their own, anchors too. Equal scores are ordered by the smaller vec_id. An anchor without positives, or
a positive without negatives, gives no rows. Empty tables give empty results. Further columns are not read. Scores must fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwarden.llm.common import staged

GROUP = 8
STRIP = 1024
_SUBSETS = (np.arange(256)[:, None] >> np.arange(GROUP) & 1).astype(np.int64)


def pack(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """(rows, planes * groups) bytes of integer vectors, and the number of planes."""
    n, size = vectors.shape
    planes = max(int(np.max(vectors, initial=0)).bit_length(), (-1 - int(np.min(vectors, initial=0))).bit_length()) + 1
    bits = (vectors[:, None, :] >> np.arange(planes)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").reshape(n, planes * -(-size // GROUP)), planes


def tables(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of every subset of each group of eight components."""
    n, size = anchors.shape
    padded = np.zeros((n, -(-size // GROUP) * GROUP), np.int64)
    padded[:, :size] = anchors
    return np.einsum("sd,ngd->gsn", _SUBSETS, padded.reshape(n, -1, GROUP))


def scores(table: np.ndarray, packed: np.ndarray, planes: int) -> np.ndarray:
    """(candidates, anchors) inner products from the anchors' tables and the candidates' packed bit planes."""
    groups = table.shape[0]
    planed = packed.reshape(len(packed), planes, groups)
    total = np.zeros((len(packed), table.shape[2]), table.dtype)
    for plane in reversed(range(planes)):
        total *= 2
        for group in range(groups):
            looked_up = table[group].take(planed[:, plane, group], axis=0)
            total += -looked_up if plane == planes - 1 else looked_up
    return total


def _best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) indices of the k best allowed candidates of each anchor; candidates come in the order that settles ties."""
    if len(score) <= k:
        candidate, anchor = np.nonzero(allowed)
        return anchor, candidate
    low = np.iinfo(score.dtype).min
    ranked = np.where(allowed, score, low)
    kth = np.partition(ranked, len(ranked) - k, axis=0)[len(ranked) - k]
    above = allowed & (ranked > kth)
    room = k - above.sum(axis=0)
    level = allowed & (ranked == kth)
    candidate, anchor = np.nonzero(above | (level & (np.cumsum(level, axis=0) <= room)))
    return anchor, candidate


def _compare(anchors: pd.DataFrame, candidates: pd.DataFrame, chosen: Callable) -> pd.DataFrame:
    """Strip by strip ``chosen(anchors, strip, score)`` gives (anchor, strip row, further columns); returns them with ids and scores."""
    candidates = candidates.sort_values("vec_id", kind="stable", ignore_index=True)
    matrix = np.stack(anchors["v"].to_numpy()).astype(np.int64).reshape(len(anchors), -1)
    planes = int(candidates["planes"].max())
    widest = int(np.abs(matrix).sum(axis=1).max(initial=0)) << planes
    table = tables(matrix).astype(np.int32 if widest < 2**31 else np.int64)
    found = []
    for start in range(0, len(candidates), STRIP):
        strip = candidates.iloc[start : start + STRIP]
        for number, rows in strip.groupby("planes", sort=True):
            packed = np.frombuffer(b"".join(rows["packed"]), np.uint8).reshape(len(rows), -1)
            score = scores(table, packed, int(number)).astype(np.int64)
            other = rows["vec_id"].to_numpy()[:, None] != anchors["vec_id"].to_numpy()[None, :]
            same = rows["label"].to_numpy()[:, None] == anchors["label"].to_numpy()[None, :]
            for anchor, row, more in chosen(score, other, same):
                found.append(pd.DataFrame({"anchor": anchors["anchor"].to_numpy()[anchor], "vec_id": rows["vec_id"].to_numpy()[row], "score": score[row, anchor], "place": more}))
    empty = pd.DataFrame({"anchor": [], "vec_id": [], "score": [], "place": []}, dtype=np.int64)
    return pd.concat([empty, *found], ignore_index=True).astype(np.int64)


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, planes, packed) of ``vectors`` (vec_id, label, v array of long)."""

    def deal(batches):
        for batch in batches:
            for size, rows in batch.groupby(batch["v"].map(len), sort=False):
                packed, planes = pack(np.stack(rows["v"].to_numpy()).astype(np.int64).reshape(len(rows), -1))
                yield pd.DataFrame({"vec_id": rows["vec_id"], "label": rows["label"], "size": np.int32(size), "planes": np.int32(planes), "packed": [r.tobytes() for r in packed]})

    return vectors.mapInPandas(deal, "vec_id long, label long, size int, planes int, packed binary")


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, block_rows: int = 16_384, anchor_rows: int = 512) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors`` have vec_id, label and v (array of long, null if the row takes no part). An anchor's positives are its best
    ``positives`` rows of the same label; a negative of another label scores between ``least`` and ``most`` per cent of the positive.
    ``block_rows`` and ``anchor_rows`` are the mean sizes of the blocks that one task compares.
    """
    whole = lambda f: f.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v").na.drop()
    packed = staged(_packed(whole(vectors)), "packed")
    own = staged(whole(anchors).withColumn("anchor", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "anchors")
    blocks, anchor_blocks = -(-packed.count() // block_rows) or 1, -(-own.count() // anchor_rows) or 1
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["block", "anchor_block", "size"]
    right = packed.withColumn("block", dealt("vec_id", blocks)).withColumn("anchor_block", copies(anchor_blocks))

    def scored(left: DataFrame, choose: Callable) -> DataFrame:
        def compare(mine_: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if mine_.empty or theirs.empty:
                return pd.DataFrame({"anchor": [], "vec_id": [], "score": [], "place": []}, dtype=np.int64)
            return _compare(mine_, theirs, choose(mine_))

        dealt_out = left.withColumn("anchor_block", dealt("anchor", anchor_blocks)).withColumn("block", copies(blocks))
        return dealt_out.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "anchor long, vec_id long, score long, place long")

    def near(_: pd.DataFrame) -> Callable:
        def choose(score, other, same):
            anchor, row = _best(score, other & same, positives)
            return [(anchor, row, 0)]

        return choose

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    met = scored(own, near).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    met = staged(met, "positives")
    bounds = met.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", F.col("score").alias("score")))).alias("met"))
    bound = staged(own.join(bounds, "anchor").withColumn("bounds", F.transform("met", lambda m: m["score"])).drop("met"), "bounds")

    def between(anchor_rows_: pd.DataFrame) -> Callable:
        n = anchor_rows_["bounds"].map(len).to_numpy()
        bounds_ = np.zeros((len(n), positives), np.int64)
        for row, known in enumerate(anchor_rows_["bounds"]):
            bounds_[row, : len(known)] = known

        def choose(score, other, same):
            for place in range(int(n.max(initial=0))):
                positive = bounds_[:, place]
                fits = other & ~same & (n > place) & (least * positive <= 100 * score) & (100 * score <= most * positive)
                anchor, row = _best(score, fits, negatives)
                yield anchor, row, place + 1

        return choose

    ranked = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    hard = scored(bound, between).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    hard = hard.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = met.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = own.select("anchor", F.col("vec_id").alias("anchor_id"))
    told = hard.join(positive, ["anchor", "place"]).join(ids, "anchor")
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("place").cast("int").alias("positive_rank"))
