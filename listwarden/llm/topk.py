"""Exact top-k inner products by aggregation without random access, block by block.

The candidates are dealt into blocks. In a block every component has a list sorted by value; a query
reads it from the end that its own component's sign calls for. All lists are read to the same depth.
What a list has not shown yet lies between its last value and the value at the depth reached, which
gives each candidate a lower and an upper bound of its score. When the k-th best lower bound exceeds the
upper bounds of the others, these drop out, and the survivors' scores are resolved; otherwise the
depth doubles. The bounds of a block are matrix products over all its queries. The best k of each block
meet in one window per query, of k rows for each block.

Cases: vectors that are null or hold null, NaN or infinite components take no part, neither as queries
nor as candidates, nor do rows with a null vec_id; vectors are compared with vectors of the same length only. Rows with the query's
vec_id count as the query itself; other rows with equal ids are each a candidate, and each a query, of their own. Equal scores go to the smaller vec_id. Empty tables give an
empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwarden.llm.common import staged

EXACT = 2.0**52


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long, null if the vector takes no part."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _whole(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "v").na.drop()


def block_top(ids: np.ndarray, x: np.ndarray, numbers: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, depth: int) -> pd.DataFrame:
    """The k best of one block for each query, which goes by its number; ids and x are the candidates, one row each."""
    n, found = len(ids), []
    exact = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0)) < EXACT
    xf, qf = (x.astype(np.float64), q.astype(np.float64)) if exact else (x, q)
    ascending = np.sort(xf, axis=0)
    lowest, highest = ascending[0], ascending[-1]
    up, down = np.maximum(qf, 0), np.minimum(qf, 0)
    waiting = np.arange(len(query_ids))
    while len(waiting):
        depth = min(depth, n)
        top, bottom = ascending[n - depth], ascending[depth - 1]
        from_top, from_bottom = xf >= top, xf <= bottom
        u, d = up[waiting], down[waiting]
        if depth == n:
            least = most = qf[waiting] @ xf.T
        else:
            least = u @ np.where(from_top, xf, lowest).T + d @ np.where(from_bottom, xf, highest).T
            most = u @ np.maximum(np.where(from_top, xf, top), lowest).T + d @ np.where(from_bottom, xf, bottom).T
        still = []
        for row, query in enumerate(waiting):
            own = ids == query_ids[query]
            low = np.where(own, -np.inf, least[row])
            others = n - int(own.sum())
            kth = np.partition(low, n - k)[n - k] if others > k else -np.inf
            left = np.flatnonzero((most[row] >= kth - abs(kth) * 1e-12) & ~own)
            if len(left) > max(4 * k, n // 16) and depth < n:
                still.append(query)
                continue
            score = (xf[left] @ qf[query]).astype(np.int64)
            best = np.lexsort((ids[left], -score))[:k]
            found.append((numbers[query], ids[left][best], score[best]))
        waiting, depth = np.array(still, dtype=np.int64), depth * 2
    return pd.DataFrame(
        {
            "number": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64),
            "vec_id": np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)]),
            "score": np.concatenate([f[2] for f in found] or [np.empty(0, np.int64)]),
        }
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k best of ``vectors`` with another id.

    Both have vec_id and v (array of long). ``block_rows`` and ``query_rows`` are the mean sizes of the blocks
    that one task compares.
    """
    vectors, queries = staged(_whole(vectors), "vectors"), staged(_whole(queries).withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = -(-vectors.count() // block_rows) or 1
    query_blocks = -(-queries.count() // query_rows) or 1
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("size")
    left = vectors.select("vec_id", "v", size, dealt(blocks).alias("block"), copies(query_blocks).alias("query_block"))
    right = queries.select("number", "vec_id", "v", size, dealt(query_blocks).alias("query_block"), copies(blocks).alias("block"))

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"number": [], "vec_id": [], "score": []}, dtype=np.int64)
        matrix = lambda f: np.stack(f["v"].to_numpy()).astype(np.int64).reshape(len(f), -1)
        return block_top(mine["vec_id"].to_numpy(), matrix(mine), theirs["number"].to_numpy(), theirs["vec_id"].to_numpy(), matrix(theirs), k, max(1, len(mine) // 8))

    keys = ["block", "query_block", "size"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "number long, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(queries.select("number", F.col("vec_id").alias("query_id")), "number").select("query_id", "rank", "vec_id", "score")
