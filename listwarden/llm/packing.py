"""Best-fit packing of tokenized documents by minimum bin slack.

A document becomes its token ids and an end id. Only a document longer than a sequence is cut, into
full pieces; its first piece takes the rest and may be shorter. Sequences are then planned on the histogram
of piece lengths, which has at most ``size`` rows whatever the corpus: take the longest length left, find
by subset-sum over the lengths left (a bitset of reachable sums) the combination that fills the rest best,
and use it as often as the counts allow. The plan has a few entries for each length and is all that the driver holds.
Spark ranks the pieces of each length (salted, so that a frequent length is ranked by many tasks) and
the rank finds its place in the plan.

Ids are those of the ``tokenizers`` library for ``tokenizer``; ``tiktoken`` computes them from the ranks of the
same vocabulary, several times faster, and texts it cannot take, or that hold a special token, go to ``tokenizers``.

Cases: a null text counts as empty and gives the end id alone. Rows that repeat, and rows with a null doc_id, are packed
each for itself. Texts of any length are tokenized whole. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwarden.llm.common import staged

SIZE = 1024
END = 2
SPECIAL = "<|endoftext|>"


@cache
def encoders(tokenizer: str, ranks: str):
    """(fast, exact) encoders of one vocabulary, made once in each worker."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks), "rb") as file:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path(tokenizer))


def token_ids(text: str, tokenizer: str, ranks: str) -> np.ndarray:
    fast, exact = encoders(tokenizer, ranks)
    if SPECIAL not in text:
        try:
            return fast.encode_to_numpy(text)
        except ValueError:  # the pattern needs more stack than it may take
            pass
    return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, piece, start, length, ids) of documents (doc_id, text); ids are little-endian unsigned 32-bit."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                ids = np.append(token_ids(text, tokenizer, ranks), END).astype("<u4")
                bounds = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for k, (start, end) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((None if pd.isna(doc_id) else doc_id, k, start, end - start, ids[start:end].tobytes()))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
            yield frame.astype({"doc_id": "Int64"})

    whole = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids binary")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the available pieces that fill ``room`` best, longer pieces first among equals."""
    reach, seen = 1, []
    within = (1 << (room + 1)) - 1
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        times = 1
        while left:
            times = min(times, left)
            seen.append((length, times, reach))
            reach |= (reach << (length * times)) & within
            left -= times
            times *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, times, before in reversed(seen):
        if not before >> total & 1:
            total -= length * times
            chosen[length] = chosen.get(length, 0) + times
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], size: int = SIZE) -> pd.DataFrame:
    """Rows (length, first, times, sequence, offset): pieces of this length from rank ``first`` on lie
    ``times`` to a sequence from number ``sequence`` on, starting at ``offset``; in the order of length, first."""
    counts, used, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    lengths = sorted((x for x in counts if counts[x] > 0), reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        chosen = dict(fullest(lengths, counts, size - longest))
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        repeats = min(counts[x] // times for x, times in chosen.items())
        offset = 0
        for x, times in sorted(chosen.items(), reverse=True):
            rows.append((x, used[x], times, sequence, offset))
            used[x] += repeats * times
            counts[x] -= repeats * times
            offset += x * times
        sequence += repeats
        lengths = [x for x in lengths if counts[x]]
    frame = pd.DataFrame(rows, columns=["length", "first", "times", "sequence", "offset"], dtype=np.int64)
    return frame.sort_values(["length", "first"], ignore_index=True)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (doc_id, piece, length and any further columns) with sequence_id and offset."""
    spark = cut.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("doc_id", "piece", *[c for c in cut.columns if c.startswith("ids")]), F.lit(salts))
    cut = staged(cut.withColumn("_salt", salt), "pieces")
    counted = cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counted.withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(histogram, size)
    shared = spark.sparkContext.broadcast(places.to_numpy())

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = shared.value
        wide = np.int64(1) << 50
        row = at[np.searchsorted(at[:, 0] * wide + at[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1]
        nth = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 4] + nth % row[:, 2] * row[:, 0]})

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = cut.withColumn("_nth", F.row_number().over(order) - 1).join(starts.drop("n"), ["length", "_salt"])
    placed = ranked.withColumn("_place", place("length", F.col("_first") + F.col("_nth")))
    kept = [c for c in cut.columns if c != "_salt"]
    return placed.select(*kept, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every piece of ``docs`` with its ids and its place."""
    return pack(pieces(docs, size), size)
