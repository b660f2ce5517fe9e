"""Removal of repeated passages: windows of words counted exactly in super-k-mer buckets.

Words are what lies between blanks and tabs to carriage returns. A window is ``LENGTH`` consecutive words of a document. Its minimiser is the least
hash among its runs of ``MER`` words. Consecutive windows of a document that share their minimiser travel as one packed string, their words
each with a blank behind it, to the bucket of the minimiser; equal windows have equal minimisers, so they meet. What a task sends to a bucket
is packed and compressed together, with the places (doc_id, hash of the text, number of the first word) that hold each string. A bucket
numbers its words, sorts its windows by a hash of the numbers, compares neighbours word by word, and takes the
smallest doc_id of each. A place is marked with a bit for each window that also starts in a document of smaller doc_id; a word under
such a window goes. All windows are judged on the input.

Skew: equal packed strings of the texts that a task reads together (``FLUSH`` bytes) are sent once. If a string has more than ``MOST_PLACES`` places
among them, these do not go to its bucket: a passage that a third of all documents share sends one string for each package, its smallest
doc_ids come back, and a sort-merge join by the string's two hashes, which Spark splits where it is skewed, brings them to the places. The minimisers
are first counted, over all documents, in 2**``cell_bits`` cells; those of a cell with more than 1 / ``SHARE`` of all runs are used only by
windows without another, and a window that has only such minimisers goes to a bucket by its own hash. So no minimiser has a larger share of the
strings but that of one very frequent window, which is collapsed as said. The counts (8 bytes a cell) are the only thing that reaches the driver.
A task holds one bucket at a time; there are two for each shuffle partition.

Such strings are told apart by 128 bits of hashes, windows by their words. Cases: a null or blank text has no words; it stays null, or
becomes empty. Documents of fewer words than a window keep all. A null doc_id is neither smaller nor larger than others: such a row keeps
its words and takes none from others. Rows with one doc_id don't take words from each other; equal rows come back as often as
they came. An empty table gives an empty result. Texts are read whole. Further columns are kept, but for the four that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwarden.llm.common import staged
from listwarden.llm.spoken import CHUNK, Spoken, joined, mixed, odd_numbers, pieces, spans_hashed

LENGTH = 13
MER = 3
SHARE = 4096
CELL_BITS = 16
#: Most windows of a packed string: one mark, a bit for each window, fits in a long.
MOST_WINDOWS = 32
SEPARATOR = r"[\x20\x09-\x0D]+"

_MER, _WINDOW, _NUMBER = odd_numbers(131, MER), odd_numbers(132, LENGTH), odd_numbers(133, 1)[0]
_HEAVY = np.uint64(1 << 63)
#: Bytes of text whose packed strings are sent together, and the most places that a string has in a package.
FLUSH, MOST_PLACES = 1 << 23, 16
_codec = pa.Codec("zstd", compression_level=1)


def _least_of(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    width, least = 1, values
    while width * 2 <= n:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    return np.minimum(least[: len(values) - n + 1], least[n - width :]) if width < n else least


def runs(spoken: Spoken, heavy: np.ndarray, cell_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of every run of consecutive windows with one minimiser."""
    n = len(spoken.hashes) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    mers = sum(spoken.hashes[k : len(spoken.hashes) - MER + 1 + k] * _MER[k] for k in range(MER))
    mers = mixed(mers) & ~_HEAVY
    rank = np.where(heavy[mers >> np.uint64(63 - cell_bits)], mers | _HEAVY, mers) if heavy.any() else mers
    key = _least_of(rank, LENGTH - MER + 1)
    alone = key >= _HEAVY
    if alone.any():
        at = np.flatnonzero(alone)
        key = key.copy()
        key[at] = mixed(sum(spoken.hashes[at + k] * _WINDOW[k] for k in range(LENGTH))) | _HEAVY
    windows = np.flatnonzero(spoken.document[:n] == spoken.document[LENGTH - 1 :])
    key = key[windows]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (np.diff(windows) != 1) | (key[1:] != key[:-1])
    begun = np.flatnonzero(fresh)
    place = np.arange(len(windows)) - np.repeat(begun, np.diff(np.append(begun, len(windows))))
    begun = np.flatnonzero(place % MOST_WINDOWS == 0)
    return windows[begun], np.diff(np.append(begun, len(windows))), key[begun]


def _known(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pc.is_valid(batch["doc_id"]))


def heavy_cells(docs: DataFrame, cell_bits: int = CELL_BITS) -> np.ndarray:
    """Marks the cells of minimisers that have more than 1 / ``SHARE`` of all runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << cell_bits, np.int64)
        none = np.zeros(1 << cell_bits, bool)
        for batch in batches:
            for _, spoken in pieces(_known(batch)["text"]):
                key = np.unique(spans_key(spoken, *runs(spoken, none, cell_bits)), axis=0)[:, 0]
                cells += np.bincount((key >> np.uint64(63 - cell_bits)).astype(np.int64), minlength=len(cells))
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(cells[used])], names=["cell", "n"])

    sums = docs.select("doc_id", "text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    heavy = np.zeros(1 << cell_bits, bool)
    heavy[sums["cell"][sums["n"] > sums["n"].sum() / SHARE]] = True
    return heavy


def spans_key(spoken: Spoken, first: np.ndarray, windows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(minimiser, hash of the words) of runs."""
    return np.stack([key, spans_hashed(mixed(spoken.hashes * _NUMBER), first, first + windows + LENGTH - 1) + windows.astype(np.uint64)], axis=1)


def _squeezed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of known types as one compressed text; equal bytes of numbers lie side by side."""
    head = np.array([len(x) for x in arrays], np.int64)
    raw = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in (head, *arrays))
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _opened(blob: bytes) -> list[np.ndarray]:
    """What ``_squeezed`` was given."""
    raw = np.frombuffer(_codec.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), np.uint8)

    def take(at: int, n: int, kind: type) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n)

    at, out = len(_PACKAGE) * 8, []
    for n, kind in zip(take(0, len(_PACKAGE), np.int64).tolist(), _PACKAGE):
        out.append(take(at, n, kind))
        at += n * np.dtype(kind).itemsize
    return out


#: Of the strings: low, high - low, windows, number of places; of the places: doc_id - low, text_hash, at; of the strings without places: which, minimiser, hash; text.
_PACKAGE = [np.int64, np.int64, np.uint8, np.uint8, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.uint8]
_PLACE = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32())])
_SENT = pa.schema([("bucket", pa.int32()), ("package", pa.binary()), ("key", pa.int64()), ("id", pa.int64()), ("held", pa.list_(_PLACE))])
_FOUND = "key long, id long, firsts array<long>, held array<struct<doc_id:long,text_hash:long,at:int>>, doc_id long, text_hash long, at int, bits long"


def _packages(gathered: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """The packed strings of some pieces, each once: a package for every bucket, and the places of strings that have many."""
    base = np.cumsum([0, *[len(g[0].text) for g in gathered]])
    text = np.concatenate([g[0].text for g in gathered])
    begin, end, windows, hashes, ids, texts, at = (np.concatenate(x) for x in zip(*[
        (s.offsets[first] + b, s.offsets[first + windows + LENGTH - 1] + b, windows, spans_key(s, first, windows, key), ids, texts, s.number[first])
        for b, (s, first, windows, key, ids, texts) in zip(base, gathered)
    ]))
    if not len(begin):
        return
    order = np.lexsort((ids, hashes[:, 0], hashes[:, 1]))
    begin, end, windows, hashes, ids, texts, at = (x[order] for x in (begin, end, windows, hashes, ids, texts, at))
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]).any(axis=1)]))
    last = np.append(new[1:], len(ids))
    bucket = (hashes[new, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids[new], bucket))
    new, last, bucket = new[order], last[order], bucket[order]
    low, high, n = ids[new], ids[last - 1], last - new
    many = n > MOST_PLACES
    inline = np.where(many, 0, n)
    held, held_from = joined(np.arange(len(ids)), new, new + inline)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    numbers, packages = [], []
    for one, two in zip(cuts[:-1], cuts[1:]):
        places = held[held_from[one] : held_from[two]]
        own = np.repeat(low[one:two], inline[one:two])
        named = np.flatnonzero(many[one:two])
        minimiser, same = (hashes[new[one + named], k].view(np.int64) for k in (0, 1))
        arrays = [np.diff(low[one:two], prepend=0), high[one:two] - low[one:two], windows[new[one:two]], inline[one:two], ids[places] - own, texts[places], at[places], named, minimiser, same, joined(text, begin[new[one:two]], end[new[one:two]])[0]]
        packages.append(_squeezed([np.ascontiguousarray(x, kind) for x, kind in zip(arrays, _PACKAGE)]))
        numbers.append(bucket[one])
    none = lambda k, kind: pa.nulls(k, kind)
    k = len(packages)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int32)), pa.array(packages, pa.binary()), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.list_(_PLACE))], schema=_SENT)
    if many.any():
        new, last = new[many], last[many]
        rows, cuts = joined(np.arange(len(ids)), new, last)
        places = pa.StructArray.from_arrays([pa.array(ids[rows]), pa.array(texts[rows]), pa.array(at[rows].astype(np.int32))], fields=list(_PLACE))
        spread = ((texts[new].view(np.uint64) ^ hashes[new, 1]) % np.uint64(buckets)).astype(np.int32)  # anywhere: they only pass through
        held = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), places)
        yield pa.RecordBatch.from_arrays([pa.array(spread), none(len(new), pa.binary()), pa.array(hashes[new, 0].view(np.int64)), pa.array(hashes[new, 1].view(np.int64)), held], schema=_SENT)


def packed_strings(docs: DataFrame, heavy: np.ndarray, buckets: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """(bucket, package, key, id, held): packages of packed strings, and the places (``held``) of strings that have many in the same package."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            batch = _known(batch)
            ids, texts = (np.asarray(batch[c]) for c in ("doc_id", "text_hash"))
            for start, spoken in pieces(batch["text"]):
                first, windows, key = runs(spoken, shared.value, cell_bits)
                row = start + spoken.document[first]
                waiting.append((spoken, first, windows, key, ids[row], texts[row]))
                size += len(spoken.text)
                if size >= FLUSH:
                    yield from _packages(waiting, buckets)
                    waiting, size = [], 0
        if waiting:
            yield from _packages(waiting, buckets)

    return docs.mapInArrow(send, "bucket int, package binary, key long, id long, held array<struct<doc_id:long,text_hash:long,at:int>>")


def first_documents(text: np.ndarray, windows: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Smallest doc_id of every window of packed strings, which lie one behind the other in ``text``, have ``windows`` windows, and are held first by ``low``."""
    cuts = np.concatenate([[0], np.flatnonzero(text == 0x20) + 1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
    numbers = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    string = np.repeat(np.arange(len(windows)), windows.astype(np.int64) + LENGTH - 1)
    at = np.flatnonzero(string[: max(0, len(string) - LENGTH + 1)] == string[LENGTH - 1 :])
    if not len(at):
        return at
    hashes = mixed(numbers.astype(np.uint64) * _NUMBER)
    code = mixed(sum(hashes[at + k] * _WINDOW[k] for k in range(LENGTH)))
    order = np.argsort(code)
    fresh = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    group = np.cumsum(fresh) - 1
    again = np.flatnonzero(~fresh)
    here, there = at[order[again]], at[order[again - 1]]
    differs = np.zeros(len(again), bool)
    for k in range(LENGTH):
        differs |= numbers[here + k] != numbers[there + k]
    if differs.any():  # different windows of one hash are told apart by all their words
        unsure = np.flatnonzero(np.isin(group, group[again[differs]]))
        rows = np.stack([numbers[at[order[unsure]] + k] for k in range(LENGTH)], axis=1)
        group[unsure] = group[-1] + 1 + np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        resort = np.argsort(group, kind="stable")
        order, group = order[resort], group[resort]
    begun = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    found = np.empty(len(at), np.int64)
    found[order] = np.repeat(np.minimum.reduceat(low[string[at[order]]], begun), np.diff(np.append(begun, len(group))))
    return found


def _judged(packages: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: marks of the places in the packages, and the smallest doc_ids of the windows of the strings without places."""
    opened = [_opened(p) for p in packages]
    low = np.concatenate([np.cumsum(o[0]) for o in opened])
    before = np.cumsum([0, *[len(o[0]) for o in opened]])
    high, windows, n, beyond, texts, at, named, key, same, text = (np.concatenate(x) for x in list(zip(*opened))[1:])
    high = high + low
    named = named + np.repeat(before[:-1], [len(o[7]) for o in opened])
    windows = windows.astype(np.int64)
    found = first_documents(text, windows, low)
    begun = np.cumsum(windows) - windows
    none = lambda k, kind: pa.nulls(k, kind)
    names = ["key", "id", "firsts", "held", "doc_id", "text_hash", "at", "bits"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(_PLACE), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    n = n.astype(np.int64)
    of_place = np.repeat(np.arange(len(n)), n)
    ids = beyond + low[of_place]
    some = np.flatnonzero(ids > np.minimum.reduceat(found, begun)[of_place])
    if len(some):
        of_place, ids = of_place[some], ids[some]
        width = windows[of_place]
        firsts, starts = joined(found, begun[of_place], begun[of_place] + width)
        bit = np.int64(1) << (np.arange(len(firsts)) - np.repeat(starts[:-1], width))
        bits = np.add.reduceat(np.where(firsts < np.repeat(ids, width), bit, 0), starts[:-1])
        columns = [pa.array(ids), pa.array(texts[some]), pa.array(at[some]), pa.array(bits)]
        yield pa.RecordBatch.from_arrays([none(len(some), k) for k in kinds[:4]] + columns, names=names)
    if len(named):
        order = np.lexsort((key, same))
        one = order[np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1])])]
        firsts, starts = joined(found, begun[named[one]], begun[named[one]] + windows[named[one]])
        told = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(firsts))
        yield pa.RecordBatch.from_arrays([pa.array(key[one]), pa.array(same[one]), told] + [none(len(one), k) for k in kinds[3:]], names=names)


def repeated(strings: DataFrame) -> DataFrame:
    """Rows of three kinds: marks (doc_id, text_hash, at, bits), ``firsts`` of strings with many places, and the ``held`` places of these."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting = None, []
        for batch in batches:
            passing = batch.filter(pc.is_valid(batch["held"]))
            k = passing.num_rows
            if k:
                columns = [passing["key"], passing["id"], pa.nulls(k, pa.list_(pa.int64())), passing["held"].cast(pa.list_(_PLACE)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "firsts", "held", "doc_id", "text_hash", "at", "bits"])
            for number, package in zip(batch["bucket"].to_pylist(), batch["package"]):
                if not package.is_valid:
                    continue
                if number != bucket and waiting:
                    yield from _judged(waiting)
                    waiting = []
                bucket = number
                waiting.append(package.as_py())
        if waiting:
            yield from _judged(waiting)

    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, _FOUND)


@F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
def _cut(text: pd.Series, marks: pd.Series) -> pd.DataFrame:
    out = []
    for said, found in zip(text, marks):
        if found is None or said is None:
            out.append((None, 0, 0))
            continue
        words = Spoken(np.frombuffer(said.encode(), np.uint8), np.array([len(said.encode())]))
        n = len(words.number)
        at = np.array([m["at"] for m in found])
        bits = np.array([m["bits"] for m in found])
        mark, window = np.nonzero(bits[:, None] >> np.arange(MOST_WINDOWS) & 1)
        start = at[mark] + window
        change = np.bincount(start, minlength=n + 1) - np.bincount(start + LENGTH, minlength=n + 1)
        stays = np.flatnonzero(np.cumsum(change)[:n] == 0)
        kept, _ = joined(words.text, words.offsets[stays], words.offsets[stays + 1])
        out.append((kept[:-1].tobytes().decode(), n, n - len(stays)))
    return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])


def dedup(docs: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """``docs`` with n_words, n_removed, and kept: the words that stay, joined by one blank."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(repeated(packed_strings(rows, heavy_cells(rows, cell_bits), buckets, cell_bits)), "repeated")
    told = found.filter("firsts IS NOT NULL").select("key", "id", "firsts")
    many = found.filter("held IS NOT NULL").select("key", "id", "held").join(told, ["key", "id"]).select(F.explode("held").alias("p"), "firsts")
    bits = "aggregate(transform(firsts, (f, i) -> if(f < p.doc_id, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    many = many.select("p.doc_id", "p.text_hash", "p.at", F.expr(bits).alias("bits")).filter("bits <> 0")
    marks = found.filter("bits IS NOT NULL").select("doc_id", "text_hash", "at", "bits").unionByName(many)
    marks = marks.select("doc_id", "text_hash", F.struct("at", "bits").alias("mark")).groupBy(F.col("doc_id").alias("_mark_doc"), F.col("text_hash").alias("_mark_text")).agg(F.collect_set("mark").alias("_marks"))
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    same = (F.col("doc_id").cast("long") == F.col("_mark_doc")) & (F.xxhash64("text") == F.col("_mark_text"))
    marked = docs.select(*[F.col(f"`{c}`") for c in others]).join(marks, same, "left")
    marked = marked.withColumn("_cut", _cut(F.when(F.col("_marks").isNotNull(), F.col("text")), F.col("_marks")))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATOR), "")
    uncut = F.col("_marks").isNull()
    return marked.select(
        *[F.col(f"`{c}`") for c in others],
        F.when(uncut, F.size(words)).otherwise(F.col("_cut.n_words")).cast("long").alias("n_words"),
        F.when(uncut, F.lit(0)).otherwise(F.col("_cut.n_removed")).cast("long").alias("n_removed"),
        F.when(uncut, F.when(F.col("text").isNotNull(), F.array_join(words, " "))).otherwise(F.col("_cut.kept")).alias("kept"),
    )
