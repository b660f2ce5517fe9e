"""String similarity: token-sort ratio (Arrow UDF) and trigram similarity (built-in columns)."""

from __future__ import annotations

import functools
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwarden.functions.names import name_key, once

# Executors need no copy of this package: the UDF travels with its helper functions.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SKETCH_WORDS = 4
_MASK_BYTES = 64 * 1024 * 1024


def _code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the strings in one array, and each string's length."""
    lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.sum(pc.binary_length(strings)).as_py() == lengths.sum():  # plain ASCII: bytes are letters
        _, offsets, data = strings.buffers()
        places = np.frombuffer(offsets, dtype=np.int32)[strings.offset: strings.offset + len(strings) + 1]
        letters = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        return letters[places[0]: places[-1]].astype(np.int64), lengths
    joined = "".join(strings.to_pylist()).encode("utf-32-le")
    return np.frombuffer(joined, dtype="<u4").astype(np.int64), lengths


def lcs_lengths(
    left_names: pa.Array, left_ids: np.ndarray, right_names: pa.Array, right_ids: np.ndarray
) -> np.ndarray:
    """Length of the longest common subsequence of each pair (left_ids[i], right_ids[i]).

    Bit-parallel recurrence over whole columns: bit i of a pair's state belongs to character i of
    the left string; each step consumes one character of every right string of the batch.
    """
    left_points, left_len = _code_points(left_names)
    right_points, right_len = _code_points(right_names)
    points = np.concatenate([left_points, right_points])
    used = np.zeros(points.max(initial=0) + 1, dtype=bool)
    used[points] = True
    dense = (np.cumsum(used) - 1)[points]
    size = int(used.sum()) + 1
    words = max(1, -(-int(left_len.max(initial=0)) // 64))

    # masks[w][name * size + letter] has a bit for every place of the letter in the left name
    masks = np.zeros((words, len(left_names) * size), dtype=np.uint64)
    owner = np.repeat(np.arange(len(left_names)), left_len)
    place = np.arange(len(left_points)) - np.repeat(np.cumsum(left_len) - left_len, left_len)
    bit = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
    np.bitwise_or.at(masks, (place // 64, owner * size + dense[: len(left_points)]), bit)

    # letters of the right names by place, padded with a letter that occurs nowhere
    letters = np.full((max(1, int(right_len.max(initial=0))), len(right_names)), size - 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(right_names)), right_len)
    place = np.arange(len(right_points)) - np.repeat(np.cumsum(right_len) - right_len, right_len)
    letters[place, owner] = dense[len(left_points):]

    offset = left_ids.astype(np.int64) * size
    state = np.full((words, len(left_ids)), ~np.uint64(0))
    for row in letters:
        where = offset + row[right_ids]
        carry = None
        for w in range(words):
            hit = masks[w][where]
            shared = state[w] & hit
            total = state[w] + shared
            if words > 1:
                overflow = total < shared
                if carry is not None:
                    total += carry
                    overflow |= total < carry
                carry = overflow.astype(np.uint64)
            state[w] = total | (state[w] & ~hit)
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def _encoded(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings and the position of each row's string among them."""
    encoded = strings.cast(pa.string()).dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)


@F.arrow_udf(T.IntegerType())
def common_subsequence(left: pa.Array, right: pa.Array) -> pa.Array:
    """Longest common subsequence length of two text columns (null if either is null)."""
    known = pc.and_(pc.is_valid(left), pc.is_valid(right))
    a, b = pc.fill_null(left, ""), pc.fill_null(right, "")
    longest = max(1, pc.max(pc.utf8_length(a)).as_py() or 0, pc.max(pc.utf8_length(b)).as_py() or 0)
    # The masks of very long texts are kept small by taking fewer rows at a time.
    rows = max(1, _MASK_BYTES // (8 * (longest // 64 + 1) * min(longest * 2, 4096)))
    parts = [np.zeros(0, dtype=np.int64)]
    for start in range(0, len(a), rows):
        left_names, left_ids = _encoded(a.slice(start, rows))
        right_names, right_ids = _encoded(b.slice(start, rows))
        parts.append(lcs_lengths(left_names, left_ids, right_names, right_ids))
    return pc.if_else(known, pa.array(np.concatenate(parts).astype(np.int32)), pa.scalar(None, pa.int32()))


# A filter on the score must not make the planner run the comparison twice.
common_subsequence = common_subsequence.asNondeterministic()


_TILE_ROWS, _TILE_COLUMNS, _TILE_PAIRS, _SCORED_PAIRS = 4, 8192, 1 << 15, 1 << 14
_ROWS_AT_ONCE, _TEXTS_AT_ONCE = 10_000, 16_384
OWN_BITS, _ALL_BITS = 120, 128
_SLACK = 1e-9


def _letter_kinds(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (letter, occurrence) pairs of all strings as numbers, and the string of each."""
    points, lengths = _code_points(strings)
    group = np.sort((np.repeat(np.arange(len(strings)), lengths) << 21) | points)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    occurrence = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    return group >> 21, (occurrence << 21) | (group & 0x1FFFFF)


def commonest_kinds(kinds: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pairs that get bits of their own, commonest first."""
    return kinds[np.lexsort((kinds, -count))][:OWN_BITS]


def key_sketches(strings: pa.Array, common: np.ndarray) -> np.ndarray:
    """A 128-bit sketch, as two rows of words, of the (letter, occurrence) pairs of each string.

    The pairs in ``common`` have bits of their own, the rest share the last ones. As in ``with_bag_sketch``, no more
    bits differ than the two bags do.
    """
    owner, kind = _letter_kinds(strings)
    place = OWN_BITS + (kind ^ (kind >> 21)) % (_ALL_BITS - OWN_BITS)
    if len(common):
        order = np.argsort(common)
        at = np.minimum(np.searchsorted(common, kind, sorter=order), len(common) - 1)
        place = np.where(common[order][at] == kind, order[at], place)
    sketch = np.zeros((2, len(strings)), dtype=np.uint64)
    np.bitwise_or.at(sketch, (place // 64, owner), np.left_shift(np.uint64(1), (place % 64).astype(np.uint64)))
    return sketch


def _subsequences(masks: np.ndarray, offset: np.ndarray, letters: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence of ``lcs_lengths`` for left names of one word and the rows of ``letters``, right names of one length.

    After two thirds of the letters, pairs that cannot reach their least length any more are left out, if they are many. Returns the
    places of those that reach it and their lengths.
    """
    length = letters.shape[1]
    left = np.arange(len(offset))
    state = np.full(len(offset), ~masks.dtype.type(0))
    for begin, end in ((0, 2 * length // 3), (2 * length // 3, length)):
        where, shared, total = np.empty(len(left), dtype=np.int64), np.empty_like(state), np.empty_like(state)
        for row in np.ascontiguousarray(letters[:, begin:end].T):
            np.add(row, offset, out=where)
            masks.take(where, out=shared, mode="clip")
            shared &= state
            np.add(state, shared, out=total)
            state -= shared
            state |= total
        found = np.bitwise_count(~state)
        some = np.flatnonzero(found >= least - (length - end))
        if end < length and len(some) < 0.6 * len(left):
            left, state, offset, letters, least = left[some], state[some], offset[some], letters[some], least[some]
    return left[some], found[some].astype(np.int64)


def close_pairs(left: pa.Array, least: np.ndarray, right: pa.Array, mine: np.ndarray, theirs: np.ndarray, slack: float = _SLACK):
    """Pairs of distinct keys whose score reaches the left key's least score; all right keys have one length.

    mine, theirs: ``key_sketches`` of both sides. Yields (left places, right places, scores). Every pair is tested by its
    letter bags, tile by tile; those that may reach the score are compared exactly, so many at a time.
    """
    left_points, left_len = _code_points(left)
    right_points, right_len = _code_points(right)
    length = int(right_len[0])
    both = left_len + length
    needed = np.ceil(least * both / 200.0 - slack).astype(np.int64)
    allowed = np.clip(both - 2 * needed, -1, _ALL_BITS).astype(np.int16)
    possible = allowed >= np.abs(left_len - length)
    if not possible.any():
        return
    used = np.zeros(max(left_points.max(initial=0), right_points.max(initial=0)) + 1, dtype=bool)
    used[left_points] = used[right_points] = True
    code = np.cumsum(used) - 1
    size, dense = int(code[-1]) + 1, code[left_points]
    letters = code[right_points].astype(np.min_scalar_type(size)).reshape(len(right), length)

    tall = max(_TILE_ROWS, _TILE_PAIRS // len(right))
    buffers = [np.empty(tall * min(_TILE_COLUMNS, len(right)), dtype=t) for t in (np.uint64, np.uint8, np.uint8, np.bool_)]

    starts = np.cumsum(left_len) - left_len
    kinds = np.where(left_len <= 32, 0, -(-left_len // 64))  # 0: half a word
    for kind in np.unique(kinds):
        words, width = max(1, int(kind)), np.uint64 if kind else np.uint32
        fitting = np.flatnonzero((kinds == kind) & possible)
        rows = max(1, min(2048, _MASK_BYTES // (8 * size * words)))
        for begin in range(0, len(fitting), rows):
            chunk = fitting[begin: begin + rows]
            masks = None
            if words == 1:
                place = np.arange(int(left_len[chunk].sum())) - np.repeat(np.cumsum(left_len[chunk]) - left_len[chunk], left_len[chunk])
                owner = np.repeat(np.arange(len(chunk)), left_len[chunk])
                masks = np.zeros(len(chunk) * size, dtype=width)
                np.bitwise_or.at(masks, owner * size + dense[starts[chunk][owner] + place], np.left_shift(width(1), place.astype(width)))

            def scored(i: np.ndarray, j: np.ndarray):
                if masks is None:
                    found = lcs_lengths(left.take(pa.array(chunk)), i, right, j)
                else:
                    some, found = _subsequences(masks, i * size, letters.take(j, axis=0), needed[chunk][i])
                    i, j = i[some], j[some]
                score = 200.0 * found / both[chunk][i]
                good = score >= least[chunk][i] - slack
                return chunk[i[good]], j[good], score[good]

            some = max(1, min(_SCORED_PAIRS, _MASK_BYTES // (8 * words * length)))
            held, count = [], 0
            for top in range(0, len(chunk), tall):
                tile = chunk[top: top + tall]
                limit = allowed[tile].astype(np.uint8)[:, None]
                for at in range(0, len(right), _TILE_COLUMNS):
                    wide = min(_TILE_COLUMNS, len(right) - at)
                    differ, bits, more, near = (b[: len(tile) * wide].reshape(len(tile), wide) for b in buffers)
                    np.bitwise_xor(mine[0, tile][:, None], theirs[0, at: at + wide], out=differ)
                    np.bitwise_count(differ, out=bits)
                    np.bitwise_xor(mine[1, tile][:, None], theirs[1, at: at + wide], out=differ)
                    bits += np.bitwise_count(differ, out=more)
                    met = np.flatnonzero(np.less_equal(bits, limit, out=near))
                    i = met // wide
                    held.append((i + top, met - i * wide + at))
                    count += len(i)
                    if count >= some:
                        yield scored(*map(np.concatenate, zip(*held)))
                        held, count = [], 0
            if count:
                yield scored(*map(np.concatenate, zip(*held)))


def _gathered(found, rows: int):
    """The pairs of ``close_pairs``, at least so many at a time but at the end."""
    held, count = [], 0
    for some in found:
        held.append(some)
        count += len(some[0])
        if count >= rows:
            yield _joined_pairs(held)
            held, count = [], 0
    if count:
        yield _joined_pairs(held)


def _joined_pairs(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return tuple(map(np.concatenate, zip(none, *found)))


def key_pairs(asked: pa.Table, listed: pa.Table) -> pa.Table:
    """The pairs of (request_key, min_score) and (list_key), list keys of one length, with their scores."""
    left, right = (t.column(c).combine_chunks().cast(pa.string()) for t, c in ((asked, "request_key"), (listed, "list_key")))
    found = []
    if len(left) and len(right):
        common = commonest_kinds(*np.unique(_letter_kinds(right)[1], return_counts=True))
        found = close_pairs(left, asked.column("min_score").to_numpy(), right, key_sketches(left, common), key_sketches(right, common))
    i, j, score = _joined_pairs(list(found))
    return pa.table({"request_key": left.take(pa.array(i)), "list_key": right.take(pa.array(j)), "score": score})


def count_kinds(batches):
    """(kind, n) of the (letter, occurrence) pairs of the first column."""
    for batch in batches:
        kinds, n = np.unique(_letter_kinds(batch.column(0).cast(pa.string()))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["kind", "n"])


def sketched(common: list[int]):
    """Puts the two words of a sketch of the first column before all columns."""

    def add(batches):
        for batch in batches:
            words = key_sketches(batch.column(0).cast(pa.string()), np.array(common, dtype=np.int64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words[0]), pa.array(words[1]), *batch.columns], names=["s0", "s1", *batch.schema.names])

    return add


def _read(uris: list[str], rows: int, columns: list[str]):
    """The rows of several files, so many at a time."""

    def each():
        for uri in uris:
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                yield from pq.ParquetFile(file).iter_batches(batch_size=rows, columns=columns)

    for table in _chunks(each(), rows):
        yield table.combine_chunks().to_batches()[0]


def _chunks(batches, rows: int, apart: str | None = None):
    """The rows of all batches, at most ``rows`` at a time, with one value of the column ``apart``."""
    held, count = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            count += held[-1].num_rows
            if count >= rows:
                yield from _apart(pa.Table.from_batches(held), apart)
                held, count = [], 0
    if count:
        yield from _apart(pa.Table.from_batches(held), apart)


def _apart(table: pa.Table, column: str | None):
    if column is None:
        yield table
    else:
        for value in pc.unique(table.column(column)):
            yield table.filter(pc.equal(table.column(column), value))


class Ranking(NamedTuple):
    """How pairs of names rank: ``limit`` best entities, weights of name and birth year; below the score ``plain`` equal values rank by entity alone."""

    limit: int
    name: float
    dob: float
    plain: float


def _year_scores(year: int, years: np.ndarray) -> np.ndarray:
    """``decision.dob_score`` of one request year."""
    return np.where((year > 0) & (years > 0), np.maximum(0.0, 100.0 - 20.0 * np.abs(year - years)), 0.0)


def _best(held: pa.Table, ranking: Ranking) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """``held`` without what cannot be among the best of its left key ``i``; the keys that have ``limit`` entities, and the value below which nothing counts.

    Of every row at least the entity ``holder`` has that value. What ranks behind ``limit`` other entities goes; equal values stay,
    unless the entity alone decides between them.
    """
    held = held.take(pc.sort_indices(held, sort_keys=[("i", "ascending"), ("value", "descending"), ("source", "ascending"), ("entity_id", "ascending")], null_placement="at_start"))
    i, value, score = (held.column(c).to_numpy() for c in ("i", "value", "score"))
    place = np.arange(len(i))
    order = np.lexsort((place, held.column("holder").to_numpy(), i))
    fresh = np.empty(len(i), dtype=bool)
    holder = held.column("holder").to_numpy()[order]
    fresh[order] = np.r_[True, (holder[1:] != holder[:-1]) | (i[order][1:] != i[order][:-1])]
    begin = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1]
    seen = np.cumsum(fresh)
    seen -= np.repeat(seen[begin] - 1, np.diff(np.r_[begin, len(i)]))  # different holders up to here
    last = np.flatnonzero(fresh & (seen == ranking.limit))
    floor = np.full(int(i[-1]) + 1, -np.inf)
    floor[i[last]] = value[last]
    tied = value >= floor[i]
    if ranking.dob == 0:
        tied &= (score >= ranking.plain) | (value >= 100.0)
    return held.filter(pa.array((seen <= ranking.limit) | tied)), i[last], value[last]


def names_within(files: list[tuple[int, str]], common: list[int], rows: int, ranking: Ranking | None = None):
    """For batches of requests, the list names of stored ``files`` (length, file) that reach the request's score.

    Requests: (asked, request_key, min_score), with a ranking also year and least value. List names: list_key, its sketch, with
    a ranking also year, source, entity_id and holder, the first entity that has the name and year. The files are read from the length nearest to the
    requests' own on. With a ranking, a request takes along the score that ``limit`` entities have reached already; what stays behind is not compared
    and does not leave. Nothing of the list is copied to the requests' task but one batch at a time.
    """
    letters = np.array(common, dtype=np.int64)
    by_length = {}
    for length, uri in files:
        by_length.setdefault(length, []).append(uri)
    columns = ["list_key", "s0", "s1"] + (["year", "source", "entity_id", "holder"] if ranking else [])

    def near(batches):
        for asked in _chunks(batches, min(rows, 2048), "year" if ranking and ranking.dob else None):
            yield from of_chunk(asked.combine_chunks())

    def of_chunk(asked: pa.Table):
        left = pa.concat_arrays(asked.column("request_key").chunks).cast(pa.string())
        name = pa.concat_arrays(asked.column("asked").chunks)
        least = asked.column("min_score").to_numpy().copy()
        sizes = pc.utf8_length(left).to_numpy()
        mine = key_sketches(left, letters)
        middle = int(np.median(sizes))
        held, waiting, count = None, [], 0
        if ranking:
            floor = asked.column("least_value").to_numpy() - 1e-6
            year = asked.column("year")[0].as_py()

        def settle():
            nonlocal held, waiting, count
            held, full, reached = _best(pa.concat_tables(waiting), ranking)
            waiting, count = [held], 0
            floor[full] = np.maximum(floor[full], reached - 1e-6)
            if not ranking.dob and ranking.name > 0:
                least[:] = np.maximum(least, floor / ranking.name)

        for length, uris in sorted(by_length.items(), key=lambda f: (-min(f[0], middle) / (f[0] + middle), f)):
            if not (200.0 * np.minimum(sizes, length) / (sizes + length) >= least - _SLACK).any():
                continue
            for batch in _read(uris, rows, columns):
                right = batch.column("list_key").cast(pa.string())
                theirs = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")])
                if not ranking:
                    for some in _gathered(close_pairs(left, least, right, mine, theirs), _ROWS_AT_ONCE):
                        i, j, score = map(pa.array, some)
                        yield pa.RecordBatch.from_arrays([name.take(i), right.take(j), score], names=["asked", "list_key", "score"])
                    continue
                years = batch.column("year").to_numpy()
                dob = _year_scores(year, years) if ranking.dob else np.zeros(len(right))
                # a birth year that counts lets a lower score through
                for part, most in ((dob > 0, 100.0), (dob <= 0, 0.0)):
                    places = np.flatnonzero(part)
                    if not len(places):
                        continue
                    needed = np.maximum(least, (floor - ranking.dob * most) / ranking.name) if ranking.name > 0 else least
                    whole = len(places) == len(right)
                    some = right if whole else right.take(pa.array(places))
                    i, j, score = _joined_pairs(list(close_pairs(left, needed, some, mine, theirs if whole else theirs[:, places])))
                    j = places[j]
                    value = np.clip(score * ranking.name + dob[j] * ranking.dob, 0.0, 100.0)
                    good = value >= floor[i]
                    i, j = i[good], j[good]
                    if len(i):
                        at = pa.array(j)
                        waiting.append(pa.table({"i": i, "score": score[good], "value": value[good], "list_key": right.take(at), **{c: batch.column(c).take(at) for c in columns[3:]}}))
                        count += len(i)
                if count > 2 * len(left):
                    settle()
        if ranking and waiting:
            settle()
            yield from pa.table({
                "asked": name.take(held.column("i").combine_chunks()), "list_key": held.column("list_key"), "year": held.column("year"), "score": held.column("score"),
            }).to_batches(max_chunksize=10_000)

    return near


def key_ratio(left_key: Column, right_key: Column) -> Column:
    """Score 0..100 of two name keys; 0 if either is empty."""
    total = F.length(left_key) + F.length(right_key)
    ratio = F.lit(200.0) * common_subsequence(left_key, right_key) / F.nullif(total, F.lit(0))
    return F.coalesce(ratio, F.lit(0.0))


def token_sort_ratio(left: Column, right: Column) -> Column:
    """Score 0..100 of two normalized names, blind to the order of their words."""
    return key_ratio(name_key(left), name_key(right))


def with_bag_sketch(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Columns <prefix>0 .. <prefix>3: a 256-bit sketch of the (letter, occurrence) pairs of a key.

    Each pair sets one bit. A bit that differs between two sketches needs at least one pair
    that the other name lacks, so the number of differing bits never exceeds the size of the
    symmetric difference of the two letter bags, which is at most
    ``len(a) + len(b) - 2 * common subsequence``. Comparing sketches therefore loses no match.
    """
    letters = F.sort_array(F.filter(F.split(key, ""), lambda c: c != ""))

    def bits_of(sorted_letters: Column) -> Column:
        occurrence = lambda c, i: i - F.array_position(sorted_letters, c)
        return F.transform(sorted_letters, lambda c, i: sketch_bit(c, occurrence(c, i)))

    return _with_sketch(df, once(letters, bits_of), prefix)


def sketch_bit(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(64 * SKETCH_WORDS)).cast("int")


def _with_sketch(df: DataFrame, bits: Column, prefix: str) -> DataFrame:
    one = F.lit(1).cast("long")

    def words_of(given: Column) -> Column:
        def word(w: int) -> Column:
            mine = F.filter(given, lambda b: b.between(64 * w, 64 * w + 63))
            return F.aggregate(
                mine,
                F.lit(0).cast("long"),
                lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, F.pmod(b, F.lit(64)))),
            )

        return F.struct(*[word(w).alias(f"{prefix}{w}") for w in range(SKETCH_WORDS)])

    # A generator of one row is computed once, however many columns read it.
    return df.select("*", F.inline(F.array(once(bits, words_of))))


def differing_bits(left: str, right: str) -> Column:
    """Number of differing bits of two sketches, given their column prefixes."""
    parts = [
        F.bit_count(F.col(f"{left}{w}").bitwiseXOR(F.col(f"{right}{w}"))) for w in range(SKETCH_WORDS)
    ]
    return functools.reduce(lambda a, b: a + b, parts)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""
    )

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def _grams(joined: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams as numbers, and the row of each, of strings that hold their trigrams one behind the other."""
    points, lengths = _code_points(joined)
    triples = points.reshape(-1, 3)
    return (triples[:, 0] << 42) | (triples[:, 1] << 21) | triples[:, 2], np.repeat(np.arange(len(joined)), lengths // 3)


def texts_within(files: list[tuple[int, str]], rows: int, threshold: float, best: int | None):
    """For batches of (text, grams), the texts of stored ``files`` (number of trigrams, file) whose shared / all trigrams exceed a threshold.

    Shared trigrams are counted by adding up lists of the stored rows that hold each. The files are read from the number nearest to the texts' own
    on. With ``best``, a text keeps its pairs down to the similarity of its ``best``-th one, ties included, and takes that along.
    """
    by_size = {}
    for size, uri in files:
        by_size.setdefault(size, []).append(uri)

    def near(batches):
        for asked in _chunks(batches, _TEXTS_AT_ONCE):
            yield from of_chunk(asked)

    def of_chunk(asked: pa.Table):
        left = pa.concat_arrays(asked.column("text").chunks).cast(pa.string())
        mine, owner = _grams(pa.concat_arrays(asked.column("grams").chunks).cast(pa.string()))
        sizes = np.bincount(owner, minlength=len(left))
        ends = np.cumsum(sizes)
        alphabet, mine = np.unique(mine, return_inverse=True)
        least = np.full(len(left), threshold)
        waiting, count = [], 0

        def settle():
            """With ``best``: what is left of the pairs, and the similarity that a pair must reach from now on."""
            nonlocal waiting, count
            i, score = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            texts = pa.concat_arrays([w[2] for w in waiting])
            order = np.lexsort((-score, i))
            i, score = i[order], score[order]
            begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            last = begin + best - 1
            last = last[(last < len(i)) & (i[np.minimum(last, len(i) - 1)] == i[begin])]
            least[i[last]] = score[last]
            good = score >= least[i]
            waiting, count = [(i[good], score[good], texts.take(pa.array(order[good])))], 0

        def table(i, score, texts):
            return pa.RecordBatch.from_arrays([left.take(pa.array(i)), texts, pa.array(score)], names=["left_text", "right_text", "similarity"])

        middle = int(np.median(sizes))
        for other, uris in sorted(by_size.items(), key=lambda f: (-min(f[0], middle) / max(f[0], middle), f[0])):
            possible = np.minimum(sizes, other) / np.maximum(sizes, other) >= least
            if not possible.any():
                continue
            for batch in _read(uris, rows, ["text", "grams"]):
                right = batch.column("text").cast(pa.string())
                theirs, holder = _grams(batch.column("grams").cast(pa.string()))
                order = np.argsort(theirs, kind="stable")
                holder, theirs = holder[order], theirs[order]
                first, last = np.searchsorted(theirs, alphabet, "left"), np.searchsorted(theirs, alphabet, "right")
                first, last = first[mine], last[mine]
                for i in np.flatnonzero(possible):
                    size = sizes[i]
                    part = slice(ends[i] - size, ends[i])
                    lists = [holder[x:y] for x, y in zip(first[part].tolist(), last[part].tolist()) if x < y]
                    if not lists:
                        continue
                    shared = np.bincount(np.concatenate(lists), minlength=len(right))
                    # a little below what the similarity asks for; the exact test follows
                    j = np.flatnonzero(shared >= least[i] / (1 + least[i]) * (size + other) - 1e-6)
                    if not len(j):
                        continue
                    score = shared[j] / (size + other - shared[j])
                    good = (score > threshold) & (score >= least[i])
                    waiting.append((np.full(np.count_nonzero(good), i), score[good], right.take(pa.array(j[good]))))
                    count += len(waiting[-1][0])
                    if best is None and count >= _ROWS_AT_ONCE:
                        yield table(*(np.concatenate([w[k] for w in waiting]) for k in (0, 1)), pa.concat_arrays([w[2] for w in waiting]))
                        waiting, count = [], 0
                if best is not None and count > 2 * best * len(left):
                    settle()
                    possible = np.minimum(sizes, other) / np.maximum(sizes, other) >= least
        if waiting:
            if best is not None:
                settle()
            yield table(*(np.concatenate([w[k] for w in waiting]) for k in (0, 1)), pa.concat_arrays([w[2] for w in waiting]))

    return near


def trigram_set_similarity(left: Column, right: Column) -> Column:
    """Shared / all of two trigram arrays; 0 if both are empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.coalesce(
        F.try_divide(shared.cast("double"), F.size(left) + F.size(right) - shared), F.lit(0.0)
    )


def trigram_similarity(left: Column, right: Column) -> Column:
    return trigram_set_similarity(trigrams(left), trigrams(right))


def register_sql_functions(spark: SparkSession) -> None:
    """The two similarities under SQL names: ``similarity(a, b)`` and ``common_subsequence(a, b)``."""
    spark.udf.register("common_subsequence", common_subsequence)
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION name_trigrams(t STRING) RETURNS ARRAY<STRING> RETURN
          array_distinct(flatten(transform(
            filter(split(regexp_replace(lower(t), '[^\\\\p{L}\\\\p{N}]+', ' '), ' '), w -> w <> ''),
            w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))
        """
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION similarity(a STRING, b STRING) RETURNS DOUBLE RETURN
          coalesce(try_divide(
            cast(size(array_intersect(name_trigrams(a), name_trigrams(b))) AS DOUBLE),
            size(array_union(name_trigrams(a), name_trigrams(b)))), 0D)
        """
    )
