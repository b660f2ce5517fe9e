"""Words of whole Arrow batches as numpy arrays: places, documents, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 21
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = odd_numbers(130, 256)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(int(base), ())) < n:
        _powers[int(base)] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, CHUNK), base, np.uint64))])
    return _powers[int(base)][:n]


def spans_hashed(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[first:end] for each pair, whatever its place."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * _power(_BASE, len(values)))])
    return mixed((total[end] - total[first]) * _power(_INVERSE, len(values) + 1)[first])


def joined(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces data[first:end] one behind the other, and the places where they begin, with the whole length last."""
    lengths = end - first
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.repeat(first - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


class Spoken:
    """Words of some documents: text (each word with a blank behind it), offsets, document and number in it of every word, hashes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK):
        inside = ~blank[data]
        border = np.zeros(len(data) + 1, bool)
        border[0], border[ends] = True, True
        before = np.concatenate([[False], inside[:-1]]) & ~border[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~border[1:]
        first, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.document = np.searchsorted(ends, first, side="right")
        self.text, self.offsets = joined(np.append(data, np.uint8(0x20)), first, end + 1)
        self.text[self.offsets[1:] - 1] = 0x20
        self.number = np.arange(len(first)) - np.searchsorted(self.document, np.arange(len(ends)))[self.document]
        self._spans = data, first, end

    @property
    def hashes(self) -> np.ndarray:
        if self._spans is not None:
            data, first, end = self._spans
            self._hashes, self._spans = spans_hashed(_BYTE[data], first, end), None
        return self._hashes

    def words(self) -> pa.Array:
        """Every word, with the blank behind it."""
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.text)])


def pieces(texts: pa.Array, blank: np.ndarray = BLANK, bytes_as: np.ndarray | None = None) -> Iterator[tuple[int, Spoken]]:
    """(number of the first text, words of it and of some that follow), in pieces of about ``CHUNK`` bytes or one text."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    start = 0
    while start < len(whole):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, side="right")) - 1)
        piece = data[offsets[start] : offsets[end]]
        yield start, Spoken(piece if bytes_as is None else bytes_as[piece], offsets[start + 1 : end + 1] - offsets[start], blank)
        start = end
