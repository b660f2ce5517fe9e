import re
from collections import defaultdict

import numpy as np
import pytest

from listwarden.llm import substrings


def _plain(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = defaultdict(set)
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 12):
                first[tuple(w[i : i + 13])].add(d)
    out = []
    for (d, w), (_, text) in zip(words, rows):
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and min(first[tuple(w[i : i + 13])]) < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), None if text is None else " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def _cut(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 5, "x", 7) for r in rows], "doc_id long, text string, n_words int, kept string, key long")
    out = substrings.dedup(frame, **more)
    assert "key" in out.columns and out.columns.count("kept") == 1
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=repr)


def _corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    say = lambda k, v=400: [f"w{x}" for x in rng.integers(0, v, k)]
    passage, stop = say(60), ["é̂", "the"]
    rows = []
    for k in range(n):
        w = say(int(rng.integers(0, 80)))
        if k % 3 == 0:
            w = w[:20] + passage[: int(rng.integers(10, 60))] + w[20:]
        if k % 7 == 0:
            w += ["ha"] * int(rng.integers(5, 90))
        if k % 5 == 0 and rows:
            w += (rows[int(rng.integers(0, len(rows)))][1] or "").split()
        if k % 4 == 0:
            w += say(40, 2) + stop * 9
        rows.append((int(rng.integers(0, n)), [" ", "\n", "\t \x0b"][k % 3].join(w)))
    return rows + [(None, rows[0][1]), (None, None), (3, None), (4, ""), (5, " \n "), rows[0], rows[0], (-7, rows[-1][1]), (9, "a b " * 30), (10, "a b " * 13)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = _corpus(seed)
    expected = _plain(rows)
    assert sum(r[2] for r in expected) > 1000
    assert _cut(spark, rows) == expected


def test_frequent_minimisers_and_hash_collisions(spark, monkeypatch):
    rows = _corpus(3)
    assert _cut(spark, rows, cell_bits=2) == _plain(rows)  # every cell is a frequent one
    text = " ".join(["a b c d e f g h i j k l m n"] * 3) + " "
    data = np.frombuffer((text + text.replace("b", "x")).encode(), np.uint8)
    windows, low = np.array([30, 30]), np.array([5, 3])
    plain = substrings.first_documents(data, windows, low)
    assert len(plain) == 60
    monkeypatch.setattr(substrings, "mixed", lambda x: x * np.uint64(0))  # all windows have one hash
    assert (plain == substrings.first_documents(data, windows, low)).all()


def test_package_round_trip():
    rng = np.random.default_rng(8)
    arrays = [rng.integers(0, 100, n).astype(kind) for n, kind in zip([5, 5, 5, 5, 9, 9, 9, 0, 0, 0, 70], substrings._PACKAGE)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, substrings._opened(substrings._squeezed(arrays))))


def test_a_passage_of_most_documents(spark):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{x}" for x in range(60))
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, k % 20)) + " " + passage + (" end" if k % 2 else "")) for k in range(400)]
    assert _cut(spark, rows) == _plain(rows)


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    long = " ".join(f"v{x}" for x in rng.integers(0, 30_000, 60_000))
    rows = [(1, long), (2, long[5000:90_000]), (3, "head " + long + " tail"), (4, "same " * 50_000), (5, "same " * 40)]
    assert _cut(spark, rows) == _plain(rows)


def test_empty_table(spark):
    assert _cut(spark, []) == []
