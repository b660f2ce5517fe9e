"""The pairs that stars leave: they are compared in squares, not made as rows."""

import random

import numpy as np
from test_minhash import plain

from listwarden.llm import minhash


def test_near_misses_of_a_large_group_are_no_rows(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"v{k}" for k in range(150)]
    docs = []
    for k in range(240):
        own = list(base)
        for _ in range(5):
            own[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        docs.append((k, " ".join(own)))
    asked, check = [], minhash._check

    def counted(*args):
        def compared(pairs, texts):
            asked.append(pairs.count())
            return check(*args)(pairs, texts)

        return compared

    monkeypatch.setattr(minhash, "_check", counted)
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain(docs)
    assert len(set(got.values())) > 20 and sum(asked) <= 16 * len(docs)


def test_own_parts_make_no_buckets(spark):
    """Documents that share a passage and are about 0.7 alike meet nobody: what is rarest among them is their own."""
    rng = random.Random(2)
    shared = " ".join(f"s{k}" for k in range(100))
    docs = [(k, shared + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(22))) for k in range(100)]
    texts = spark.createDataFrame(docs, "id long, text string")
    sketch = minhash.frequencies(texts)
    dealt = minhash._prefixes(sketch, 0.8)(texts.select("id"), texts)
    assert dealt.filter("core").count() == 0


def test_squares_equal_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 300):
        pool, idf = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64)), 1 + rng.integers(0, 9, 200) / 8
        sets = []
        for k in range(n):
            pick = np.sort(rng.choice(100, rng.integers(85, 100), replace=False)) if k % 3 else np.sort(rng.choice(200, rng.integers(1, 60), replace=False))
            counts = rng.integers(1, 4, len(pick)) ** rng.integers(1, 3) if k % 2 else np.full(len(pick), 2)
            sets.append((pool[pick], counts, idf[pick]))
        expected = np.array([[a is not b and minhash.similarity(a, b) >= 0.8 for b in sets] for a in sets])
        got = minhash.linked_all(sets, 0.8)
        np.fill_diagonal(got, False)
        assert (got == expected).all() and (n < 60 or expected.sum() > 100)
        for a, b in minhash._forest(got):
            assert expected[a, b]
