import random
import re

import numpy as np
import pyarrow as pa

from listwarden.llm import minhash


def _words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _counts(text):
    w = _words(text)
    n = min(len(w), 5)
    found = {}
    for k in range(len(w) - n + 1 if w else 0):
        found[tuple(w[k : k + n])] = found.get(tuple(w[k : k + n]), 0) + 1
    return found


def plain(docs, least=0.8):
    """Smallest doc_id of each group, by all pairs and exact document frequencies."""
    counts = {d: _counts(t) for d, t in docs}
    spoken = max(2, sum(bool(c) for c in counts.values()))
    frequency = {}
    for c in counts.values():
        for s in c:
            frequency[s] = frequency.get(s, 0) + 1
    idf = {s: 1 + round(8 * np.log(spoken / f) / np.log(spoken)) / 8 for s, f in frequency.items()}
    group = {d: d for d in counts}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in counts:
        for b in counts:
            if a < b and counts[a] and counts[b]:
                both = counts[a].keys() & counts[b].keys()
                for weight in (idf, dict.fromkeys(frequency, 1)):
                    shared = sum(min(counts[a][s], counts[b][s]) * weight[s] for s in both)
                    total = sum(n * weight[s] for c in (counts[a], counts[b]) for s, n in c.items()) - shared
                    if shared >= least * total - 1e-12:
                        x, y = root(a), root(b)
                        group[max(x, y)] = min(x, y)
    return {d: root(d) for d in counts}


def _corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    shared = " ".join(rng.choices(words, k=60))
    docs = []
    for k in range(40):
        text = rng.choices(words, k=rng.randrange(30, 400))
        docs.append(" ".join(text))
        for _ in range(k % 4):
            near = list(text)
            for _ in range(rng.randrange(0, 1 + len(near) // 40)):
                near[rng.randrange(len(near))] = rng.choice(words)
            docs.append(" ".join(near).upper() if rng.random() < 0.2 else " ".join(near))
        if k % 3 == 0:
            docs.append(shared + " " + " ".join(rng.choices(words, k=200)))
    return list(enumerate(docs))


def test_groups_equal_brute_force(spark):
    docs = _corpus()
    docs += [(1000, None), (1001, ""), (1002, "?!"), (1003, "two words"), (1004, "Two, words!"), (1005, "De " * 3000), (1006, "De " * 2900), (1007, "x " * 60_000 + "y"), (1008, "x " * 60_000 + "y")]
    frame = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, id string, bands int")
    got = minhash.near_duplicates(frame).collect()
    assert {r.doc_id: r.group_id for r in got} == plain(docs)
    assert all(r.keep == (r.doc_id == r.group_id) for r in got)
    same = {r.doc_id: r.class_id for r in got}
    assert (same[1004], same[1006], same[1008]) == (1003, 1006, 1007)
    kept = minhash.dedup(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)


def test_large_group_of_near_copies_is_one(spark):
    rng = random.Random(9)
    base = [f"v{k}" for k in range(150)]
    docs = []
    for k in range(600):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        docs.append((k, " ".join(own)))
    docs += [(k, " ".join(f"o{rng.randrange(10**6)}" for _ in range(80))) for k in range(600, 700)]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[k] == 0 for k in range(600)) >= 599 and all(got[k] == k for k in range(600, 700))


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"a{k}" for k in range(50))
    rows = [(1, long), (1, long), (None, long), (1, "other " + long[::-1]), (None, None)]
    got = [(r.doc_id, r.class_id, r.group_id, r.keep) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, None, None, False), (1, None, None, False), (None, None, None, True), (1, 1, 1, True), (None, None, None, True)], key=str)


def test_samples_meet_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(8)
    met, expected = [], []
    for _ in range(150):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        level = rng.integers(0, minhash.LEVELS + 1, 300).astype(np.uint8)
        in_a, in_b = rng.random(300) < 0.85, rng.random(300) < 0.85
        many = rng.integers(1, 4, 300)
        weight = many * (1 + level / minhash.LEVELS)
        met.append((minhash.samples(pool[in_a], many[in_a], level[in_a]) == minhash.samples(pool[in_b], many[in_b], level[in_b])).mean())
        expected.append(weight[in_a & in_b].sum() / weight[in_a | in_b].sum())
    assert abs(np.mean(met) - np.mean(expected)) < 0.02


def test_words_in_pieces_and_slices():
    texts = ["One two", None, "", "é one", "two ONE", "x" * (1 << 21)]
    whole = [list(w) for _, w, _, _ in minhash.documents(pa.array(texts))]
    assert [len(w) for w in whole] == [2, 0, 0, 2, 2, 1]
    assert whole[0] == whole[4][::-1] and whole[3][1] == whole[0][0]
    assert [list(w) for _, w, _, _ in minhash.documents(pa.array(texts).slice(3, 2))] == whole[3:5]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
