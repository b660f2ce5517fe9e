import re
from collections import Counter, defaultdict

import numpy as np

from listwarden.llm import divergence


def _plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [tuple(x or "" for x in r) for r in rows]
    spoken = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)) for text, lang, source in rows]
    spoken = [(lang, source, [w.translate(lower) for w in words]) for lang, source, words in spoken]
    df, n, sources = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, words in spoken:
        sources[lang].add(source)
        df.update((lang, w) for w in set(words))
        n[lang, source].update(words)
    order = lambda s: s.encode()
    out = []
    for lang in sources:
        kept = [w for (x, w), d in df.items() if x == lang and d >= 3]

        def shares(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // (total + len(kept)) for w in kept}

        whole = Counter()
        for s in sources[lang]:
            whole.update(n[lang, s])
        p, q = {s: shares(n[lang, s]) for s in sources[lang]}, shares(whole)
        for s in sources[lang]:
            pairs = sorted((-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), order(o), o) for o in sources[lang] - {s})
            terms = sorted((-((p[s][w] - q[w]) ** 2 // q[w]), order(w), w) for w in kept if n[lang, s][w] and p[s][w] > q[w])[:200]
            out += [(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(pairs, 1)] + [(lang, s, "term", x, -v, k) for k, (v, _, x) in enumerate(terms, 1)]
    return sorted(out)


def _audited(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, source string, n long, v long, number int")
    return sorted(tuple(r) for r in divergence.audit(frame, **more).collect())


def test_equals_brute_force_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vocabulary = [f"{a}{b}{c}" for a in "aBz" for b in ("é", "q", "Ünd", "r") for c in "xyzuvw"]
    rows = []
    for k in range(400):
        lang = ["en", "de", None][int(rng.integers(0, 3))]
        source = f"s{int(rng.integers(0, 90)) if lang == 'en' else int(rng.integers(0, 5))}"
        words = rng.choice(vocabulary, int(rng.integers(0, 30)), p=np.arange(1, 73) / (36 * 73))
        rows.append((" ,1".join(words) + " Once" + "abcdefghij"[k % 10] * (k % 97), lang, source if k % 11 else None))
    rows += [(None, "en", "only null"), ("", "fr", "a"), ("x y", "fr", "b"), ("x", "fr", None), ("12 34", "es", "a"), rows[0], rows[0]]
    assert _audited(spark, rows, terms=16) == _plain(rows)


def test_very_long_text_and_many_terms_of_one_group(spark):
    long = " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}" for k in range(200_000))
    rows = [(long, "en", "big"), (long[:4000], "en", "b"), (long[2000:9000], "en", "c"), (long, "en", "d")]
    assert _audited(spark, rows) == _plain(rows)


def test_tree_walk_in_small_steps_equals_the_sum(monkeypatch):
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 5, (70, 37)) * (rng.random((70, 37)) < 0.1)
    totals = counts.sum(axis=1) + 37
    monkeypatch.setattr(divergence, "FRONTIER", 50)
    p = divergence.shares(counts, totals[:, None])
    expected = ((p[:, None, :] - p[None, :, :]) ** 2 // p[None, :, :]).sum(axis=2)
    assert (divergence.divergences(counts, totals, 70, False) == expected).all()
    part = divergence.divergences(counts, totals, 64, True)
    assert (part[:64, 64:] == expected[:64, 64:]).all() and (part[64:, :64] == expected[64:, :64]).all()


def test_empty_table(spark):
    assert _audited(spark, []) == []
