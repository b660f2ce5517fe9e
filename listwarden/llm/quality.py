"""Quality classifier: a sparse ensemble of rules, compiled into column expressions.

Statistics of a whole text are column expressions. Small trees are boosted on the statistics of a bounded sample of
labelled rows (``sample_rows``, the smallest hashes of their ids); every path from a root to a node is a rule, a conjunction of
bounds. A logistic model with an L1 penalty weighs the rules and leaves few of them. The model is a short list of rules, and a score is
one expression over the statistics, evaluated by Spark for all documents.

Cases: null and empty texts have statistics of zero and get a score like any other. Labels that are null are not learned from;
of several labels of a doc_id the mean decides, ties towards 1. With labels of one class or none at all the score is the smoothed share of
that class for every text. A null doc_id is not held out. Rows come back one for one; an empty table gives an empty result.
Further columns are kept by ``keep_good`` and not read by ``scored``. doc_id, lang, source and labels are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
SAMPLE_ROWS = 20_000


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a column for each of ``STATISTICS``."""
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    n = F.size(words)
    split = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumns(
        {"_words": F.array_remove(F.split(text, r"\s+"), ""), "_lines": F.filter(F.split(text, "\n"), lambda x: x != "")}
    )
    again = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a == b, 1).otherwise(0))
    found = {
        "words": F.log1p(n.cast("double")),
        "word_length": _ratio(F.length(text) - n, n),
        "upper": _share(text, r"\p{Lu}"),
        "letters": _share(text, r"\p{L}"),
        "digits": _share(text, r"\p{N}"),
        "spaces": _share(text, r"\s"),
        "symbols": _share(text, r"[^\p{L}\p{N}\s.,]"),
        "stops": _share(text, r"[.,]"),
        "pipes": _share(text, r"\|"),
        "distinct_words": _ratio(F.size(F.array_distinct(words)), n),
        "repeated_words": _ratio(F.aggregate(again, F.lit(0), lambda a, b: a + b), n),
        "wordless": _ratio(F.size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))), n),
        "line_words": _ratio(n, F.size(lines)),
        "distinct_lines": _ratio(F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return split.withColumns({k: v.cast("double") for k, v in found.items()}).drop("_text", "_words", "_lines")


STATISTICS = [
    "words", "word_length", "upper", "letters", "digits", "spaces", "symbols", "stops", "pipes", "distinct_words", "repeated_words",
    "wordless", "line_words", "distinct_lines",
]


@dataclass(frozen=True)
class Rule:
    """Holds where every statistic lies above its lower and not above its upper bound; bounds are (name, low, high)."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [(x[name] > low) & (x[name] <= high) for name, low, high in self.bounds])

    def column(self) -> Column:
        parts = [F.col(n) > F.lit(low) for n, low, _ in self.bounds if low > -np.inf] + [F.col(n) <= F.lit(high) for n, _, high in self.bounds if high < np.inf]
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        margin = reduce(lambda a, b: a + b, [F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weights], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-margin))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grow(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 32, least: float = 0.005) -> list[Rule]:
    """Rules of boosted trees: in each node the cut that reduces the squared error of the gradient most.

    Each tree sees half of the rows and of the statistics, so that statistics that tell the same each get rules.
    """
    rng, names = np.random.default_rng(7), list(x)
    edges = {n: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1])) for n, v in x.items()}
    bins = {n: np.searchsorted(edges[n], v, side="left") for n, v in x.items()}
    margin, rules, floor = np.zeros(len(y)), {}, max(2, int(least * len(y)))

    def split(rows: np.ndarray, left: int, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            rules.setdefault(Rule(tuple((n, *bounds[n]) for n in sorted(bounds))))
        residual, best = gradient[rows], (1e-9, None, None)
        if left and len(rows) >= 2 * floor:
            for n in seen:
                size = len(edges[n]) + 1
                count = np.cumsum(np.bincount(bins[n][rows], minlength=size))[:-1]
                total = np.cumsum(np.bincount(bins[n][rows], weights=residual, minlength=size))[:-1]
                ok = (count >= floor) & (len(rows) - count >= floor)
                if ok.any():
                    gain = np.where(ok, total**2 / np.maximum(count, 1) + (residual.sum() - total) ** 2 / np.maximum(len(rows) - count, 1), 0) - residual.sum() ** 2 / len(rows)
                    if gain.max() > best[0]:
                        best = (gain.max(), n, int(gain.argmax()))
        if best[1] is None:
            curve = (chance[rows] * (1 - chance[rows])).sum()
            leaves.append((bounds, rate * residual.sum() / max(curve, 1e-6)))
            return
        _, n, k = best
        low, high = bounds.get(n, (-np.inf, np.inf))
        under = bins[n][rows] <= k
        split(rows[under], left - 1, {**bounds, n: (low, min(high, float(edges[n][k])))})
        split(rows[~under], left - 1, {**bounds, n: (max(low, float(edges[n][k])), high)})

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        gradient, leaves = y - chance, []
        seen = rng.choice(names, max(1, len(names) // 2), replace=False).tolist()
        split(np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False)), depth, {})
        for bounds, step in leaves:
            margin[Rule(tuple((n, *b) for n, b in bounds.items())).holds(x) if bounds else slice(None)] += step
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 800) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty, by accelerated proximal steps."""
    n, m = r.shape
    step = 4 * n / (np.linalg.norm(r, 2) ** 2 + n)
    w, b, v, c, t = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(m), 0.0, 1.0
    c = b
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(r @ v + c))) - y
        w_next = v - step * (r.T @ error) / n
        w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - step * penalty, 0)
        b_next, t_next = c - step * error.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return b, w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, penalty: float = 5e-4) -> Model:
    """A model of ``labels`` (doc_id, quality) by the statistics of ``docs`` (doc_id, text), rows held out excepted."""
    known = labels.select("doc_id", "quality").dropna().filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("_y", *STATISTICS).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    y = rows["_y"].to_numpy()
    if len(np.unique(y)) < 2:
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    x = {n: rows[n].to_numpy() for n in STATISTICS}
    rules = grow(x, y)
    if not rules:
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    intercept, weights = lasso(np.stack([rule.holds(x) for rule in rules], axis=1).astype(float), y, penalty)
    return Model(float(intercept), tuple((rule, float(w)) for rule, w in zip(rules, weights) if w))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    one = statistics(docs.select("doc_id", "text")).select("doc_id", model.score().alias("score"))
    return one.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below the threshold; statistics never clash with columns of ``docs``."""
    own = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"))
    # the generator keeps the filter behind the scores: below them it would compute every statistic anew for each rule that reads it
    scores = statistics(packed).select("text", "_own", F.explode(F.array(model.score())).alias("_score"))
    kept = scores.filter(F.col("_score") >= threshold)
    return kept.select(*[F.col(f"_own.`{c}`").alias(c) if c != "text" else F.col("text") for c in docs.columns])
