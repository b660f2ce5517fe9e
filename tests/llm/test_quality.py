import numpy as np

from listwarden.llm import quality
from listwarden.llm.common import table


def test_held_out_rows_are_told_apart(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    scored = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").toPandas()
    fresh = scored[scored["held_out"]]
    good, score = fresh["quality"].to_numpy() == 1, fresh["score"].to_numpy()
    assert (score[good][:, None] > score[~good][None, :]).mean() >= 0.97
    assert (fresh["predicted"][good] == 1).mean() >= 0.98
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= 0.3) == (scored["predicted"] == 1)).all()


def test_compiled_rules_equal_the_matrix(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    frame = quality.statistics(docs.select("doc_id", "text")).withColumn("score", model.score()).toPandas()
    x = {n: frame[n].to_numpy() for n in quality.STATISTICS}
    margin = model.intercept + sum(w * rule.holds(x) for rule, w in model.weights)
    assert np.allclose(frame["score"], 1 / (1 + np.exp(-margin)), atol=1e-12)
    assert len(model.weights) < 150


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(0)
    rules = rng.integers(0, 2, (2000, 12)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * rules[:, 0] - 3 * rules[:, 1])))).astype(float)
    _, w = quality.lasso(rules, y, 0.02)
    assert w[0] > 1 and w[1] < -1 and np.all(np.abs(w[2:]) < 0.05)


def test_odd_rows_and_few_labels(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "words here", "x", 1), (3, "long " * 200_000, "x", 1), (3, "long " * 200_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, digits int")
    for labels in ([], [(1, 1), (2, 1), (None, 0), (3, None)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int")
        model = quality.fit(docs, known)
        got = quality.scored(docs, model).collect()
        assert len(got) == 5 and all(0 < r.score < 1 for r in got) and len({r.score for r in got}) == 1
        kept = quality.keep_good(docs, model)
        assert kept.columns == docs.columns and kept.count() == 5
    assert quality.scored(docs.limit(0), model).count() == 0
