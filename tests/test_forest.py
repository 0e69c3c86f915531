"""The forest: splits by their definition, votes of rows that a tree hasn't seen, and nothing of it on the driver."""

import numpy as np
from pyspark.sql import functions as F

from tripstrata.operators import forest, sampling


def gini(counts, weight):
    w = counts * weight
    return 1 - (w * w).sum() / w.sum() ** 2


def test_a_split_is_the_one_of_least_impurity():
    rng = np.random.default_rng(3)
    x, y, times, weight = rng.integers(0, 6, (80, 3)).astype(np.uint8), rng.integers(0, 3, 80), rng.poisson(1, 80).astype(np.uint8), np.array([0.5, 1.0, 2.0])
    tree = forest.grow(x, y, times, weight, 2, np.random.default_rng(0), tried=3)
    at = tree.leaves(x)
    assert (tree.below >= 0).sum() == 3 and set(at) == set(np.flatnonzero(tree.below < 0))
    for node, rows in ((0, np.ones(80, bool)), (1, x[:, tree.feature[0]] <= tree.bin[0]), (2, x[:, tree.feature[0]] > tree.bin[0])):
        count = lambda some: np.bincount(y[some], times[some], 3)
        costs = {}
        for f in range(3):
            for b in range(5):
                sides = [count(rows & (x[:, f] <= b)), count(rows & (x[:, f] > b))]
                if all(s.sum() for s in sides):
                    costs[f, b] = sum(gini(s, weight) * (s * weight).sum() for s in sides)
        assert np.isclose(costs[tree.feature[node], tree.bin[node]], min(costs.values()))
    for leaf in set(at):
        w = np.bincount(y[at == leaf], times[at == leaf], 3) * weight
        assert np.allclose(tree.votes[leaf] / forest.WHOLE, w / w.sum())


def test_nodes_and_rows_in_pieces_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(4)
    x, y, times = rng.integers(0, 32, (3000, 9)).astype(np.uint8), rng.integers(0, 4, 3000), rng.poisson(1, 3000).astype(np.uint8)
    whole = forest.grow(x, y, times, np.ones(4), 8, np.random.default_rng(1))
    monkeypatch.setattr(forest, "BLOCK", 100)
    monkeypatch.setattr(forest, "HELD", 3 * forest.BINS * 4 * 5)
    parts = forest.grow(x, y, times, np.ones(4), 8, np.random.default_rng(1))
    assert len(whole.bin) > 100 and all((getattr(whole, n) == getattr(parts, n)).all() for n in ("feature", "bin", "below", "votes"))


def test_no_tree_comes_to_the_driver_and_all_rows_are_predicted(spark, monkeypatch):
    """Spark's own forest keeps all trees on the driver, whose memory 200 of them on 100,000 rows filled."""
    from pyspark.ml.classification import RandomForestClassifier

    from tripstrata.plans import models as plans

    def refuse(*_):
        raise AssertionError("a forest on the driver")

    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 3, (3, 5))
    names = (7, -2, 40)
    rows = [(i, (centres[i % 3] + rng.normal(0, 1, 5)).tolist(), names[i % 3]) for i in range(600)] + [(600, None, 7), (601, [1.0, None, 0.0, 0.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(plans, "embeddings", lambda *_: df)
    got = {(r["label"], r["predicted"]): r["n"] for r in plans.random_forest(spark, "").collect()}
    assert sum(got.values()) == 600 and sum(n for (a, b), n in got.items() if a == b) >= 570
    few = sampling.folds(df.where(F.col("vec_id") < 0), "label", "vec_id")
    assert forest.out_of_fold(few, "label", "fold", "vec_id", "embedding", 5).count() == 0


def test_the_forest_is_as_good_as_spark_s(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 900)
    x = rng.normal(0, 1, (900, 6)) + 1.2 * (np.arange(6) == y[:, None])
    df = spark.createDataFrame([(i, v.tolist(), int(c), i % 3) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, label int, fold int").repartition(2)
    got = forest.out_of_fold(df, "label", "fold", "id", "v", 3, trees=40).agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).first()[0]
    w = df.withColumn("features", array_to_vector("v")).cache()
    right = [RandomForestClassifier(numTrees=40, maxDepth=12, seed=1).fit(w.where(F.col("fold") != i)).transform(w.where(F.col("fold") == i)).where("label = prediction").count() for i in range(3)]
    assert abs(got - sum(right) / 900) < 0.05
