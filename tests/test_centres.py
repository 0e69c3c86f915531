"""k-means over weighted points, and Birch on rows that Spark's k-means or a plain matrix failed on."""

import numpy as np
import pytest

from tripstrata.operators import centres, models


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)


def test_birch_where_rows_have_no_whole_vector(spark):
    rng = np.random.default_rng(1)
    rows = [*(rng.normal(0, 0.1, (40, 2)) + np.repeat([[0, 0], [9, 0]], 20, 0)).tolist(), None, [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0], []]
    for got in (models.birch(frame(spark, rows), 2, 0.5), models.kmeans(frame(spark, rows), 2, 3)):
        labels = {r["vec_id"]: r["label"] for r in got.collect()}
        assert len(labels) == 45 and {labels[i] for i in range(40, 45)} == {-1}
        assert len({labels[i] for i in range(20)}) == len({labels[i] for i in range(20, 40)}) == 1 and {labels[0], labels[20]} == {0, 1}
    assert {r["label"] for r in models.birch(frame(spark, rows[40:]), 2, 0.5).collect()} == {-1}


def test_birch_finds_all_clusters_where_a_few_points_hold_nearly_all_of_the_cost(spark):
    """The seeds of Spark's k-means were fewer than the clusters there."""
    scales = [[10.0**i, 0.0] for i in range(14)]
    assert len({r["label"] for r in models.birch(frame(spark, scales), 10, 0.5).collect()}) == 10


def test_kmeans_of_weighted_points(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(0, 1, (90, 3)) + np.repeat(rng.normal(0, 8, (3, 3)), 30, 0), rng.integers(1, 5, 90), 0)
    points = centres.folded(frame(spark, x))
    assert points.count() == 90 and points.agg({"n": "sum"}).first()[0] == len(x)
    got = centres.lloyd(points, 3, 3)
    near = ((x[:, None] - got) ** 2).sum(2).argmin(1)
    assert np.allclose(got, [x[near == i].mean(0) for i in range(3)])
    (count, sums, cost), = centres.batch_sums(points, [got], "n")
    assert count.tolist() == np.bincount(near).tolist() and cost == pytest.approx(((x - got[near]) ** 2).sum())
    # no more seeds than distinct points, each of them once
    assert sorted(centres.seeds(centres.folded(frame(spark, [[1, 1], [2, 2], [1, 1]])), 5, 2)[1].tolist()) == [[1, 1], [2, 2]]


def test_draws_are_even_and_depend_on_hash_and_turn_only():
    h = np.arange(100_000) * 7919 - 5_000_000
    u = centres.uniform(h, 3)
    assert 0 < u.min() < u.max() < 1 and np.abs(np.histogram(u, 20, (0, 1))[0] / 5000 - 1).max() < 0.06
    assert (u == centres.uniform(h, 3)).all() and abs(np.corrcoef(u, centres.uniform(h, 4))[0, 1]) < 0.02
