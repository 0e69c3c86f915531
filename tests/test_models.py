"""Mini batches and prototypes: numbers against whole fits and definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstrata.operators import models, monitor
from tripstrata.plans import registry


def test_minibatch_cost_is_near_a_whole_fit(spark):
    rng = np.random.default_rng(3)
    centres = rng.uniform(-10, 10, (6, 4))
    x = np.concatenate([rng.normal(c, 1.0, (400, 4)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    got = models.minibatch_centres(df, 6, "id", batch=300, steps=16)
    cost = lambda c: ((x[:, None] - c) ** 2).sum(2).min(1).sum()
    assert cost(got) <= 1.05 * models.kmeans_costs(df, [6])[0][1]
    counts, sums, total = models.batch_sums(df, [got])[0]
    near = ((x[:, None] - got) ** 2).sum(2).argmin(1)
    assert counts.tolist() == np.bincount(near, minlength=6).tolist() and total == pytest.approx(cost(got)) and np.allclose(sums[2], x[near == 2].sum(0))


def test_prototypes_take_all_rows_and_their_cost_never_rises(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal(10 * (i % 3), 1)), "abc"[i % 3] if rng.random() < 0.9 else None) for i in range(600)] + [(600, None, "a")]
    df = spark.createDataFrame(rows, "id long, x double, c string")
    got, costs = models.k_prototypes(df, "id", ["x"], ["c"], 3)
    labels = {r["id"]: r["label"] for r in got.collect()}
    assert len(labels) == 601 and all(b <= a + 1e-9 for a, b in zip(costs, costs[1:], strict=False))
    groups = [{labels[i] for i in range(k, 600, 3)} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    # the cost by its definition: the mean and the most frequent code of each label
    total = 0.0
    for k in range(3):
        some = [r for r in rows if labels[r[0]] == k]
        mean, mode = np.mean([r[1] for r in some if r[1] is not None]), "abc"[next(i for i in range(3) if labels[i] == k)]
        total += sum((0 if r[1] is None else (r[1] - mean) ** 2) + (0 if r[2] == mode else 0.5) for r in some)
    assert costs[-1] == pytest.approx(total, rel=1e-6)
    assert models.k_prototypes(df.where(F.col("id") < 0), "id", ["x"], ["c"], 3)[0].count() == 0


def rand_index(a, b):
    """Adjusted Rand index by counting pairs of rows."""
    n = len(a)
    same = lambda x: {(i, j) for i in range(n) for j in range(i) if x[i] == x[j]}
    p, q = same(a), same(b)
    chance = len(p) * len(q) / (n * (n - 1) / 2)
    return (len(p & q) - chance) / ((len(p) + len(q)) / 2 - chance)


def test_stability_of_exact_samples(spark):
    df = spark.range(200).withColumn("x", F.xxhash64("id"))
    sizes, labels = [], []

    def fit(some, run):
        got = some.withColumn("label", F.pmod(F.xxhash64("x", F.lit(run // 2)), F.lit(3)).cast("int"))
        rows = {r["id"]: r["label"] for r in got.collect()}
        sizes.append(len(rows))
        labels.append(rows)
        return got

    got = monitor.bootstrap_stability(df, "id", fit, runs=4)
    assert sizes == [180] * 4 and len({tuple(sorted(x)) for x in labels}) == 4
    pairs = [(labels[i], labels[j]) for i in range(4) for j in range(i + 1, 4)]
    want = [rand_index(*zip(*((a[k], b[k]) for k in a.keys() & b.keys()), strict=True)) for a, b in pairs]
    assert got == pytest.approx(np.mean(want)) and want[0] == pytest.approx(1.0)


def plain_tree(points, radius, width):
    """Leaf entries (members) of a clustering-feature tree of nested lists of points, nothing summed beforehand."""
    members = lambda e: [e] if isinstance(e, tuple) else [p for x in e["in"] for p in members(x)]
    centre = lambda e: np.mean(members(e), 0)

    def insert(node, point):
        near = min(node["in"], key=lambda e: ((centre(e) - point) ** 2).sum(), default=None)
        if node["leaf"]:
            joint = [*members(near), point] if near else None
            if near and np.sqrt(((np.array(joint) - np.mean(joint, 0)) ** 2).sum(1).mean()) <= radius:
                near["in"].append(point)
                return [node]
            node["in"].append({"leaf": None, "in": [point]})
        else:
            at = next(i for i, e in enumerate(node["in"]) if e is near)
            first, *more = insert(near, point)
            node["in"][at] = first
            node["in"] += more
        if len(node["in"]) <= width:
            return [node]
        c = [centre(e) for e in node["in"]]
        _, i, j = max(((((a - b) ** 2).sum(), -i, -j) for i, a in enumerate(c) for j, b in enumerate(c)))
        goes = [k == -j or (k != -i and ((c[k] - c[-j]) ** 2).sum() < ((c[k] - c[-i]) ** 2).sum()) for k in range(len(c))]
        return [{"leaf": node["leaf"], "in": [e for e, g in zip(node["in"], goes, strict=True) if g == side]} for side in (False, True)]

    root = {"leaf": True, "in": []}
    for p in points:
        halves = insert(root, p)
        root = halves[0] if len(halves) == 1 else {"leaf": False, "in": halves}

    def leaf_entries(node):
        return node["in"] if node["leaf"] else [e for x in node["in"] for e in leaf_entries(x)]

    return [members(e) for e in leaf_entries(root)]


def test_subclusters_are_those_of_a_plain_tree():
    rng = np.random.default_rng(8)
    points = [tuple(v) for v in rng.normal(0, 2, (250, 3))]
    found = models.Features(0.8, 10_000, width=4)
    for p in points:
        found.add(1.0, np.array(p), float(np.dot(p, p)))
    n, s, _ = found.leaves()
    want = plain_tree(points, 0.8, 4)
    assert n.tolist() == [len(x) for x in want] and found.size == len(want) > 20
    assert np.allclose(s / n[:, None], [np.mean(x, 0) for x in want])


def test_a_tree_is_bounded_and_balanced():
    rng = np.random.default_rng(9)
    found = models.Features(0.01, 60, width=5)
    for v in rng.normal(0, 5, (3000, 4)):
        found.add(1.0, v, float(v @ v))
    assert found.size == len(found.n) <= 60 and found.n.sum() == 3000

    def depths(node):
        assert node.k <= 5
        return {0} if node.below is None else {d + 1 for x in node.below for d in depths(x)}

    assert len(depths(found.root)) == 1


def test_birch_finds_blobs(spark):
    rng = np.random.default_rng(10)
    centres = np.array([[0, 0], [20, 0], [0, 20], [20, 20]])
    rows = [(i, rng.normal(centres[i % 4], 1).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    got = {r["id"]: r["label"] for r in models.birch(df, 4, 0.5).collect()}
    groups = [{got[i] for i in range(k, 800, 4)} for k in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    assert models.birch(df, 4, 0.5, starts=1).count() == 800


def test_a_rebuilt_tree_keeps_many_entries():
    """In many dimensions a radius a little too large merges nearly all: the tree has to stay near its bound, above any number of clusters."""
    rng = np.random.default_rng(12)
    found = models.Features(0.5, 100)
    for v in rng.normal(0, 0.2, (4000, 64)):
        found.add(1.0, v, float(v @ v))
    assert 25 <= found.size == len(found.n) <= 100 and found.n.sum() == 4000


def test_birch_of_one_blob_and_of_few_distinct_vectors(spark):
    """Ten clusters where the radius once grew until fewer subclusters were left, and more clusters than distinct vectors."""
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(3000)]
    got = models.birch(spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(2), 10, 0.5)
    assert len({r["label"] for r in got.collect()}) == 10
    few = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, embedding array<double>").repartition(3)
    labels = {r["id"]: r["label"] for r in models.birch(few, 10, 0.5).collect()}
    assert len(labels) == 30 and all(labels[i] == labels[i % 3] for i in labels) and len(set(labels.values())) == 3


def test_forest_does_not_depend_on_how_the_table_is_cut(spark, tmp_path):
    """Every row is predicted once, and one file gives the same confusion counts as five."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 3 = 0")
    got = []
    for parts in (1, 5):
        rows.repartition(parts).write.parquet(f"{tmp_path}/{parts}/embeddings.parquet")
        got.append(sorted(tuple(r) for r in registry.queries()["random_forest"](spark, f"{tmp_path}/{parts}").collect()))
    assert got[0] == got[1] and sum(n for *_, n in got[0]) == rows.count()
