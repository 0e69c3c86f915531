"""Neighbours, DBSCAN, percentiles and mixtures against all pairs, numpy and known densities."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripstrata.functions.quantiles import percentiles
from tripstrata.operators import mixture, models, resample
from tripstrata.operators import neighbours as neighbours_module
from tripstrata.operators.neighbours import neighbours
from tripstrata.operators.sampling import cut_lineage

SF = "/root/testdata/sf0.01"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, embedding array<double>").repartition(4)


def brute(q, q_ids, x, ids, k):
    """(query, other, distance) of the k nearest others, ties to the smaller id."""
    out = {}
    for i, v in zip(q_ids, q, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), d[j]) for j in order]
    return out


def table_of(df, key="id"):
    out = {}
    for r in df.orderBy(key, "r").collect():
        out.setdefault(r[key], []).append((r["other"], r["distance"]))
    return out


def like_embeddings(spark, n):
    """Rows drawn from the given embeddings' means and spreads by label."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding", "label").collect()
    y, given = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(4)
    some = rng.choice(y, n)
    return np.stack([rng.normal(given[y == c].mean(0), given[y == c].std(0) + 1e-9) for c in some])


def test_exact_at_20000_rows(spark):
    x = like_embeddings(spark, 20_000)
    asked = np.arange(0, 20_000, 40)
    df = frame(spark, x)
    got = table_of(neighbours(df.where("id % 40 = 0"), df, "id", "embedding", 15))
    want = brute(x[asked], asked, x, np.arange(len(x)), 15)
    assert got.keys() == want.keys()
    for i, near in want.items():
        assert [o for o, _ in got[i]] == [o for o, _ in near]
        assert np.allclose([d for _, d in got[i]], [d for _, d in near], rtol=0, atol=1e-12)


@pytest.mark.parametrize("group", [7, 50, 10_000])
def test_exact_with_copies_ties_and_small_groups(spark, group):
    rng = np.random.default_rng(1)
    # a grid has ties, one vector has a third of all rows, two rows lie far off
    x = np.concatenate([rng.integers(0, 5, (120, 2)), np.tile([2.0, 2.0], (60, 1)), [[90.0, 0.0], [0.0, -70.0]]]).astype(float)
    ids = rng.permutation(len(x))
    want = brute(x, ids, x, ids, 4)
    df = frame(spark, x, ids)
    assert table_of(neighbours(df, df, "id", "embedding", 4, group)) == {i: [(o, pytest.approx(d)) for o, d in v] for i, v in want.items()}


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert table_of(neighbours(df, df, "id", "embedding", 3)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    labels = dict(models.dbscan(df, "id", 2, k=2).collect())
    assert labels == {1: 1, 2: 1, 3: -1, 4: -1, 5: -1, 6: -1}
    none = df.where("id = 6")
    assert neighbours(none, none, "id", "embedding", 3).collect() == [] == neighbours(df, none, "id", "embedding", 3).collect() and dict(models.dbscan(none, "id").collect()) == {6: -1}


@pytest.mark.parametrize("group", [16, 10_000])
def test_dbscan_with_copies(spark, group):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.6, (70, 2)) for c in ((0, 0), (5, 0), (0, 6))] + [np.tile([9.0, 9.0], (80, 1)), rng.uniform(-9, 12, (30, 2))])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    eps = np.quantile(np.sort(d, 1)[:, 4], 0.8)
    core = (d <= eps).sum(1) >= 6
    want = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = np.array([want[core & (d[i] <= eps)].min() if core[i] else -1 for i in range(len(x))])
        if (new == want).all():
            break
        want = new
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(core & (d[i] <= eps))
        want[i] = want[near[np.argmin(d[i][near])]] if len(near) else -1
    got = dict(models.dbscan(frame(spark, x), "id", 6, 0.8, 5, group).collect())
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_tomek_links(spark):
    rows = [(0, 0, [0.0]), (1, 1, [1.0]), (2, 1, [1.5]), (3, 0, [5.0]), (4, 1, [5.2])]
    e = spark.createDataFrame(rows, "id long, label int, v array<double>")
    assert [tuple(r) for r in resample.tomek_links(e, "label", "id", "v").collect()] == [(3, 4)]


# --- percentiles


def test_percentiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select((F.col("id") % 3).alias("g"), (F.pow(F.lit(10.0), F.pmod(F.xxhash64("id"), F.lit(9_000_000)) / 1_000_000.0)).alias("x"))
    parts = [0.0, 0.02, 0.25, 0.5, 0.999, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in percentiles(df, ["g"], "x", parts, cut_lineage).collect()}
    want = df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, parts))).alias("q"), F.count("*").alias("n")).collect()
    assert got == {r["g"]: (r["n"], r["q"]) for r in want}


def test_percentiles_odd(spark):
    rows = [(None, 1.0, 2), (None, 3.0, 1), ("a", 5.0, 1), ("b", None, 1), ("b", float("nan"), 1), *[("c", 7.0, 1)] * 5000, *[("c", float(i), 1) for i in range(6000)], ("d", -1e308, 1), ("d", 1e308, 1), ("d", 0.0, 3)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    got = {r["g"]: (r["n"], r["q"]) for r in percentiles(df, ["g"], "x", [0.25, 0.5], cut_lineage, "w").collect()}
    assert got[None] == (3, [1.0, 1.0]) and got["a"] == (1, [5.0, 5.0]) and "b" not in got and got["d"] == (5, [0.0, 0.0])
    assert got["c"] == (11_000, np.quantile([7.0] * 5000 + list(range(6000)), [0.25, 0.5]).tolist())
    (whole,) = percentiles(df.where("g = 'c'"), [], "x", [0.5], cut_lineage).collect()
    assert whole["q"] == [499.5] and whole["n"] == 11_000


# --- mixtures


def test_mixture_finds_components_and_never_falls(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.multivariate_normal(m, c, n) for m, c, n in (((0, 0), ((1, 0.8), (0.8, 1)), 400), ((6, 0), ((0.3, 0), (0, 2)), 200), ((0, 7), ((1, 0), (0, 1)), 300))])
    model = mixture.fit_mixture(frame(spark, x), 3, "id", starts=3)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.path, model.path[1:], strict=False)) and len(model.path) > 2
    order = np.argsort(-model.weights)
    assert model.weights[order] == pytest.approx([400 / 900, 300 / 900, 200 / 900], abs=0.03)
    assert np.allclose(model.means[order], [[0, 0], [0, 7], [6, 0]], atol=0.4)
    assert np.allclose(model.covariances[order[0]], [[1, 0.8], [0.8, 1]], atol=0.25)
    # the likelihood by the definition of the density
    dens = sum(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in zip(model.weights, model.means, model.covariances, strict=True))
    assert model.loglik == pytest.approx(np.log(dens).sum(), rel=1e-3)


def test_mixture_of_flat_copied_and_few_rows(spark):
    x = np.concatenate([np.tile([1.0, 2.0, 3.0], (40, 1)), np.tile([1.0, 2.0, 9.0], (5, 1))])
    df = frame(spark, x).union(spark.createDataFrame([(100, None), (101, [1.0, float("nan"), 2.0])], "id long, embedding array<double>"))
    got = mixture.gaussian_mixture(df, 10, "id", starts=2)
    labels = {r["id"]: r["label"] for r in got.collect()}
    assert labels[100] == labels[101] == -1 and len({labels[i] for i in range(40)}) == 1 and labels[0] != labels[44] >= 0


def test_blocks_are_bounded(spark, monkeypatch):
    """Whatever the numbers of points and of asked rows, no block of distances is larger than BLOCK; the results are those of all pairs."""
    monkeypatch.setattr("tripstrata.operators.neighbours.BLOCK", 4096)
    assert [n * neighbours_module.at_once(n) <= 4096 for n in (1, 8, 100, 256)] == [True] * 4 and neighbours_module.at_once(1 << 30) == 16
    rng = np.random.default_rng(3)
    x, label = rng.normal(0, 1, (700, 5)), rng.integers(0, 3, 700)
    df = frame(spark, x)
    assert [[o for o, _ in v] for v in table_of(neighbours(df, df, "id", "embedding", 3)).values()] == [[o for o, _ in v] for v in brute(x, np.arange(700), x, np.arange(700), 3).values()]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    near = lambda i, c: d[i, label == c].sum() / ((label == c).sum() - (label[i] == c))
    parts = [(near(i, label[i]), min(near(i, c) for c in range(3) if c != label[i])) for i in range(700)]
    given = df.join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, label int"), "id")
    got = models.silhouettes(given, "label", "id").first()
    assert got["asked"] == 700 and got["silhouette"] == pytest.approx(np.mean([(b - a) / max(a, b) for a, b in parts]))


@pytest.mark.parametrize(("scale", "off"), [(1.0, 0.0), (1e-6, 1.0), (1e20, 0.0), (1e-20, 0.0)])
def test_measured_loses_nothing_in_bounded_memory(scale, off):
    """All pairs within the limit, and the k nearest, at any scale; 400 askers who are near to all 4,000 points need few numbers at once."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x, q = rng.normal(off, scale, (4000, 64)), rng.normal(off, scale, (400, 64))
    d = np.sqrt(np.stack([((x - v) ** 2).sum(1) for v in q]))
    limit = np.quantile(d, 0.01) ** 2
    got = {(i, j) for a, b, m in neighbours_module.measured(q, x, np.full(len(q), limit)) for i, j, e in zip(a, b, m, strict=True) if e * e <= limit}
    assert got == set(zip(*np.nonzero(d * d <= limit), strict=True))
    compare = neighbours_module.nearest_compare(7)
    tables = [pa.table({"id": np.arange(len(v)), "v": neighbours_module.vectors(v), "reach": np.full(len(v), np.nan)}) for v in (x, q)]
    near = compare(*tables, iter([(np.arange(400), np.arange(4000))])).to_pydict()
    assert np.array(near["other"]).reshape(400, 7).tolist() == np.argsort(d, 1, kind="stable")[:, :7].tolist()
    tracemalloc.start()
    n = sum(len(i) for i, _, _ in neighbours_module.measured(q, x, np.full(len(q), np.inf)))
    assert n == 1_600_000 and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_askers_are_stored_once(spark, monkeypatch):
    """Without bounds that rule out cells, each point asks every bin: what is stored for that are the askers, not their copies."""
    stored = []

    def cut(df):
        out = cut_lineage(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr("tripstrata.operators.neighbours.cut_lineage", cut)
    x = np.random.default_rng(6).normal(0, 1, (300, 24))
    got = table_of(neighbours(frame(spark, x), frame(spark, x), "id", "embedding", 2, 30))
    assert [[o for o, _ in got[i]] for i in range(300)] == [[o for o, _ in v] for v in brute(x, np.arange(300), x, np.arange(300), 2).values()]
    assert max(stored) <= 300 * 3


def test_dbscan_of_one_cluster_searches_once(spark, monkeypatch):
    """The search that gives eps tells the cores and their links too."""
    calls = []
    monkeypatch.setattr(models, "meet", lambda *a: calls.append(a) or neighbours_module.meet(*a))
    x = np.random.default_rng(7).normal(0, 1, (200, 2))
    got = dict(models.dbscan(frame(spark, x), "id", 6).collect())
    assert not calls and len(set(got.values()) - {-1}) == 1


def test_sums_of_mixtures_that_fill_several_pieces(spark):
    rng = np.random.default_rng(8)
    x, k, d = rng.normal(0, 1, (90, 40)), 5, 40
    models = [mixture.Mixture(np.full(k, 1 / k), rng.normal(0, 1, (k, d)), np.repeat(np.eye(d)[None], k, 0)) for _ in range(2)]
    origin = x.mean(0)
    got = mixture.moments(frame(spark, x).repartition(3).select("embedding"), models, origin)
    assert got.size > mixture.CHUNK
    for m, sums in zip(models, got, strict=True):
        logs, off = m.logs(x), x - origin
        norm = mixture.log_sum(logs)
        post = np.exp(logs - norm[:, None])
        want = [[norm.sum()], post.sum(0), (post.T @ off).ravel(), np.einsum("nk,ni,nj->kij", post, off, off).ravel()]
        assert np.allclose(sums, np.concatenate(want), atol=1e-9)
