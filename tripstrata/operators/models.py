"""Clustering, mixtures and classifiers.

k-means has its own steps (centres.py), PCA is Spark ML's, mixtures have their own EM (mixture.py), forests their own trees (forest.py). Latent classes are fitted by EM over distinct patterns, which are few
however many rows there are. DBSCAN, nearest neighbours and the silhouette take all rows, as do the HDBSCAN and Ward of linkage.py; the
HDBSCAN, Ward and density-based validity here hold all pairs and are fitted on a sample with a stated bound, and every row is then assigned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.functions.graph import components as connected
from tripstrata.functions.quantiles import percentiles
from tripstrata.operators.centres import batch_sums, folded, lloyd, padded, seeds
from tripstrata.operators.comparison import mean_silhouettes
from tripstrata.operators.neighbours import GROUP, at_once, first_of, matrix, measured, meet, nearest_points, neighbours, place, points, squares, usable, vectors, within_reach
from tripstrata.operators.sampling import cut_lineage, sample, shared_folder

#: Rows at most of a sample whose pairs are all compared.
PAIRS = 2000


def as_vectors(df: DataFrame, array: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def kmeans(df: DataFrame, k: int, starts: int = 20, steps: int = 50) -> DataFrame:
    """The best of several starts by its cost over all rows; rows without a whole finite vector get -1."""
    return labelled(df, lloyd(folded(df), k, starts, steps))


def labelled(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """`df` with label, the nearest centre; -1 where there is no distance to it."""
    if not len(centres):
        return df.withColumn("label", F.lit(-1))
    there = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("distance") < float("inf"))
    return nearest(df, centres).withColumn("label", F.when(there, F.col("label")).otherwise(-1)).drop("distance")


def minibatch_centres(df: DataFrame, k: int, key: str, batch: int = 4096, steps: int = 20, starts: int = 3) -> np.ndarray:
    """Centres moved by one batch of about `batch` rows a step, with a rate of 1 / count; the start of the least cost over all rows.

    A row's hash gives its batch. One scan writes all batches, a folder for each, so a step reads its own rows only; more steps than batches
    go round, more batches than steps are more steps: every row moves a centre. Seeds are drawn from all rows (k-means++).
    """
    rows = usable(df, "embedding").select(key, "embedding")
    n = rows.count()
    groups = max(1, -(-n // batch))
    at = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(key, F.lit(5)), F.lit(groups)).cast("int"))
    dealt.write.partitionBy("batch").parquet(at)
    batches = df.sparkSession.read.parquet(at)
    centres = padded(seeds(folded(rows), k, starts), k)
    seen = [np.zeros(k) for _ in centres]
    for step in range(max(steps, groups)):
        for c, held, (count, sums, _) in zip(centres, seen, batch_sums(batches.where(F.col("batch") == step % groups), centres), strict=True):
            held += count
            some = count > 0
            # each row moves its centre by 1 / (rows so far): together, a mean of what was there and the batch
            c[some] += (sums[some] - count[some, None] * c[some]) / held[some, None]
    return min(zip(batch_sums(rows, centres), centres, strict=True), key=lambda g: g[0][2])[1]


def minibatch_kmeans(df: DataFrame, k: int, key: str, batch: int = 4096, steps: int = 20, starts: int = 3) -> DataFrame:
    """Rows go to the nearest of minibatch_centres()."""
    return nearest(df, minibatch_centres(df, k, key, batch, steps, starts))


def nearest(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """label and distance of the nearest of a few centres; ties go to the first."""
    d = [F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, x: s + x) for c in centres]
    best = F.array_min(F.array(*[F.struct(x.alias("d2"), F.lit(i).alias("label")) for i, x in enumerate(d)]))
    return df.withColumn("b", best).withColumns({"label": F.col("b.label"), "distance": F.sqrt("b.d2")}).drop("b")


def kmeans_costs(df: DataFrame, ks: list[int], steps: int = 50) -> list[tuple[int, float]]:
    """The cost of one fit for each number of clusters."""
    v = as_vectors(df).persist()
    out = [(k, KMeans(k=k, maxIter=steps, seed=1).fit(v).summary.trainingCost) for k in ks]
    v.unpersist()
    return out


def principal(df: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """Centred principal components and their explained parts; each component's largest loading is positive."""
    n = len(df.select("embedding").first()[0])
    mean = df.agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(n)]).first()
    v = as_vectors(df.withColumn("embedding", F.zip_with("embedding", F.array(*map(F.lit, mean)), lambda a, b: a.cast("double") - b)))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(v)
    loads = model.pc.toArray()
    sign = np.sign(loads[np.abs(loads).argmax(0), range(k)])
    out = model.transform(v).withColumn("pc", F.zip_with(vector_to_array("pc"), F.array(*[F.lit(float(s)) for s in sign]), lambda a, b: a * b)).drop("features", "embedding")
    return out, model.explainedVariance.toArray().tolist()


def bounded(df: DataFrame, key: str, f: Callable[[np.ndarray], np.ndarray], most: int = PAIRS) -> DataFrame:
    """Labels from f over the vectors of a sample of at most `most` rows, as one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        return pd.DataFrame({key: group[key], "label": f(np.array(group["embedding"].tolist(), float))})

    return sample(df, most, key).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, f"{key} long, label int")


def means_of(df: DataFrame, fitted: DataFrame, key: str) -> np.ndarray:
    """The mean vector of each label of a fitted sample (key, label), in order of the labels."""
    long = df.join(F.broadcast(fitted.select(key, "label")), key).select("label", F.posexplode("embedding").alias("i", "x"))
    got = long.groupBy("label", "i").agg(F.avg("x").alias("c")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("v"))
    return np.array([[x["c"] for x in r["v"]] for r in got.orderBy("label").collect()])


def distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    return np.sqrt(np.maximum(s[:, None] + s - 2 * x @ x.T, 0))


def reached(near: DataFrame, placed: DataFrame, counts: list[int]) -> DataFrame:
    """(id, d1, d2 ...): how far from a point the nearest points (`near`, the point itself among them) first hold each of `counts` rows; null if
    they hold fewer."""
    each = near.join(placed.select(F.col("id").alias("other"), F.col("w").alias("held")), "other")
    run = each.withColumn("held", F.sum("held").over(Window.partitionBy("id").orderBy("distance", "other").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("id").agg(*[F.min(F.when(F.col("held") >= n, F.col("distance"))).alias(f"d{i + 1}") for i, n in enumerate(counts)])


def linked_within(eps: float) -> Callable:
    """Links that connect what links of at most eps between askers and points connect: no more of them than there are of both."""

    def compare(a: pa.Table | None, q: pa.Table | None, seen: Iterator) -> pa.Table:
        links: list[tuple[int, int]] = []
        if a is not None:
            x, y, ids, own = matrix(a["v"]), matrix(q["v"]), a["id"].to_numpy(), q["id"].to_numpy()
            part = np.arange(len(x))
            for who, at in seen:
                for i, j, d in measured(y[who], x[at], np.full(len(who), eps * eps)):
                    i, j = i[d <= eps], j[d <= eps]
                    bounds = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else np.zeros(1, int)
                    for lo, hi in zip(bounds, bounds[1:], strict=False):
                        met = at[j[lo:hi]]
                        roots, firsts = np.unique(part[met], return_index=True)
                        links += [(own[who[i[lo]]], ids[met[f]]) for f in firsts]
                        if len(roots) > 1:
                            part[np.isin(part, roots)] = roots[0]
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return compare


def dbscan(df: DataFrame, key: str, least: int = 15, quantile: float = 0.9, k: int = 5, group: int = GROUP) -> DataFrame:
    """(key, label): the smallest core key of the row's cluster, -1 for noise. eps is a quantile of all rows' distances to the k-th neighbour
    (the row itself being the first). Equal vectors are one weighted point.

    One search for the nearest points that hold `least` rows tells eps, the cores (those rows lie within eps), all that a point without so many has
    within eps, and links of cores. Where these leave more than one component, only cores outside the largest can have a link that
    is missing: they ask all cores, and a task gives spanning links, never all pairs.
    """
    placed, cells = place(points(df, key, "embedding"), group)
    near = cut_lineage(nearest_points(placed, placed, cells, max(k, least), group).select("id", "other", "distance"))
    far = cut_lineage(reached(near, placed, [k, least]).join(placed.select("id", "w"), "id"))
    got = percentiles(far.where("d1 IS NOT NULL"), [], "d1", [quantile], cut_lineage, "w").first()
    eps = got["q"][0] if got else None
    if eps is None:
        return df.select(key, F.lit(-1).cast("long").alias("label"))
    core = cut_lineage(far.where(F.col("d2") <= eps).select("id"))
    close = near.where(F.col("distance") <= eps).join(core.select(F.col("id").alias("other")), "other", "left_semi")
    both_ways = lambda e: cut_lineage(e.union(e.select("b", "a")).distinct())
    links = close.where("id <> other").join(core, "id", "left_semi").select(F.col("id").alias("a"), F.col("other").alias("b"))
    found = connected(core, both_ways(links), cut_lineage)
    largest = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(2).collect()
    if len(largest) > 1:
        dense = cut_lineage(placed.join(core, "id", "left_semi").select(placed.columns))
        asked = placed.withColumn("reach", F.lit(float(eps))).join(found.where(F.col("component") != largest[0]["component"]), "id", "left_semi")
        more = cut_lineage(meet(asked, dense, cells, within_reach(cells), linked_within(eps), "a long, b long", group))
        # what is still to be joined are components
        of = lambda n: found.select(F.col("id").alias(n), F.col("component").alias(f"c{n}"))
        between = more.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = connected(found.select(F.col("component").alias("id")).distinct(), both_ways(between), cut_lineage)
        found = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component").select("id", F.col("whole").alias("component"))
    border = first_of(close.join(core, "id", "left_anti"), 1).join(found.select(F.col("id").alias("other"), "component"), "other").select("id", "component")
    labels = placed.join(found.unionByName(border), "id").select("v", F.col("component").alias("label"))
    rows = df.select(key, F.col("embedding").cast("array<double>").alias("v"))
    return rows.join(labels, "v", "left").select(key, F.coalesce("label", F.lit(-1)).alias("label"))


def assigned(df: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Every row's label: its own where it was in the fitted sample (key, label), else that of the nearest fitted row."""
    some = df.join(F.broadcast(fitted.select(key)), key, "left_semi")
    near = neighbours(df.join(F.broadcast(fitted.select(key)), key, "left_anti"), some, key, "embedding", 1)
    rest = near.join(fitted.select(F.col(key).alias("other"), "label"), "other").select(key, "label")
    return fitted.select(key, "label").unionByName(rest)


def spanning_tree(w: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning tree of a full weight matrix."""
    n = len(w)
    best, source, out, inside = w[0].copy(), np.zeros(n, int), [], np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        out.append((float(best[j]), int(source[j]), j))
        inside[j] = True
        closer = (w[j] < best) & ~inside
        best[closer], source[closer] = w[j][closer], j
    return out


def hdbscan(size: int = 30, least: int = 5) -> Callable[[np.ndarray], np.ndarray]:
    """Mutual reachability, its spanning tree, the condensed tree, and the clusters of most excess of mass (Campello et al. 2013)."""

    def run(x: np.ndarray) -> np.ndarray:
        d = distances(x)
        core = np.sort(d, 1)[:, min(least, len(d)) - 1]
        edges = sorted(spanning_tree(np.maximum(d, np.maximum(core[:, None], core))))
        n = len(d)
        parent, node, count = list(range(n)), list(range(n)), [1] * n
        children: dict[int, tuple[int, int, float]] = {}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for w, a, b in edges:
            a, b = find(a), find(b)
            children[len(count)] = (node[a], node[b], w)
            count.append(count[node[a]] + count[node[b]])
            parent[b], node[a] = a, len(count) - 1
        label = np.full(n, -1)
        if n < 2 * size:
            return label

        def points(i: int) -> list[int]:
            out, todo = [], [i]
            while todo:
                i = todo.pop()
                if i < n:
                    out.append(i)
                else:
                    todo += children[i][:2]
            return out

        chosen: list[int] = []

        def walk(i: int, birth: float, root: bool) -> tuple[float, list[int]]:
            mass, at = 0.0, i
            while True:
                if at < n:
                    return mass, [i]
                a, b, w = children[at]
                rate = 1 / max(w, 1e-12)
                big = [c for c in (a, b) if count[c] >= size]
                mass += (rate - birth) * sum(count[c] for c in (a, b) if count[c] < size)
                if len(big) == 2:
                    mass += (rate - birth) * (count[a] + count[b])
                    parts = [walk(c, rate, False) for c in big]
                    below = sum(p[0] for p in parts)
                    if root or below > mass:
                        return max(below, 0.0), [c for p in parts for c in p[1]]
                    return mass, [i]
                if not big:
                    return mass, [] if root else [i]
                at = big[0]

        _, chosen = walk(len(count) - 1, 0.0, True)
        for k, c in enumerate(chosen):
            label[points(c)] = k
        return label

    return run


def ward(k: int) -> Callable[[np.ndarray], np.ndarray]:
    """Agglomeration by the least growth of within-cluster squares (Lance-Williams updates)."""

    def run(x: np.ndarray) -> np.ndarray:
        d, n = distances(x) ** 2, np.ones(len(x))
        np.fill_diagonal(d, np.inf)
        label, alive = np.arange(len(x)), np.ones(len(x), bool)
        for _ in range(len(x) - k):
            i, j = np.unravel_index(d.argmin(), d.shape)
            new = ((n[i] + n) * d[i] + (n[j] + n) * d[j] - n * d[i, j]) / (n[i] + n[j] + n)
            new[~alive] = np.inf
            d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
            d[i, i] = np.inf
            n[i] += n[j]
            alive[j] = False
            label[label == j] = i
        return np.unique(label, return_inverse=True)[1]

    return run


#: Subclusters that a partition keeps; beyond it, the radius grows and they are merged anew. Entries of a node of their tree.
SUBCLUSTERS, WIDTH = 512, 50


class Node:
    """Up to `width` entries of a tree of clustering features, and one more before it is split: their counts, sums, sums of squares and
    centroids, and below each a node (none in a leaf)."""

    def __init__(self, width: int, dim: int, leaf: bool):
        self.k, self.n, self.q, self.s, self.c = 0, np.zeros(width + 1), np.zeros(width + 1), np.zeros((width + 1, dim)), np.zeros((width + 1, dim))
        self.below: list[Node] | None = None if leaf else []

    def put(self, at: int, n: float, s: np.ndarray, q: float) -> None:
        self.n[at], self.s[at], self.q[at], self.c[at] = n, s, q, s / n
        self.k = max(self.k, at + 1)

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.k].sum(), self.s[: self.k].sum(0), self.q[: self.k].sum()


class Features:
    """Clustering features within a radius in a height-balanced tree, as by Zhang et al. (1996): an entry goes down to the nearest
    centroid of each node and is merged there if the radius allows; a node of over `width` entries is split between the two that are
    farthest apart. With more than `most` leaf entries the tree is rebuilt with a larger radius: the least at which half of the
    entries could join their nearest, since in many dimensions a little more than that merges nearly all."""

    def __init__(self, radius: float, most: int = SUBCLUSTERS, width: int = WIDTH):
        self.radius, self.most, self.width, self.size, self.root = radius, most, width, 0, None

    def add(self, n: float, s: np.ndarray, q: float) -> None:
        if self.root is None:
            self.root = Node(self.width, len(s), True)
        self._insert(n, s, q)
        growth = 1e-3
        while self.size > self.most:
            old = self.leaves()
            self.radius = max(self.radius * (1 + growth) + 1e-9, self._joining(*old))
            self.size, self.root, growth = 0, Node(self.width, len(s), True), 2 * growth
            for x in zip(*old, strict=True):
                self._insert(*x)

    def _insert(self, n: float, s: np.ndarray, q: float) -> None:
        halves = self._down(self.root, n, s, q)
        if halves:
            self.root = Node(self.width, len(s), False)
            for i, half in enumerate(halves):
                self.root.put(i, *half.total())
                self.root.below.append(half)

    @staticmethod
    def _joining(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
        """The median of the radius that each entry would have with its nearest one."""
        c = s / n[:, None]
        apart = squares(c, c)
        np.fill_diagonal(apart, np.inf)
        near = apart.argmin(1)
        total, joint = n + n[near], s + s[near]
        return float(np.sqrt(np.median(np.maximum((q + q[near]) / total - ((joint / total[:, None]) ** 2).sum(1), 0))))

    def _down(self, node: Node, n: float, s: np.ndarray, q: float) -> tuple[Node, Node] | None:
        at = int(((node.c[: node.k] - s / n) ** 2).sum(1).argmin()) if node.k else -1
        if node.below is None:
            if at >= 0:
                total, joint, squares = node.n[at] + n, node.s[at] + s, node.q[at] + q
                if max(squares / total - ((joint / total) ** 2).sum(), 0.0) ** 0.5 <= self.radius:
                    node.put(at, total, joint, squares)
                    return None
            node.put(node.k, n, s, q)
            self.size += 1
        else:
            halves = self._down(node.below[at], n, s, q)
            if not halves:
                node.put(at, node.n[at] + n, node.s[at] + s, node.q[at] + q)
                return None
            node.put(at, *halves[0].total())
            node.put(node.k, *halves[1].total())
            node.below[at] = halves[0]
            node.below.append(halves[1])
        return self._split(node) if node.k > self.width else None

    def _split(self, node: Node) -> tuple[Node, Node]:
        c = node.c[: node.k]
        apart = ((c[:, None] - c) ** 2).sum(2)
        one, other = divmod(int(apart.argmax()), node.k)
        second = apart[other] < apart[one]
        second[one], second[other] = False, True
        out = Node(self.width, c.shape[1], node.below is None), Node(self.width, c.shape[1], node.below is None)
        for i, to in enumerate(second):
            half = out[int(to)]
            half.put(half.k, node.n[i], node.s[i], node.q[i])
            if node.below is not None:
                half.below.append(node.below[i])
        return out

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, sums and sums of squares of the leaf entries, from left to right."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node.below is None:
                found.append((node.n[: node.k], node.s[: node.k], node.q[: node.k]))
            else:
                todo += node.below[::-1]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros((0, 0)), np.zeros(0))

    @property
    def n(self) -> np.ndarray:
        return self.leaves()[0]


def birch(df: DataFrame, k: int, radius: float, starts: int = 2) -> DataFrame:
    """Subclusters per partition in one pass, of bounded number, then k-means over their means, weighted by their sizes. Rows without a whole
    finite vector are in no subcluster and get -1."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(radius)
        for b in batches:
            for x in matrix(b.column(0)):
                found.add(1.0, x, float(x @ x))
        n, s, _ = found.leaves()
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(n), vectors(s / n[:, None])], ["n", "embedding"])

    subs = usable(df, "embedding").select("embedding").mapInArrow(summaries, "n double, embedding array<double>")
    return labelled(df, lloyd(folded(subs, weight="n"), k, starts))


def silhouettes(df: DataFrame, label: str, key: str) -> DataFrame:
    """Mean silhouette of all rows against all rows without noise, and how many they are (comparison.mean_silhouettes). Rows without a whole
    finite vector have no place."""
    of = F.array(F.struct(F.lit("given").alias("method"), F.col(label).cast("int").alias("label")))
    rows = usable(df.where(F.col(label) >= 0), "embedding").select(key, F.col("embedding").alias("v"), of.alias("of"))
    got = mean_silhouettes(cut_lineage(rows), key).select("asked", "silhouette")
    return got.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.first("silhouette").alias("silhouette"))


def dbcv(x: np.ndarray, label: np.ndarray) -> float:
    """Density-based validity: separation against sparseness over mutual reachability, weighted by size, noise in the total."""
    ids = [c for c in np.unique(label) if c >= 0]
    if len(ids) < 2:
        return float("nan")
    total, dim = len(label), x.shape[1]
    d, core = distances(x), np.zeros(len(x))
    for c in ids:
        at = np.flatnonzero(label == c)
        inner = d[np.ix_(at, at)]
        # the mean of (1 / d) ** dim to the power -1 / dim, in logarithms; a distance of 0 adds nothing
        logs = np.where(inner > 0, -dim * np.log(np.maximum(inner, 1e-300)), -np.inf)
        top = np.maximum(logs.max(1), -1e300)
        mean = top + np.log(np.maximum(np.exp(logs - top[:, None]).sum(1), 1e-300) / max(len(at) - 1, 1))
        core[at] = np.where(np.isfinite(logs).any(1), np.exp(-mean / dim), 0)
    reach = np.maximum(d, np.maximum(core[:, None], core))
    out = 0.0
    for c in ids:
        at, rest = np.flatnonzero(label == c), np.flatnonzero((label >= 0) & (label != c))
        sparse = max((w for w, *_ in spanning_tree(reach[np.ix_(at, at)])), default=0.0)
        apart = reach[np.ix_(at, rest)].min()
        out += (apart - sparse) / max(apart, sparse, 1e-12) * len(at) / total
    return float(out)


def knn_labels(train: DataFrame, df: DataFrame, key: str, k: int = 15) -> DataFrame:
    """Distance-weighted vote of the k nearest of all training rows."""
    near = neighbours(df, train, key, "embedding", k)
    votes = near.join(train.select(F.col(key).alias("other"), "label"), "other").groupBy(key, "label").agg(F.sum(1 / F.greatest("distance", F.lit(1e-12))).alias("w"))
    return votes.groupBy(key).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("predicted"))


def latent_classes(df: DataFrame, columns: list[str], k: int, steps: int = 40, starts: int = 2, weight: str | None = None) -> dict:
    """EM of a latent class model over the distinct patterns of integer codes, the best of several starts; log-likelihood, BIC, AIC
    and class shares. Rows count once, or as often as `weight` says.

    The patterns (one row each, with their counts) come to the driver: at most the product of the columns' levels.
    """
    got = df.groupBy(*columns).agg((F.sum(weight) if weight else F.count("*")).alias("n")).orderBy(*columns).collect()
    return max((_latent_start(got, columns, k, steps, seed) for seed in range(starts)), key=lambda g: g["loglik"])


def _latent_start(got: list, columns: list[str], k: int, steps: int, seed: int) -> dict:
    codes, n = np.array([[r[c] for c in columns] for r in got], int), np.array([r["n"] for r in got], float)
    levels = codes.max(0) + 1
    rng = np.random.default_rng(seed)
    pi, rates = np.full(k, 1 / k), [rng.dirichlet(np.ones(m) * 5, k) for m in levels]
    loglik = -np.inf
    for _ in range(steps):
        logs = np.log(pi) + sum(np.log(np.maximum(r[:, codes[:, j]].T, 1e-12)) for j, r in enumerate(rates))
        top = logs.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        post = np.exp(logs - norm[:, None]) * n[:, None]
        loglik = float((n * norm).sum())
        pi = post.sum(0) / n.sum()
        rates = [np.stack([np.bincount(codes[:, j], post[:, c], m) for c in range(k)]) / np.maximum(post.sum(0)[:, None], 1e-12) for j, m in enumerate(levels)]
    p = k - 1 + k * int((levels - 1).sum())
    return {"k": k, "loglik": loglik, "bic": -2 * loglik + p * float(np.log(n.sum())), "aic": -2 * loglik + 2 * p, "shares": sorted(pi.tolist(), reverse=True)}


def spread_modes(df: DataFrame, codes: list[str], k: int, weight: str | None = None) -> list[dict]:
    """Start modes (Huang 1998): the values of each code by falling frequency, dealt to the k modes in turns. Rows count once, or as often
    as `weight` says."""
    out: list[dict] = [{} for _ in range(k)]
    for c in codes:
        by = [r[0] for r in df.groupBy(c).agg((F.sum(weight) if weight else F.count("*")).alias("n")).orderBy(F.desc("n"), c).limit(k).collect()]
        for i, mode in enumerate(out):
            mode[c] = by[i % len(by)] if by else None
    return out


def k_prototypes(df: DataFrame, key: str, numbers: list[str], codes: list[str], k: int, gamma: float = 0.5, steps: int = 30, starts: int = 2) -> tuple[DataFrame, list[float]]:
    """All rows with `label`, and the costs of the best start's steps: Lloyd steps with squared distances plus gamma per mismatch, means of
    numbers and modes of codes, until the cost stays (Huang 1998).

    Equal (numbers, codes) are folded to one weighted row first, so a step reads as many rows as there are kinds of rows. A mode takes the most
    frequent value, the smallest of equals, from counts by value; ties of distance go to the first prototype. NULLs match NULLs in codes;
    a NULL number adds nothing. `df` is read three times, whatever the steps: for the kinds, the seeds and the labels.
    """
    kinds = cut_lineage(df.groupBy(*numbers, *codes).agg(F.count("*").alias("__n")))
    few = [r.asDict() for r in sample(df, k * starts, key).select(*numbers).collect()]
    modes = spread_modes(kinds, codes, k, "__n")

    def cost(p: dict) -> Column:
        parts = [F.coalesce((F.col(x) - F.lit(p[x])) ** 2, F.lit(0.0)) for x in numbers] + [F.when(F.col(x).eqNullSafe(F.lit(p[x])), 0.0).otherwise(gamma) for x in codes]
        return sum(parts[1:], parts[0])

    def near(rows: DataFrame, prototypes: list[dict]) -> DataFrame:
        best = F.array_min(F.array(*[F.struct(cost(p).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(prototypes)]))
        return rows.withColumn("__b", best).withColumns({"label": F.col("__b.i"), "__d": F.col("__b.d")}).drop("__b")

    def step(prototypes: list[dict]) -> tuple[list[dict], float]:
        at = near(kinds, prototypes)
        n = F.col("__n")
        got = at.groupBy("label").agg(F.sum(F.col("__d") * n).alias("cost"), *[F.try_divide(F.sum(F.col(x) * n), F.sum(F.when(F.col(x).isNotNull(), n))).alias(x) for x in numbers]).collect()
        new = [dict(p) for p in prototypes]
        for r in got:
            new[r["label"]] |= {x: r[x] if r[x] is not None else prototypes[r["label"]][x] for x in numbers}
        for c in codes:
            counts = at.groupBy("label", c).agg(F.sum("__n").alias("n"))
            for r in counts.groupBy("label").agg(F.min_by(c, F.struct(-F.col("n"), c)).alias("mode")).collect():
                new[r["label"]][c] = r["mode"]
        return new, float(sum(r["cost"] for r in got))

    best: tuple[list[dict], list[float]] | None = None
    for start in range(starts if few else 0):
        now, costs = [m | few[(start * k + i) % len(few)] for i, m in enumerate(modes[start % k :] + modes[: start % k])], []
        for _ in range(steps):
            new, total = step(now)
            costs.append(total)
            if len(costs) > 1 and costs[-1] >= costs[-2]:
                break
            now = new
        if best is None or costs[-1] < best[1][-1]:
            best = now, costs
    if best is None:
        return df.withColumn("label", F.lit(None).cast("int")), []
    return near(df, best[0]).drop("__d"), best[1]
