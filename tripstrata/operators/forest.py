"""Random forests whose trees are grown by the tasks: no tree, and no histogram of one, comes to the driver.

Values become bins at quantiles of all rows, a byte each, so that a task can hold what a tree needs of every row: the bytes lie in a
temporary file of the task, in memory are a few bytes a row and histograms of a bounded number of nodes. A task grows the trees of one
fold that it is given one after another, level by level, and gives the votes for the rows of the fold.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.quantiles import percentiles
from tripstrata.operators.neighbours import matrix, usable
from tripstrata.operators.sampling import cut_lineage

#: Bins of a value at most; rows of a block that is sent as one; trees of a task at most; rows looked at, and numbers of histograms held, at once.
BINS, ROWS, TREES, BLOCK, HELD = 32, 64, 20, 1 << 16, 1 << 22
#: A vote of one is this many, so that sums of votes are whole numbers and don't depend on their order.
WHOLE = 1 << 40


class Tree:
    """Nodes by number: the feature and the bin up to which rows go to `below`, all others to the one after it (-1: a leaf), and the votes."""

    def __init__(self, classes: int):
        self.feature, self.bin, self.below, self.votes = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, classes), np.int64)

    def more(self, n: int) -> np.ndarray:
        at = np.arange(n) + len(self.bin)
        zero = np.zeros(n, int)
        self.feature, self.bin, self.below = np.append(self.feature, zero), np.append(self.bin, zero), np.append(self.below, zero - 1)
        self.votes = np.vstack([self.votes, np.zeros((n, self.votes.shape[1]), np.int64)])
        return at

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows):
            rows = rows[self.below[at[rows]] >= 0]
            at[rows] = self.below[at[rows]] + (x[rows, self.feature[at[rows]]] > self.bin[at[rows]])
        return at


def best_splits(counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which feature, bin, whether there is a split that helps) of nodes by their counts (node, feature, bin, class): the least Gini impurity
    of both sides, each with a row at least; the first of equals."""
    left = counts.cumsum(2)
    total = left[:, :1, -1:]
    left = left[:, :, :-1]
    sides, some = 0.0, True
    for side in (left, total - left):
        w = side * weight
        held = w.sum(3)
        sides = sides + np.divide((w * w).sum(3), held, out=np.zeros_like(held), where=held > 0)
        some = some & (side.sum(3) > 0)
    w = (total * weight)[:, 0, 0]
    alone = (w * w).sum(1) / w.sum(1)
    gain = np.where(some, sides - alone[:, None, None], -np.inf).reshape(len(counts), -1)
    at = gain.argmax(1)
    feature, bin_ = np.divmod(at, left.shape[2])
    return feature, bin_, gain[np.arange(len(at)), at] > 1e-9 * alone


def grow(x: np.ndarray, y: np.ndarray, times: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator, tried: int | None = None) -> Tree:
    """A tree on rows of bins `x` with classes `y`, each counted `times`; classes weigh `weight`. A node tries `tried` features, the root of
    their number if not told."""
    classes, features = len(weight), x.shape[1]
    tried = tried or int(np.ceil(np.sqrt(features)))
    tree, at = Tree(classes), np.where(times > 0, 0, -1).astype(np.int32)
    first, n = int(tree.more(1)[0]), 1
    for level in range(depth + 1):
        held = np.zeros((n, classes))
        for lo in range(0, len(y), BLOCK):
            rows = slice(lo, lo + BLOCK)
            ok = at[rows] >= 0
            held += np.bincount((at[rows][ok] - first) * classes + y[rows][ok], times[rows][ok], n * classes).reshape(n, classes)
        parts = held * weight
        tree.votes[first : first + n] = np.round(parts / np.maximum(parts.sum(1, keepdims=True), 1e-300) * WHOLE)
        open_ = np.flatnonzero((held > 0).sum(1) > 1) if level < depth else np.zeros(0, int)
        if not len(open_):
            return tree
        chosen = np.sort(rng.random((len(open_), features)).argpartition(tried - 1, 1)[:, :tried], 1)
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        at[at >= 0] = np.where(place[at[at >= 0] - first] >= 0, at[at >= 0], -1)
        found = [np.zeros(len(open_), int), np.zeros(len(open_), int), np.zeros(len(open_), bool)]
        step = max(HELD // (tried * BINS * classes), 1)
        for a in range(0, len(open_), step):
            z = min(a + step, len(open_))
            counts = np.zeros((z - a) * tried * BINS * classes)
            for lo in range(0, len(y), BLOCK):
                rows = lo + np.flatnonzero(at[lo : lo + BLOCK] >= 0)
                node = place[at[rows] - first]
                if step < len(open_):
                    some = (node >= a) & (node < z)
                    rows, node = rows[some], node[some]
                if len(rows):
                    values = x[rows[0] : rows[-1] + 1][rows - rows[0]][np.arange(len(rows))[:, None], chosen[node]].astype(int)
                    to = (((node - a)[:, None] * tried + np.arange(tried)) * BINS + values) * classes + y[rows][:, None]
                    counts += np.bincount(to.ravel(), np.repeat(times[rows], tried), len(counts))
            for whole, part in zip(found, best_splits(counts.reshape(z - a, tried, BINS, classes), weight), strict=True):
                whole[a:z] = part
        which, bins, helps = found
        nodes = first + open_[helps]
        tree.feature[nodes], tree.bin[nodes] = chosen[np.arange(len(open_)), which][helps], bins[helps]
        below = tree.more(2 * len(nodes))
        tree.below[nodes] = below[::2]
        first, n = int(below[0]) if len(below) else 0, len(below)
        if not n:
            return tree
        for lo in range(0, len(y), BLOCK):
            rows = lo + np.flatnonzero(at[lo : lo + BLOCK] >= 0)
            if len(rows):
                old = at[rows]
                right = x[rows[0] : rows[-1] + 1][rows - rows[0], tree.feature[old]] > tree.bin[old]
                at[rows] = np.where(tree.below[old] >= 0, tree.below[old] + right, -1)
    return tree


def thresholds(df: DataFrame, vector: str) -> list[np.ndarray]:
    """For each dimension the values between its bins: quantiles of all rows, each once."""
    long = df.select(F.posexplode(vector).alias("i", "x"))
    got = percentiles(long, ["i"], "x", [i / BINS for i in range(1, BINS)], cut_lineage).select("i", "q").orderBy("i").collect()
    return [np.unique(np.array(r["q"], float)) for r in got]


def out_of_fold(df: DataFrame, label: str, fold: str, key: str, vector: str, folds: int, trees: int = 200, depth: int = 12, seed: int = 1) -> DataFrame:
    """(label, predicted) of each row: the class with the most votes of a forest of `trees` trees on the rows of the other folds. Each tree draws its
    rows with replacement (Poisson), every class weighs as much as any other. Rows without a label or a whole finite vector take no part."""
    spark = df.sparkSession
    rows = cut_lineage(usable(df.where(F.col(label).isNotNull()), vector).select(F.col(key).cast("long").alias("key"), label, fold, vector))
    sizes = {r[0]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()}
    if not sizes:
        return rows.select(label, F.col(label).alias("predicted"))
    names, weight = np.array(list(sizes)), 1.0 / np.array(list(sizes.values()), float)
    cuts, classes, total = thresholds(rows, vector), len(sizes), sum(sizes.values())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(3))
            x = np.column_stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, x.T, strict=True)])
            y, of = np.searchsorted(names, b.column(1).to_numpy()).astype(np.int32), b.column(2).to_numpy().astype(np.int8)
            for at in range(0, len(x), ROWS):
                some = slice(at, at + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([v[some].tobytes()], pa.binary()) for v in (x, y, of)], ["x", "y", "fold"])

    # blocks in the order of the key's hash and the key, however the table is cut
    parts = max(2, -(-total // 8192))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", label, vector)
    blocks = cut_lineage(dealt.select("key", label, fold, vector).mapInArrow(pack, "x binary, y binary, fold binary").withColumn("at", F.monotonically_increasing_id()))
    runs = [(f, lo, min(lo + TREES, trees)) for f in range(folds) for lo in range(0, trees, TREES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, ofs, task = [], [], None
        with tempfile.TemporaryFile() as file:
            for b in batches:
                for at, x, y, of in zip(b.column(0).to_pylist(), *[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                    task = at
                    file.write(x)
                    ys.append(np.frombuffer(y, np.int32))
                    ofs.append(np.frombuffer(of, np.int8))
            if task is None:
                return
            file.flush()
            y, of = np.concatenate(ys), np.concatenate(ofs)
            x = np.memmap(file, np.uint8, "r", shape=(len(y), len(cuts)))
            out, low, high = runs[task]
            mine = np.flatnonzero(of == out)
            votes = np.zeros((len(mine), classes), np.int64)
            for number in range(low, high):
                rng = np.random.default_rng([seed, out, number])
                times = np.concatenate([rng.poisson(1.0, min(BLOCK, len(y) - lo)).astype(np.uint8) for lo in range(0, len(y), BLOCK)])
                times[of == out] = 0
                if not times.any():
                    continue
                tree = grow(x, y, times, weight, depth, rng)
                for lo in range(0, len(mine), BLOCK):
                    votes[lo : lo + BLOCK] += tree.votes[tree.leaves(x[mine[lo : lo + BLOCK]])]
            del x
        for lo in range(0, len(mine), BLOCK):
            some = slice(lo, lo + BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(mine[some]), pa.array(y[mine[some]]), *(pa.array(v) for v in votes[some].T)], ["row", "own", *columns])

    columns = [f"v{i}" for i in range(classes)]
    dealt = blocks.crossJoin(F.broadcast(spark.range(len(runs)).select(F.col("id").cast("int").alias("task")))).select("task", "at", "x", "y", "fold")
    votes = dealt.repartitionById(len(runs), F.col("task")).sortWithinPartitions("task", "at").mapInArrow(run, ", ".join(["row long", "own int", *(f"{c} long" for c in columns)]))
    summed = votes.groupBy("row", "own").agg(*[F.sum(c).alias(c) for c in columns])
    most = F.array_position(F.array(*columns), F.greatest(*columns) if classes > 1 else F.col(columns[0]))
    named = F.array(*[F.lit(n.item()) for n in names])
    return summed.select(F.element_at(named, F.col("own") + 1).alias(label), F.element_at(named, most.cast("int")).alias("predicted"))
