"""Exact neighbours of any number of rows: a join of cells, pruned by bounds.

Equal vectors are folded to one point first. Points lie in cells, by the nearest of about the root of their number of centres, each with
its smallest and largest distance to the centre; cells that lie side by side are gathered to bins, which are what a task holds. A
point asked for looks into the cells around it, which gives it an upper bound; then it goes to every cell that the triangle
inequality doesn't rule out under that bound, so nothing is lost. A task compares one bin with one slice of those who ask; its distances are
differences' norms, the matrix product only chooses whom to measure. Vectors that are null, or have null or non-finite elements, have no
neighbours and are nobody's; the others must have one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.operators.sampling import cut_lineage, sample

#: Points of a bin and askers of a slice, about; centres at most (their coordinates go to every task); sampled points a centre.
GROUP, CENTRES, SAMPLED = 32_768, 8192, 8
#: Numbers that are subtracted at once to measure pairs exactly, and pairs whose distance is estimated at once.
NUMBERS, BLOCK = 1 << 20, 1 << 20


@dataclass
class Cells:
    """Centres in the order of their bins, and what lies around them."""

    centres: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # the first bin of each cell
    parts: np.ndarray  # and how many it is cut into


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)), pa.array(x.ravel()))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product, with its rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def at_once(n: int) -> int:
    """Rows that are held against n others at once: a block of bounded size, whatever n is."""
    return int(min(max(BLOCK // max(n, 1), 16), 512))


def usable(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.withColumn(vector, v).where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)))


def points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One point per distinct vector: id (the smallest key), v and w, how many rows it stands for."""
    return usable(df, vector).groupBy(F.col(vector).alias("v")).agg(F.min(F.col(key).cast("long")).alias("id"), F.count("*").alias("w")).select("id", "v", "w")


def fit_centres(of: DataFrame, n: int) -> np.ndarray:
    """A few k-means steps over a sample of SAMPLED points a centre; lying in the order of their main direction."""
    k = int(min(max(np.sqrt(n), 1), CENTRES))
    x = np.array([r["v"] for r in sample(of, SAMPLED * k, "id").select("v").collect()], float)
    if not len(x):
        return np.zeros((1, 1))
    c = x[:: max(len(x) // k, 1)][:k].copy()
    for _ in range(4):
        near = np.concatenate([squares(x[i : i + at_once(len(c))], c).argmin(1) for i in range(0, len(x), at_once(len(c)))])
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    c = np.unique(c, axis=0)
    off = c - c.mean(0)
    return c[np.argsort(off @ np.linalg.svd(off, full_matrices=False)[2][0], kind="stable")]


def place(of: DataFrame, group: int = GROUP) -> tuple[DataFrame, Cells]:
    """`of` (id, v, w), checkpointed with cell and bin, and the cells. The driver gets one row per cell."""
    of = cut_lineage(of)
    centres = fit_centres(of, of.count())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, at_once(len(centres))):
                part = b.slice(at, at_once(len(centres)))
                x = matrix(part.column(1))
                cell = squares(x, centres).argmin(1)
                off = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(off)], ["id", "v", "w", "cell", "off"])

    placed = cut_lineage(of.select("id", "v", "w").mapInArrow(assign, "id long, v array<double>, w long, cell int, off double"))
    sizes, low, high = np.zeros(len(centres), int), np.zeros(len(centres)), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("off").alias("low"), F.max("off").alias("high")).collect():
        sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    first, parts, at, filled = np.zeros(len(centres), int), np.maximum(-(-sizes // group), 1), 0, 0
    for i, n in enumerate(sizes):
        if filled and filled + n > group:
            at, filled = at + 1, 0
        first[i] = at
        if parts[i] > 1:
            at, filled = at + parts[i], 0
        else:
            filled += n
    bins = of.sparkSession.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(centres))], "cell int, first int, parts int")
    placed = placed.join(F.broadcast(bins), "cell").withColumn("bin", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).drop("first", "parts")
    return placed, Cells(centres, sizes, low, high, first, parts)


def around(cells: Cells, least: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Needs the nearest cells that together hold `least` points."""

    def need(off: np.ndarray, reach: np.ndarray) -> np.ndarray:
        order = np.argsort(off, axis=1, kind="stable")
        held = np.cumsum(cells.sizes[order], axis=1)
        wanted = np.concatenate([np.ones((len(off), 1), bool), held[:, :-1] < least], axis=1)
        out = np.zeros(off.shape, bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out & (cells.sizes > 0)

    return need


def within_reach(cells: Cells) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Needs every cell that can hold a point no farther than the asker's reach: its distances to the centre differ by no more."""

    def need(off: np.ndarray, reach: np.ndarray) -> np.ndarray:
        reach = (reach + 1e-9 * (1 + reach))[:, None] + 1e-9 * off
        return (off - cells.high <= reach) & (cells.low - off <= reach) & (cells.sizes > 0)

    return need


def meet(asked: DataFrame, placed: DataFrame, cells: Cells, need: Callable, compare: Callable, schema: str, group: int = GROUP) -> DataFrame:
    """What `compare` makes of each bin's points and each slice of those of `asked` (id, v, w, reach) that need one of its cells.

    compare(x, q, seen) gets the bin's columns, the askers' columns, and for some of the askers with like needs (rows of q) the rows of x
    in the cells that they need, through iterating `seen`.
    """
    bins = int((cells.first + cells.parts).max())

    inside = [np.flatnonzero((cells.first <= i) & (i < cells.first + cells.parts)) for i in range(bins)]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
        for b in batches if cells.sizes.any() else ():
            for at in range(0, b.num_rows, at_once(len(cells.centres))):
                part = b.slice(at, at_once(len(cells.centres)))
                wanted = need(np.sqrt(squares(matrix(part.column(1)), cells.centres)), part.column(3).to_numpy(zero_copy_only=False))
                for i in range(bins):
                    some = wanted[:, inside[i]]
                    who = np.flatnonzero(some.any(1))
                    if len(who):
                        yield part, i, who, some[who]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(bins, np.int64)
        for _, i, who, _ in parts(batches):
            n[i] += len(who)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins, dtype=np.int32)), pa.array(n)], ["bin", "n"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, i, who, some in parts(batches):
            # the cells needed; none if they hold most of the bin, as then the whole bin is compared
            held = cells.sizes[inside[i]]
            whole = (some @ held) * 2 > held.sum()
            lists = [None if w else inside[i][row].astype(np.int32).tolist() for w, row in zip(whole, some, strict=True)]
            got = part.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array([i] * len(who), pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "w", "reach", "bin", "cells"])

    # askers come once for each bin: only how many there are is stored, they are dealt as they are made
    asked = cut_lineage(asked.select("id", "v", "w", "reach"))
    askers = asked.mapInArrow(visit, "id long, v array<double>, w long, reach double, bin int, cells array<int>")
    slices = [(r["bin"], -(-r["n"] // group)) for r in asked.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0").collect()]
    counts = asked.sparkSession.createDataFrame(slices, "bin int, slices int")
    right = askers.join(F.broadcast(counts), "bin").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
    left = placed.join(F.broadcast(counts), "bin").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def run(a: pa.Table, q: pa.Table) -> pa.Table:
        if not len(a) or not len(q):
            return compare(None, None, [])
        a = a.take(np.argsort(a["cell"].to_numpy(), kind="stable"))
        cell, wants = a["cell"].to_numpy(), q["cells"].to_pylist()
        like: dict[tuple | None, list[int]] = {}
        for i, c in enumerate(wants):
            like.setdefault(None if c is None else tuple(c), []).append(i)

        def seen() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            loose: list[int] = []
            for c, who in like.items():
                # askers with needs of their own are taken together in the order of their first cell
                if len(who) < 32 and c is not None:
                    loose += who
                    continue
                yield np.array(who), np.arange(len(cell)) if c is None else np.flatnonzero(np.isin(cell, c))
            loose.sort(key=lambda i: wants[i])
            for i in range(0, len(loose), 64):
                who = loose[i : i + 64]
                yield np.array(who), np.flatnonzero(np.isin(cell, list({c for j in who for c in wants[j]})))

        return compare(a, q, seen())

    return left.groupBy("bin", "slice").cogroup(right.groupBy("bin", "slice")).applyInArrow(run, schema)


def exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (q[i], x[j]) as norms of differences; a bounded number of differences at once."""
    step, out = max(NUMBERS // max(x.shape[1], 1), 1), np.empty(len(i))
    for at in range(0, len(i), step):
        out[at : at + step] = np.sqrt(((q[i[at : at + step]] - x[j[at : at + step]]) ** 2).sum(1))
    return out


def measured(q: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of x, exact distances) of all pairs within about sqrt(limit), with `k` at least of each row's k nearest of them; in
    blocks of rows of q. Rows of q come in order.

    A block is one matrix product, of single precision where its rounding leaves few more pairs than there are; the bound on the rounding is
    added to every limit, so that no pair is lost by it.
    """
    if not len(x) or not len(q):
        return
    middle = x.mean(0)
    a, b = q - middle, x - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    a, b = np.column_stack([-2 * a, aa, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), bb])
    sizes, top = aa + bb.max(), max(aa.max(), bb.max())
    kinds = [np.float32, np.float64] if 1e-25 < top < 1e30 else [np.float64]
    right: dict[type, np.ndarray] = {}
    step = at_once(len(x))
    for lo in range(0, len(q), step):
        rows = slice(lo, lo + step)
        n = len(a[rows])
        for kind in list(kinds):
            if kind not in right:
                right[kind] = np.ascontiguousarray(b.astype(kind).T)
            slack = 2 * (x.shape[1] + 8) * float(np.finfo(kind).eps) * sizes[rows]
            d, most = a[rows].astype(kind) @ right[kind], limit[rows] + slack
            if k and k < len(x) and not np.isfinite(most).all():
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack)
            at = np.flatnonzero(d <= most.astype(kind)[:, None])
            if kind is np.float64 or len(at) <= 32 * n * (k or 32):
                break
            kinds = [np.float64]  # too coarse for these distances, or there are as many: the other blocks need no trial
        i, j = np.divmod(at, len(x))
        if k and len(i) > k * n:
            # only those that can be among the k nearest by their estimates
            about = d.ravel()[at].astype(float)
            order = np.lexsort((about, i))
            first, counts = np.searchsorted(i, np.arange(n)), np.bincount(i, minlength=n)
            kth = np.full(n, np.inf)
            many = counts >= k
            kth[many] = about[order[first[many] + k - 1]]
            some = about <= (kth + 2 * slack)[i]
            i, j = i[some], j[some]
        yield i + lo, j, exact(q[rows], x, i, j)


def nearest_compare(k: int) -> Callable:
    def compare(a: pa.Table | None, q: pa.Table | None, seen: Iterator) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if a is not None:
            x, y, ids, own = matrix(a["v"]), matrix(q["v"]), a["id"].to_numpy(), q["id"].to_numpy()
            reach = q["reach"].to_numpy()
            limit = np.where(np.isnan(reach), np.inf, reach**2 * (1 + 1e-9))
            for who, at in seen:
                names = ids[at]
                for i, j, d in measured(y[who], x[at], limit[who], k):
                    order = np.lexsort((names[j], d, i))
                    i, j, d = i[order], j[order], d[order]
                    ok = np.arange(len(i)) - np.searchsorted(i, i) < k
                    out.append((own[who[i[ok]]], names[j[ok]], d[ok]))
        parts = [np.concatenate(p) for p in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(parts, ["id", "other", "distance"])

    return compare


def first_of(found: DataFrame, k: int, by: str = "id") -> DataFrame:
    w = Window.partitionBy(by).orderBy("distance", "other")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def nearest_points(asked: DataFrame, placed: DataFrame, cells: Cells, k: int, group: int = GROUP) -> DataFrame:
    """(id, other, distance, r): the k nearest points for each of `asked` (id, v, w), itself among them if it is one of them."""
    schema = "id long, other long, distance double"
    asked = cut_lineage(asked)
    tried = meet(asked.withColumn("reach", F.lit(float("nan"))), placed, cells, around(cells, k), nearest_compare(k), schema, group)
    reach = first_of(tried, k).groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reach"))
    found = meet(asked.join(reach, "id"), placed, cells, within_reach(cells), nearest_compare(k), schema, group)
    return first_of(found, k)


def neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, group: int = GROUP) -> DataFrame:
    """(key, other, distance, r): the k nearest of `rows` for each of `queries`, ties to the smaller key; a row isn't its own neighbour.

    Fewer than k where there are no more rows. Of equal vectors, the k + 1 smallest keys are enough, and the window that picks them limits each
    task's rows before the exchange. Keys are whole numbers.
    """
    placed, cells = place(points(rows, key, vector), group)
    asked = points(queries, key, vector)
    found = nearest_points(asked, placed, cells, k + 1, group)
    copies = usable(rows.select(F.col(key).cast("long").alias("other"), F.col(vector).alias("v")), "v").withColumn("c", F.row_number().over(Window.partitionBy("v").orderBy("other"))).where(F.col("c") <= k + 1)
    members = copies.withColumn("point", F.min("other").over(Window.partitionBy("v"))).select("point", F.col("other"))
    own = usable(queries.select(F.col(key).cast("long").alias("__row"), F.col(vector).alias("v")), "v").join(asked.select("v", "id"), "v").select("__row", "id")
    each = found.select("id", F.col("other").alias("point"), "distance").join(members, "point").select("id", "other", "distance")
    few = cut_lineage(first_of(each, k + 1))
    all_rows = own.join(few.select("id", "other", "distance"), "id").where(F.col("other") != F.col("__row")).select(F.col("__row").alias(key), "other", "distance")
    return first_of(all_rows, k, key)
