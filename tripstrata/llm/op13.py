"""Whitening: covariances by generated SQL sums over the upper triangle, eigenvectors from LAPACK, rows projected and rescaled.

The triangle is laid out in tiles of TILE by TILE dimension pairs: a row meets every tile once, and one aggregation by tile sums the
tile's centred products in generated columns, combined in each task before the exchange. So an expression stays small enough for
the JVM to compile at any number of dimensions, and no pair is summed twice but those within a tile on the diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, table

TILE = 8
COMPONENTS = 8
#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000


def usable(vectors: DataFrame, vector: str) -> Column:
    """Whether a vector is there, not empty, and without null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def tile_sums(rows: DataFrame, vector: str, means: list[float]) -> DataFrame:
    """One row per tile of the upper triangle: i, j (of the tile) and s0, s1, ... the sums of centred products, row by row."""
    d = len(means)
    tiles = -(-d // TILE)
    centred = F.array(*[F.get(vector, F.lit(i)) - F.lit(m) for i, m in enumerate(means)], *[F.lit(0.0)] * (tiles * TILE - d))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(tiles) for j in range(i, tiles)])
    at = rows.select(centred.alias("x")).select("x", F.explode(pairs).alias("tile")).select("x", "tile.i", "tile.j")
    sums = [f"sum(x[i * {TILE} + {a}] * x[j * {TILE} + {b}]) AS s{a * TILE + b}" for a in range(TILE) for b in range(TILE)]
    return at.groupBy("i", "j").agg(*map(F.expr, sums))


def covariance(rows: DataFrame, vector: str, means: list[float], n: int) -> np.ndarray:
    """The covariance, by n, of vectors of doubles with the given means. The driver gets one number per pair of dimensions."""
    d = len(means)
    out = np.zeros((d + -d % TILE,) * 2)
    for r in tile_sums(rows, vector, means).collect():
        i, j, block = r["i"] * TILE, r["j"] * TILE, np.array(r[2:]).reshape(TILE, TILE)
        out[i : i + TILE, j : j + TILE] = block
        out[j : j + TILE, i : i + TILE] = block.T
    return out[:d, :d] / n


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance and their unit vectors (rows), the largest entry of each positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return values, vectors * sign[:, None]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable row of `vectors`: key, n, deviation, whitened (array, by component), explained (array), identity_error.

    Rows whose vector is null or empty, or has null or non-finite entries, are left out, and so are those whose number of dimensions isn't
    the most frequent one (the larger of two), which have no covariance with the rest. Repeated rows and keys, also null ones, stay. A component
    without variance (beyond rounding) has null `whitened` and takes no part in the error. A deviation too large for a long is null.
    Entries of over 2^43 in size are taken as 2^43. Other columns are ignored; an empty table gives no rows.
    """
    with Scratch(vectors.sparkSession) as s:
        kept = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable(vectors, vector))
        most = kept.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        if most is None:
            return s.keep(kept.selectExpr("key", "0L AS n", "0L AS deviation", "array(0D) AS whitened", "array(0D) AS explained", "0D AS identity_error"))
        d, n = most["d"], most["n"]
        limit = float(1 << 43)
        kept = kept.where(F.size("v") == d)
        whole = lambda i: F.floor(F.lit(float(SCALE)) * F.greatest(F.least(F.get("v", F.lit(i)), F.lit(limit)), F.lit(-limit))) + SHIFT
        # whole numbers up to 2^53 as doubles: exact, and products need no cast
        rows = kept.select("key", F.array(*[whole(i).cast("double") for i in range(d)]).alias("x"))
        got = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        sums, wide = [0] * d, 0
        for r in got:
            sums[r["i"]] = int(r["s"])
            wide += max(abs(n * int(r["low"]) - int(r["s"])), abs(n * int(r["high"]) - int(r["s"]))) ** 2
        means = [t / n for t in sums]
        v = covariance(rows, "x", means, n)
        e, u = components(v, k)
        trace = float(np.trace(v))
        real = e > 1e-12 * max(trace, 1e-300)
        turn = (u / np.sqrt(np.where(real, e, 1.0))[:, None]).T
        fits, mean, exact = wide < 1 << 63, np.array(means), np.array(sums, object)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    x = part.column(1).flatten().to_numpy().reshape(-1, d)
                    if fits:
                        off = n * x.astype(np.int64) - exact.astype(np.int64)
                        deviation = (off * off).sum(1).tolist()
                    else:
                        deviation = [t if (t := int(sum(y * y for y in n * row.astype(np.int64).astype(object) - exact))) < 1 << 63 else None for row in x]
                    w = (x - mean) @ turn
                    flat, lengths = pa.array(w.ravel(), mask=np.tile(~real, len(w))), np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), flat)], ["key", "deviation", "whitened"])

        kind = rows.schema["key"].dataType.simpleString()
        white = s.save(rows.mapInArrow(project, f"key {kind}, deviation long, whitened array<double>"), "white")
        good = np.flatnonzero(real)
        error = None
        if len(good):
            some = white.select(F.array(*[F.get("whitened", F.lit(int(i))) for i in good]).alias("w"))
            centre = some.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(len(good))]).first()
            error = float(np.abs(covariance(some, "w", list(centre), n) - np.eye(len(good))).max())
        parts = [float(x) / trace if trace > 0 else 0.0 for x in e]
        return s.keep(white.select("key", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, parts)).alias("explained"), F.lit(error).cast("double").alias("identity_error")))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whiten(table(spark, sf_dir, "embeddings"))
    each = got.select(F.col("key").alias("vec_id"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "one.whitened", "one.explained", "identity_error")
