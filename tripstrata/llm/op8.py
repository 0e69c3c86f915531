"""Sharding by histogram sort: exact byte counts below candidate keys, probes refined until the splitters fit, one exchange.

The order is (hash of the text, hash of the row), so equal texts lie side by side; the law is `bytes`: shards of near equal bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstrata.llm.common import Scratch, table

SHARDS = 24
PROBES = 256
#: Allowed distance of a splitter from its place, as a part of a shard's bytes; finer only ends where one row is larger.
TOLERANCE = 0.0005
#: Bytes of text whose rows (without the text) one task of the exchange takes.
SLICE_BYTES = 4 << 30


def locate(hashes: np.ndarray, rows: np.ndarray, h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the sorted pairs (hashes, rows) are at or below each pair (h, r)."""
    place, end = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
    for a in np.unique(place[end > place]):
        tied = np.flatnonzero((place == a) & (end > a))
        place[tied] = a + np.searchsorted(rows[a : end[tied[0]]], r[tied], "right")
    return place


def find_splitters(keys: DataFrame, cuts: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """`cuts` - 1 splitters (hash, row key) at equal bytes, and all bytes. A splitter's row is the first above it.

    Each round sends a sorted list of probes and gets the exact bytes below each: one scan, one sum per probe. A
    splitter's interval shrinks by the number of its probes each round: first over the hashes, then, where one hash
    (a group of copies) is larger than the tolerance, over the row keys within that hash.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    goals = [total * i // cuts for i in range(1, cuts)]
    slack = max(1, int(tolerance * total / cuts))
    lo, hi = -(1 << 63), (1 << 63)

    def below(probes: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
        order = sorted(set(probes))
        hashes, rows = np.array([p[0] for p in order], np.int64), np.array([p[1] for p in order], np.int64)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(hashes) + 1, np.int64)
            for b in batches:
                h, r, z = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                np.add.at(sums, locate(hashes, rows, h, r), z)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["at", "n"])

        got = keys.select("hash", "row", "size").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros(len(order) + 1, np.int64)
        for x in got:
            sums[x["at"]] = x["n"]
        return dict(zip(order, np.cumsum(sums)[:-1].tolist(), strict=True))

    spans = {g: (lo, hi) for g in goals}
    found: dict[int, tuple[int, int]] = {}
    inside: dict[int, tuple[int, int, int]] = {}
    while spans or inside:
        probes = {g: [(x, lo) for x in sorted({a + (b - a) * k // PROBES for k in range(1, PROBES)} - {a, b} | {a if a > lo else a + 1})] for g, (a, b) in spans.items()}
        probes |= {g: [(h, x) for x in sorted({a + (b - a) * k // PROBES for k in range(1, PROBES)} | {a})] for g, (h, a, b) in inside.items()}
        counted = below([p for ps in probes.values() for p in ps])
        for g, ps in probes.items():
            near = min(ps, key=lambda p: (abs(counted[p] - g), p))
            if abs(counted[near] - g) <= slack:
                found[g] = near
                spans.pop(g, None), inside.pop(g, None)
                continue
            low = max((p for p in ps if counted[p] <= g), default=None)
            high = min((p for p in ps if counted[p] > g), default=None)
            if g in spans:
                a, b = spans[g]
                a, b = low[0] if low else a, high[0] if high else b
                if b - a > 1:
                    spans[g] = (a, b)
                else:
                    spans.pop(g)
                    inside[g] = (a, 0, 1 << 63)
            else:
                h, a, b = inside[g]
                a, b = low[1] if low else a, high[1] if high else b
                if b - a > 1:
                    inside[g] = (h, a, b)
                else:
                    found[g] = near
                    inside.pop(g)
    return [found[g] for g in goals], total


def ranged(keys: DataFrame, splitters: list[tuple[int, int]], name: str) -> DataFrame:
    """`keys` with the number of splitters at or below each (hash, row) in the column `name`."""
    hashes, rows = np.array([x[0] for x in splitters], np.int64), np.array([x[1] for x in splitters], np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, r = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("hash", "row"))
            yield b.append_column(name, pa.array(locate(hashes, rows, h, r).astype(np.int32)))

    return keys.mapInArrow(dealt, T.StructType([*keys.schema.fields, T.StructField(name, T.IntegerType())]))


def with_slices(keys: DataFrame, bounds: list[tuple[int, int]], each: int) -> list[tuple[int, int]]:
    """The shards' bounds and about `each` - 1 splitters within each shard, at quantiles of its hashes; where several fall on one
    hash (a group of copies), at equal parts of its row keys. One row of quantiles a shard comes to the driver."""
    parts = F.array(*[F.lit(i / each) for i in range(1, each)])
    found = set(bounds)
    ends = [(-(1 << 63), 0), *bounds, ((1 << 63) - 1, (1 << 62))]
    for r in keys.groupBy("shard").agg(F.percentile_approx("hash", parts, 10 * each).alias("q")).collect():
        low, high = ends[r["shard"]], ends[r["shard"] + 1]
        for h, n in Counter(r["q"]).items():
            found |= {x for x in ((h, (1 << 62) * i // n) for i in range(n)) if low < x < high}
    return sorted(found)


def histogram_shards(docs: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard, slot, text_hash.

    Size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text is that of the empty text. Each shard
    has near equal bytes: off by the tolerance and one row at most. Rows that are alike in every column go side by
    side. Other columns are ignored; an empty table gives no rows. A shard is never one task's: it is cut into slices of
    about `slice_bytes`, and a slot is the slice's first slot plus the place within it.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("uid"))
    with Scratch(spark) as s:
        keys = s.save(keys, "keys")
        # the order within a hash
        keys = keys.withColumn("row", F.xxhash64("doc_id", "uid").bitwiseAND((1 << 62) - 1))
        total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        if not total:
            return s.keep(keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.col("hash").alias("text_hash")))
        each = max(1, -(-total // (n_shards * slice_bytes)))
        bounds, _ = find_splitters(keys, n_shards, tolerance)
        shard = ranged(keys, bounds, "shard")
        splitters = with_slices(shard, bounds, each) if each > 1 else bounds
        starts_at = np.array([0, *(i + 1 for i, x in enumerate(splitters) if x in set(bounds))])
        sliced = ranged(shard, splitters, "slice")
        window = Window.partitionBy("slice").orderBy("hash", "row", "uid")
        placed = s.save(sliced.withColumn("place", F.row_number().over(window) - 1), "placed")
        counts = {x["slice"]: x["n"] for x in placed.groupBy("slice").agg(F.count("*").alias("n")).collect()}
        of = np.searchsorted(starts_at, np.arange(len(splitters) + 1), "right") - 1
        first = [sum(counts.get(j, 0) for j in range(int(starts_at[of[i]]), i)) for i in range(len(of))]
        starts = spark.createDataFrame(list(enumerate(first)), "slice int, first long")
        done = placed.join(F.broadcast(starts), "slice")
        return s.keep(done.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.col("hash").alias("text_hash")))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = histogram_shards(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
