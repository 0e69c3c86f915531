"""Importance resampling towards a target: hashed n-gram features, array-scored weights, an exact draw by merged runs.

Two arrays of bucket counts, of the documents and of the target, give a gain per bucket; a document's weight is the floored
mean gain of its features, and Gumbel noise from its id makes the highest scores a draw without replacement. Scored rows
are sorted into runs, each cut at bounds that part the order of scores into ranges of about RANGE rows. Tournament trees merge the runs of
a range, at most FAN of them at once, in passes over stored runs; the ranges' counts give the first rank of each, and merging
stops when the draw is complete. So no task holds more than a few runs' blocks of one range.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, table

BUCKETS, RUNS, LEAST_WORDS, SEED = 10_000, 2, 20, 7
#: The part of the eligible documents that is drawn, in hundredths.
PART = 25
#: Rows of a sorted run; rows of a range, about; runs that one tree merges; parts of one score at most, before equal ids are parted too.
RUN, RANGE, FAN, PARTS = 1 << 20, 1 << 17, 256, 1000
#: Features that are counted or scored at once; a longer text is a part of its own.
FEATURES = 1 << 20
#: Lower-cases A-Z and turns every other byte that isn't a digit, a-z or above 0x7F into a space.
WORD_BYTES = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x > 0x7F else 0x20 for x in range(256))
#: A record of a run: score upside down, id, hash of the row (these order it), features, weight, whether the id is null.
RECORD, SIZE = ">QQQQQQ", 48
SIGN = 1 << 63


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def buckets_of(words: list[bytes], runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to `runs` consecutive words, repeats included; a longer run's CRC goes on from a shorter one's."""
    sums = list(map(crc32, words))
    parts = [sums]
    for n in range(1, runs):
        sums = list(map(crc32, words[n:], map(crc32, repeat(b" "), sums)))
        parts.append(sums)
    return np.fromiter(chain.from_iterable(parts), np.int64, sum(map(len, parts))) % buckets


def parts_of(batches: Iterator[pa.RecordBatch], column: int, runs: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray]]]:
    """Slices of the batches with their texts' numbers of words and buckets, of about FEATURES features."""
    for b in batches:
        at, counts, found, total = 0, [], [], 0
        for i, text in enumerate(b.column(column)):
            words = words_of(text.as_py())
            counts.append(len(words))
            found.append(buckets_of(words, runs, buckets))
            total += len(found[-1])
            if total >= FEATURES or i == b.num_rows - 1:
                yield b.slice(at, i + 1 - at), counts, found
                at, counts, found, total = i + 1, [], [], 0


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (text, not null) lie in each bucket: summed per task, then by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for _, _, found in parts_of(batches, 0, runs, buckets):
            n += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of how much likelier a bucket is in the target (t) than in the documents (s)."""
    add = len(s)
    ratio = (t + 1.0) * (float(s.sum()) + add) / ((s + 1.0) * (float(t.sum()) + add))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def score(texts: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of (doc_id, text)."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counts, found in parts_of(batches, 1, runs, buckets):
            n = np.array([len(x) for x in found], np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[np.concatenate(found)])])
            ends = np.cumsum(n)
            weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    found = texts.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return found.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def tournament(runs: list[Iterator[bytes]]) -> Iterator[bytes]:
    """Merges sorted runs. An inner node keeps the loser of its match; the next record of the winner's run replays the matches above it."""
    k, end = len(runs), b"\xff" * (SIZE + 1)
    heads = [next(r, end) for r in runs]
    loser = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], loser[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while heads[best] is not end:
        yield heads[best]
        heads[best] = next(runs[best], end)
        node = (best + k) >> 1
        while node:
            if heads[loser[node]] < heads[best]:
                best, loser[node] = loser[node], best
            node >>= 1


def records(blocks: list[bytes]) -> Iterator[bytes]:
    for block in blocks:
        yield from (block[i : i + SIZE] for i in range(0, len(block), SIZE))


def spans(by_score: list[tuple[int, int]], draw: int, range_rows: int, inner: dict[int, list[int]]) -> list[bytes]:
    """Bounds, as the first bytes of records, that part the rows from the highest score down to the one at which the draw ends.

    `by_score`: (score, rows), highest first; `inner`: for a score of more than `range_rows` rows, its ids at even steps. An id that comes
    at several steps has so large a part of the rows that these are parted by their hashes, which are even.
    """
    bounds, filled, taken = [], 0, 0
    for value, n in by_score:
        if taken >= draw:
            break
        key = lambda doc, mix, value=value: struct.pack(">QQQ", SIGN - value, doc + SIGN, mix)
        if n > range_rows:
            steps = inner.get(value, [])
            bounds.append(key(-SIGN, 0))
            for doc in sorted(set(steps)):
                share = steps.count(doc) * n // (len(steps) + 1)
                parts = max(1, -(-share // range_rows)) if steps.count(doc) > 1 else 1
                bounds += [key(doc, (1 << 64) * i // parts) for i in range(parts)]
            filled = range_rows
        elif filled + n > range_rows:
            bounds.append(key(-SIGN, 0))
            filled = n
        else:
            filled += n
        taken += n
    return sorted(set(bounds))


def merge_pass(runs: DataFrame, groups: int, seed: int) -> DataFrame:
    """Runs of the same range, dealt to `groups` trees: one longer run each, in blocks of at most 4,096 records."""

    def merge(t: pa.Table) -> pa.Table:
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for run, block, data in zip(t["run"].to_pylist(), t["block"].to_pylist(), t["records"].to_pylist(), strict=True):
            parts.setdefault(run, []).append((block, data))
        found = list(tournament([records([d for _, d in sorted(p)]) for p in parts.values()]))
        blocks = [b"".join(found[i : i + 4096]) for i in range(0, len(found), 4096)]
        n = len(blocks)
        return pa.table({"range": pa.array([t["range"][0].as_py()] * n, pa.int32()), "run": pa.array([min(parts)] * n, pa.int64()), "block": pa.array(range(n), pa.int32()), "n": pa.array([len(x) // SIZE for x in blocks], pa.int64()), "records": pa.array(blocks, pa.binary())})

    dealt = runs.withColumn("tree", F.pmod(F.xxhash64("run", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("range", "tree").applyInArrow(merge, "range int, run long, block int, n long, records binary")


def drawn_rows(scored: DataFrame, s: Scratch, draw: int, run_rows: int, range_rows: int, fan: int) -> DataFrame:
    """The `draw` first rows of `scored` (row, doc_id, n_features, weight, score) by falling score, then id (null last): those and rank, mix."""
    # distinct scores are few: whole thousandths of a logarithm and of 32-bit noise
    by_score = [(r["score"], r["n"]) for r in scored.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()]
    hot = [(v, n) for (v, n), before in zip(by_score, accumulate((n for _, n in by_score), initial=0), strict=False) if n > range_rows and before < draw]
    inner: dict[int, list[int]] = {}
    doc = F.coalesce("doc_id", F.lit(SIGN - 1))
    if hot:
        parts = min(PARTS, max(-(-n // range_rows) for _, n in hot))
        some = scored.join(F.broadcast(scored.sparkSession.createDataFrame([(v,) for v, _ in hot], "score long")), "score")
        steps = F.percentile_approx(doc, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts))
        inner = {r["score"]: r["steps"] for r in some.groupBy("score").agg(steps.alias("steps")).collect()}
    bounds = spans(by_score, draw, range_rows, inner)
    lowest = next(v for (v, _), total in zip(by_score, accumulate(n for _, n in by_score), strict=True) if total >= draw)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def run() -> Iterator[pa.RecordBatch]:
            held.sort()
            number, cuts = int.from_bytes(held[0][16:24]) >> 1, [0, *(bisect_right(held, x) for x in bounds), len(held)]
            full = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            data = [b"".join(held[a:b]) for _, a, b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, *_ in full], pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array([0] * len(full), pa.int32()), pa.array([b - a for _, a, b in full], pa.int64()), pa.array(data, pa.binary())], ["range", "run", "block", "n", "records"],
            )
            held.clear()

        for b in batches:
            for value, doc_id, mix, n, weight, none in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(struct.pack(RECORD, SIGN - value, doc_id + SIGN, mix + SIGN, n, weight + SIGN, none))
                if len(held) == run_rows:
                    yield from run()
        if held:
            yield from run()

    rows = scored.where(F.col("score") >= lowest).select("score", doc.alias("doc"), F.xxhash64("row").alias("mix"), "n_features", "weight", F.col("doc_id").isNull().cast("int").alias("none"))
    runs = s.save(rows.mapInArrow(sort, "range int, run long, block int, n long, records binary"), "runs")
    sizes = {r["range"]: (r["n"], r["runs"]) for r in runs.groupBy("range").agg(F.sum("n").alias("n"), F.count_distinct("run").alias("runs")).collect()}
    firsts = dict(zip(sorted(sizes), accumulate((sizes[i][0] for i in sorted(sizes)), initial=0), strict=False))
    runs = runs.where(F.col("range") <= max(i for i, first in firsts.items() if first < draw))
    most, step = max(n for _, n in sizes.values()), 0
    while most > fan:
        most, step = -(-most // (fan // 2)), step + 1
        runs = s.save(merge_pass(runs, most, step), "merged")

    def rank(t: pa.Table) -> pa.Table:
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for number, block, data in zip(t["run"].to_pylist(), t["block"].to_pylist(), t["records"].to_pylist(), strict=True):
            parts.setdefault(number, []).append((block, data))
        first, out = firsts[t["range"][0].as_py()], []
        for place, record in enumerate(tournament([records([d for _, d in sorted(p)]) for p in parts.values()]), first + 1):
            if place > draw:
                break
            value, doc_id, mix, n, weight, none = struct.unpack(RECORD, record)
            out.append((None if none else doc_id - SIGN, n, weight - SIGN, SIGN - value, place, mix - SIGN))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6, ["doc_id", "n_features", "weight", "score", "rank", "mix"])

    return s.save(runs.groupBy("range").applyInArrow(rank, "doc_id long, n_features long, weight long, score long, rank long, mix long"), "drawn")


def resample(docs: DataFrame, target: DataFrame, part: int = PART, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED, run_rows: int = RUN, range_rows: int = RANGE, fan: int = FAN) -> DataFrame:
    """One row per row of `docs`: doc_id, n_features, weight, score and rank, null where it isn't drawn.

    Null and empty texts have no features and weight 0; texts of any length are read whole. A null doc_id has the noise of an empty
    one and comes after all others of its score. Rows with one doc_id and score are alike in the order; a hash of the row decides. Other
    columns are ignored; without documents there are no rows, without a target its counts are 0.
    """
    with Scratch(docs.sparkSession) as s:
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        gain = gains(bucket_counts(text, runs, buckets), bucket_counts(target.select(F.coalesce("text", F.lit("")).alias("text")), runs, buckets))
        scored = s.save(score(text, gain, runs, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
        eligible = F.col("n_words") >= least_words
        draw = part * scored.where(eligible).count() // 100
        columns = ["doc_id", "n_features", "weight", "score", "rank"]
        undrawn = scored.withColumn("rank", F.lit(None).cast("long"))
        if not draw:
            return s.keep(undrawn.select(columns))
        drawn = drawn_rows(scored.where(eligible), s, draw, run_rows, range_rows, fan)
        last = drawn.where(F.col("rank") == draw).first()
        doc, value, at = F.coalesce("doc_id", F.lit(SIGN - 1)), last["score"], F.lit(SIGN - 1 if last["doc_id"] is None else last["doc_id"])
        after = (F.col("score") < value) | (F.col("score") == value) & ((doc > at) | (doc == at) & (F.xxhash64("row") > last["mix"]))
        return s.keep(undrawn.where(~eligible | after).select(columns).unionByName(drawn.select(columns)))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
