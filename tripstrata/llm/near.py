"""Near copies by the similarity of their sets of word shingles: SimHash and MinHash bands find candidates, exact sets decide.

The first candidates are op1's: fingerprints at 2 or fewer differing bits, by its covering masks and midpoints. A pair of similarity
0.8 usually lies farther apart than that (4 to 14 bits), so MinHash bands find the rest.
Documents with one set of shingles are one node. A node has BANDS keys, each over ROWS minima of its shingles under different
hash functions; a pair of similarity s shares none of them with probability (1 - s ** ROWS) ** BANDS, 7e-5 at 0.8. Candidates
are all pairs of a bucket of at most SMALL nodes. A larger bucket, which shared boilerplate fills as well as copies do, is split by
further minima: by those of each of the SPLITS next bands. A pair of similarity 0.8 that meets in large buckets only is lost by
the splits with probability 0.004. What is still large then has two bands, ten minima, in common: there each node first meets PIVOTS others,
the least under as many orders that are the same in all buckets, which links copies of one text at a cost that is linear in a bucket's size.
Large buckets whose nodes aren't one component by then are searched exactly: a join over the rarest shingles of each set (`rest_pairs`) finds
every pair of two components that is similar enough. Only pairs whose exact similarity is at least `least` are linked, and linked
documents are one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch
from tripstrata.llm.op1 import components, covering_masks, fingerprint, links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
SMALL, SPLITS, PIVOTS = 12, 6, 4
#: Counters of shingles, by their last bits; they order a set's shingles by rarity and go to every task.
COUNTERS = 1 << 18
#: Pairs of one node that meet one copy of its shingles.
SPREAD = 64
FACTORS, TERMS = (np.random.default_rng(7).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32))
FACTORS |= np.uint32(1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; words as op1 has them, and a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in runs], np.uint64).view(np.int64))


def band_keys(found: np.ndarray) -> list[int]:
    """One key a band; none without shingles."""
    if not len(found):
        return []
    low = (found.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (low[at : at + 4096] * FACTORS + TERMS).min(1), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[i : i + 4 * ROWS]) - (1 << 63) for i in range(0, len(raw), 4 * ROWS)]


def simhash_pairs(nodes: DataFrame, s: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of the nodes (id, fp) that connect all whose fingerprints differ in 2 bits or fewer: op1's links between
    fingerprints, each held by its smallest id, and one from that to every other id of the fingerprint."""
    held = s.save(nodes.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    equal = nodes.select(F.col("id").alias("b"), "fp").join(held.withColumnRenamed("id", "a"), "fp").where("a < b").select("a", "b")
    return s.save(equal.unionByName(links(held, covering_masks()).select("a", "b")), "simhash")


def pairs_of(keyed: DataFrame, held: DataFrame, small: int) -> DataFrame:
    """Pairs (id, p) of the rows (id, key) of `keyed` in buckets of 2 to `small`, by the sizes n of `held` (key, n)."""
    few = keyed.join(held.where((F.col("n") > 1) & (F.col("n") <= small)).select("key"), "key").groupBy("key").agg(F.collect_list("id").alias("ids"))
    return few.select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("p"))


def candidates(nodes: DataFrame, s: Scratch, small: int = SMALL, splits: int = SPLITS) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of the nodes (id, keys) that share a bucket, and the members (id, key) of buckets that stay large."""
    keyed = nodes.select("id", F.posexplode("keys").alias("t", "key")).select("id", "t", F.xxhash64("t", "key").alias("key"))
    held = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    pairs = pairs_of(keyed.select("id", "key"), held, small)
    large = keyed.join(held.where(F.col("n") > small).select("key"), "key").groupBy("id").agg(F.collect_set("t").alias("ts"))
    next_key = lambda t: F.transform(F.sequence(F.lit(1), F.lit(splits)), lambda o: F.xxhash64(t, o, F.get("keys", t), F.get("keys", (t + o) % BANDS)))
    split = s.save(nodes.join(large, "id").select("id", F.explode(F.flatten(F.transform("ts", next_key))).alias("key")), "split")
    pivots = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id"))["id"] for i in range(PIVOTS)]
    again = split.groupBy("key").agg(F.count("*").alias("n"), F.array(*pivots).alias("pivots")).where("n > 1")
    pairs = pairs.unionByName(pairs_of(split, again.select("key", "n"), small))
    rest = s.save(split.join(again.where(F.col("n") > small).select("key", "pivots"), "key"), "rest")
    # the same few pivots come up in most buckets of a group of copies: each node has a set of them
    met = rest.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"))
    pairs = pairs.unionByName(met.select("id", F.explode("pivots").alias("p")))
    return pairs.where("id <> p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct(), rest.select("id", "key")


def prefix_lengths(n: int, least: float) -> tuple[int, int]:
    """How many of a set's n shingles, in an order that all sets share, hold the first common one with any set that is as similar as
    `least`: one no longer than it, and one no shorter."""
    return n - math.ceil(least * n - 1e-9) + 1, n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1


def rest_pairs(held: DataFrame, s: Scratch, least: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the nodes (id, component, set): all that are as similar as `least` and of two components, and some others.

    A set's shingles are ordered by the count of their counter, rare ones first. Similar sets share one within short prefixes of
    that order, at places that leave enough shingles behind both. Rows of a shingle's largest component don't meet each other, so
    copies that are linked already cost nothing more.
    """
    counted = held.select(F.explode("set").alias("token")).groupBy(F.col("token").bitwiseAND(COUNTERS - 1).alias("at")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted["at"].to_numpy()] = counted["n"].to_numpy()
    shared = held.sparkSession.sparkContext.broadcast(counts)

    def prefixes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, groups = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, (one, group) in enumerate(zip(ids, groups, strict=True)):
                x = b.column(2)[i].values.to_numpy()
                if not len(x):
                    continue
                probe, index = prefix_lengths(len(x), least)
                first = x[np.lexsort((x, shared.value[x & (COUNTERS - 1)]))][:probe]
                at = np.arange(len(first), dtype=np.int32)
                columns = [np.full(len(first), one), np.full(len(first), group), np.full(len(first), len(x), np.int32), first, at, at < index]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "component", "n", "token", "at", "short"])

    rows = s.save(held.select("id", "component", "set").mapInArrow(prefixes_of, "id long, component long, n int, token long, at int, short boolean"), "prefixes")
    by_group = rows.groupBy("token", "component").agg(F.count("*").alias("m"), F.max("short").alias("short"))
    mixed = by_group.groupBy("token").agg(F.max_by("component", "m").alias("main"), F.count("*").alias("groups"), F.max("short").alias("short")).where("groups > 1 AND short").select("token", "main")
    live = s.save(rows.join(mixed, "token"), "live")
    other = live.select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "component", "n", "at", "short")])
    c = F.col
    lengths = F.least("n", "n_") >= least * F.greatest("n", "n_") - 1e-6
    prefix = F.when(c("n") < c("n_"), c("short")).when(c("n") > c("n_"), c("short_")).otherwise(c("short") & c("short_"))
    left = F.least(c("n") - c("at"), c("n_") - c("at_")) >= least / (1 + least) * (c("n") + c("n_")) - 1e-6
    met = live.where("component <> main").join(other, "token").where((c("component") != c("component_")) & lengths & prefix & left)
    return met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, set) are as similar as `least`. The sets of a node with many pairs are copied, so that its pairs are spread."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    left = sets.withColumnRenamed("id", "a").withColumnRenamed("set", "x").join(parts, "a").select("a", "x", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    right = sets.withColumnRenamed("id", "b").withColumnRenamed("set", "y").join(parts, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("more"))
    dealt = dealt.join(parts, "b").withColumn("more", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    both = dealt.join(left.drop("parts"), ["a", "part"]).join(right, ["b", "more"])
    # n / (|x| + |y| - n) >= least, by the number n of common shingles
    n = F.size(F.array_intersect("x", "y"))
    alike = (F.least(F.size("x"), F.size("y")) >= least * F.greatest(F.size("x"), F.size("y"))) & (n >= least * (F.size("x") + F.size("y") - n))
    return both.where(alike).select("a", "b")


def near_copies(docs: DataFrame, row: str, least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """One row per row of `docs` that isn't the first of its component: row.

    The first has the smallest doc_id (null last), then the smallest number. Texts without words (null and empty ones too) are alike;
    a very long text is taken whole, its shingles as 64-bit hashes. Ties and repeated rows are told apart by the number; other
    columns are ignored, and an empty table gives no rows.
    """
    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, fps = [], [], []
            for x in b.column(2).to_pylist():
                found = shingles(x, size)
                fps.append(fingerprint(x))
                ids.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))], ["row", "doc_id", "id", "keys", "fp"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x, size) for x in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "set"])

    with Scratch(docs.sparkSession) as s:
        text = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        prints = s.save(text.mapInArrow(prints_of, "row long, doc_id long, id long, keys array<long>, fp long"), "prints")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        nodes = s.save(prints.groupBy("id").agg(best.alias("best"), F.min("keys").alias("keys"), F.min("fp").alias("fp")), "nodes")
        pairs, rest = candidates(nodes, s)
        pairs = s.save(pairs.union(simhash_pairs(nodes, s)).distinct(), "pairs")
        some = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        rows = nodes.join(some, "id").select("id", F.col("best.row").alias("row"))
        sets = s.save(text.join(rows, "row").select("id", "text").mapInArrow(sets_of, "id long, set array<long>"), "sets")
        edges = s.save(linked(pairs, sets, least), "links")
        found = components(edges, s)
        # members of large buckets have sets, as each has met a pivot
        member = rest.join(found, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
        mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        held = s.save(member.join(mixed, "key").select("id", "component").distinct(), "held")
        if not held.isEmpty():
            more = s.save(rest_pairs(held.join(sets, "id"), s, least), "more")
            found = components(edges.unionByName(linked(more, sets, least)), s)
        labelled = nodes.select("id", "best").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        first = labelled.groupBy("component").agg(F.min("best").alias("of"))
        of = labelled.join(first, "component").select("id", F.col("of.row").alias("first"))
        return s.keep(prints.join(of, "id").where(F.col("row") != F.col("first")).select("row"))
