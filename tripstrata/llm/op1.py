"""SimHash near-dedup with covering locality-sensitive hashing.

Each bit of the fingerprint gets a non-zero vector of `radius` + 1 bits; for each non-zero v there is a mask with the bits whose
vector isn't orthogonal to v. The vectors of at most `radius` differing bits span at most `radius` dimensions, so some v is
orthogonal to all of them: its mask has none of the differing bits, and the fingerprints agree under it. The 2 ** (radius + 1) - 1 tables therefore miss no pair.

Within a bucket no pairs are emitted. Fingerprints that share a bucket flip one bit outside its mask (or none); two of them
at distance 2 meet at a common midpoint, at distance 1 at each other. At most 65 distinct fingerprints meet at one
midpoint, any two of them within distance 2: each gets one link to the smallest. So work is linear in a bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, table

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits that over half the shingle hashes have; A-Z lower-cased; words are separated by [\\x20\\x09-\\x0D]."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def covering_masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """Signed 64-bit masks. The vectors are dealt evenly, so that every mask keeps a little over half of the bits."""
    k = radius + 1
    vectors = np.random.default_rng(seed).permutation(1 + np.arange(BITS) % ((1 << k) - 1))
    masks = []
    for v in range(1, 1 << k):
        mask = sum(1 << i for i in range(BITS) if (int(vectors[i]) & v).bit_count() & 1)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def links(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (id, fp) at distance 2 or less, enough to connect all such."""
    tables = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(m).alias("key")) for i, m in enumerate(masks)])
    keyed = prints.select("id", "fp", F.explode(tables).alias("x")).select("id", "fp", "x.t", "x.key")
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    # the bits outside the masks of all the tables in which a fingerprint has company
    outside = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("t").cast("int") + 1)
    near = keyed.join(full, ["t", "key"]).groupBy("id", "fp").agg(F.bit_or(outside).alias("bits"))
    one = F.lit(1).cast("long")
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", one, i)))
    points = F.array_append(F.transform(F.filter(flips, lambda x: x != 0), lambda x: F.col("fp").bitwiseXOR(x)), F.col("fp"))
    met = near.select("id", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    return met.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a < b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable over `edges` (a, b), for the ids in it.

    Large-star and small-star rounds in turn, each written to the shared folder; done when a round changes nothing.
    Every round sums over neighbours with partial sums and joins the small side back, so a hub is never gathered.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(down, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = scratch.save(small, "small")
        seen = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(now, large)
        now = small
        if (seen["n"], seen["h"]) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = (seen["n"], seen["h"])


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id, row, first.

    Fingerprints at RADIUS or fewer differing bits are linked (midpoints are made for a radius of 2); component_id is the smallest doc_id reachable. A null or
    empty text, or one without words, has fingerprint zero and is linked like any other. `first` is true for just one row of a
    component, one with the smallest doc_id; a null doc_id comes last, and is the component_id only of rows without any other.
    Texts are read whole, however long; ties and repeated rows are told apart by `row`. Other columns are ignored; an empty table gives no rows.
    """
    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["row", "doc_id", "fp"])

    with Scratch(docs.sparkSession) as s:
        text = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        prints = s.save(text.mapInArrow(prints_of, "row long, doc_id long, fp long"), "prints")
        # the fingerprint itself is the node; bitwise order does for that
        nodes = s.save(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")), "nodes")
        edges = links(nodes.select(F.col("fp").alias("id"), "fp"), covering_masks())
        found = components(edges, s)
        labelled = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        best = labelled.groupBy("component").agg(F.min("best").alias("of"))
        named = labelled.select("fp", "component").join(best, "component").select("fp", "of")
        done = prints.join(named, "fp").select(
            "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("of.doc_id").alias("component_id"), "row", (F.col("row") == F.col("of.row")).alias("first")
        )
        return s.keep(done)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
