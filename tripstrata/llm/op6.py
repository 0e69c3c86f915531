"""Exact dedup: an extendible-hash index in shared files, owner tasks by key range, chains compared byte by byte.

1. Every text is normalised (white space deleted) and hashed to a 64-bit key; map tasks count keys, so that a group of copies
   reaches its owner as one key a task.
2. The owner of a range of keys inserts them into an extendible-hash index: a directory addressed by the leading bits,
   doubled when an overfull bucket is as deep as the directory. Directory and buckets are files in the shared folder, mapped by
   whoever looks a key up: by the directory to the bucket, then within it.
3. Rows whose key has company are compared by their bytes: first with the texts of their own chunk (a stretch of a map task's
   rows), then one text per chunk and key by the owner, which sees its keys in order and chains the unlike texts of one key.
4. Size and best row are summed per chunk and text first; rows get their group by key, chunk and number, never by key alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, row_number, table
from tripstrata.llm.op3 import Model, summed
from tripstrata.llm.shards import Shard, bits_for, by_part, finer, packed, split_by, unpacked

#: Deleted before texts are compared: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
#: Keys of a bucket, of an owner, and of a map task's count at a time; bytes of texts in a chunk.
BUCKET, RANGE_KEYS, COUNTED, CHUNK_BYTES = 4096, 1 << 20, 1 << 20, 32 << 20
FLIP = 1 << 63


def hash_key(text: bytes, bits: int = 64) -> int:
    """The index key of a normalised text. Fewer bits make collisions; tests use that."""
    return xxhash.xxh64_intdigest(text) >> (64 - bits) << (64 - bits)


def split_buckets(keys: np.ndarray, capacity: int) -> list[tuple[int, int, np.ndarray]]:
    """Extendible hashing of unsigned keys: (prefix, depth, positions of the keys) of each bucket.

    Keys come in blocks, as insertions do. An overfull bucket splits on its next bit; when it is as deep as the
    directory, the directory doubles first. 64 equal bits can't split: such a bucket keeps a chain of pages.
    """
    depth, directory = 0, [0]
    buckets: dict[int, tuple[int, list[np.ndarray]]] = {0: (0, [])}
    fresh = 1
    for at in range(0, max(len(keys), 1), 1 << 16):
        rows = np.arange(at, min(at + (1 << 16), len(keys)))
        slot = (keys[rows] >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(rows), np.int64)
        owner = np.asarray(directory)[slot]
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        todo = [(int(owner[x[0]]), rows[x]) for x in np.split(order, cuts) if len(x)]
        for b, more in todo:
            buckets[b][1].append(more)
            work = [b]
            while work:
                b = work.pop()
                local, held = buckets[b]
                held = [np.concatenate(held)] if held else [np.zeros(0, np.int64)]
                buckets[b] = (local, held)
                if len(held[0]) <= capacity or local == 64 or len(np.unique(keys[held[0]])) == 1:
                    continue
                if local == depth:
                    directory = [x for x in directory for _ in (0, 1)]
                    depth += 1
                one = ((keys[held[0]] >> np.uint64(63 - local)) & np.uint64(1)).astype(bool)
                buckets[b], buckets[fresh] = (local + 1, [held[0][~one]]), (local + 1, [held[0][one]])
                span = [i for i, x in enumerate(directory) if x == b]
                for i in span[len(span) // 2 :]:
                    directory[i] = fresh
                work += [b, fresh]
                fresh += 1
    first = {b: i for i, b in reversed(list(enumerate(directory)))}
    return [(first[b] << (64 - depth) if depth else 0, local, held[0] if held else np.zeros(0, np.int64)) for b, (local, held) in buckets.items()]


def directory(keys: np.ndarray, used: int, capacity: int) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Depth, directory (bucket number by the leading bits after `used` ones) and buckets (positions of their keys)."""
    found = sorted(split_buckets(keys << np.uint64(used) if used else keys, capacity), key=lambda b: b[0])
    deep = max(d for _, d, _ in found)
    return deep, np.repeat(np.arange(len(found)), [1 << (deep - d) for _, d, _ in found]), [x for *_, x in found]


class Index(Model):
    """Directories and buckets of all owners: `tables` has, by part, the files' name and for each finer range where its directory
    begins, its depth, and its first bucket."""

    def has_company(self, keys: np.ndarray) -> np.ndarray:
        """Which keys (of rows) more than one row has."""
        bits, more = self.about["bits"], self.about["more"]
        order = np.argsort(keys)
        out = np.zeros(len(keys), bool)
        for part, x in split_by(bits, keys[order]):
            name, ranges = self.about["tables"][part]
            at, q = order[x], keys[order[x]]
            starts, depths, firsts = (np.array(c, np.int64) for c in zip(*ranges, strict=True))
            fine = ((q >> np.uint64(64 - bits - more)) & np.uint64((1 << more) - 1)).astype(np.int64) if more else np.zeros(len(q), np.int64)
            rest = q << np.uint64(bits + more)
            depth = depths[fine].astype(np.uint64)
            slot = np.where(depth > 0, rest >> (np.uint64(64) - np.maximum(depth, np.uint64(1))), np.uint64(0)).astype(np.int64)
            bucket = firsts[fine] + self.array(f"{name}.directory", "<i8")[starts[fine] + slot]
            ends, known = self.array(f"{name}.ends", "<i8"), self.array(f"{name}.keys", "<u8")
            low, stop = np.where(bucket > 0, ends[np.maximum(bucket - 1, 0)], 0), ends[bucket]
            high = stop
            while (open_ := low < high).any():
                mid = (low + high) // 2
                less = open_ & (known[np.minimum(mid, len(known) - 1)] < q)
                low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
            ok = (low < stop) & (known[np.minimum(low, len(known) - 1)] == q)
            if not ok.all():
                raise LookupError(f"{int((~ok).sum())} keys aren't in their bucket")
            out[at] = self.array(f"{name}.many", "u1")[low] > 0
        return out


def build_index(text: DataFrame, s: Scratch, bits: int, capacity: int) -> Index:
    """The index over the keys of `text` (text)."""
    root = s.path("index")
    s.kept.add(root)
    n_bits, more = bits_for(text.count(), RANGE_KEYS, RANGE_KEYS)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            for part, x in split_by(n_bits, key):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([packed(key[x], n[x].astype(np.int64))], pa.binary())], ["part", "blob"])

        for b in batches:
            held.append(np.array([hash_key(x.encode().translate(None, SPACE), bits) for x in b.column(0).to_pylist()], np.uint64))
            size += b.num_rows
            if size >= COUNTED:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def own(part: int, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        n, dealt = finer(n_bits, more, map(unpacked, blobs))
        shard, ranges, n_buckets, n_keys = Shard(root, "x", ("directory", "ends", "keys", "many")), [], 0, 0
        for i in range(n):
            key, k, _ = summed(*(dealt.pop(i, 1 << 62) or [np.zeros(0, np.uint64), np.zeros(0, np.int64)]))
            deep, slots, buckets = directory(key, n_bits + more, capacity)
            ranges.append({"start": shard.length, "depth": deep, "first": n_buckets})
            held = [np.sort(x) for x in buckets]
            at = np.concatenate(held)
            shard.append(directory=slots, ends=n_keys + np.cumsum([len(x) for x in held]), keys=key[at], many=(k[at] > 1).astype(np.uint8))
            n_buckets, n_keys = n_buckets + len(buckets), n_keys + len(key)
        yield pa.RecordBatch.from_pylist([{"part": part, "name": shard.close(), "ranges": ranges}], TABLE)

    TABLE = pa.schema([("part", pa.int64()), ("name", pa.string()), ("ranges", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "depth", "first")])))])
    dealt = text.select("text").mapInArrow(keys_of, "part long, blob binary")
    rows = by_part(dealt, n_bits, own, "part long, name string, ranges array<struct<start:long,depth:long,first:long>>").collect()
    return Index(root, {"bits": n_bits, "more": more, "tables": {r["part"]: (r["name"], [(x["start"], x["depth"], x["first"]) for x in r["ranges"]]) for r in rows}})


def exact_dedup(docs: DataFrame, bits: int = 64, capacity: int = BUCKET, chunk_bytes: int = CHUNK_BYTES, row: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_code_points, row (its place in the input, or
    its number in the column of that name).

    A null text counts as empty; empty texts equal each other. Of equal texts the longest original stays, then the
    smallest doc_id (null last), then one of the repeated rows: just one row of a group has kept = true. Very long texts are
    compared whole. Other columns of `docs` are ignored; an empty table gives no rows. No group is gathered anywhere.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_number(row).alias("row"))

    with Scratch(spark) as s:
        index = build_index(text, s, bits, capacity)

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, chunk, held, chains = TaskContext.get().partitionId(), 0, 0, {}
            for b in batches:
                norms, out = [x.encode().translate(None, SPACE) for x in b.column(1).to_pylist()], []
                keys = np.array([hash_key(x, bits) for x in norms], np.uint64)
                for doc_id, x, at, norm, key, many in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), norms, keys.tolist(), index.has_company(keys).tolist(), strict=True):
                    number, new = -1, None
                    if many:
                        chain = chains.setdefault(key, [])
                        number = next((i for i, y in enumerate(chain) if y == norm), len(chain))
                        if number == len(chain):
                            chain.append(norm)
                            new, held = norm, held + len(norm)
                    out.append((at, doc_id, key - FLIP, len(x), hashlib.sha256(norm).digest(), (task << 32) + chunk, number, new))
                    if held > chunk_bytes:
                        chunk, held, chains = chunk + 1, 0, {}
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

        NAMES = ["row", "doc_id", "key", "n_cp", "sha", "chunk", "number", "new"]
        KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        rows = s.save(text.mapInArrow(rows_of, "row long, doc_id long, key long, n_cp long, sha binary, chunk long, number long, new binary"), "rows")

        def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, chain = None, []
            for b in batches:
                got = []
                for key, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if key != now:
                        now, chain = key, []
                    k = next((i for i, y in enumerate(chain) if y == x), len(chain))
                    if k == len(chain):
                        chain.append(x)
                    got.append(k)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(got, pa.int64())], ["key", "chunk", "number", "chain"])

        # owners see their keys in order, one text of each chunk and key; a chain has the unlike texts of one key
        fresh = rows.where("new IS NOT NULL").select("key", "chunk", "number", "new").repartition("key").sortWithinPartitions("key", "chunk", "number")
        chains = fresh.mapInArrow(chained, "key long, chunk long, number long, chain long")
        best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        some = rows.where("number >= 0").drop("new")
        parts = s.save(some.groupBy("key", "chunk", "number").agg(F.count("*").alias("n"), best.alias("best")).join(chains, ["key", "chunk", "number"]), "parts")
        groups = parts.groupBy("key", "chain").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
        of = parts.select("key", "chunk", "number", "chain").join(groups, ["key", "chain"]).drop("chain")
        joined = some.join(of, ["key", "chunk", "number"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha", "n_cp", "row")
        alone = rows.where("number < 0").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "n_cp", "row")
        done = alone.unionByName(joined).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), F.col("n_cp").alias("n_code_points"), "row")
        return s.keep(done)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_code_points", "row")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
