"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id are removed.

Every string of LENGTH bytes holds a minimizer: of its GRAM-byte grams the one with the least hash, the first of equals. Equal
strings have equal minimizers, and the SIDE bytes on one side of it in common: on its left if it begins SIDE bytes or more after the
string does, on its right if no more. So:
1. Map tasks send the distinct hashes of their minimizers with either side to owners, who write those that two documents have as sorted
   shards. Common words make many a minimizer common by chance, the more the larger the corpus, but few with a side.
2. Map tasks map these shards and send, for each minimizer with such a side, its context: the bytes of all the strings that have it,
   and that side. Equal contexts go as one, with their smallest doc_id, so copies don't multiply.
3. An owner of hashes deals its contexts on by further bits, lays the distinct ones end to end, block by block, and sorts each
   block's suffixes by induced sorting with disk-backed queues and common-prefix values (induced.py). Where less than LENGTH is
   shared a new string begins, and its smallest doc_id goes to every place of it. Contexts of one minimizer that fill more than
   one block become sorted runs on disk, kept without the prefixes that neighbours share, which are merged.
   The results, one per distinct context, are sorted shards again.
4. Map tasks look their contexts up and mark what goes.
Texts are never joined to results by a shuffle; no task holds a document group or all contexts of a minimizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, table, text_bytes
from tripstrata.llm.op3 import Model
from tripstrata.llm.runs import BLOCK_BYTES, LENGTH, QUEUE_BYTES, smallest_by_context
from tripstrata.llm.shards import Shard, bits_for, by_part, finer, packed, split_by, unpacked

GRAM = 16
#: Bytes beside a minimizer, of which a string that has it holds those on the left or those on the right: half of what it holds beside it.
SIDE = (LENGTH - GRAM) // 2
#: Bytes of text for each owner, and for what it sorts at a time; minimizers and contexts that a map task gathers at a time.
OWNER_BYTES, FINE_BYTES, MINIMIZERS, CONTEXTS = 8 << 20, 8 << 20, 500_000, 60_000
#: Longer texts are looked through in pieces that overlap by LENGTH - 1; shorter ones together, up to so many bytes.
PIECE, TOGETHER = 1 << 23, 1 << 15
NO_ID = (1 << 63) - 1
#: Rows and bytes of a batch that goes to Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def least_grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of the bytes, and for each string of LENGTH bytes the place of its gram with the least."""
    h, step = x.astype(np.uint64) + np.uint64(1), 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) + h[step:]
        step *= 2
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = (h & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    return h, (low & np.uint64(0xFFFFFF)).astype(np.int64)


def with_side(h: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the GRAM + SIDE bytes from each place on."""
    out = np.full(len(at), salt, np.uint64)
    for k in (*range(0, SIDE, GRAM), SIDE):
        out = (out ^ h[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def minimizers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each minimizer, and the first and last start of the strings that have it."""
    return sided(texts)[:4]


def sided(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """minimizers(), then the start from which on the right side is held and up to which the left one is, which of the two sides some of
    its strings hold (left, right), and the hashes with the left and the right side (of no meaning where none holds it).

    Short texts are taken together and a very long one in pieces; strings across two texts are left out.
    """
    pieces = [(d, at, x[at : at + PIECE + LENGTH - 1] if len(x) > PIECE else x) for d, x in enumerate(texts) for at in range(0, max(1, len(x) - LENGTH + 1), PIECE) if len(x) - at >= LENGTH]
    out, a = [], 0
    while a < len(pieces):
        z, size = a, 0
        while z < len(pieces) and (z == a or size + len(pieces[z][2]) <= TOGETHER):
            size, z = size + len(pieces[z][2]), z + 1
        sizes = np.array([len(x) for *_, x in pieces[a:z]])
        begin, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
        h, place = least_grams(np.frombuffer(b"".join([x for *_, x in pieces[a:z]]), np.uint8))
        of = np.repeat(np.arange(z - a), n)
        start = np.arange(len(of)) + np.repeat(begin - (np.cumsum(n) - n), n)
        place = place[start]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
        of, first, last = of[new], start[new], start[np.append(new[1:], len(start)) - 1]
        gram = place[new]
        middle = gram - SIDE
        left, right = first <= middle, last >= middle
        wide = [np.zeros(len(gram), np.uint64) for _ in range(2)]
        for w, some, at, salt in zip(wide, (left, right), (middle, gram), (1, 2), strict=True):
            w[some] = with_side(h, at[some], salt)
        # the least of many hashes is small: mixed once more, or nearly all would have the same leading bits
        own = h[gram] * np.uint64(0xC2B2AE3D27D4EB4F)
        shift = (np.array([at for _, at, _ in pieces[a:z]]) - begin)[of]
        out.append((np.array([d for d, *_ in pieces[a:z]])[of], own ^ (own >> np.uint64(29)), first + shift, last + shift, middle + shift, left, right, *wide))
        a = z
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, bool, bool, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def known(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the owners' shards have."""
    order = np.argsort(hashes)
    out = np.zeros(len(hashes), bool)
    for part, x in split_by(model.about["bits"], hashes[order]):
        name = model.about["common"].get(part)
        if name is not None:
            shard, q = model.array(f"{name}.hash", "<u8"), hashes[order[x]]
            out[order[x]] = shard[np.minimum(np.searchsorted(shard, q), len(shard) - 1)] == q
    return out


def contexts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the minimizers that two documents have with a side: text number, hash, first and last start of the strings that hold it."""
    doc, h, first, last, middle, left, right, *wide = sided(texts)
    for some, hashes in zip((left, right), wide, strict=True):
        some[some] = known(model, hashes[some])
    ok = left | right
    first, last = np.where(left, first, np.maximum(first, middle)), np.where(right, last, np.minimum(last, middle))
    return doc[ok], h[ok], first[ok], last[ok]


def looked_up(model: Model, part: int, h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many results each context has, and where they begin in the part's ids."""
    name = model.about["found"][part]
    q = model.mixed(h, keys[:, 0])
    n, offset, todo, start = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.arange(len(q)), 0
    first, second = model.array(f"{name}.q", "<u8"), model.array(f"{name}.lo", "<u8")
    for end in model.array(f"{name}.ends", "<i8").tolist():
        at = start + np.searchsorted(first[start:end], q[todo])
        # a key that comes twice goes on to its next place
        while (again := (at < end) & (first[np.minimum(at, end - 1)] == q[todo]) & (second[np.minimum(at, end - 1)] != keys[todo, 1])).any():
            at = at + again
        ok = np.flatnonzero((at < end) & (first[np.minimum(at, end - 1)] == q[todo]))
        n[todo[ok]], offset[todo[ok]] = model.array(f"{name}.n", "u1")[at[ok]], model.array(f"{name}.at", "<i8")[at[ok]]
        todo, start = np.delete(todo, ok), end
    return n, offset


class Index(Model):
    """The shards of minimizers and contexts. Contexts are ordered by the bits that deal them, then by their own hash, so that those
    of one minimizer don't lie on one key."""

    def mixed(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << (64 - self.about["bits"] - self.about["more"])) - 1)
        return (h & ~low) | (own & low)


def dedup_spans(docs: DataFrame, owner_bytes: int = OWNER_BYTES, fine_bytes: int = FINE_BYTES, block_bytes: int = BLOCK_BYTES, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end) of removed bytes.

    Texts are UTF-8 bytes, a null one is empty; matches never cross documents; a text is judged by the input, not by what is
    left of other texts. Rows with one doc_id take nothing from each other; a null doc_id comes after all others. Very long texts
    are looked through in pieces. Other columns are ignored; an empty table gives no rows.
    """
    conf = docs.sparkSession.conf
    before = {k: conf.get(k) for k in BATCHES}
    # whole texts go to Python in small batches: two tasks' copies of a batch would be most of what an executor holds
    for k, v in BATCHES.items():
        conf.set(k, v)
    try:
        with Scratch(docs.sparkSession) as s:
            return s.keep(_dedup_spans(docs, s, owner_bytes, fine_bytes, block_bytes, queue_bytes))
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _dedup_spans(docs: DataFrame, s: Scratch, owner_bytes: int, fine_bytes: int, block_bytes: int, queue_bytes: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    root = s.path("shards")
    s.kept.add(root)
    bits, more = bits_for(text_bytes(docs), owner_bytes, fine_bytes)
    model = Index(root, {"bits": bits, "more": more})

    def send_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, doc = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            d, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            twice = (np.maximum.reduceat(d, first) > np.minimum.reduceat(d, first)).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
            h = h[first]
            for part, x in split_by(bits, h):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([packed(h[x], twice[x])], pa.binary())], ["part", "blob"])

        for b in batches:
            for at in range(0, b.num_rows, 200):
                texts = b.column(0).slice(at, 200).to_pylist()
                d, _, _, _, _, left, right, *wide = sided(texts)
                held += [(d[some] + doc, h[some]) for some, h in zip((left, right), wide, strict=True)]
                size, doc = size + int(left.sum() + right.sum()), doc + len(texts)
                if size >= MINIMIZERS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def own_minimizers(part: int, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        n, dealt = finer(bits, more, map(unpacked, blobs), limit=queue_bytes)
        shard = Shard(root, "m", ("hash",))
        for i in range(n):
            if (found := dealt.pop(i, 1 << 62)) is not None:
                h, twice = found
                order = np.argsort(h, kind="stable")
                h, k = h[order], twice[order].astype(np.int64) + 1
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                shard.append(hash=h[first][np.add.reduceat(k, first) > 1])
        name = shard.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name}] * bool(shard.length), NAMED)

    NAMED = pa.schema([("part", pa.int64()), ("name", pa.string())])
    sent = rows.select("text").mapInArrow(send_minimizers, "part long, blob binary")
    model.about["common"] = {x["part"]: x["name"] for x in by_part(sent, bits, own_minimizers, "part long, name string").collect()}

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            items = sorted(held.items(), key=lambda x: x[1][0])
            h = np.array([v[0] for _, v in items], np.uint64)
            for part, x in split_by(bits, h):
                some = items[x]
                key = np.frombuffer(b"".join(k for k, _ in some), np.uint64).reshape(-1, 2)
                blob = packed(h[x], key[:, 0], key[:, 1], np.array([v[1] for _, v in some], np.int64), np.array([len(v[2]) for _, v in some], np.int32), np.frombuffer(b"".join(v[2] for _, v in some), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([blob], pa.binary())], ["part", "blob"])

        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                doc, h, first, last = contexts(model, texts)
                for d, k, a, z in zip(doc.tolist(), h.tolist(), first.tolist(), last.tolist(), strict=True):
                    x, doc_id = texts[d][a : z + LENGTH], NO_ID if ids[d] is None else ids[d]
                    key = xxhash.xxh3_128_digest(x)
                    old = held.get(key)
                    if old is None:
                        held[key] = [k, doc_id, x]
                    elif doc_id < old[1]:
                        old[1] = doc_id
                if len(held) >= CONTEXTS:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    def own_contexts(part: int, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        n, dealt = finer(bits, more, map(unpacked, blobs), sizes=4, limit=queue_bytes)
        shard, ends, n_ids = Shard(root, "c", ("q", "lo", "n", "at", "ids", "ends")), [], 0
        for i in range(n):
            pieces = iter(lambda i=i: dealt.pop(i, CONTEXTS), None)
            for h, hi, lo, start, count, values in smallest_by_context(pieces, block_bytes, queue_bytes):
                q = model.mixed(h, hi)
                order = np.lexsort((lo, q))
                count = count[order]
                at = np.cumsum(count) - count
                ids = values[np.repeat(start[order], count) + np.arange(int(count.sum())) - np.repeat(at, count)]
                shard.append(q=q[order], lo=lo[order], n=count.astype(np.uint8), at=n_ids + at, ids=ids)
                n_ids += len(ids)
                # one range of q after the other: only blocks of one range need a segment each
                if ends and ends[-1][0] < i:
                    ends[-1] = (i, shard.length)
                else:
                    ends.append((i, shard.length))
        # the segments' ends stay with the shard: the driver and the tasks hear its name only
        shard.append(ends=np.array([x[1] for x in ends], np.int64))
        yield pa.RecordBatch.from_pylist([{"part": part, "name": shard.close()}], FOUND)

    FOUND = pa.schema([("part", pa.int64()), ("name", pa.string())])
    found = rows.mapInArrow(send_contexts, "part long, blob binary")
    model.about["found"] = {x["part"]: x["name"] for x in by_part(found, bits, own_contexts, "part long, name string").collect()}

    def marks(doc_ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Removed runs of bytes, in order: text number, start, end."""
        doc, h, first, last = contexts(model, texts)
        mine = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
        order = np.argsort(h, kind="stable")
        found = []
        for part, x in split_by(bits, h[order]):
            some = order[x]
            d, a, z = doc[some], first[some], last[some]
            keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(texts[i][j : k + LENGTH]) for i, j, k in zip(d.tolist(), a.tolist(), z.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
            n, offset = looked_up(model, part, h[some], keys)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(model.array(f"{model.about['found'][part]}.ids", "<i8")[np.repeat(offset, n) + within] < np.repeat(mine[d], n))
            of, within = np.repeat(np.arange(len(n)), n)[hit], within[hit]
            start = a[of] + within
            found.append((d[of], start, np.where(n[of] == 1, z[of], start) + LENGTH))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        d, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, d))
        begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
        base = begin[d[order]]
        start, top = start[order] + base, np.maximum.accumulate(end[order] + base) if len(d) else end
        new = np.flatnonzero(np.append(True, start[1:] > top[:-1])) if len(d) else np.zeros(0, np.int64)
        until = top[np.append(new[1:] - 1, len(top) - 1)] if len(d) else top
        return d[order][new], start[new] - base[new], until - base[new]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                spans: list[list[tuple[int, int]]] = [[] for _ in texts]
                for d, a, z in zip(*(x.tolist() for x in marks(ids, texts)), strict=True):
                    spans[d].append((a, z))
                out = []
                for doc_id, text, gone in zip(ids, texts, spans, strict=True):
                    ends = [0, *(x for m in gone for x in m), len(text)]
                    kept = b"".join(text[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True))
                    out.append((doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in gone]))
                yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, x, strict=True)) for x in out], OUT)

    OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents")).drop("spans")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, p, x[2 * p + 1 : 2 * p + 100] AS s FROM d, unnest(range(0, n - 49)) AS t(p) WHERE n >= 50),
g AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.p FROM w JOIN g USING (s) WHERE g.least < w.doc_id),
prior AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hit),
runs AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM prior),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) || any_value(x)[2 * max(z) + 1 :] AS kept FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
