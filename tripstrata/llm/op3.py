"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map.

1. Map tasks hash words, count bigrams a few million tokens at a time and send them, compressed, to the owner of their hash.
2. Each owner sums its bigrams, range after range of their hash, writes a shard (a sorted array of the hashes seen once, one of the
   others with their counts) and sends what words and contexts got: counts, continuations, and how many followers were
   seen once, twice and more. Bigrams are dealt by the hash of both words, so a very common context is spread over all owners.
3. Owners of words sum that into shards of words: hash, count, continuations, and the weight of the lower order.
4. Scoring tasks memory-map the shards (from the shared folder; a store that can't be mapped is copied to the task's
   own temporary file) and look up sorted hashes.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, local_path, table, text_bytes
from tripstrata.llm.shards import Shard, bits_for, by_part, finer, packed, split_by, unpacked

#: Tokens that a map task counts at a time; text bytes for each owner of bigrams, and for what it sums at a time; documents
#: scored at a time.
CHUNK, OWNER_BYTES, FINE_BYTES, BLOCK = 3_000_000, 24 << 20, 24 << 20, 500
#: Distinct words whose hashes a worker remembers at a time.
REMEMBERED = 500_000
START, END = np.uint64(1), np.uint64(2)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = max(3, xxhash.xxh64_intdigest(word))
        return h


def tokens(texts: list[str], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by END, and how many tokens each text has."""
    words = [x.encode().lower().split() for x in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    out = np.full(sizes.sum(), END, np.uint64)
    at = 0
    for w in words:
        out[at : at + len(w)] = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        at += len(w) + 1
    return out, sizes


def pairs(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; START before a text's first."""
    u = np.concatenate([[START], w[:-1]]).astype(np.uint64)
    u[np.cumsum(sizes)[:-1]] = START
    return u


def mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = u * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
    k ^= k >> np.uint64(31)
    k *= np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(29))


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values), order[first]]


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; 1/2 where they don't tell."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    got = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), 0.95 * (i + 1)) for i, d in enumerate(got)]


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(c > 0, c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def in_training(mod: int = 7) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod != 2


def fetched(uri: str) -> IO[bytes]:
    """A temporary copy of a file in a store that can't be mapped."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri)
    out = tempfile.TemporaryFile()
    with system.open_input_stream(at) as data:
        while block := data.read(1 << 24):
            out.write(block)
    out.flush()
    return out


class Model:
    """The mapped shards and the constants of a trained model."""

    def __init__(self, root: str, about: dict):
        self.root, self.about, self.maps = root, about, {}

    def __getstate__(self) -> dict:
        return {"root": self.root, "about": self.about, "maps": {}}

    def array(self, name: str, kind: str) -> np.ndarray:
        if name not in self.maps:
            uri = f"{self.root}/{name}"
            path = local_path(uri)
            with open(path, "rb") if path else fetched(uri) as f:
                # without a descriptor of its own: a model may have more shards than a process may have open files
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False) if f.seek(0, 2) else b""
            self.maps[name] = np.frombuffer(held, kind)
        return self.maps[name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, continuations and lower-order weight of distinct sorted hashes; zeros and weight 1 for unknown ones."""
        c, cont, gamma = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes))
        for part, x in split_by(self.about["word_bits"], hashes):
            name = self.about["words"].get(part)
            if name is not None:
                known = self.array(f"{name}.hash", "<u8")
                at = np.minimum(np.searchsorted(known, hashes[x]), len(known) - 1)
                ok = np.flatnonzero(known[at] == hashes[x])
                to = np.arange(x.start, x.stop)[ok]
                c[to], cont[to], gamma[to] = self.array(f"{name}.c", "<i8")[at[ok]], self.array(f"{name}.cont", "<i8")[at[ok]], self.array(f"{name}.gamma", "<f4")[at[ok]]
        return c, cont, gamma

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys."""
        out = np.zeros(len(keys), np.int64)
        for part, x in split_by(self.about["bits"], keys):
            name = self.about["bigrams"].get(part)
            if name is not None:
                q = keys[x]
                for kind in ("one", "many"):
                    known = self.array(f"{name}.{kind}", "<u8")
                    if len(known):
                        at = np.minimum(np.searchsorted(known, q), len(known) - 1)
                        ok = np.flatnonzero(known[at] == q)
                        out[np.arange(x.start, x.stop)[ok]] = 1 if kind == "one" else self.array(f"{name}.counts", "<i8")[at[ok]]
        return out

    def score(self, texts: list[str], known: Hashes) -> list[np.ndarray]:
        """Per text: tokens, tokens known from training, base score, score (log10)."""
        a = self.about
        w, sizes = tokens(texts, known)
        u = pairs(w, sizes)
        distinct, where = np.unique(np.concatenate([[START], w]), return_inverse=True)
        c, cont, gamma = self.words(distinct)
        at = where[1:]
        before = np.concatenate([[where[0]], at[:-1]])
        before[np.cumsum(sizes)[:-1]] = where[0]
        keys = mix(u, w)
        order = np.argsort(keys)
        n = np.empty(len(keys), np.int64)
        n[order] = self.bigrams(keys[order])
        lower = (discounted(cont, a["low"]) + a["rest"] / (a["V"] + 1)) / max(a["types"], 1) if a["types"] else np.full(len(c), 1 / (a["V"] + 1))
        p = discounted(n, a["high"]) / np.maximum(c[before], 1) + gamma[before] * lower[at]
        count = np.where(distinct == START, 0, c)[at]
        base = np.log10((count + 1) / (a["N"] + a["V"] + 1))
        first = np.cumsum(sizes) - sizes
        return [sizes, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]


def train(docs: DataFrame, s: Scratch, owner_bytes: int = OWNER_BYTES, fine_bytes: int = FINE_BYTES, chunk: int = CHUNK) -> Model:
    """Counts the texts of `docs` into a model in the shared folder; it goes when the scratch does."""
    root = s.path("model")
    s.kept.add(root)
    n_bytes = text_bytes(docs)
    bits, more = bits_for(n_bytes, owner_bytes, fine_bytes)
    word_bits, word_more = bits_for(n_bytes, 2 * owner_bytes, 2 * fine_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Hashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, w = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            key, n, at = summed(mix(u, w), np.ones(len(w), np.int64))
            u, w = u[at], w[at]
            for part, x in split_by(bits, key):
                order = np.argsort(u[x], kind="stable")
                blob = packed(u[x][order], w[x][order], n[x][order].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([blob], pa.binary())], ["part", "blob"])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                w, sizes = tokens(b.column(0).slice(at, BLOCK).to_pylist(), known)
                held.append((pairs(w, sizes), w))
                size += len(w)
                if size >= chunk:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def own_bigrams(part: int, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        def keyed() -> Iterator[list[np.ndarray]]:
            for u, w, n in map(unpacked, blobs):
                key = mix(u, w)
                order = np.argsort(key)
                yield [key[order], u[order], w[order], n[order]]

        parts, dealt = finer(bits, more, keyed())
        shard, seen = Shard(root, "b", ("one", "many", "counts")), np.zeros(4, np.int64)
        for i in range(parts):
            if (found := dealt.pop(i, 1 << 62)) is None:
                continue
            key, u, w, n = found
            key, n, at = summed(key, n.astype(np.int64))
            u, w = u[at], w[at]
            shard.append(one=key[n == 1], many=key[n > 1], counts=n[n > 1])
            seen += [int((n == k).sum()) for k in (1, 2, 3, 4)]
            before = summed(u, n, *((n == k).astype(np.int64) for k in (1, 2)), (n > 2).astype(np.int64))[:-1]
            after = summed(w, n, np.ones(len(w), np.int64))[:-1]
            # hash, followers in all, followers seen once, twice and more, count, continuations
            for h, sums in ((before[0], [*before[1:], None, None]), (after[0], [None] * 4 + after[1:])):
                columns = [np.zeros(len(h), np.int64) if c is None else c for c in sums]
                for p, x in split_by(word_bits, h):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([packed(h[x], *(c[x] for c in columns))], pa.binary())], ["part", "blob"])
        about = json.dumps({"part": part, "name": shard.close(), "n": seen.tolist()}).encode()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([about], pa.binary())], ["part", "blob"])

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "part long, blob binary")
    sums = s.save(by_part(counted, bits, own_bigrams, "part long, blob binary"), "sums")
    about = [json.loads(x["blob"]) for x in sums.where("part < 0").collect()]
    high = discounts([sum(x["n"][k] for x in about) for k in range(4)])

    def own_words(part: int, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        parts, dealt = finer(word_bits, word_more, map(unpacked, blobs))
        shard, stats = Shard(root, "w", ("hash", "c", "cont", "gamma")), {"V": 0, "N": 0, "types": 0, "n": [0] * 4, "more": 0}
        for i in range(parts):
            if (found := dealt.pop(i, 1 << 62)) is None:
                continue
            h, total, n1, n2, n3, c, cont, _ = summed(*found)
            # a word is followed by something as often as it occurs, START as often as there are texts; END never is
            gamma = np.where(total > 0, (high[0] * n1 + high[1] * n2 + high[2] * n3) / np.maximum(total, 1), 1.0)
            shard.append(hash=h, c=np.where(c > 0, c, total), cont=cont, gamma=gamma.astype(np.float32))
            stats["V"] += int((c > 0).sum())
            stats["N"] += int(c.sum())
            stats["types"] += int(cont.sum())
            stats["n"] = [x + int((cont == k).sum()) for x, k in zip(stats["n"], (1, 2, 3, 4), strict=True)]
            stats["more"] += int((cont > 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"part": part, "name": shard.close()} | stats)])], ["about"])

    found = [json.loads(x["about"]) for x in by_part(sums.where("part >= 0"), word_bits, own_words, "about string").collect()]
    s.drop(sums)
    add = lambda k: sum(x[k] for x in found)
    n = [sum(x["n"][k] for x in found) for k in range(4)]
    low = discounts(n)
    return Model(root, {
        "bits": bits, "word_bits": word_bits, "bigrams": {x["part"]: x["name"] for x in about}, "words": {x["part"]: x["name"] for x in found}, "high": high, "low": low,
        "V": add("V"), "N": add("N"), "types": add("types"), "rest": low[0] * n[0] + low[1] * n[1] + low[2] * add("more"),
    })


def score_texts(docs: DataFrame, owner_bytes: int = OWNER_BYTES, fine_bytes: int = FINE_BYTES, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out (a null doc_id never is). A null or empty text is one token, the end. Repeated
    rows count each in training and get equal scores; a very long text is scored whole. Without training rows the model is uniform over one unknown word.
    Other columns are ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as s:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        model = train(docs.where(in_training()), s, owner_bytes, fine_bytes, chunk)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Hashes()
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    x = b.slice(at, BLOCK)
                    got = model.score(x.column(2).to_pylist(), known)
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(got[0]), pa.array(got[1]), pa.array(np.full(x.num_rows, model.about["N"])), pa.array(got[2]), pa.array(got[3])], NAMES)

        NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        rows = docs.select("doc_id", (~in_training()).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
        return s.keep(rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
