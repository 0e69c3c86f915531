"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal and elastic net.

Document frequencies cover all training documents. The classifier is fitted on a bounded sample of labelled rows (SAMPLE, the
rows with the smallest hashes of their doc_id); a fifth of it is kept back to calibrate the temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstrata.llm.common import smallest_hashes, table

BITS = 16
GRAMS = 3
#: At most so many labelled rows are fitted on.
SAMPLE = 3000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.001, 3
#: TF-IDF weights of a text sum to this.
SCALE = 20.0
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed character n-grams of 1 to GRAMS characters of the lower-cased text, ascending, and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found, h = [], np.zeros(len(points) + 1, np.uint32)
    for n in range(min(GRAMS, len(points))):
        h = (h[: len(points) - n] + np.uint32(n + 1)) * np.uint32(0x01000193) + points[n:]
        found.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return at.astype(np.int32), n.astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal for softmax regression; L1 keeps the weights sparse."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = more


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by a refined grid."""
    if not len(y):
        return 1.0
    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(4):
        grid = np.linspace(lo, hi, 21)
        loss = [-np.log(softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        k = int(np.argmin(loss))
        lo, hi = grid[max(0, k - 1)], grid[min(20, k + 1)]
    return float(np.exp((lo + hi) / 2))


def is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, table: np.ndarray, heat: float):
        self.langs, self.idf, self.table, self.heat = langs, idf.astype(np.float32), (table * idf[:, None]).astype(np.float32), heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, n = counts(text)
        p = softmax((SCALE / max(float(n @ self.idf[at]), 1e-12)) * (n @ self.table[at]).astype(np.float64) / self.heat)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the text and non-null lang of the documents that aren't held out."""
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                seen[counts(x)[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*seen[at].tolist(), n], pa.int64())], ["f", "n"])

    # one row per feature at most; Arrow columns, as a Python object a number would fill the driver
    df = rows.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, k = df["f"].to_numpy(), df["n"].to_numpy()
    n = int(k[f < 0].sum())
    if not n:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), 1.0)
    idf = np.zeros(1 << BITS)
    idf[f[f >= 0]] = np.log((1 + n) / (1 + k[f >= 0])) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1))], ["lang", "h", "at", "n"])

    # ties of the hash are settled by what the rows teach, so that a rerun learns from the same ones
    few = smallest_hashes(rows.withColumn("o", F.struct("h", "lang", F.xxhash64("text").alias("t"))), n, sample)
    got = few.select("text", "lang", "h").mapInArrow(vectors, "lang string, h long, at array<int>, n array<int>").toArrow().combine_chunks()
    names, hashes = got["lang"].to_pylist(), got["h"].to_pylist()
    langs = sorted(set(names))
    data = []
    for i in sorted(range(len(names)), key=lambda i: (hashes[i], names[i])):
        at = got["at"][i].values.to_numpy()
        k = got["n"][i].values.to_numpy() * idf[at]
        data.append((at, SCALE * k / max(k.sum(), 1e-12), langs.index(names[i])))
    fit, check = [x for i, x in enumerate(data) if i % 5], data[::5]
    learner = Ftrl(len(langs))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            learner.learn(*fit[i])
    w = learner.weights(slice(None))
    heat = temperature(np.array([x @ w[at] for at, x, _ in check]), np.array([y for *_, y in check])) if check else 1.0
    return Model(langs, idf, w, heat)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc (all its columns), held_out, lang_pred, score (calibrated probability of lang_pred).

    Texts that are null or have no letter get `und` and score 0; so does every text when no row is there to learn from.
    A very long text counts whole. A null doc_id is never held out; rows with a null lang or text teach nothing. lang, source and doc_id are no inputs of a
    prediction. Repeated rows count each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, sample))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc", "held_out", "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("doc"), F.col("text"), is_held_out().alias("held_out"))
    return rows.mapInArrow(predict, T.StructType([rows.schema["doc"], rows.schema["held_out"]]).add("lang_pred", "string").add("score", "double"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc.doc_id", "held_out", "lang_pred", "score")
