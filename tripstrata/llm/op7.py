"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w . x - b_k): one weight vector for all thresholds b_0 < b_1 < ..., so the grades stay ordered. Features
are words and word beginnings, chosen by how unevenly they fall on the grades; the expected severity is the sum of
P(grade > k) over k. Where labels are only 0 and 1, toxic rows are graded by how sure a model is of them that was
fitted on the other folds, so that no row is graded by its own label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstrata.llm.common import smallest_hashes, table

WORD = re.compile(r"[^\W\d_]+")
#: At most so many labelled rows are fitted on: those with the smallest hashes of their doc_id.
SAMPLE = 20_000
#: Lengths of the word beginnings that count, written with a hyphen.
PREFIXES = (4, 5, 6)
#: A feature is in so many of them, with so large a chi-square against the grades; the largest FEATURES count.
LEAST_DOCS, LEAST_CHI2, FEATURES = 8, 16.0, 2000
L2, STEPS, RATE = 1e-5, 600, 0.05
#: Distinct words whose features a worker remembers at a time.
REMEMBERED = 500_000
#: 0/1 labels are spread over so many grades, by models of so many folds.
GRADES, FOLDS, FOLD_STEPS = 4, 5, 150
#: A document is toxic if P(grade > 0) is at least this.
THRESHOLD = 0.5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def parts(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]


class Vocabulary:
    """Chosen features of texts; each word is looked up once and remembered."""

    def __init__(self, features: list[str]):
        self.at, self.known = {x: i for i, x in enumerate(features)}, {}

    def __getstate__(self) -> dict:
        return {"at": self.at, "known": {}}

    def found(self, text: str | None) -> dict[int, float]:
        known, out = self.known, Counter()
        if len(known) > REMEMBERED:
            known.clear()
        for w in WORD.findall((text or "").lower()):
            got = known.get(w)
            if got is None:
                got = known[w] = [self.at[x] for x in parts(w) if x in self.at]
            if got:
                out.update(got)
        return {i: 1.0 + math.log(n) for i, n in sorted(out.items())}


class Model:
    def __init__(self, features: list[str], w: np.ndarray, bounds: np.ndarray):
        self.vocabulary, self.w, self.bounds = Vocabulary(features), w, bounds

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        if not len(self.bounds):
            return np.zeros(1)
        return sigmoid(sum(self.w[i] * x for i, x in self.vocabulary.found(text).items()) - self.bounds)


def choose_features(sample: DataFrame, grades: dict[int, int], least_docs: int = LEAST_DOCS) -> list[str]:
    """The features of the sample with the largest chi-square of their presence against grade > 0."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            everywhere, in_bad = Counter(), Counter()
            for x, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {p for w in set(WORD.findall(x.lower())) for p in parts(w)}
                everywhere.update(found)
                if g > 0:
                    in_bad.update(found)
            names = list(everywhere)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([everywhere[x] for x in names], pa.int64()), pa.array([in_bad[x] for x in names], pa.int64())], ["word", "n", "k"])

    n, bad = sum(grades.values()), sum(k for g, k in grades.items() if g > 0)
    counted = sample.select("text", "grade").mapInArrow(counts, "word string, n long, k long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= least_docs)
    expected = F.col("n") * F.lit(bad / max(n, 1))
    chi2 = (F.col("k") - expected) ** 2 / (expected * F.lit(max(1 - bad / max(n, 1), 1e-9))) if 0 < bad < n else F.lit(0.0)
    top = counted.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "word").limit(FEATURES)
    return [x["word"] for x in top.collect()]


def fit(rows: list[tuple[list[int], list[float]]], grade: np.ndarray, n_words: int, levels: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by full-batch Adam steps on the cumulative-link log loss."""
    at = np.array([i for a, _ in rows for i in a], np.int64)
    x = np.array([v for _, b in rows for v in b])
    doc = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    w, start = np.zeros(n_words), np.array([np.log((np.sum(grade <= k) + 1) / (np.sum(grade > k) + 1)) for k in range(levels - 1)])
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    first, mean, square = start[0], np.zeros(n_words + levels - 1), np.zeros(n_words + levels - 1)
    k = np.arange(levels - 1)
    for t in range(1, steps + 1):
        bounds = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        s = np.bincount(doc, x * w[at], len(rows))
        above = np.concatenate([np.ones((len(rows), 1)), sigmoid(s[:, None] - bounds), np.zeros((len(rows), 1))], axis=1)
        p = np.maximum(above[np.arange(len(rows)), grade] - above[np.arange(len(rows)), grade + 1], 1e-9)
        slope = above * (1 - above)
        up, down = slope[np.arange(len(rows)), grade], slope[np.arange(len(rows)), grade + 1]
        ds = -(up - down) / p / len(rows)
        db = np.array([((grade == j + 1) * up / p).sum() - ((grade == j) * down / p).sum() for j in k]) / len(rows)
        grad = np.concatenate([np.bincount(at, ds[doc] * x, n_words) + L2 * w, [db.sum()], [db[j + 1 :].sum() * np.exp(gaps[j]) for j in range(levels - 2)]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        speed = -RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, first, gaps = w + speed[:n_words], first + speed[n_words], gaps + speed[n_words + 1 :]
    return w, np.concatenate([[first], first + np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the documents with a label (doc_id, grade); grades are small whole numbers from 0, and 0/1 labels are spread by
    cross_graded. Of the rows of a labelled doc_id one counts (the least hash of the text), so that `sample` bounds the rows too."""
    marked = labels.where(F.col("grade").isNotNull()).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")).withColumn("h", F.xxhash64("doc_id"))
    few = smallest_hashes(marked.withColumn("o", F.struct("h", "doc_id")), marked.count(), sample).drop("o")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("h", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text"))["text"].alias("text")).select("text", "grade", "h")
    grades = {x["grade"]: x["count"] for x in rows.groupBy("grade").count().collect()}
    levels = max(grades, default=0) + 1
    if levels < 2:
        return Model([], np.zeros(0), np.zeros(0))
    features = choose_features(rows, grades)
    vocabulary = Vocabulary(features)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [vocabulary.found(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))], ["grade", "h", "at", "x"])

    got = rows.mapInArrow(vectors, "grade int, h long, at array<int>, x array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["at"], r["x"]))
    grade = np.array([r["grade"] for r in got])
    data = [(r["at"], r["x"]) for r in got]
    if levels == 2:
        grade, levels = cross_graded(data, grade, len(features)), GRADES
    return Model(features, *fit(data, grade, len(features), levels))


def cross_graded(data: list[tuple[list[int], list[float]]], toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Grades 0 to GRADES - 1 from 0/1 labels: the toxic rows, in order of their score by a model that saw only the other folds,
    are dealt to grades of equal size. Rows come in the order of their hash, so every FOLDS-th row is a fold."""
    fold, score = np.arange(len(data)) % FOLDS, np.zeros(len(data))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        w, _ = fit([data[i] for i in rest], toxic[rest], n_words, 2, FOLD_STEPS)
        for i in np.flatnonzero(fold == k):
            at, x = data[i]
            score[i] = float(w[at] @ np.array(x)) if len(at) else 0.0
    some = score[toxic > 0]
    cuts = np.quantile(some, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(some) else np.zeros(GRADES - 2)
    return toxic * (1 + np.searchsorted(cuts, score, "left"))


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, grade, severity, toxic_score, toxic.

    grade: the most probable one (the lowest of equals); severity: the expected grade; toxic_score: P(grade > 0). A null or empty
    text has no words and gets what the thresholds alone say, a very long one counts whole; without labels of two grades all scores are 0. Repeated
    rows get equal results; of a doc_id's labels the highest counts, a label of no document is ignored. Other columns are
    ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            above = [model.above(x) for x in b.column(1).to_pylist()]
            best = [int(np.argmax(-np.diff(np.concatenate([[1.0], a, [0.0]])))) for a in above]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(best, pa.int32()), pa.array([float(a.sum()) for a in above], pa.float64()), pa.array([float(a[0]) for a in above], pa.float64()), pa.array([bool(a[0] >= THRESHOLD) for a in above], pa.bool_())],
                ["doc_id", "grade", "severity", "toxic_score", "toxic"],
            )

    rows = docs.select("doc_id", "text")
    kinds = T.StructType([rows.schema["doc_id"]]).add("grade", T.IntegerType()).add("severity", "double").add("toxic_score", "double").add("toxic", "boolean")
    return rows.mapInArrow(grade, kinds)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))
