"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame; all but the last
return the columns of `docs` as they are. Nulls, empty texts, repeated rows and empty tables have the results that the
stages' operators define. Stages that drop rows number them in a table in the shared folder, which their result reads: it
stays until the caller deletes it (run() does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm import near, op4, op6, op9, op10
from tripstrata.llm.common import Scratch, numbered, table, without_rows

#: Texts whose language is less probable than this go, and those without a letter.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and those whose language stays unclear."""
    found = op4.identify(docs)
    return found.where((F.col("lang_pred") != op4.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal but for white space."""
    docs = numbered(docs)
    return without_rows(docs, op6.exact_dedup(docs, row=docs._at).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of near copies: 0.8 of the 5-word shingles of two are common.
    op1's SimHash links are tried first, MinHash bands find what lies farther apart, and exact sets decide on both."""
    docs = numbered(docs)
    return without_rows(docs, near.near_copies(docs, docs._at))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which benchmark windows cover a twentieth of the words or more."""
    docs = numbered(docs)
    return without_rows(docs, op10.decontaminate(docs, table(spark, sf_dir, "benchmark"), row=docs._at).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece."""
    return op9.pack(docs).drop("row")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: The first stage is a trained classifier and the last depends on the order of tasks: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, kept = docs, stage(spark, docs, sf_dir)
            docs = scratch.save(kept, name)
            if hasattr(kept, "_reads"):
                scratch.drop(kept._reads)
            if hasattr(before, "_scratch_path"):
                scratch.drop(before)
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
