"""What the training-data operators share: input tables, scratch tables in the shared folder, Arrow batches."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# workers get this package's functions by value: they need not have it on their path
cloudpickle.register_pickle_by_value(sys.modules["tripstrata"])

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs in one process (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator run, as Parquet in the shared folder; all go at the end but the one kept.

    Written tables cut the lineage: a lost executor costs the running stage, not the earlier ones.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.kept, self.n = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", set(), 0

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}-{self.n}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.add(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._scratch_path)
            self.kept.discard(df._scratch_path)

    def keep(self, df: DataFrame) -> DataFrame:
        out = self.save(df, "result")
        self.kept.discard(out._scratch_path)
        return out

    def __exit__(self, *_: object) -> None:
        for path in self.kept:
            delete(self.spark, path)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def text_bytes(spark_df: DataFrame, column: str = "text") -> int:
    """Exact bytes of all texts; sizes the reducers, so that their number follows the input."""
    return spark_df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def smallest_hashes(df: DataFrame, n: int, most: int) -> DataFrame:
    """At most `most` rows of the n of `df`: those with the smallest o, a struct that begins with a hash h.

    Only rows with a hash that about twice as many have, or a smaller one, are sorted.
    """
    if n > 2 * most:
        df = df.where(F.col("o.h") <= -(1 << 63) + (1 << 64) * 2 * most // n)
    return df.orderBy("o").limit(most)


def local_path(uri: str) -> str | None:
    """The path of a file: URI, None of any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


#: Row numbers up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def row_number(column: str | None) -> Column:
    """The numbers in `column`; without one, numbers that hold only within the plan that makes them."""
    return F.monotonically_increasing_id() if column is None else F.col(column)


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with row numbers, written once: every plan that reads it sees the same numbers, however it is cut.

    The numbers' column has a name that `docs` doesn't use, in `_at`. The table stays for whoever reads it: its path is in
    `_scratch_path`.
    """
    at = "__at"
    while at.lower() in (c.lower() for c in docs.columns):
        at += "_"
    with Scratch(docs.sparkSession) as s:
        out = s.keep(docs.withColumn(at, F.monotonically_increasing_id()))
    out._at = at
    return out


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs`, a table of numbered(), without the rows numbered in `rows` (row) and without the numbers."""
    rows = rows.select(F.col("row").alias(docs._at))
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    out = docs.join(rows, docs._at, "left_anti").drop(docs._at)
    out._reads = docs
    return out
