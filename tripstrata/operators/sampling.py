"""Global ranks, deterministic samples, stratified splits, over- and undersampling."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, in the one that the cluster names; only a session in one process (tests) may make one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_rank(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """A 1-based global rank without a window over all rows: range-partitioned, sorted, shifted by the sizes of earlier partitions."""
    # checkpointed: a lost partition that is cut anew could have other bounds
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = parts.groupBy(part.alias("__p")).agg(F.count("*").alias("n")).orderBy("__p").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["__p"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(before or [(0, 0)], "__p long, __first long")
    ranked = parts.withColumn("__p", part).join(F.broadcast(first), "__p").withColumn("rank", F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1)
    return ranked.drop("__p", "__first", "__id"), total


def rank_within(df: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Adds `rank` (1-based, by the key's seeded hash) within the stratum, and its `size`, exactly and without gathering a stratum:
    hashes fall into 1,024 bins, whose sizes are summed, and only a bin's rows are ranked together."""
    h = df.withColumn("__h", F.xxhash64(key, F.lit(seed))).withColumn("__b", F.shiftright("__h", 54))
    w = Window.partitionBy(stratum)
    bins = h.groupBy(stratum, "__b").agg(F.count("*").alias("__n"))
    bins = bins.select(stratum, "__b", F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"), F.sum("__n").over(w).alias("size"))
    within = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", key))
    return h.withColumn("__r", within).join(bins, [stratum, "__b"]).withColumn("rank", F.col("__first") + F.col("__r")).drop("__h", "__b", "__r", "__first")


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, uniform and reproducible: those with the smallest seeded hashes of the key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def sample_then_filter(df: DataFrame, n: int, key: str, where: str) -> DataFrame:
    """A filter on a sample of all rows: fewer than n rows come out."""
    return sample(df, n, key).where(where)


def filter_then_sample(df: DataFrame, n: int, key: str, where: str) -> DataFrame:
    return sample(df.where(where), n, key)


def stratified_split(df: DataFrame, stratum: str, key: str, part: float = 0.8) -> DataFrame:
    """Adds `train`: round(part * size) rows of each stratum by hash; all of a stratum of one row."""
    ranked = rank_within(df, stratum, key)
    return ranked.withColumn("train", (F.col("size") < 2) | (F.col("rank") <= F.round(F.col("size") * part))).drop("rank", "size")


def folds(df: DataFrame, stratum: str, key: str, k: int = 5) -> DataFrame:
    """Adds `fold`, 0 to k - 1: each stratum is spread over the folds, at most one row apart."""
    return rank_within(df, stratum, key).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "size")


def oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Repeats rows until every class is exactly as large as the largest; those with the smallest hashes come once more."""
    ranked = rank_within(df, label, key)
    most = ranked.agg(F.max("size").alias("most"))
    times = F.floor(F.col("most") / F.col("size")) + F.when(F.col("rank") <= F.col("most") % F.col("size"), 1).otherwise(0)
    return ranked.crossJoin(F.broadcast(most)).withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("rank", "size", "most")


def undersample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Exactly as many rows of each class as the smallest has, by hash."""
    ranked = rank_within(df, label, key)
    least = ranked.agg(F.min("size").alias("least"))
    return ranked.crossJoin(F.broadcast(least)).where("rank <= least").drop("rank", "size", "least")
