"""Resamplers that look at neighbours: SMOTE, ADASYN and Tomek links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.operators.neighbours import neighbours
from tripstrata.operators.sampling import with_rank


def between(picked: DataFrame, df: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """Synthetic rows on the way from a row to its `other`, a part of it that the two keys and `copy` give."""
    v = df.select(F.col(key), F.col(vector).alias("a"), label)
    o = df.select(F.col(key).alias("other"), F.col(vector).alias("b"))
    t = F.pmod(F.xxhash64(key, "other", "copy"), F.lit(1000)) / 1000.0
    return picked.join(v, key).join(o, "other").select(key, label, F.zip_with("a", "b", lambda x, y: x + (y - x) * t).alias(vector))


def smote(df: DataFrame, label: str, key: str, vector: str, wanted: int, k: int = 3, near: DataFrame | None = None) -> DataFrame:
    """`wanted` synthetic rows of one class, which `df` holds: points on the way to one of the k nearest others of the class (`near`)."""
    near = near or neighbours(df, df, key, vector, k)
    ranked, n = with_rank(near.select(key, "other", F.xxhash64(key, "other", F.lit(7)).alias("h")), "h", key, "other")
    times = F.lit(wanted // max(n, 1)) + F.when(F.col("rank") <= wanted % max(n, 1), 1).otherwise(0)
    return between(ranked.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))), df, label, key, vector)


def adasyn(df: DataFrame, label: str, key: str, vector: str, small: int, wanted: int, k: int = 3, near: DataFrame | None = None, near_own: DataFrame | None = None) -> DataFrame:
    """About `wanted` synthetic rows of class `small`, more where more of a row's k nearest (`near`) are of other classes (He et al. 2008),
    on the way to one of the k nearest of the class (`near_own`)."""
    own = df.where(F.col(label) == small)
    near = (near or neighbours(own, df, key, vector, k)).join(own.select(key), key, "left_semi")
    hard = near.join(df.select(F.col(key).alias("other"), F.col(label).alias("of")), "other").groupBy(key).agg(F.avg((F.col("of") != small).cast("double")).alias("hard"))
    whole = hard.agg(F.sum("hard").alias("whole"))
    made = hard.crossJoin(F.broadcast(whole)).select(key, F.round(F.try_divide("hard", "whole") * wanted).cast("int").alias("times")).where("times > 0")
    near_own = (near_own or neighbours(own, own, key, vector, k)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "other"))).alias("near"))
    picked = made.join(near_own, key).select(key, "near", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return between(picked.select(key, "copy", F.get("near", F.pmod("copy", F.size("near")).cast("int"))["other"].alias("other")), df, label, key, vector)


def tomek_links(df: DataFrame, label: str, key: str, vector: str, near: DataFrame | None = None) -> DataFrame:
    """Pairs of different classes that are each other's nearest (`near`)."""
    near = (near or neighbours(df, df, key, vector, 1)).where(F.col("r") == 1).select(F.col(key).alias("a"), F.col("other").alias("b"))
    both = near.join(near.toDF("b", "a"), ["a", "b"]).where("a < b")
    lab = df.select(key, label)
    return both.join(lab.toDF("a", "la"), "a").join(lab.toDF("b", "lb"), "b").where("la <> lb").select("a", "b")
