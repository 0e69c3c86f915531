"""Queries of the clustering, mixture, classification and resampling operators. SQL expresses few of these; tests hold their
operators against brute force, or their results against given labels."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.functions.columns import bins, clip
from tripstrata.operators import comparison, coupon, forest, linkage, mixture, models, monitor, neighbours, resample, sampling
from tripstrata.plans.base import query
from tripstrata.plans.segments import ranked, rounded
from tripstrata.sources.tables import star


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query(None)
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return models.kmeans(embeddings(spark, d).drop("label"), 10).groupBy("label").agg(F.count("*").alias("n"))


@query(None)
def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The cost of 2 to 15 clusters."""
    return spark.createDataFrame([(k, round(c, 4)) for k, c in models.kmeans_costs(embeddings(spark, d).drop("label"), list(range(2, 16)))], "k int, cost double")


@query(None)
def minibatch_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return models.minibatch_kmeans(embeddings(spark, d), 10, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 4).alias("mean_distance"))


@query(None)
def gaussian_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.gaussian_mixture(embeddings(spark, d).drop("label"), 10, "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query(None)
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    pc, parts = models.principal(embeddings(spark, d), 2)
    return pc.select("vec_id", "label", F.round(F.col("pc")[0], 5).alias("pc1"), F.round(F.col("pc")[1], 5).alias("pc2"), F.lit(round(sum(parts), 5)).alias("explained"))


@query(None)
def variance_components(spark: SparkSession, d: str) -> DataFrame:
    """How many principal components hold 90 % of the variance."""
    _, parts = models.principal(embeddings(spark, d), 64)
    held = np.cumsum(parts)
    k = int(np.searchsorted(held, 0.9) + 1)
    return spark.createDataFrame([(k, round(float(held[min(k, len(held)) - 1]), 5))], "components int, held double")


@query(None)
def segment_boxes(spark: SparkSession, d: str) -> DataFrame:
    """q02 to q98 of each label in the plane of the first two components."""
    pc, _ = models.principal(embeddings(spark, d), 2)
    q = lambda i: F.percentile(F.col("pc")[i], F.array(F.lit(0.02), F.lit(0.98)))
    return pc.groupBy("label").agg(q(0).alias("x"), q(1).alias("y"))


@query(None)
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return models.dbscan(embeddings(spark, d).drop("label"), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query(None)
def hdbscan_of_sample(spark: SparkSession, d: str) -> DataFrame:
    """HDBSCAN of a sample of at most PAIRS rows; every other row gets the label of the nearest sampled one."""
    e = embeddings(spark, d).drop("label")
    return models.assigned(e, models.bounded(e, "vec_id", models.hdbscan(15, 5)), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query(None)
def ward_of_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ward on a sample of at most 1,000 rows; every row then goes to the nearest centroid."""
    e = embeddings(spark, d).drop("label")
    got = models.bounded(e, "vec_id", models.ward(10), 1000)
    return models.nearest(e, models.means_of(e, got, "vec_id")).groupBy("label").agg(F.count("*").alias("n"))


@query(None)
def birch(spark: SparkSession, d: str) -> DataFrame:
    return models.birch(embeddings(spark, d).drop("label"), 10, 0.5).groupBy("label").agg(F.count("*").alias("n"))


def fitted(spark: SparkSession, d: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The embeddings and the labels (method, vec_id, label) of seven methods, each fitted on all rows. Rows without a whole finite
    vector have no place in any of them and aren't compared."""
    e = neighbours.usable(embeddings(spark, d).drop("label"), "embedding")
    ways = {
        "kmeans": lambda: models.kmeans(e, k), "minibatch": lambda: models.minibatch_kmeans(e, k, "vec_id"), "mixture": lambda: mixture.gaussian_mixture(e, k, "vec_id"), "birch": lambda: models.birch(e, k, 0.5),
        "dbscan": lambda: models.dbscan(e, "vec_id"), "hdbscan": lambda: linkage.hdbscan(e, "vec_id", 15, 5), "ward": lambda: linkage.ward(e, "vec_id", k),
    }
    sampling.shared_folder(spark)  # named once, before the methods ask for it
    # each takes many short jobs that don't keep the machines busy: they are fitted side by side
    with ThreadPoolExecutor(len(ways)) as pool:
        found = dict(zip(ways, pool.map(inheritable_thread_target(spark)(lambda way: way()), ways.values()), strict=True))
    return e, comparison.long_labels(found, "vec_id")


@query(None)
def method_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Seven methods, fitted on all rows, by their ranks on five metrics of all rows."""
    return ranked(rounded(comparison.scores(*fitted(spark, d), "vec_id", asked=None)))


@query(None)
def knn_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy by label of a 15-nearest-neighbour vote."""
    e = sampling.stratified_split(embeddings(spark, d), "label", "vec_id")
    train = e.where("train").select("vec_id", "embedding", "label")
    test = e.where("NOT train").select("vec_id", "embedding", F.col("label").alias("own"))
    return test.join(models.knn_labels(train, test, "vec_id"), "vec_id").groupBy("own").agg(F.count("*").alias("n"), F.round(F.avg((F.col("own") == F.col("predicted")).cast("int")), 4).alias("accuracy"))


@query(None)
def knn_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a 20 x 20 mesh over the plane of the first two components, by the 15 nearest rows."""
    pc, _ = models.principal(embeddings(spark, d), 2)
    rows = sampling.cut_lineage(pc.select("vec_id", "label", F.col("pc").alias("embedding")))
    r = rows.agg(*[f(F.col("embedding")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("low", F.min), ("high", F.max))]).first()
    at = lambda i, k: r[f"low{i}"] + (r[f"high{i}"] - r[f"low{i}"]) * k / 19
    mesh = spark.createDataFrame([(-1 - 20 * i - j, [at(0, i), at(1, j)]) for i in range(20) for j in range(20)], "vec_id long, embedding array<double>")
    return models.knn_labels(rows, mesh, "vec_id").groupBy("predicted").agg(F.count("*").alias("n"))


@query(None)
def random_forest(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts of a class-weighted forest of 200 trees, each row predicted by the forest of the four folds without it."""
    e = sampling.folds(embeddings(spark, d), "label", "vec_id")
    got = forest.out_of_fold(e, "label", "fold", "vec_id", "embedding", 5)
    return got.groupBy(F.col("label").cast("int").alias("label"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query(None)
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette of the given labels, of all rows against all rows."""
    return models.silhouettes(embeddings(spark, d), "label", "vec_id").withColumn("silhouette", F.round("silhouette", 6))


@query(None)
def validity_of_sample(spark: SparkSession, d: str) -> DataFrame:
    """Density-based validity of the given labels, on a sample of at most PAIRS rows."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(g)], "dbcv": [round(models.dbcv(np.array(g["embedding"].tolist(), float), g["label"].to_numpy()), 6)]})

    return sampling.sample(embeddings(spark, d), models.PAIRS, "vec_id").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "n long, dbcv double")


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Integer codes of bookings: lead bucket, tier, coupons and flags."""
    bk = coupon.bookings(coupon.clean(spark, d)).where("max_tier IS NOT NULL")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return bk.select("customer_id", "issue_date", "proxy_segment", bins(F.col("lead_days"), [-1, 3, 14, 45, 120, 999]).alias("lead_bucket"), (F.col("max_tier") - 1).alias("tier"), clip(F.col("n_coupons") - 1, 0, 3).cast("int").alias("coupons"), flag("is_international"), flag("round_trip"), flag("any_premium"), flag("foreign_issue"))


CODES = ["lead_bucket", "tier", "coupons", "is_international", "round_trip", "any_premium", "foreign_issue"]


@query(None)
def latent_classes(spark: SparkSession, d: str) -> DataFrame:
    df = codes(spark, d).groupBy(*CODES).agg(F.count("*").alias("m")).persist()
    got = [models.latent_classes(df, CODES, k, weight="m") for k in range(3, 10)]
    df.unpersist()
    return spark.createDataFrame([(g["k"], round(g["bic"], 3), round(g["aic"], 3), round(g["shares"][0], 4)) for g in got], "k int, bic double, aic double, largest double")


@query(None)
def sub_segments(spark: SparkSession, d: str) -> DataFrame:
    """Latent classes within parents; the number of classes with the least BIC. Columns that don't vary are dropped."""
    df, out = codes(spark, d).persist(), []
    parents = [r[0] for r in df.groupBy("proxy_segment").count().where("count >= 50").orderBy("proxy_segment").collect()]
    for parent in parents:
        some = df.where(F.col("proxy_segment") == parent)
        distinct = some.agg(*[F.count_distinct(c).alias(c) for c in CODES]).first()
        best = min((models.latent_classes(some, [c for c in CODES if distinct[c] > 1], k) for k in (2, 3, 4)), key=lambda g: g["bic"])
        out += [(parent, best["k"], i, round(s, 4)) for i, s in enumerate(best["shares"])]
    df.unpersist()
    return spark.createDataFrame(out, "parent string, k int, sub int, share double")


@query(None)
def k_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """The bookings' columns are stored once: each pass of the operator reads them, not the coupons."""
    df = codes(spark, d).select(F.xxhash64("customer_id", "issue_date").alias("id"), F.col("lead_bucket").cast("double").alias("lead"), "tier", "is_international", "any_premium", "proxy_segment")
    got, _ = models.k_prototypes(sampling.cut_lineage(df), "id", ["lead"], ["tier", "is_international", "any_premium"], 4)
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("lead"), 4).alias("lead"), F.mode("proxy_segment", True).alias("segment"))


@query(None)
def inductive_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Nearest seed centroid (seeds of five rows or more); farther than the p95 of training goes to -1."""
    e = sampling.stratified_split(embeddings(spark, d), "label", "vec_id")
    seeds = e.where("train").groupBy("label").count().where("count >= 5").select("label")
    c = monitor.centroids(e.where("train").join(F.broadcast(seeds), "label", "left_semi"), "label", "embedding").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("v")).orderBy("label").collect()
    scored = models.nearest(e.withColumnRenamed("label", "own"), np.array([[x["c"] for x in r["v"]] for r in c]))
    limit = scored.where("train").agg(F.percentile("distance", 0.95).alias("limit"))
    final = scored.crossJoin(F.broadcast(limit)).withColumn("assigned", F.when(F.col("distance") > F.col("limit"), -1).otherwise(F.col("label")))
    return final.groupBy("train", "assigned").agg(F.count("*").alias("n"))


@query(None)
def bootstrap_stability(spark: SparkSession, d: str) -> DataFrame:
    ari = monitor.bootstrap_stability(embeddings(spark, d).drop("label"), "vec_id", lambda df, i: models.kmeans(df, 10, 1, 20))
    return spark.createDataFrame([(round(ari, 6),)], "ari double").withColumn("verdict", monitor.ari_verdict(F.col("ari")))


@query(None)
def reservoir_samples(spark: SparkSession, d: str) -> DataFrame:
    o = star(spark, d, "orders")
    a, b = sampling.sample_then_filter(o, 1000, "o_orderkey", "o_orderstatus = 'P'"), sampling.filter_then_sample(o, 1000, "o_orderkey", "o_orderstatus = 'P'")
    return a.agg(F.count("*").alias("sample_then_filter")).crossJoin(b.agg(F.count("*").alias("filter_then_sample")))


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, (SELECT max(n) FROM n) AS over, (SELECT min(n) FROM n) AS under FROM n")
def resampled_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Class sizes before and after over- and undersampling."""
    e = embeddings(spark, d)
    n = lambda df, name: df.groupBy("label").agg(F.count("*").alias(name))
    return n(e, "n").join(n(sampling.oversample(e, "label", "vec_id"), "over"), "label").join(n(sampling.undersample(e, "label", "vec_id"), "under"), "label")


@query(None)
def resampling(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic rows that bring every class to the size of the largest (plain and by difficulty), and mutual nearest rows of two classes."""
    e = embeddings(spark, d)
    sizes = {r["label"]: r["n"] for r in e.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = sorted(k for k in sizes if sizes[k] < max(sizes.values()))
    near, most = sampling.cut_lineage(resample.neighbours(e, e, "vec_id", "embedding", 3)), max(sizes.values())

    def made(k: int) -> list:
        own = e.where(F.col("label") == k)
        near_own = sampling.cut_lineage(resample.neighbours(own, own, "vec_id", "embedding", 3))
        plain = resample.smote(own, "label", "vec_id", "embedding", most - sizes[k], near=near_own).withColumn("how", F.lit("smote"))
        hard = resample.adasyn(e, "label", "vec_id", "embedding", k, most - sizes[k], near=near, near_own=near_own).withColumn("how", F.lit("adasyn"))
        return plain.unionByName(hard).groupBy("how", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()

    # a class is too small to keep the machines busy: they are taken side by side, a few at a time
    with ThreadPoolExecutor(4) as pool:
        rows = [r for part in pool.map(inheritable_thread_target(spark)(made), few) for r in part]
    links = resample.tomek_links(e, "label", "vec_id", "embedding", near).agg(F.count("*").alias("n")).select(F.lit("tomek links").alias("how"), F.lit(-1).alias("label"), "n")
    return links.unionByName(spark.createDataFrame(rows, "how string, label int, n long"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def label_sizes(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
