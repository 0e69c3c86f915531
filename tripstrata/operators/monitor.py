"""Evaluation and drift: stability indices, agreement, recall and cost, centroid and volume drift, cluster quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.functions.columns import counted_percentile
from tripstrata.operators.sampling import cut_lineage, rank_within

# What a miss of a segment costs.
PENALTY = {"Corporate": 10, "Mabuhay Loyalist": 8, "OFW/Migrant": 5, "Premium Bleisure": 4, "Pilgrimage": 3, "Balikbayan/VFR": 2, "Family": 2, "Digital Nomad": 2, "Last-Minute": 1, "Budget/Adventure": 1}
LEAST = 1e-6


def penalty(segment: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in PENALTY.items() for v in kv]), segment), F.lit(1))


def shares(df: DataFrame, key: str, name: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(key).agg((F.sum(weight) if weight else F.count("*")).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")


def psi_terms(ref: DataFrame, cur: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Per category of either side: shares (at least LEAST) and the term of the population stability index. Rows count once, or as often as
    `weight` says."""
    both = shares(ref, key, "p", weight).join(shares(cur, key, "q", weight), key, "full").withColumns({x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(LEAST)) for x in ("p", "q")})
    return both.withColumn("term", (F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))


def decile_bins(ref: DataFrame, x: str, weight: str | None = None) -> Column:
    """The bin of x between the distinct deciles of the reference (one row to the driver); open at both ends."""
    edges = counted_percentile(ref, [], x, [i / 10 for i in range(11)], weight).first()["q"]
    inner = sorted(set(edges))[1:-1]
    return sum((F.when(F.col(x) >= e, 1).otherwise(0) for e in inner), F.lit(0))


def psi_verdict(psi: Column) -> Column:
    return F.when(psi > 0.25, "RETRAIN").when(psi > 0.10, "INVESTIGATE").otherwise("STABLE")


def ari_verdict(ari: Column) -> Column:
    return F.when(ari >= 0.90, "STABLE").when(ari >= 0.75, "INVESTIGATE").otherwise("RETRAIN")


def volume_drift(ref: DataFrame, cur: DataFrame, key: str, most: float = 30.0) -> DataFrame:
    """Shares in percent, relative change, and whether it is over `most` or the category is new."""
    both = shares(ref, key, "p").join(shares(cur, key, "q"), key, "full").withColumns({x: F.lit(100.0) * F.coalesce(x, F.lit(0.0)) for x in ("p", "q")})
    change = F.when(F.col("p") > 0, F.lit(100.0) * (F.col("q") - F.col("p")) / F.col("p"))
    return both.withColumn("change", change).withColumn("drift", F.coalesce(F.abs("change") > most, F.lit(True)))


def long_vectors(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """One row per vector element (i, x); a mean vector is then a plain average with partial sums."""
    return df.select(*keep, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    return long_vectors(df, vector, label).groupBy(label, "i").agg(F.avg("x").alias("c"))


def centroid_drift(ref: DataFrame, cur: DataFrame, label: str, vector: str, most: float = 1.0) -> DataFrame:
    """Euclidean shift of each label's centroid; labels absent now and noise (-1) are left out."""
    a, b = centroids(ref, label, vector), centroids(cur, label, vector).withColumnRenamed("c", "now")
    moved = a.join(b, [label, "i"]).where(F.col(label) != -1).groupBy(label).agg(F.sqrt(F.sum((F.col("c") - F.col("now")) ** 2)).alias("shift"))
    return moved.withColumn("drift", F.col("shift") > most)


def adjusted_rand(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Agreement of two labelings from their contingency counts (Hubert and Arabie)."""
    pairs = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2.0)
    cells = df.groupBy(a, b).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    rows, cols = (cells.groupBy(x).agg(F.sum("n").alias("n")).agg(pairs("n").alias(name)) for x, name in ((a, "sa"), (b, "sb")))
    one = cells.agg(pairs("n").alias("s"), F.sum("n").alias("t")).crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("t") * (F.col("t") - 1) / 2.0)
    return one.select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2.0 - expected), F.lit(1.0)).alias("ari"))


def recall_and_cost(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Recall and weighted cost of misses per true segment."""
    miss = F.col(true) != F.col(predicted)
    return df.groupBy(true).agg(F.count("*").alias("support"), F.round(F.avg((~miss).cast("int")), 3).alias("recall"), F.sum(F.when(miss, penalty(F.col(true))).otherwise(0)).alias("cost"))


def class_metrics(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per label of either side, 0 where undefined; from the confusion counts."""
    cells = df.groupBy(true, predicted).agg(F.count("*").alias("n"))
    t = cells.groupBy(F.col(true).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    p = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("given"))
    both = t.join(p, "label", "full").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    both = both.withColumn("precision", ratio("hit", "given")).withColumn("recall", ratio("hit", "support"))
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def dispersion(df: DataFrame, label: str, vector: str, key: str) -> DataFrame:
    """Per label: rows, mean and summed squared distance to the centroid; long form, centroids joined by label and element."""
    long = long_vectors(df, vector, key, label).join(F.broadcast(centroids(df, label, vector)), [label, "i"])
    d = long.groupBy(key, label).agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("d2"))
    return d.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("mean_d"), F.sum("d2").alias("sum_d2"))


def davies_bouldin(df: DataFrame, label: str, vector: str, key: str) -> DataFrame:
    c, s = centroids(df, label, vector), dispersion(df, label, vector, key).select(label, "mean_d")
    a, b = c.select(F.col(label).alias("a"), "i", "c"), c.select(F.col(label).alias("b"), "i", F.col("c").alias("o"))
    apart = a.join(F.broadcast(b), "i").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("c") - F.col("o")) ** 2)).alias("m"))
    r = apart.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.col("m")).alias("r"))
    return r.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label: str, vector: str, key: str) -> DataFrame:
    whole = long_vectors(df, vector).groupBy("i").agg(F.avg("x").alias("g"))
    s = dispersion(df, label, vector, key).select(label, "n", "sum_d2")
    between = centroids(df, label, vector).join(F.broadcast(whole), "i").groupBy(label).agg(F.sum((F.col("c") - F.col("g")) ** 2).alias("b2")).join(s, label)
    k, n = F.count("*"), F.sum("n")
    return between.agg(((F.sum(F.col("n") * F.col("b2")) / (k - 1)) / (F.sum("sum_d2") / (n - k))).alias("calinski_harabasz"))


def exact_part(df: DataFrame, key: str, part: float, seed: int) -> DataFrame:
    """round(part * rows) rows, those with the smallest seeded hashes of the key: ranks come from counted hash bins, not from a sort of all rows."""
    ranked = rank_within(df.withColumn("__all", F.lit(0)), "__all", key, seed)
    return ranked.where(F.col("rank") <= F.round(F.col("size") * part)).drop("__all", "rank", "size")


def pairwise_rand(labels: DataFrame, key: str) -> DataFrame:
    """(a, b, shared, ari) for all pairs of runs of `labels` (run, key, label): the adjusted Rand index over the rows that both have,
    from one table of contingency counts. 1 where neither run can differ."""
    left, right = (labels.select(key, F.col("run").alias(n), F.col("label").alias(f"l{n}")) for n in "ab")
    cells = left.join(right, key).where("a < b").groupBy("a", "b", "la", "lb").agg(F.count("*").alias("n"))
    two = lambda n: F.sum(n * (n - 1) / 2)
    rows = cells.groupBy("a", "b", "la").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(two(F.col("n")).alias("r"), F.sum("n").alias("shared"))
    columns = cells.groupBy("a", "b", "lb").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(two(F.col("n")).alias("c"))
    both = cells.groupBy("a", "b").agg(two(F.col("n")).alias("s")).join(rows, ["a", "b"]).join(columns, ["a", "b"])
    chance = F.try_divide(F.col("r") * F.col("c"), F.col("shared") * (F.col("shared") - 1) / 2)
    return both.select("a", "b", "shared", F.coalesce(F.try_divide(F.col("s") - chance, (F.col("r") + F.col("c")) / 2 - chance), F.lit(1.0)).alias("ari"))


def bootstrap_stability(df: DataFrame, key: str, fit: Callable[[DataFrame, int], DataFrame], runs: int = 10, part: float = 0.9, least: int = 10) -> float:
    """Mean agreement of the labels that `fit` gives to pairs of exact samples without replacement, over the rows that both have; pairs
    with fewer than `least` of these are left out."""
    found = [cut_lineage(fit(exact_part(df, key, part, i), i).select(F.lit(i).alias("run"), key, "label")) for i in range(runs)]
    labels = found[0]
    for x in found[1:]:
        labels = labels.unionByName(x)
    got = pairwise_rand(labels, key).where(F.col("shared") >= least).agg(F.avg("ari").alias("ari")).first()["ari"]
    return float("nan") if got is None else got


def retrain(psi: dict[str, float], ari: float, noise: float) -> tuple[bool, list[str]]:
    """Whether to retrain, and why: one index over .25, two over .10, low agreement, or much noise."""
    why = [f"PSI {k}" for k, v in psi.items() if v > 0.25]
    why += ["PSI of several features"] * (sum(v > 0.10 for v in psi.values()) >= 2) + ["agreement"] * (ari < 0.75) + ["noise"] * (noise > 0.12)
    return bool(why), why


# Bounds beyond which a model is fitted anew.
RETRAIN_PSI, WATCH_PSI, WATCHED, LEAST_ARI, MOST_NOISE = 0.25, 0.10, 2, 0.75, 12.0


def feature_psi(ref: DataFrame, cur: DataFrame, features: list[str]) -> DataFrame:
    """(feature, psi) of numeric features, each over the deciles of its reference; rows without a value don't count. Either side is read
    once: values are counted by feature, and all else takes the counts."""

    def counted(df: DataFrame) -> DataFrame:
        long = df.select(*[F.col(x).cast("double").alias(x) for x in features]).unpivot([], features, "feature", "x").where("x IS NOT NULL")
        return cut_lineage(long.groupBy("feature", "x").agg(F.count("*").alias("n")))

    sides, out = [counted(df) for df in (ref, cur)], None
    for x in features:
        old, new = (df.where(F.col("feature") == x) for df in sides)
        at = decile_bins(old, "x", "n")
        part = psi_terms(*(df.select(at.alias("bin"), "n") for df in (old, new)), "bin", "n").agg(F.lit(x).alias("feature"), F.coalesce(F.sum("term"), F.lit(0.0)).alias("psi")).select("feature", "psi")
        out = part if out is None else out.unionByName(part)
    return out


def retrain_decision(segments: DataFrame, features: DataFrame, ari: DataFrame, noise: DataFrame) -> DataFrame:
    """One row: psi_segment, n_features over WATCH_PSI, ari, noise_pct, whether to retrain, and the reasons in this order. Takes the
    terms of the segments' index (term), indices by feature (feature, psi), and rows of one number (ari; noise_pct). An agreement that
    is NULL or NaN is no reason."""
    one = segments.agg(F.coalesce(F.sum("term"), F.lit(0.0)).alias("psi_segment"))
    for other in (features.agg(F.count_if(F.col("psi") > WATCH_PSI).alias("n_features")), ari.select("ari"), noise.select("noise_pct")):
        one = one.crossJoin(F.broadcast(other))
    why = [
        F.when(F.col("psi_segment") > RETRAIN_PSI, "segment mix"), F.when(F.col("n_features") >= WATCHED, "features"),
        F.when(~F.isnan("ari") & (F.col("ari") < LEAST_ARI), "agreement"), F.when(F.col("noise_pct") > MOST_NOISE, "noise"),
    ]
    return one.withColumn("reasons", F.concat_ws(", ", *why)).withColumn("retrain", F.col("reasons") != "")
