"""Monitoring and evaluation queries over events, embeddings and labelled tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.operators import coupon, monitor as ops, rules
from tripstrata.plans import eda
from tripstrata.plans.base import query
from tripstrata.sources.tables import star

SPLIT = "2024-01-16"
_EVENTS = f"ref AS (SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT}'), cur AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{SPLIT}')"
_CAT = f"{_EVENTS}, p AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS p FROM ref GROUP BY 1), q AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS q FROM cur GROUP BY 1), b AS (SELECT event_type, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (event_type))"


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df, at = star(spark, d, "events"), F.lit(SPLIT).cast("timestamp_ntz")
    return df.where(F.col("ts") < at), df.where(F.col("ts") >= at)


@query(f"WITH {_CAT} SELECT event_type, round(greatest(p, 1e-6), 6) AS p, round(greatest(q, 1e-6), 6) AS q, round((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6)), 6) AS term FROM b")
def psi_categorical(spark: SparkSession, d: str) -> DataFrame:
    return ops.psi_terms(*halves(spark, d), "event_type").select("event_type", *[F.round(x, 6).alias(x) for x in ("p", "q", "term")])


@query(f"WITH {_EVENTS}, e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM ref), inner_ AS (SELECT e[2:len(e) - 1] AS e FROM e), rb AS (SELECT len(list_filter(e, lambda x: value >= x)) AS bin FROM ref CROSS JOIN inner_), cb AS (SELECT len(list_filter(e, lambda x: value >= x)) AS bin FROM cur CROSS JOIN inner_), p AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM rb GROUP BY 1), q AS (SELECT bin, count(*) / sum(count(*)) OVER () AS q FROM cb GROUP BY 1), b AS (SELECT greatest(coalesce(p, 0), 1e-6) AS p, greatest(coalesce(q, 0), 1e-6) AS q FROM p FULL JOIN q USING (bin)) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, CASE WHEN sum((q - p) * ln(q / p)) > 0.25 THEN 'RETRAIN' WHEN sum((q - p) * ln(q / p)) > 0.1 THEN 'INVESTIGATE' ELSE 'STABLE' END AS verdict FROM b")
def psi_numeric(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = halves(spark, d)
    b = ops.decile_bins(ref, "value")
    psi = ops.psi_terms(ref.withColumn("bin", b), cur.withColumn("bin", b), "bin").agg(F.sum("term").alias("psi"))
    return psi.select(F.round("psi", 6).alias("psi"), ops.psi_verdict(F.col("psi")).alias("verdict"))


@query(f"WITH {_CAT} SELECT event_type, round(100.0 * p, 4) AS p, round(100.0 * q, 4) AS q, round(CASE WHEN p > 0 THEN 100.0 * (q - p) / p END, 4) AS change, coalesce(abs(CASE WHEN p > 0 THEN 100.0 * (q - p) / p END) > 30, true) AS drift FROM b")
def volume_drift(spark: SparkSession, d: str) -> DataFrame:
    return ops.volume_drift(*halves(spark, d), "event_type").select("event_type", *[F.round(x, 4).alias(x) for x in ("p", "q", "change")], "drift")


LONG = "v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"WITH {LONG}, a AS (SELECT label, i, avg(x) AS c FROM v WHERE vec_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT label, i, avg(x) AS o FROM v WHERE vec_id % 2 = 1 GROUP BY 1, 2) SELECT label, round(sqrt(sum((c - o) ^ 2)), 6) AS shift, sqrt(sum((c - o) ^ 2)) > 1 AS drift FROM a JOIN b USING (label, i) GROUP BY 1")
def centroid_drift(spark: SparkSession, d: str) -> DataFrame:
    e = star(spark, d, "embeddings")
    return ops.centroid_drift(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "embedding").withColumn("shift", F.round("shift", 6))


@query(f"WITH {LONG}, c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY 1, 2), d AS (SELECT vec_id, v.label AS own, c.label AS near, sum((x - c) ^ 2) AS d2 FROM v JOIN c USING (i) GROUP BY 1, 2, 3) SELECT vec_id, any_value(own) AS own, arg_min(near, row(d2, near)) AS near, round(sqrt(min(d2)), 5) AS distance FROM d GROUP BY 1")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Centroids are one row per label; points meet them as a broadcast array, so no row is multiplied beyond the labels."""
    e = star(spark, d, "embeddings")
    c = ops.centroids(e, "label", "embedding").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("v"))
    table = c.agg(F.array_sort(F.collect_list(F.struct("label", F.transform("v", lambda x: x["c"]).alias("v")))).alias("all"))
    distance = lambda v: F.aggregate(F.zip_with("embedding", v, lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("all", lambda t: F.struct(distance(t["v"]).alias("d2"), t["label"].alias("near"))))
    return e.crossJoin(F.broadcast(table)).select("vec_id", F.col("label").alias("own"), best.alias("b")).select("vec_id", "own", "b.near", F.round(F.sqrt("b.d2"), 5).alias("distance"))


U2U3 = f"WITH {eda.sql.CLEAN}, {eda.TICKET}, t AS (SELECT {eda.U2} AS true_segment, {eda.U3} AS predicted FROM ticket)"


def compared(spark: SparkSession, d: str) -> DataFrame:
    df = eda.tickets(spark, d)
    return df.select(rules.last_match(rules.ticket_rules()).alias("true_segment"), rules.last_match(rules.monitor_rules(), "Budget/Adventure").alias("predicted"))


@query(U2U3 + ", n AS (SELECT true_segment, predicted, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n), a AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM n GROUP BY true_segment)), b AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM n GROUP BY predicted)) SELECT round((x.s - a.s * b.s / (x.t * (x.t - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (x.t * (x.t - 1) / 2)), 6) AS ari FROM x, a, b")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return ops.adjusted_rand(compared(spark, d), "true_segment", "predicted").select(F.round("ari", 6).alias("ari"))


_PENALTY = "CASE true_segment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ops.PENALTY.items()) + " ELSE 1 END"


@query(U2U3 + f" SELECT true_segment, count(*) AS support, round(avg((true_segment = predicted)::INT), 3) AS recall, sum(CASE WHEN true_segment <> predicted THEN {_PENALTY} ELSE 0 END)::BIGINT AS cost FROM t GROUP BY 1")
def recall_cost(spark: SparkSession, d: str) -> DataFrame:
    return ops.recall_and_cost(compared(spark, d), "true_segment", "predicted")


@query(U2U3 + ", s AS (SELECT true_segment AS label, count(*) AS support, count(*) FILTER (true_segment = predicted) AS hit FROM t GROUP BY 1), g AS (SELECT predicted AS label, count(*) AS given FROM t GROUP BY 1), b AS (SELECT label, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(given, 0) AS given FROM s FULL JOIN g USING (label)), r AS (SELECT *, coalesce(hit / nullif(given, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM b) SELECT label, support, hit, given, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ops.class_metrics(compared(spark, d), "true_segment", "predicted").select("label", "support", "hit", "given", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(U2U3 + " SELECT true_segment, predicted, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY true_segment), 4) AS row_pct FROM t GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = compared(spark, d).groupBy("true_segment", "predicted").agg(F.count("*").alias("n"))
    return n.withColumn("row_pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("true_segment")), 4))


_DISP = f"WITH {LONG}, c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY 1, 2), p AS (SELECT vec_id, label, sum((x - c) ^ 2) AS d2 FROM v JOIN c USING (label, i) GROUP BY 1, 2), s AS (SELECT label, count(*) AS n, avg(sqrt(d2)) AS mean_d, sum(d2) AS sum_d2 FROM p GROUP BY 1)"


@query(_DISP + ", m AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) ^ 2)) AS m FROM c a JOIN c b USING (i) WHERE a.label <> b.label GROUP BY 1, 2), r AS (SELECT a, max((x.mean_d + y.mean_d) / m) AS r FROM m JOIN s x ON a = x.label JOIN s y ON b = y.label GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return ops.davies_bouldin(star(spark, d, "embeddings"), "label", "embedding", "vec_id").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(_DISP + ", g AS (SELECT i, avg(x) AS g FROM v GROUP BY 1), b AS (SELECT label, sum((c - g) ^ 2) AS b2 FROM c JOIN g USING (i) GROUP BY 1) SELECT round((sum(n * b2) / (count(*) - 1)) / (sum(sum_d2) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM b JOIN s USING (label)")
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return ops.calinski_harabasz(star(spark, d, "embeddings"), "label", "embedding", "vec_id").select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"WITH {LONG} SELECT label, i::INT AS i, round((avg(x) - any_value(m)) / any_value(s), 5) AS z FROM v JOIN (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY 1) USING (i) GROUP BY 1, 2")
def scaled_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Standardised with the population deviation; scaling commutes with the mean, so centroids are scaled, not rows."""
    long = ops.long_vectors(star(spark, d, "embeddings"), "embedding", "label")
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.groupBy("label", "i").agg(F.avg("x").alias("c")).join(F.broadcast(stats), "i").select("label", "i", F.round((F.col("c") - F.col("m")) / F.col("s"), 5).alias("z"))


_NAMES = list(ops.PENALTY.items())


_WEIGHTS = f"WITH {LONG}, pen(label, p) AS (VALUES " + ", ".join(f"({i}, {v})" for i, (_, v) in enumerate(_NAMES)) + "), n AS (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 10), c AS (SELECT label, i, avg(x) AS c FROM v SEMI JOIN n USING (label) GROUP BY 1, 2), w AS (SELECT i, 1 + sum(p * abs(c)) / (SELECT sum(p) FROM pen) AS w FROM c JOIN pen USING (label) GROUP BY 1) SELECT i::INT AS i, round(w / avg(w) OVER (), 6) AS weight FROM w"


@query(_WEIGHTS)
def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    """1 + penalty-weighted mean size of a feature's group means, over groups of ten or more; divided by the mean weight."""
    from pyspark.sql import Window

    e = star(spark, d, "embeddings")
    p = spark.createDataFrame([(i, float(v)) for i, (_, v) in enumerate(_NAMES)], "label int, p double")
    big = e.groupBy("label").count().where("count >= 10").select("label")
    c = ops.centroids(e.join(F.broadcast(big), "label", "left_semi"), "label", "embedding")
    w = c.join(F.broadcast(p), "label").groupBy("i").agg((1 + F.sum(F.col("p") * F.abs("c")) / float(sum(v for _, v in _NAMES))).alias("w"))
    return w.select("i", F.round(F.col("w") / F.avg("w").over(Window.partitionBy()), 6).alias("weight"))


@query(f"SELECT i, weight FROM ({_WEIGHTS}) ORDER BY weight DESC, i LIMIT 15")
def top_weights(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen features of most weight."""
    return feature_weights(spark, d).orderBy(F.desc("weight"), "i").limit(15)


@query("SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, round(stddev_pop(count(*)) OVER (), 4) AS size_std FROM embeddings GROUP BY 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = star(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return n.select("label", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(w), 4).alias("pct"), F.round(F.stddev_pop("n").over(w), 4).alias("size_std"))


@query(f"WITH {LONG}, c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY 1, 2) SELECT label, i::INT AS i, round((c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w + 1e-9), 5) AS norm FROM c WINDOW w AS (PARTITION BY i)")
def normalised_centroids(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("i")
    c = ops.centroids(star(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "i", F.round((F.col("c") - F.min("c").over(w)) / (F.max("c").over(w) - F.min("c").over(w) + 1e-9), 5).alias("norm"))


@query(f"WITH {eda.sql.CLEAN}, {eda.TICKET}, s AS (SELECT cabin, region, count(*) AS n FROM ticket GROUP BY 1, 2) SELECT region, coalesce(sum(n) FILTER (cabin = 'Y'), 0)::BIGINT AS y, coalesce(sum(n) FILTER (cabin = 'W'), 0)::BIGINT AS w, coalesce(sum(n) FILTER (cabin = 'J'), 0)::BIGINT AS j FROM s GROUP BY 1")
def one_hot_sums(spark: SparkSession, d: str) -> DataFrame:
    """One-hot columns of a fixed category list, summed."""
    return eda.tickets(spark, d).groupBy("region").agg(*[F.sum((F.col("cabin") == v).cast("int")).alias(v.lower()) for v in "YWJ"])


@query(eda.sql.customer(", c AS (SELECT *, row_number() OVER (ORDER BY total_rev, customer_id) AS r, count(*) OVER () AS n FROM customer_) SELECT CASE WHEN r <= 1 + (n - 1) * 0.2::DOUBLE THEN 0 WHEN r <= 1 + (n - 1) * 0.4::DOUBLE THEN 1 WHEN r <= 1 + (n - 1) * 0.6::DOUBLE THEN 2 WHEN r <= 1 + (n - 1) * 0.8::DOUBLE THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM c GROUP BY 1"))
def value_quintiles(spark: SparkSession, d: str) -> DataFrame:
    """Near equal quintiles of the rank in order of value. Ranks come from sorted partitions and the sizes of those before them."""
    from tripstrata.functions.columns import quantile_bucket
    from tripstrata.operators.sampling import with_rank

    df = coupon.customers(coupon.bookings(coupon.clean(spark, d))).select("customer_id", "total_rev")
    ranked, n = with_rank(df, "total_rev", "customer_id")
    return ranked.withColumn("bucket", quantile_bucket(F.col("rank"), F.lit(n), 5)).groupBy("bucket").agg(F.count("*").alias("n"))
