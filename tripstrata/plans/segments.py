"""Queries over profiles, names, matrices and rankings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.operators import comparison, coupon, monitor, rules
from tripstrata.operators import segments as ops
from tripstrata.operators.sampling import cut_lineage
from tripstrata.plans import sql
from tripstrata.plans.base import query
from tripstrata.plans.monitor import LONG, nearest_centroid
from tripstrata.sources.tables import star

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NUMBERS = ("lead_days", "n_coupons", "n_directions", "max_tier", "min_tier", "dep_month", "age", "rev_pos")
FLAGS = ("is_award", "is_group", "any_business", "any_premium", "is_international", "is_domestic", "pilgrimage", "foreign_issue", "connecting", "flown_any", "refund_any", "age_known", "corp_channel", "sea_crew", "round_trip", "peak_month")
KINDS = {
    "channel": PRIORITIES, "dest_region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), "dep_month": tuple(range(1, 13)), "max_tier": tuple(range(1, 8)),
    "proxy_segment": ("Mabuhay Loyalist", "Corporate", "Pilgrimage", "OFW/Migrant", "Balikbayan/VFR"),
}


def booked(spark: SparkSession, d: str) -> DataFrame:
    return coupon.bookings(coupon.clean(spark, d))


@query("""WITH t AS (SELECT o_orderkey % 50 = 0 AS bad, o_orderdate::DATE AS day FROM orders),
s AS (SELECT CASE WHEN bad THEN 'n/a' ELSE strftime(day, '%-d/%-m/%Y') END AS a, CASE WHEN bad THEN '13/1/' ELSE strftime(day, '%-m/%-d/%y') END AS b FROM t)
SELECT year(try_strptime(a, '%d/%m/%Y')) AS year, count(*) AS n, count(*) FILTER (try_strptime(a, '%d/%m/%Y') = try_strptime(b, '%m/%d/%y')) AS same FROM s GROUP BY 1""")
def date_orders(spark: SparkSession, d: str) -> DataFrame:
    """Dates written day first and month first, read back; what can't be read is NULL."""
    bad, day = F.col("o_orderkey") % 50 == 0, F.col("o_orderdate")
    s = star(spark, d, "orders").select(F.when(bad, "n/a").otherwise(F.date_format(day, "d/M/yyyy")).alias("a"), F.when(bad, "13/1/").otherwise(F.date_format(day, "M/d/yy")).alias("b"))
    read = s.select(ops.date_day_first(F.col("a")).alias("a"), ops.date_month_first(F.col("b")).alias("b"))
    return read.groupBy(F.year("a").cast("long").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("SELECT trim(split_part(p_brand || ' / ' || p_type, '/', 1)) AS brand, count(*) AS n FROM part GROUP BY 1")
def first_parts(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").groupBy(ops.first_part(F.concat("p_brand", F.lit(" / "), "p_type")).alias("brand")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS k FROM customer), v AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT k FROM s WHERE k IS NOT NULL)) SELECT coalesce(code, -1)::INT AS code, any_value(s.k) AS k, count(*) AS n FROM s LEFT JOIN v USING (k) GROUP BY 1")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    s = star(spark, d, "customer").select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("k"))
    return ops.with_codes(s, "k", "code").groupBy("code").agg(F.max("k").alias("k"), F.count("*").alias("n"))


@query(sql.booking("SELECT proxy_segment, count(dest_region) AS n FROM booking GROUP BY 1 HAVING count(dest_region) > 0"))
def without_unknown_region(spark: SparkSession, d: str) -> DataFrame:
    return booked(spark, d).dropna(subset=["dest_region"]).groupBy("proxy_segment").agg(F.count("*").alias("n"))


_PROFILE = """, c AS (SELECT *, customer_id % 8 AS cluster FROM booking),
top AS (SELECT cluster, proxy_segment AS dominant FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, proxy_segment) = 1),
p AS (SELECT cluster, count(*) AS size, median(lead_days) AS med_lead_days, median(max_tier) AS med_max_tier, round(100.0 * avg(is_international::INT), 1) AS pct_is_international, round(100.0 * avg(round_trip::INT), 1) AS pct_round_trip, round(100.0 * avg(any_premium::INT), 1) AS pct_any_premium FROM c GROUP BY 1)
SELECT p.*, dominant, (CASE WHEN pct_is_international >= 60 THEN 'International' WHEN pct_is_international <= 40 THEN 'Domestic' ELSE 'Mixed' END) || ' · ' ||
 (CASE WHEN med_lead_days <= 3 THEN 'last-minute' WHEN med_lead_days <= 14 THEN 'short lead' WHEN med_lead_days <= 45 THEN 'planned' ELSE 'early' END) || ' · ' ||
 (CASE WHEN med_max_tier >= 5 THEN 'premium' WHEN med_max_tier >= 3 THEN 'standard' ELSE 'saver' END) AS name FROM p JOIN top USING (cluster)"""


@query(sql.booking(_PROFILE))
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Size, medians, flags and dominant segment of each cluster (of customers, by number), and a name from them."""
    c = booked(spark, d).withColumn("cluster", F.col("customer_id") % 8)
    p = ops.profiles(c, "cluster", ("lead_days", "max_tier"), ("is_international", "round_trip", "any_premium"), "proxy_segment")
    return p.withColumn("name", ops.cluster_name(F.col("pct_is_international"), F.col("med_lead_days"), F.col("med_max_tier")))


@query(sql.booking("SELECT proxy_segment = 'Unassigned' AS noise, count(*) AS n, round(avg(lead_days), 4) AS lead_days, round(avg(n_coupons), 4) AS n_coupons, round(avg(rev_pos), 2) AS rev_pos FROM booking GROUP BY 1"))
def noise_means(spark: SparkSession, d: str) -> DataFrame:
    """Feature means of what no rule or cluster took against the rest."""
    return booked(spark, d).groupBy((F.col("proxy_segment") == "Unassigned").alias("noise")).agg(F.count("*").alias("n"), F.round(F.avg("lead_days"), 4).alias("lead_days"), F.round(F.avg("n_coupons"), 4).alias("n_coupons"), F.round(F.avg("rev_pos"), 2).alias("rev_pos"))


def _sums(spark: SparkSession, d: str, kinds: dict) -> DataFrame:
    df, names = ops.matrix(booked(spark, d), (*NUMBERS, *FLAGS), kinds)
    sums = df.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.round(F.sum("x"), 2).alias("total"))
    return sums.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "i int, feature string")), "i").select("feature", "total")


def _sums_sql(kinds: dict) -> str:
    cells = [(c, f"coalesce({c}::DOUBLE, 0)") for c in NUMBERS] + [(c, f"coalesce({c}::INT, 0)") for c in FLAGS]
    cells += [(f"{c}={v}", f"coalesce(({c} = {v if isinstance(v, int) else repr(v)})::INT, 0)") for c, values in kinds.items() for v in values]
    return sql.booking(" UNION ALL ".join(f"SELECT '{n}' AS feature, round(sum({x})::DOUBLE, 2) AS total FROM booking" for n, x in cells))


@query(_sums_sql({}))
def compact_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Column sums of the 24-column feature matrix of bookings."""
    return _sums(spark, d, {})


@query(_sums_sql(KINDS))
def full_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Column sums of the 58-column matrix: numbers, flags and one-hot kinds."""
    return _sums(spark, d, KINDS)


@query(sql.booking(", t AS (SELECT *, customer_id % 5 <> 0 AS train FROM booking), f AS (SELECT avg(lead_days) AS m, stddev_pop(lead_days) AS s, avg(n_coupons) AS m2, stddev_pop(n_coupons) AS s2 FROM t WHERE train) SELECT train, round(avg((lead_days - m) / s), 5) + 0.0 AS lead_days, round(avg((n_coupons - m2) / s2), 5) + 0.0 AS n_coupons, round(stddev_pop((lead_days - m) / s), 5) AS spread, round(avg(is_international::INT), 5) AS abroad FROM t, f GROUP BY 1"))
def mixed_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Numbers scaled by what the training rows have, flags left alone: means of both parts."""
    df = booked(spark, d).withColumn("train", F.col("customer_id") % 5 != 0).select("train", F.col("lead_days").cast("double").alias("lead_days"), F.col("n_coupons").cast("double").alias("n_coupons"), "is_international")
    out = ops.scaled(df, ("lead_days", "n_coupons"), F.col("train"))
    return out.groupBy("train").agg((F.round(F.avg("lead_days"), 5) + 0.0).alias("lead_days"), (F.round(F.avg("n_coupons"), 5) + 0.0).alias("n_coupons"), F.round(F.stddev_pop("lead_days"), 5).alias("spread"), F.round(F.avg(F.col("is_international").cast("int")), 5).alias("abroad"))


@query(sql.booking(", p(segment, penalty) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in monitor.PENALTY.items()) + ") SELECT segment, penalty FROM p ANTI JOIN (SELECT proxy_segment AS segment FROM booking GROUP BY 1 HAVING count(*) >= 100) USING (segment)"))
def penalties_without_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Segments that have a penalty but not a hundred seeds."""
    p = spark.createDataFrame(list(monitor.PENALTY.items()), "segment string, penalty int")
    seeds = booked(spark, d).groupBy(F.col("proxy_segment").alias("segment")).agg(F.count("*").alias("n")).where("n >= 100")
    return p.join(seeds, "segment", "left_anti")


@query(sql.booking(", m AS (SELECT median(k) AS mid FROM (SELECT DISTINCT dep_month AS k FROM booking)) SELECT dep_month <= mid AS reference, count(*) AS n, min(dep_month)::INT AS first_month, max(dep_month)::INT AS last_month FROM booking, m GROUP BY 1"))
def median_month_split(spark: SparkSession, d: str) -> DataFrame:
    return ops.median_month(booked(spark, d), "dep_month", "customer_id").groupBy("reference").agg(F.count("*").alias("n"), F.min("dep_month").alias("first_month"), F.max("dep_month").alias("last_month"))


WATCHED = ("lead_days", "n_coupons", "n_directions", "max_tier", "age")


def _psi_sql(x: str) -> str:
    """The stability index of one column over the deciles of the reference."""
    return f"""SELECT '{x}' AS feature, sum((q - p) * ln(q / p)) AS psi FROM (SELECT greatest(coalesce(p, 0), 1e-6) AS p, greatest(coalesce(q, 0), 1e-6) AS q
 FROM (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM (SELECT len(list_filter(e, lambda y: {x} >= y)) AS bin FROM old, edge_{x} WHERE {x} IS NOT NULL) GROUP BY 1)
 FULL JOIN (SELECT bin, count(*) / sum(count(*)) OVER () AS q FROM (SELECT len(list_filter(e, lambda y: {x} >= y)) AS bin FROM new_, edge_{x} WHERE {x} IS NOT NULL) GROUP BY 1) USING (bin))"""


_RETRAIN = (
    ", split AS (SELECT booking.*, dominant_segment, dep_month <= mid AS reference FROM booking JOIN customer_ USING (customer_id), (SELECT median(k) AS mid FROM (SELECT DISTINCT dep_month AS k FROM booking))), old AS (SELECT * FROM split WHERE reference), new_ AS (SELECT * FROM split WHERE NOT reference), "
    + ", ".join(f"edge_{x} AS (SELECT e[2:len(e) - 1] AS e FROM (SELECT list_sort(list_distinct(quantile_cont({x}, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM old))" for x in WATCHED)
    + ", features AS (" + " UNION ALL ".join(map(_psi_sql, WATCHED)) + """), sp AS (SELECT proxy_segment AS k, count(*) / sum(count(*)) OVER () AS p FROM old GROUP BY 1), sq AS (SELECT proxy_segment AS k, count(*) / sum(count(*)) OVER () AS q FROM new_ GROUP BY 1),
 mix AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM (SELECT greatest(coalesce(p, 0), 1e-6) AS p, greatest(coalesce(q, 0), 1e-6) AS q FROM sp FULL JOIN sq USING (k))),
 cell AS (SELECT proxy_segment AS a, dominant_segment AS b, count(*) AS n FROM split GROUP BY 1, 2), ra AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM cell GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM cell GROUP BY b)),
 rand AS (SELECT (s - ra.v * rb.v / (t * (t - 1) / 2.0)) / ((ra.v + rb.v) / 2.0 - ra.v * rb.v / (t * (t - 1) / 2.0)) AS ari FROM (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS t FROM cell), ra, rb),
 found AS (SELECT mix.psi AS psi_segment, (SELECT count(*) FROM features WHERE psi > 0.10) AS n_features, ari, (SELECT 100.0 * avg((proxy_segment = 'Unassigned')::INT) FROM split) AS noise_pct FROM mix, rand)
SELECT round(psi_segment, 6) AS psi_segment, n_features, round(ari, 6) AS ari, round(noise_pct, 4)::DOUBLE AS noise_pct,
 concat_ws(', ', CASE WHEN psi_segment > 0.25 THEN 'segment mix' END, CASE WHEN n_features >= 2 THEN 'features' END, CASE WHEN ari < 0.75 THEN 'agreement' END, CASE WHEN noise_pct > 12 THEN 'noise' END) AS reasons,
 psi_segment > 0.25 OR n_features >= 2 OR ari < 0.75 OR noise_pct > 12 AS retrain FROM found"""
)


#: What the rollup of customers reads of bookings.
_ROLLED_UP = ("customer_id", "issue_date", "proxy_segment", "rev_pos", "n_coupons", "is_international", "round_trip", "any_premium", "is_award", "any_business", "sea_crew", "dest_region", "all_nonrev")


@query(sql.customer(_RETRAIN))
def retrain_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether segments have to be fitted anew: the mix and the features of late months against early ones, the agreement of a booking's
    segment with its customer's, and the share of unassigned bookings. Bookings are stored once, what is watched of them is read once for
    the features of either half, and all else is taken from counts of segments."""
    bk = cut_lineage(booked(spark, d).select(*_ROLLED_UP, *[x for x in (*WATCHED, "dep_month") if x not in _ROLLED_UP]))
    main = coupon.customers(bk).select("customer_id", "dominant_segment")
    halves = ops.median_month(bk, "dep_month", "customer_id")
    counts = halves.groupBy("customer_id", "proxy_segment", "reference").agg(F.count("*").alias("n")).join(main, "customer_id")
    both = cut_lineage(counts.groupBy("proxy_segment", "dominant_segment", "reference").agg(F.sum("n").alias("n")))
    noise = both.agg((F.lit(100.0) * F.sum(F.when(F.col("proxy_segment") == "Unassigned", F.col("n")).otherwise(0)) / F.sum(F.when(F.col("proxy_segment").isNotNull(), F.col("n")))).alias("noise_pct"))
    mix = monitor.psi_terms(both.where("reference"), both.where("NOT reference"), "proxy_segment", "n")
    features = monitor.feature_psi(halves.where("reference"), halves.where("NOT reference"), list(WATCHED))
    got = monitor.retrain_decision(mix, features, monitor.adjusted_rand(both, "proxy_segment", "dominant_segment", "n"), noise)
    return got.withColumns({"psi_segment": F.round("psi_segment", 6), "ari": F.round("ari", 6), "noise_pct": F.round("noise_pct", 4)})


def labelings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The embeddings, and labels of them that rules give: as they are given, of the nearest centroid, that one where both agree (else
    noise), the signs of two elements, and one cluster."""
    e = star(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    near = nearest_centroid(spark, d).select("vec_id", "own", "near")
    found = {
        "given": e, "nearest": near.withColumn("label", F.col("near")), "agreed": near.withColumn("label", F.when(F.col("own") == F.col("near"), F.col("near")).otherwise(-1)),
        "signs": e.withColumn("label", 2 * (F.col("embedding")[0] > 0).cast("int") + (F.col("embedding")[1] > 0).cast("int")), "one": e.withColumn("label", F.lit(0)),
    }
    return e, comparison.long_labels(found, "vec_id")


def measured(spark: SparkSession, d: str, asked: int | None = comparison.ASKED) -> DataFrame:
    """The metrics of labelings(), rounded, so that equal ones tie; silhouettes of `asked` rows, of all if it is None."""
    return rounded(comparison.scores(*labelings(spark, d), "vec_id", asked=asked))


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumns({m: F.round(m, k) for m, k in _DIGITS.items()})


_DIGITS = {"silhouette": 4, "davies_bouldin": 4, "calinski_harabasz": 3, "noise_pct": 4, "size_std": 4}
_BEFORE = f"""{LONG}, w AS (SELECT vec_id, i, x FROM v), e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY 1, 2),
d AS (SELECT vec_id, v.label AS own, c.label AS near, sum((x - c) ^ 2) AS d2 FROM v JOIN c USING (i) GROUP BY 1, 2, 3), near AS (SELECT vec_id, any_value(own) AS own, arg_min(near, row(d2, near)) AS near FROM d GROUP BY 1),
lab AS (SELECT 'given' AS method, vec_id, label FROM embeddings UNION ALL SELECT 'nearest', vec_id, near FROM near UNION ALL SELECT 'agreed', vec_id, CASE WHEN own = near THEN near ELSE -1 END FROM near
  UNION ALL SELECT 'signs', vec_id, 2 * (x[1] > 0)::INT + (x[2] > 0)::INT FROM e UNION ALL SELECT 'one', vec_id, 0 FROM e),
ok AS (SELECT * FROM lab WHERE label >= 0), sz AS (SELECT method, label, count(*) AS n FROM ok GROUP BY 1, 2),
noise AS (SELECT method, 100.0 * avg((label < 0)::INT) AS noise_pct FROM lab GROUP BY 1), shape AS (SELECT method, count(*) AS k, stddev_pop(n) AS size_std, sum(n) AS n FROM sz GROUP BY 1),
cen AS (SELECT method, label, i, avg(x) AS c FROM ok JOIN w USING (vec_id) GROUP BY 1, 2, 3), dist AS (SELECT method, label, vec_id, sum((x - c) ^ 2) AS d2 FROM ok JOIN w USING (vec_id) JOIN cen USING (method, label, i) GROUP BY 1, 2, 3),
sp AS (SELECT method, label, avg(sqrt(d2)) AS s, sum(d2) AS w FROM dist GROUP BY 1, 2),
apart AS (SELECT a.method, a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) ^ 2)) AS m FROM cen a JOIN cen b ON a.method = b.method AND a.i = b.i AND a.label <> b.label GROUP BY 1, 2, 3),
worst AS (SELECT p.method, p.a, max((x.s + y.s) / p.m) AS r FROM apart p JOIN sp x ON x.method = p.method AND x.label = p.a JOIN sp y ON y.method = p.method AND y.label = p.b GROUP BY 1, 2),
db AS (SELECT method, avg(r) AS davies_bouldin FROM worst GROUP BY 1), grand AS (SELECT method, i, sum(c * n) / sum(n) AS g FROM cen JOIN sz USING (method, label) GROUP BY 1, 2),
bt AS (SELECT method, sum(n * (c - g) ^ 2) AS b FROM cen JOIN sz USING (method, label) JOIN grand USING (method, i) GROUP BY 1), wt AS (SELECT method, sum(w) AS w FROM sp GROUP BY 1),
"""
_FAR = "far AS (SELECT p.method, p.vec_id, p.label AS own, q.label AS other, sum(list_distance(x.x, y.x)) AS s, count(*) AS n FROM "
_AFTER = """ p JOIN ok q ON p.method = q.method JOIN e x ON x.vec_id = p.vec_id JOIN e y ON y.vec_id = q.vec_id GROUP BY 1, 2, 3, 4),
ab AS (SELECT method, vec_id, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = other THEN n END) AS n, min(CASE WHEN own <> other THEN s / n END) AS b FROM far GROUP BY 1, 2),
sil AS (SELECT method, avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b, 1e-12) ELSE 0 END) AS silhouette FROM ab GROUP BY 1),
g AS (SELECT method, CASE WHEN k > 1 THEN round(silhouette, 4) END AS silhouette, CASE WHEN k > 1 THEN round(davies_bouldin, 4) END AS davies_bouldin,
  CASE WHEN k > 1 THEN round((b / (k - 1)) / (w / (n - k)), 3) END AS calinski_harabasz, round(noise_pct, 4)::DOUBLE AS noise_pct, k::INT AS n_clusters, round(size_std, 4) AS size_std
  FROM shape JOIN noise USING (method) JOIN bt USING (method) JOIN wt USING (method) LEFT JOIN db USING (method) LEFT JOIN sil USING (method))"""
_MEASURED = f"{_BEFORE}asked AS (SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {comparison.ASKED}),\n{_FAR}(SELECT * FROM ok WHERE vec_id IN (SELECT vec_id FROM asked)){_AFTER}"
_MEASURED_WHOLE = f"{_BEFORE}{_FAR}ok{_AFTER}"
_COSTS = {"silhouette": "-silhouette", "davies_bouldin": "davies_bouldin", "calinski_harabasz": "-calinski_harabasz", "noise_pct": "noise_pct", "size_std": "size_std"}
_RANKS = ", ".join(f"rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rank_{m}" for m, c in _COSTS.items())


@query(f"WITH {_MEASURED} SELECT * FROM g")
def labeling_scores(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette (of the comparison.ASKED rows with the smallest md5 of their id, against all rows), Davies-Bouldin, Calinski-Harabasz,
    noise, clusters and the deviation of their sizes of each labeling."""
    return measured(spark, d)


def ranked(scores: DataFrame) -> DataFrame:
    got = ops.leaderboard(scores)
    return got.select("method", *[f"rank_{m}" for m in ops.RANK_WEIGHTS], F.round("composite", 6).alias("composite"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_MEASURED}, r AS (SELECT *, {_RANKS} FROM g), s AS (SELECT method, " + ", ".join(f"rank_{m}::DOUBLE AS rank_{m}" for m in _COSTS) + ", round((3 * rank_silhouette + 2 * rank_davies_bouldin + 2 * rank_calinski_harabasz + 2 * rank_noise_pct + rank_size_std) / 10, 6)::DOUBLE AS composite FROM r) SELECT *, rank() OVER (ORDER BY composite) AS place FROM s")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Labelings ranked on five metrics with averaged ties and weights 3, 2, 2, 2, 1; method_leaderboard ranks fitted methods."""
    return ranked(measured(spark, d))


@query(f"WITH {_MEASURED_WHOLE} SELECT method, " + ", ".join(f"round({'1 - ' if m in ops.LESS_IS_BETTER else ''}({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER () + 1e-9), 6) AS {m}" for m in _COSTS) + ", round(1 - abs(n_clusters - 10) / 10.0, 6)::DOUBLE AS n_clusters FROM g")
def display_scores(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the labelings from 0 to 1; silhouettes are those of all rows."""
    return ops.display_scores(measured(spark, d, asked=None))


@query(f"WITH {LONG}, c AS (SELECT label, i, avg(x) AS c FROM v WHERE label <> 0 GROUP BY 1, 2), d AS (SELECT vec_id, c.label AS near, sum((x - c) ^ 2) AS d2 FROM v JOIN c USING (i) WHERE v.label = 0 GROUP BY 1, 2) SELECT near AS label, count(*) AS n FROM (SELECT vec_id, arg_min(near, row(d2, near)) AS near FROM d GROUP BY 1) GROUP BY 1")
def noise_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Rows of label 0, as if they were noise, given to the nearest centroid of the others."""
    import numpy as np

    from tripstrata.operators.models import nearest

    e = star(spark, d, "embeddings")
    got = monitor.centroids(e.where("label <> 0"), "label", "embedding").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("v")).orderBy("label").collect()
    names = F.array(*[F.lit(r["label"]) for r in got])
    near = nearest(e.where("label = 0"), np.array([[x["c"] for x in r["v"]] for r in got]))
    return near.groupBy(F.element_at(names, F.col("label") + 1).alias("label")).agg(F.count("*").alias("n"))


_NAMED = [(n, c) for n, c in (("cabin_ord", "CASE WHEN cabin = 'J' THEN 2 WHEN cabin = 'W' THEN 1 ELSE 0 END"), ("crew", "(channel = '5-LOW')::INT"), ("mid_east", "(dest_region_of_leg = 'MIDDLE EAST')::INT"), ("agency", "(channel = '3-MEDIUM')::INT"), ("beyonds", "is_connecting::INT"), ("tmc", "(channel = '1-URGENT')::INT"), ("fare_per_pax", "coalesce(revenue, 0) / 100"), ("lead_time", "lead_time_days"), ("pax", "l_quantity / 20"), ("flex", "(farebrand LIKE '%Flex')::INT"), ("web", "(channel = '2-HIGH')::INT"), ("asean", "(dest_region_of_leg = 'ASIA')::INT"), ("saver", "(farebrand LIKE '%aver')::INT"), ("is_dom", "dom_coupon::INT"), ("australasia", "(dest_region_of_leg = 'AMERICA')::INT"))]
_NAME_SQL = "CASE WHEN cabin_ord >= 1.8 THEN 'Corporate' WHEN crew > 0.3 OR (mid_east > 0.4 AND agency > 0.35) THEN 'OFW/Migrant' WHEN beyonds > 0.4 THEN 'Balikbayan/VFR' WHEN cabin_ord >= 0.8 THEN 'Premium Bleisure' WHEN (tmc > 0.1 OR fare_per_pax > 300) AND lead_time < 15 AND pax < 2 THEN 'Corporate' WHEN lead_time <= 3 AND flex > 0.2 THEN 'Last-Minute' WHEN pax >= 3.5 THEN 'Pilgrimage / Family' WHEN mid_east > 0.25 OR agency > 0.55 THEN 'OFW/Migrant' WHEN beyonds > 0.2 AND pax >= 2 THEN 'Balikbayan/VFR' WHEN web > 0.35 AND asean > 0.15 AND pax < 1.5 THEN 'Digital Nomad' WHEN saver > 0.5 AND is_dom > 0.6 THEN 'Budget/Adventure' WHEN australasia > 0.15 OR (fare_per_pax > 180 AND lead_time > 14) THEN 'Premium Bleisure' ELSE 'Unassigned' END"


@query(sql.clean(", m AS (SELECT channel || '/' || cabin AS cluster, count(*) AS size, " + ", ".join(f"avg({c}) AS {n}" for n, c in _NAMED) + f" FROM clean GROUP BY 1) SELECT cluster, size, {_NAME_SQL} AS name FROM m"))
def centroid_names(spark: SparkSession, d: str) -> DataFrame:
    """Names from the means of clusters (channel and cabin), by the first rule that holds."""
    c = F.col
    flag = lambda p: p.cast("int")
    df = coupon.routed(coupon.clean(spark, d)).select(
        F.concat("channel", F.lit("/"), "cabin").alias("cluster"), F.when(c("cabin") == "J", 2).when(c("cabin") == "W", 1).otherwise(0).alias("cabin_ord"), flag(c("channel") == "5-LOW").alias("crew"),
        flag(c("dest_region") == "MIDDLE EAST").alias("mid_east"), flag(c("channel") == "3-MEDIUM").alias("agency"), flag(c("is_connecting")).alias("beyonds"), flag(c("channel") == "1-URGENT").alias("tmc"),
        (F.coalesce("revenue", F.lit(0.0)) / 100).alias("fare_per_pax"), c("lead_time_days").alias("lead_time"), (c("l_quantity") / 20).alias("pax"), flag(c("farebrand").endswith("Flex")).alias("flex"), flag(c("channel") == "2-HIGH").alias("web"),
        flag(c("dest_region") == "ASIA").alias("asean"), flag(c("farebrand").endswith("aver")).alias("saver"), flag(c("dom_coupon")).alias("is_dom"), flag(c("dest_region") == "AMERICA").alias("australasia"),
    )
    means = df.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(n).alias(n) for n, _ in _NAMED])
    return means.select("cluster", "size", rules.first_match(rules.centroid_rules()).alias("name"))


_P = "CASE true_segment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in monitor.PENALTY.items()) + " ELSE 1 END"


@query(sql.customer(f", l AS (SELECT customer_id, dominant_segment AS true_segment FROM customer_ WHERE customer_id % 3 = 0) SELECT true_segment, count(*) AS support, round(avg((true_segment = proxy_segment)::INT), 3) AS recall, sum(CASE WHEN true_segment <> proxy_segment THEN {_P} ELSE 0 END)::BIGINT AS cost FROM booking JOIN l USING (customer_id) GROUP BY 1"))
def labelled_recall(spark: SparkSession, d: str) -> DataFrame:
    """Bookings against the labels of some customers (their dominant segment): an inner join, then recall and cost of misses."""
    bk = booked(spark, d)
    labels = coupon.customers(bk).where("customer_id % 3 = 0").select("customer_id", F.col("dominant_segment").alias("true_segment"))
    return monitor.recall_and_cost(bk.join(labels, "customer_id"), "true_segment", "proxy_segment")
