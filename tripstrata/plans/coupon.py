"""Queries over coupons, bookings and customers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripstrata.functions.columns import cents, clip, counted_percentile, from_cents, pct, share
from tripstrata.operators import coupon as ops
from tripstrata.plans import sql
from tripstrata.plans.base import query
from tripstrata.sources.tables import star

FLAGS = ("flown", "foreign_issue", "is_connecting", "is_award", "class_award", "class_group", "class_nonrev", "is_refund", "is_group_booking", "rev_missing", "age_known")
MEASURES = ("n_coupons", "n_directions", "lead_days", "max_tier", "min_tier", "dep_month", "dest_region", "issue_country", "channel", "is_international", "is_domestic", "pilgrimage", "any_premium", "any_business", "is_award", "is_group", "foreign_issue", "corp_channel", "sea_crew", "connecting", "refund_any", "flown_any", "round_trip", "peak_month", "proxy_segment", "origin_first", "dest_last", "age", "age_known")


@query(sql.booking("SELECT proxy_segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, round(avg(rev_pos), 2) AS avg_rev FROM booking GROUP BY 1"))
def segment_profile(spark: SparkSession, d: str) -> DataFrame:
    bk = ops.bookings(ops.clean(spark, d))
    return bk.groupBy("proxy_segment").agg(F.count("*").alias("n"), F.round(F.avg("rev_pos"), 2).alias("avg_rev")).withColumn("share", share("n"))


@query(sql.clean("SELECT customer_id, issue_date::VARCHAR AS issue_date, departure_dt, lead_time_days, booking_class, sold_class, farebrand, value_tier, cabin, channel, revenue, net_fare, age, n_legs, sector_origin, sector_dest, booking_type, sector, origin_poo, online_od, flight_number, pax_count, is_nonstop, coupon_number, trip_od, src_file, iss_year, " + ", ".join(FLAGS) + " FROM clean"))
def clean_coupons(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean(spark, d).select("customer_id", F.col("issue_date").cast("string").alias("issue_date"), "departure_dt", "lead_time_days", "booking_class", "sold_class", "farebrand", "value_tier", "cabin", "channel", "revenue", "net_fare", "age", "n_legs", "sector_origin", "sector_dest", "booking_type", "sector", "origin_poo", "online_od", "flight_number", "pax_count", "is_nonstop", "coupon_number", "trip_od", "src_file", "iss_year", *FLAGS)


@query(sql.clean("SELECT " + ", ".join(f"round(100 * avg({f}::INT), 2) AS {f}" for f in FLAGS) + " FROM clean"))
def flag_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean(spark, d).agg(*[pct(F.col(f), 2).alias(f) for f in FLAGS])


@query(sql.clean("SELECT coalesce(farebrand, '(none)') AS farebrand, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM clean GROUP BY 1"))
def farebrand_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean(spark, d).groupBy(F.coalesce("farebrand", F.lit("(none)")).alias("farebrand")).agg(F.count("*").alias("n")).withColumn("share", share("n"))


@query(sql.clean("SELECT coalesce(value_tier::VARCHAR, 'NULL') AS tier, count(*) AS n FROM clean GROUP BY 1"))
def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean(spark, d).groupBy(F.coalesce(F.col("value_tier").cast("string"), F.lit("NULL")).alias("tier")).agg(F.count("*").alias("n")).orderBy("tier")


@query(sql.clean("SELECT count(*) FILTER (value_tier IS NULL) AS null_tier, count(*) FILTER (booking_class IN ('F', 'G')) AS dated FROM clean"))
def null_tier_identity(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean(spark, d).agg(F.count_if(F.col("value_tier").isNull()).alias("null_tier"), F.count_if(F.col("booking_class").isin("F", "G")).alias("dated"))


COLUMNS = ("customer_id", "issue_date", "booking_class", "value_tier", "channel", "trip_od", "revenue")


@query(sql.clean(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 3) AS null_pct, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS lowest, max({c})::VARCHAR AS highest FROM clean" for c in COLUMNS[:-1])))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts: values are counted per column first, so that few rows are left to be told apart."""
    df = ops.clean(spark, d).select(*COLUMNS[:-1])
    wide = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), (F.col(c).cast("long") if t in ("int", "bigint") else F.lit(None).cast("long")).alias("k")) for c, t in df.dtypes]))
    values = df.select(wide.alias("x")).select("x.*").groupBy("column_name", "v", "k").agg(F.count("*").alias("n"))
    some = values.groupBy("column_name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("v").alias("n_distinct"), *[f(x).alias(f"{p}_{x}") for p, f in (("low", F.min), ("high", F.max)) for x in "vk"])
    # numbers by value, all else as text
    ends = {to: F.coalesce(F.col(f"{p}_k").cast("string"), F.col(f"{p}_v")) for p, to in (("low", "lowest"), ("high", "highest"))}
    return some.select("column_name", "nulls", F.round(F.lit(100.0) * F.col("nulls") / F.col("n"), 3).alias("null_pct"), "n_distinct", *[v.alias(k) for k, v in ends.items()])


@query(None)
def column_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Approximate distinct counts of all columns, of every second one in a pass: rows of all columns are made by a method of over 8,000 bytes,
    which the JVM doesn't compile."""
    df = ops.clean(spark, d)

    def sketch(columns: list[str]) -> DataFrame:
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("about")) for c in columns])).alias("x")).select("x.*")

    return sketch(df.columns[::2]).unionByName(sketch(df.columns[1::2]))


@query(sql.clean(""", g AS (SELECT customer_id, count(*) AS n, count(DISTINCT issue_date::VARCHAR || '|' || trip_od) AS k, sum(revenue) AS r FROM clean GROUP BY 1)
SELECT count(*) AS n_ids, round(avg(n), 4) AS avg_rows, median(n) AS med_rows, max(n) AS max_rows, round(quantile_cont(n, 0.95), 4) AS p95_rows, round(avg(k), 4) AS avg_keys, count(*) FILTER (n > 1) AS repeat_ids, round(avg(r), 2) AS avg_revenue FROM g"""))
def grain_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    g = ops.clean(spark, d).groupBy("customer_id").agg(F.count("*").alias("n"), F.count_distinct(F.concat(c("issue_date").cast("string"), F.lit("|"), "trip_od")).alias("k"), F.sum("revenue").alias("r"))
    return g.agg(F.count("*").alias("n_ids"), F.round(F.avg("n"), 4).alias("avg_rows"), F.median("n").alias("med_rows"), F.max("n").alias("max_rows"), F.round(F.percentile("n", 0.95), 4).alias("p95_rows"), F.round(F.avg("k"), 4).alias("avg_keys"), F.count_if(c("n") > 1).alias("repeat_ids"), F.round(F.avg("r"), 2).alias("avg_revenue"))


@query(sql.clean("SELECT count(*) AS n, count(*) FILTER (revenue < 0) AS negative, count(*) FILTER (revenue = 0) AS zero, count(*) FILTER (revenue IS NULL) AS missing, round(avg(revenue), 2) AS mean, floor(median(round(revenue * 100)::BIGINT) + 0.5) / 100 AS median, floor(quantile_cont(round(revenue * 100)::BIGINT, 0.99) + 0.5) / 100 AS p99, round(max(revenue), 2) AS highest, count(*) FILTER (l_quantity > 45 OR l_quantity < 2) AS outliers FROM clean"))
def money_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows are counted by value (in cents) and outlier flag once; all figures come from the counts."""
    x, n = F.col("x"), F.col("n")
    out = (F.col("l_quantity") > 45) | (F.col("l_quantity") < 2)
    counts = ops.clean(spark, d).groupBy(cents(F.col("revenue")).alias("x"), out.alias("out")).agg(F.count("*").alias("n"))
    some = lambda p: F.coalesce(F.sum(F.when(p, n)), F.lit(0))
    q = F.percentile("x", F.array(F.lit(0.5), F.lit(0.99)), n)
    return counts.agg(F.sum("n").alias("n"), some(x < 0).alias("negative"), some(x == 0).alias("zero"), some(x.isNull()).alias("missing"), F.round(F.sum(x * n) / F.sum(F.when(x.isNotNull(), n)) / 100, 2).alias("mean"), from_cents(q[0]).alias("median"), from_cents(q[1]).alias("p99"), (F.max("x") / 100).alias("highest"), some(F.col("out")).alias("outliers"))


@query(sql.clean("SELECT src_file, count(*) AS n, min(issue_date)::VARCHAR AS first_issue, max(issue_date)::VARCHAR AS last_issue FROM clean GROUP BY 1"))
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean(spark, d).groupBy("src_file").agg(F.count("*").alias("n"), F.min("issue_date").cast("string").alias("first_issue"), F.max("issue_date").cast("string").alias("last_issue"))


@query(sql.clean("SELECT trip_od, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, trip_od LIMIT 10"))
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean(spark, d).groupBy("trip_od").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trip_od").limit(10)


@query(sql.clean(", g AS (SELECT customer_id, count(DISTINCT src_file) AS k FROM clean GROUP BY 1) SELECT round(100 * avg((k > 1)::INT), 2) AS pct_shared, round(100 * avg((k > 1)::INT), 2) > 1.0 AS ok FROM g"))
def guard_id_persistence(spark: SparkSession, d: str) -> DataFrame:
    g = ops.clean(spark, d).groupBy("customer_id").agg(F.count_distinct("src_file").alias("k"))
    return g.agg(pct(F.col("k") > 1, 2).alias("pct_shared")).withColumn("ok", F.col("pct_shared") > 1.0)


@query(sql.clean(", g AS (SELECT issue_country, median(revenue) AS m FROM clean WHERE revenue > 0 GROUP BY 1 HAVING count(*) > 50) SELECT count(*) AS n_countries, round(max(m) / nullif(min(m), 0), 1) AS spread, round(max(m) / nullif(min(m), 0), 1) < 20 AS ok FROM g"))
def guard_value_spread(spark: SparkSession, d: str) -> DataFrame:
    g = counted_percentile(ops.clean(spark, d).where("revenue > 0").withColumn("x", cents(F.col("revenue"))), ["issue_country"], "x", [0.5]).where("n > 50").select((F.col("q")[0] / 100).alias("m"))
    return g.agg(F.count("*").alias("n_countries"), F.round(F.try_divide(F.max("m"), F.min("m")), 1).alias("spread")).withColumn("ok", F.col("spread") < 20)


@query(sql.clean("SELECT customer_id FROM clean GROUP BY 1 HAVING bool_and(class_nonrev)"))
def excluded_customers(spark: SparkSession, d: str) -> DataFrame:
    return ops.excluded(ops.clean(spark, d))


@query(sql.clean(", x AS (SELECT customer_id FROM clean GROUP BY 1 HAVING bool_and(class_nonrev)) SELECT count(*) AS n FROM clean WHERE customer_id NOT IN (SELECT customer_id FROM x)"))
def coupons_without_excluded(spark: SparkSession, d: str) -> DataFrame:
    df = ops.clean(spark, d)
    return ops.not_in(df, "customer_id", ops.excluded(df), "customer_id").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def customers_not_in(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a pending order."""
    some = star(spark, d, "orders").where("o_orderstatus = 'P'")
    return ops.not_in(star(spark, d, "customer"), "c_custkey", some, "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 1000 THEN o_custkey END FROM orders)")
def customers_not_in_null(spark: SparkSession, d: str) -> DataFrame:
    """The same where one order or more has no known customer: none is left."""
    some = star(spark, d, "orders").select(F.when(F.col("o_totalprice") > 1000, F.col("o_custkey")).alias("k"))
    return ops.not_in(star(spark, d, "customer"), "c_custkey", some, "k").agg(F.count("*").alias("n"))


@query(sql.booking("SELECT customer_id, issue_date::VARCHAR AS issue_date, round(rev_pos, 2) AS rev_pos, " + ", ".join(MEASURES) + " FROM booking"))
def booking_features(spark: SparkSession, d: str) -> DataFrame:
    return ops.bookings(ops.clean(spark, d)).select("customer_id", F.col("issue_date").cast("string").alias("issue_date"), F.round("rev_pos", 2).alias("rev_pos"), *MEASURES)


@query(sql.customer("SELECT * REPLACE (last_issue::VARCHAR AS last_issue) FROM customer_"))
def customer_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ops.customers(ops.bookings(ops.clean(spark, d))).withColumn("last_issue", F.col("last_issue").cast("string"))


@query(sql.customer("SELECT dominant_segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, round(avg(total_rev), 2) AS avg_total FROM customer_ GROUP BY 1"))
def dominant_segments(spark: SparkSession, d: str) -> DataFrame:
    return ops.customers(ops.bookings(ops.clean(spark, d))).groupBy("dominant_segment").agg(F.count("*").alias("n"), F.round(F.avg("total_rev"), 2).alias("avg_total")).withColumn("share", share("n"))


@query(sql.booking("SELECT dest_region, is_international, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM booking GROUP BY 1, 2"))
def route_mix(spark: SparkSession, d: str) -> DataFrame:
    return ops.bookings(ops.clean(spark, d)).groupBy("dest_region", "is_international").agg(F.count("*").alias("n")).withColumn("share", share("n"))


@query(sql.booking("SELECT count(*) AS n_bookings, round(avg(n_coupons), 2) AS avg_coupons, round(100 * avg(round_trip::INT), 1) AS pct_round_trip, round(100 * avg((n_directions = 1)::INT), 1) AS pct_one_direction, round(100 * avg((n_directions > 2)::INT), 1) AS pct_gt2_dir FROM booking"))
def booking_grain(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return ops.bookings(ops.clean(spark, d)).agg(F.count("*").alias("n_bookings"), F.round(F.avg("n_coupons"), 2).alias("avg_coupons"), pct(c("round_trip")).alias("pct_round_trip"), pct(c("n_directions") == 1).alias("pct_one_direction"), pct(c("n_directions") > 2).alias("pct_gt2_dir"))


@query(sql.customer("SELECT CASE WHEN n_coupons >= 100 THEN '100+' WHEN n_coupons >= 40 THEN '40-99' WHEN n_coupons >= 8 THEN '8-39' ELSE '<8' END AS bucket, count(*) AS n_customers, round(100 * avg(any_sea_crew::INT), 1) AS pct_sea_crew, round(100 * avg(all_nonrev::INT), 2) AS pct_all_nonrev, min(n_coupons) AS from_coupons FROM customer_ GROUP BY 1"))
def heavy_tail(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    bucket = F.when(c("n_coupons") >= 100, "100+").when(c("n_coupons") >= 40, "40-99").when(c("n_coupons") >= 8, "8-39").otherwise("<8")
    return ops.customers(ops.bookings(ops.clean(spark, d))).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_customers"), pct(c("any_sea_crew")).alias("pct_sea_crew"), pct(c("all_nonrev"), 2).alias("pct_all_nonrev"), F.min("n_coupons").alias("from_coupons")).orderBy("from_coupons")


@query(sql.clean(", x AS (SELECT customer_id FROM clean GROUP BY 1 HAVING count(*) >= 50) SELECT channel, count(*) AS coupons FROM clean WHERE customer_id IN (SELECT customer_id FROM x) GROUP BY 1 ORDER BY coupons DESC, channel LIMIT 6"))
def tail_channels(spark: SparkSession, d: str) -> DataFrame:
    df = ops.clean(spark, d)
    heavy = df.groupBy("customer_id").count().where("count >= 50").select("customer_id")
    return df.join(heavy, "customer_id", "left_semi").groupBy("channel").agg(F.count("*").alias("coupons")).orderBy(F.desc("coupons"), "channel").limit(6)


@query(sql.clean("SELECT count(*) AS n, count(*) FILTER (lead_time_days < 0) AS n_negative, round(100 * avg((lead_time_days < 0)::INT), 3) AS pct_negative, min(lead_time_days) AS min_d, median(lead_time_days) AS med_d, round(avg(lead_time_days), 1) AS avg_d, max(lead_time_days) AS max_d, round(100 * avg((lead_time_days BETWEEN 0 AND 3)::INT), 2) AS pct_last_minute FROM clean"))
def lead_time_stats(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("lead_time_days")
    return ops.clean(spark, d).agg(F.count("*").alias("n"), F.count_if(x < 0).alias("n_negative"), pct(x < 0, 3).alias("pct_negative"), F.min(x).alias("min_d"), F.median(x).alias("med_d"), F.round(F.avg(x), 1).alias("avg_d"), F.max(x).alias("max_d"), pct(x.between(0, 3), 2).alias("pct_last_minute"))


@query(sql.customer("SELECT count(*) FILTER (ever_award) AS award_customers, count(*) FILTER (n_bookings >= 2) AS repeat_customers, count(*) FILTER (pct_premium > 0) AS premium_customers, count(*) AS n_customers, round(avg(tenure_days), 1) AS avg_tenure_days FROM customer_"))
def loyalty_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ops.customers(ops.bookings(ops.clean(spark, d))).agg(F.count_if("ever_award").alias("award_customers"), F.count_if(F.col("n_bookings") >= 2).alias("repeat_customers"), F.count_if(F.col("pct_premium") > 0).alias("premium_customers"), F.count("*").alias("n_customers"), F.round(F.avg("tenure_days"), 1).alias("avg_tenure_days"))


@query(sql.booking("SELECT count(*) AS n_bookings, count(*) FILTER (lead_days BETWEEN 0 AND 3) AS last_minute, count(*) FILTER (is_award) AS award, count(*) FILTER (any_business AND lead_days <= 7) AS corporate_like, count(*) FILTER (min_tier <= 2) AS budget_econ, count(*) FILTER (foreign_issue AND min_tier <= 4) AS diaspora_econ, count(*) FILTER (is_group) AS family_group, count(*) FILTER (any_premium AND NOT any_business) AS premium_leisure FROM booking"))
def seed_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return ops.bookings(ops.clean(spark, d)).agg(F.count("*").alias("n_bookings"), F.count_if(c("lead_days").between(0, 3)).alias("last_minute"), F.count_if("is_award").alias("award"), F.count_if(c("any_business") & (c("lead_days") <= 7)).alias("corporate_like"), F.count_if(c("min_tier") <= 2).alias("budget_econ"), F.count_if(c("foreign_issue") & (c("min_tier") <= 4)).alias("diaspora_econ"), F.count_if("is_group").alias("family_group"), F.count_if(c("any_premium") & ~c("any_business")).alias("premium_leisure"))


@query(sql.booking("SELECT least(greatest(lead_days, 0), 120) AS lead, count(*) AS n FROM booking GROUP BY 1"))
def clamped_lead(spark: SparkSession, d: str) -> DataFrame:
    return ops.bookings(ops.clean(spark, d)).groupBy(clip(F.col("lead_days"), 0, 120).alias("lead")).agg(F.count("*").alias("n"))


@query(sql.booking(", d AS (SELECT DISTINCT proxy_segment FROM booking), m AS (SELECT unnest(range(1, 13)) AS dep_month) SELECT proxy_segment, m.dep_month::INT AS dep_month, count(b.customer_id) AS n FROM d CROSS JOIN m LEFT JOIN booking b USING (proxy_segment, dep_month) GROUP BY 1, 2"))
def segment_months(spark: SparkSession, d: str) -> DataFrame:
    """Counts in the fixed domain of segments and months, zero-filled; the domain is 11 x 12 rows."""
    n = ops.bookings(ops.clean(spark, d)).groupBy("proxy_segment", "dep_month").agg(F.count("*").alias("n"))
    grid = n.select("proxy_segment").distinct().withColumn("dep_month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return grid.join(n, ["proxy_segment", "dep_month"], "left").na.fill(0, ["n"])


@query(None)
def dedup_check(spark: SparkSession, d: str) -> DataFrame:
    """Exact repeats of the natural key, estimated in one pass; nothing is removed."""
    df = star(spark, d, "lineitem")
    return df.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey")).alias("about_distinct"))


@query(sql.booking("SELECT proxy_segment, channel, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY proxy_segment), 4) AS row_share FROM booking GROUP BY 1, 2"))
def crosstab_share(spark: SparkSession, d: str) -> DataFrame:
    n = ops.bookings(ops.clean(spark, d)).groupBy("proxy_segment", "channel").agg(F.count("*").alias("n"))
    return n.withColumn("row_share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("proxy_segment")), 4))


@query(sql.booking("SELECT proxy_segment, count(*) FILTER (any_premium) AS premium, count(*) FILTER (NOT any_premium) AS economy FROM booking GROUP BY 1"))
def crosstab_pivot(spark: SparkSession, d: str) -> DataFrame:
    bk = ops.bookings(ops.clean(spark, d)).withColumn("kind", F.when(F.col("any_premium"), "premium").otherwise("economy"))
    return bk.groupBy("proxy_segment").pivot("kind", ["premium", "economy"]).agg(F.count("customer_id")).na.fill(0)
