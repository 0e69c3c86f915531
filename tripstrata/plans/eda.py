"""Exploration and rule queries over tickets, records and travellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripstrata.functions.columns import average_rank, bins, cents, clip, from_cents, null_false, share
from tripstrata.functions.quantiles import percentiles
from tripstrata.operators import coupon, rules
from tripstrata.operators import tickets as t
from tripstrata.operators.sampling import cut_lineage
from tripstrata.plans import sql
from tripstrata.plans.base import query
from tripstrata.sources.tables import star

TICKET = """ticket AS (SELECT customer_id, issue_date, departure_dt, farebrand, cabin, revenue, lead_time_days AS lead_time, l_quantity::INT % 6 + 1 AS pax,
 CASE dest_region_of_leg WHEN 'MIDDLE EAST' THEN 'Middle East' WHEN 'ASIA' THEN 'ASEAN' WHEN 'EUROPE' THEN 'Europe' WHEN 'AMERICA' THEN 'North America' WHEN 'AFRICA' THEN 'Africa' ELSE 'Unknown' END AS region,
 CASE channel WHEN '1-URGENT' THEN 'WEB/APP' WHEN '2-HIGH' THEN 'Traditional Travel Agency' WHEN '3-MEDIUM' THEN 'TMC' WHEN '4-NOT SPECIFIED' THEN 'Call Center' WHEN '5-LOW' THEN 'Sea Crew' ELSE 'Unknown' END AS channel,
 CASE WHEN dom_coupon THEN 'Domestic' WHEN origin_domestic = 0 AND dest_domestic = 1 THEN 'Beyonds (INT - DOM)' ELSE 'International' END AS itinerary, month(issue_date) AS booking_month,
 CASE cabin WHEN 'J' THEN 2 WHEN 'W' THEN 1 ELSE 0 END AS cabin_ord, coalesce(dom_coupon, false)::INT AS is_dom, revenue / (l_quantity::INT % 6 + 1) AS fare_per_pax, trip_od, dayofweek(departure_dt) + 1 AS dow FROM clean)"""
U2 = """CASE WHEN cabin = 'J' THEN 'Corporate' WHEN cabin = 'W' THEN 'Premium Bleisure' WHEN region = 'Middle East' OR channel = 'Sea Crew' THEN 'OFW/Migrant' WHEN itinerary = 'Beyonds (INT - DOM)' THEN 'Balikbayan/VFR'
 WHEN pax >= 4 AND channel = 'Traditional Travel Agency' THEN 'Pilgrimage' WHEN pax BETWEEN 3 AND 5 THEN 'Family' WHEN lead_time <= 3 THEN 'Last-Minute'
 WHEN pax = 1 AND region = 'ASEAN' AND channel = 'WEB/APP' AND farebrand IN ('Economy Flex', 'Economy Value') THEN 'Digital Nomad' WHEN farebrand IN ('Economy Supersaver', 'Economy Saver') THEN 'Budget/Adventure' ELSE 'Unassigned' END"""
U3 = """CASE WHEN cabin = 'J' THEN 'Corporate' WHEN cabin = 'W' THEN 'Premium Bleisure' WHEN region = 'Middle East' AND channel = 'Sea Crew' THEN 'OFW/Migrant' WHEN itinerary = 'Beyonds (INT - DOM)' THEN 'Balikbayan/VFR'
 WHEN region = 'Middle East' AND channel = 'Traditional Travel Agency' THEN 'Pilgrimage' WHEN pax BETWEEN 3 AND 5 THEN 'Family' WHEN lead_time <= 3 THEN 'Last-Minute' WHEN lead_time > 30 AND cabin = 'Y' AND pax = 1 THEN 'Digital Nomad' ELSE 'Budget/Adventure' END"""
U8 = """CASE WHEN lead_time <= 3 THEN 'Last-Minute' WHEN farebrand = 'Economy Supersaver' THEN 'Budget Leisure' WHEN itinerary = 'Beyonds (INT - DOM)' THEN 'Balikbayan' WHEN region = 'Middle East' THEN 'OFW (Mid East)' WHEN cabin = 'W' THEN 'Prem Bleisure (W)' WHEN cabin = 'J' THEN 'Corporate (J)' ELSE 'Other' END"""
RECORD = """rec0 AS (SELECT *, isodow_ - 1 AS dep_dow, month(departure_dt) AS dep_month, l_quantity::INT + 5 AS age, CASE cabin WHEN 'J' THEN 2 WHEN 'W' THEN 1 ELSE 0 END AS cabin_ord, l_quantity * 10 + origin_key AS ancillary,
 CASE WHEN origin_domestic = 1 THEN 'PH' ELSE 'AE' END AS point_of_origin, CASE dest_region_of_leg WHEN 'ASIA' THEN 'Asia' WHEN 'MIDDLE EAST' THEN 'MiddleEast' ELSE dest_region_of_leg END AS region_name FROM (SELECT * EXCLUDE (age, n_legs), isodow(departure_dt) AS isodow_ FROM clean)),
rec AS (SELECT *, (dep_dow IN (5, 6))::INT AS is_weekend, (dep_month IN (12, 3, 4, 5))::INT AS is_peak_season, (age < 12)::INT AS is_child, (channel = '3-MEDIUM')::INT AS is_gds, (channel = '4-NOT SPECIFIED')::INT AS is_ota, is_group_booking::INT AS is_group,
 (foreign_issue AND origin_domestic = 0)::INT AS pos_mismatch, CASE WHEN age < 12 THEN 'child' WHEN age < 25 THEN 'youth' WHEN age < 60 THEN 'adult' ELSE 'senior' END AS age_band,
 CASE WHEN dom_coupon THEN 'Domestic' WHEN region_name = 'Asia' THEN 'Regional' WHEN region_name IN ('MiddleEast', 'AMERICA', 'EUROPE') THEN 'LongHaul' ELSE 'Other' END AS haul_type,
 round(ancillary / nullif(origin_key * 100.0, 0), 6) AS ancillary_ratio, greatest(length(trip_od) // 3 - 1, 1)::INT AS n_legs FROM rec0),
cut AS (SELECT median(ancillary) AS m, quantile_cont(ancillary, 0.25) AS q FROM rec),
u4 AS (SELECT *, CASE WHEN cabin_ord = 2 OR (booking_class IN ('Y', 'J') AND is_gds = 1 AND lead_time_days <= 14 AND is_weekend = 0) THEN 'Corporate' WHEN cabin_ord >= 1 AND is_weekend = 1 AND ancillary > m THEN 'Premium Bleisure'
 WHEN pos_mismatch = 1 AND cabin_ord = 0 AND (region_name = 'MiddleEast' OR point_of_origin = 'AE') THEN 'OFW/Migrant' WHEN dest_domestic = 1 AND point_of_origin <> 'PH' AND haul_type <> 'LongHaul' AND cabin_ord = 0 THEN 'Balikbayan/VFR'
 WHEN is_group = 1 AND region_name = 'MiddleEast' AND is_peak_season = 1 THEN 'Pilgrimage' WHEN is_group = 1 AND cabin_ord = 0 AND (is_weekend = 1 OR is_child = 1) THEN 'Family' WHEN lead_time_days <= 3 THEN 'Last-Minute'
 WHEN is_group = 0 AND region_name = 'Asia' AND is_gds = 0 AND is_ota = 0 AND lead_time_days >= 60 THEN 'Digital Nomad' WHEN booking_class IN ('K', 'U') AND cabin_ord = 0 AND is_ota = 1 THEN 'Budget/Adventure' ELSE 'Unassigned' END AS seg FROM rec CROSS JOIN cut),
u5 AS (SELECT *, CASE WHEN (seg = 'Corporate' AND ((lead_time_days > 60 AND cabin_ord = 0) OR is_ota = 1)) OR (seg = 'Digital Nomad' AND is_group = 1) OR (seg = 'Premium Bleisure' AND ancillary <= q) THEN 'Unassigned' ELSE seg END AS seg_nl FROM u4)"""
TRAVELLER = """tr AS (SELECT customer_id, ['Economy','Economy','Premium Economy','Business','First'][l_quantity::INT % 5 + 1] AS seat, ['Low','Medium','High'][origin_key % 3 + 1] AS income, ['Leisure','Business','Family','Emergency'][dest_key % 4 + 1] AS purpose,
 ['Mobile App','Online','Kiosk','Counter'][(l_quantity::INT + origin_key) % 4 + 1] AS check_in, l_quantity::INT + 20 AS age, l_quantity::INT % 4 AS bags, lead_time_days AS lead_time, dest_key % 4 AS loyalty_ord, [0,0,1,2,3][l_quantity::INT % 5 + 1] AS cabin_ord, revenue FROM clean),
u6 AS (SELECT *, CASE WHEN purpose = 'Business' AND seat IN ('Business','First') THEN 'Corporate' WHEN loyalty_ord = 3 AND purpose IN ('Leisure','Family','Emergency') THEN 'Mabuhay Loyalist' WHEN seat IN ('Premium Economy','Business') AND purpose = 'Leisure' AND income = 'High' THEN 'Premium Bleisure'
 WHEN seat = 'Economy' AND bags >= 2 AND income = 'Low' AND purpose <> 'Business' THEN 'OFW/Migrant' WHEN purpose = 'Family' AND bags >= 2 AND income = 'High' THEN 'Balikbayan/VFR' WHEN age >= 55 AND income = 'Low' AND bags >= 2 AND purpose = 'Leisure' THEN 'Pilgrimage'
 WHEN purpose = 'Family' AND bags >= 2 AND income = 'Medium' THEN 'Family' WHEN purpose = 'Leisure' AND check_in IN ('Mobile App','Online') AND age < 40 AND income <> 'Low' THEN 'Digital Nomad' WHEN lead_time <= 3 OR purpose = 'Emergency' THEN 'Last-Minute'
 WHEN seat = 'Economy' AND income = 'Low' AND purpose = 'Leisure' THEN 'Budget/Adventure' ELSE 'Unassigned' END AS seg FROM tr),
u7 AS (SELECT *, CASE WHEN (seg = 'Corporate' AND lead_time > 60 AND cabin_ord = 0 AND loyalty_ord = 0) OR (seg = 'Mabuhay Loyalist' AND loyalty_ord = 0) OR (seg = 'OFW/Migrant' AND bags = 0) OR (seg = 'Premium Bleisure' AND income = 'Low') THEN 'Unassigned' ELSE seg END AS seg_nl FROM u6)"""


def ticket_sql(text: str) -> str:
    return f"WITH {sql.CLEAN}, {TICKET} {text}"


def record_sql(text: str) -> str:
    return f"WITH {sql.CLEAN}, {RECORD} {text}"


def traveller_sql(text: str) -> str:
    return f"WITH {sql.CLEAN}, {TRAVELLER} {text}"


def tickets(spark: SparkSession, d: str) -> DataFrame:
    return t.tickets(coupon.clean(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return tickets(spark, d).withColumn("segment", rules.last_match(rules.ticket_rules()))


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


@query(ticket_sql(f"SELECT {U2} AS segment, count(*) AS n, round(avg(fare_per_pax), 4) AS avg_fare FROM ticket GROUP BY 1"))
def ticket_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("fare_per_pax"), 4).alias("avg_fare"))


@query(ticket_sql(f"SELECT {U3} AS segment, count(*) AS n FROM ticket GROUP BY 1"))
def monitor_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return counted(tickets(spark, d).withColumn("segment", rules.last_match(rules.monitor_rules(), "Budget/Adventure")), "segment")


@query(ticket_sql(f"SELECT {U8} AS segment, count(*) AS n FROM ticket GROUP BY 1"))
def coarse_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return counted(tickets(spark, d).withColumn("segment", rules.last_match(rules.coarse_rules(), "Other")), "segment")


@query(ticket_sql("SELECT count(*) AS n, count(*) FILTER (cabin = 'J') AS corporate, count(*) FILTER (region = 'Middle East') AS mid_east, count(*) FILTER (cabin = 'W') AS bleisure, count(*) FILTER (itinerary = 'Beyonds (INT - DOM)') AS beyonds, count(*) FILTER (farebrand = 'Economy Supersaver') AS budget, count(*) FILTER (lead_time <= 3) AS last_minute, count(*) FILTER (channel = 'Sea Crew') AS crew, count(*) FILTER (channel = 'TMC') AS tmc FROM ticket"))
def overlapping_proxies(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return tickets(spark, d).agg(F.count("*").alias("n"), *[F.count_if(p).alias(k) for k, p in {"corporate": c("cabin") == "J", "mid_east": c("region") == "Middle East", "bleisure": c("cabin") == "W", "beyonds": c("itinerary") == "Beyonds (INT - DOM)", "budget": c("farebrand") == "Economy Supersaver", "last_minute": c("lead_time") <= 3, "crew": c("channel") == "Sea Crew", "tmc": c("channel") == "TMC"}.items()])


def joined_groups(df: DataFrame, more: DataFrame, group: str) -> DataFrame:
    """`df` with the columns of `more`, by a group that can be NULL."""
    more = more.withColumnRenamed(group, "__group")
    return df.join(more, df[group].eqNullSafe(more["__group"]), "left").drop("__group")


def record_labels(spark: SparkSession, d: str) -> DataFrame:
    """The two scalars of the rules are one-row aggregates, joined as a broadcast row."""
    df = t.records(coupon.clean(spark, d))
    cuts = percentiles(df, [], "ancillary", [0.5, 0.25], cut_lineage).select(F.col("q")[0].alias("anc_median"), F.col("q")[1].alias("anc_quarter"))
    df = df.crossJoin(F.broadcast(cuts))
    df = df.withColumn("segment", rules.last_match(rules.record_rules(["K", "U"], ["Y", "J"], F.col("anc_median"))))
    return df.withColumn("segment_nl", rules.without_contradictions(F.col("segment"), rules.record_contradictions(F.col("anc_quarter"))))


@query(record_sql("SELECT seg AS segment, seg_nl AS segment_nl, count(*) AS n FROM u5 GROUP BY 1, 2"))
def record_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return counted(record_labels(spark, d), "segment", "segment_nl")


@query(record_sql("SELECT haul_type, age_band, count(*) AS n, round(avg(ancillary_ratio), 5) AS avg_ratio, max(n_legs) AS max_legs, sum(is_weekend)::BIGINT AS weekend, sum(is_peak_season)::BIGINT AS peak FROM rec GROUP BY 1, 2"))
def record_features(spark: SparkSession, d: str) -> DataFrame:
    return t.records(coupon.clean(spark, d)).groupBy("haul_type", "age_band").agg(F.count("*").alias("n"), F.round(F.avg("ancillary_ratio"), 5).alias("avg_ratio"), F.max("n_legs").alias("max_legs"), F.sum("is_weekend").alias("weekend"), F.sum("is_peak_season").alias("peak"))


RECORD_FLAGS = {
    "red_eye": "(dest_key * 5 + coupon_number * 3) % 24 IN (22, 23, 0, 1, 2, 3, 4, 5)", "changed_itinerary": "sold_class <> booking_class", "is_premium_cabin": "cabin IN ('W', 'J')", "is_nonstop": "l_linenumber = 1",
    "is_connecting": "l_linenumber > 1", "is_domestic": "dom_coupon", "is_intl_pos": "foreign_issue", "gender_male": "customer_id % 3 = 1", "is_indirect": "channel IN ('3-MEDIUM', '4-NOT SPECIFIED')", "is_regional_carrier": "l_suppkey % 10 = 7",
}


@query(record_sql("SELECT haul_type, age_band, count(*) AS n, sum(coalesce(value_tier, 0))::BIGINT AS fare_tier, sum((dest_key * 5 + coupon_number * 3) % 24)::BIGINT AS dep_hours, " + ", ".join(f"count(*) FILTER ({p}) AS {n}" for n, p in RECORD_FLAGS.items()) + " FROM rec GROUP BY 1, 2"))
def record_flags(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each haul and age band have each of the 0/1 features, and the sums of tiers and hours."""
    df = t.record_flags(t.records(coupon.clean(spark, d)))
    return df.groupBy("haul_type", "age_band").agg(F.count("*").alias("n"), F.sum("fare_tier").alias("fare_tier"), F.sum("dep_hour").alias("dep_hours"), *[F.sum(f).alias(f) for f in t.FLAGS])


def traveller_labels(spark: SparkSession, d: str) -> DataFrame:
    df = t.travellers(coupon.clean(spark, d)).withColumn("segment", rules.last_match(rules.traveller_rules()))
    return df.withColumn("segment_nl", rules.without_contradictions(F.col("segment"), rules.traveller_contradictions()))


@query(traveller_sql("SELECT seg AS segment, seg_nl AS segment_nl, count(*) AS n FROM u7 GROUP BY 1, 2"))
def traveller_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return counted(traveller_labels(spark, d), "segment", "segment_nl")


LEAD_EDGES, LEAD_NAMES = [-1, 0, 3, 7, 14, 30, 60, 9999], ["0", "1-3", "4-7", "8-14", "15-30", "31-60", "60+"]


@query(ticket_sql("SELECT CASE WHEN lead_time <= -1 THEN NULL WHEN lead_time <= 0 THEN '0' WHEN lead_time <= 3 THEN '1-3' WHEN lead_time <= 7 THEN '4-7' WHEN lead_time <= 14 THEN '8-14' WHEN lead_time <= 30 THEN '15-30' WHEN lead_time <= 60 THEN '31-60' ELSE '60+' END AS bucket, count(*) AS n FROM ticket GROUP BY 1"))
def lead_buckets(spark: SparkSession, d: str) -> DataFrame:
    return counted(tickets(spark, d).withColumn("bucket", bins(F.col("lead_time"), LEAD_EDGES, LEAD_NAMES)), "bucket")


@query(ticket_sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM ticket GROUP BY {c}" for c in ("region", "cabin", "channel", "itinerary"))))
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Value counts of several columns in one pass: rows are unpivoted, then counted."""
    long = tickets(spark, d).select("region", "cabin", "channel", "itinerary").unpivot([], ["region", "cabin", "channel", "itinerary"], "feature", "value")
    n = counted(long, "feature", "value")
    return n.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("feature")), 4))


@query(ticket_sql("SELECT dow, least(greatest(pax, 0), 5) AS pax_clipped, count(*) AS n FROM ticket GROUP BY 1, 2"))
def party_by_weekday(spark: SparkSession, d: str) -> DataFrame:
    return counted(tickets(spark, d).withColumn("pax_clipped", clip(F.col("pax"), 0, 5)), "dow", "pax_clipped")


def width_bucket(x: Column, low: float, high: float, k: int) -> Column:
    return F.when(x.isNotNull(), F.least(F.floor((x - low) / ((high - low) / k)), F.lit(k - 1)))


@query(ticket_sql("SELECT CASE WHEN fare_per_pax IS NOT NULL THEN least(floor(least(greatest(fare_per_pax, 0), 60000) / 1000), 59)::BIGINT END AS bin, count(*) AS n FROM ticket GROUP BY 1"))
def fare_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = clip(F.col("fare_per_pax"), 0.0, 60000.0)
    return counted(tickets(spark, d).withColumn("bin", width_bucket(x, 0.0, 60000.0, 60).cast("long")), "bin")


@query(ticket_sql(""", c AS (SELECT cabin, round(revenue * 100)::BIGINT AS x FROM ticket WHERE revenue IS NOT NULL), q AS (SELECT cabin, quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3, sum(x)::DOUBLE / count(*) AS mean FROM c GROUP BY 1)
SELECT cabin, floor(any_value(q1) + 0.5) / 100 AS q1, floor(any_value(med) + 0.5) / 100 AS med, floor(any_value(q3) + 0.5) / 100 AS q3, floor(any_value(mean) + 0.5) / 100 AS mean, min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) / 100 AS low, max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) / 100 AS high FROM c JOIN q USING (cabin) GROUP BY 1"""))
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles per group, then whiskers at the last value within 1.5 interquartile ranges. Rows are counted by value once; both
    steps work on the counts, in cents."""
    n = tickets(spark, d).select("cabin", cents(F.col("revenue")).alias("x")).where("x IS NOT NULL").groupBy("cabin", "x").agg(F.count("*").alias("n"))
    q = n.groupBy("cabin").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    q = q.select("cabin", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"), "mean")
    x, reach = F.col("x"), 1.5 * (F.col("q3") - F.col("q1"))
    ends = [(F.min(F.when(x >= F.col("q1") - reach, x)) / 100).alias("low"), (F.max(F.when(x <= F.col("q3") + reach, x)) / 100).alias("high")]
    return n.join(F.broadcast(q), "cabin").groupBy("cabin").agg(*[from_cents(F.first(c)).alias(c) for c in ("q1", "med", "q3", "mean")], *ends)


@query(ticket_sql("SELECT region, round(median(fare_per_pax), 4) AS med_fare, median(lead_time) AS med_lead, count(*) AS n FROM ticket GROUP BY 1"))
def group_medians(spark: SparkSession, d: str) -> DataFrame:
    """Fares are free doubles, narrowed down by counting; lead times are few whole numbers. The columns are stored once, for both."""
    df = cut_lineage(tickets(spark, d).select("region", "fare_per_pax", "lead_time"))
    fares = percentiles(df, ["region"], "fare_per_pax", [0.5], cut_lineage, stored=True).select("region", F.round(F.col("q")[0], 4).alias("med_fare"))
    return joined_groups(df.groupBy("region").agg(F.median("lead_time").alias("med_lead"), F.count("*").alias("n")), fares, "region").orderBy("med_fare")


@query(ticket_sql(f", s AS (SELECT *, {U2} AS segment FROM ticket) SELECT segment, round(least(median(fare_per_pax) / 1000, 1), 6) AS fare, round(least(median(lead_time) / 90, 1), 6) AS lead, round(least((median(pax) - 1) / 9, 1), 6) AS party, round(avg((is_dom = 0)::INT), 6) AS intl, round(avg((farebrand = 'Economy Flex')::INT), 6) AS flex FROM s GROUP BY 1 HAVING count(*) >= 10"))
def radar(spark: SparkSession, d: str) -> DataFrame:
    """The tickets' columns are stored once, for the fares' rounds and all else."""
    df = cut_lineage(labelled(spark, d).select("segment", "fare_per_pax", "lead_time", "pax", "is_dom", (F.col("farebrand") == "Economy Flex").cast("int").alias("flex")))
    fares = percentiles(df, ["segment"], "fare_per_pax", [0.5], cut_lineage, stored=True).select("segment", F.round(F.least(F.col("q")[0] / 1000, F.lit(1.0)), 6).alias("fare"))
    g = df.groupBy("segment").agg(F.round(F.least(F.median("lead_time") / 90, F.lit(1.0)), 6).alias("lead"), F.round(F.least((F.median("pax") - 1) / 9, F.lit(1.0)), 6).alias("party"), F.round(F.avg((F.col("is_dom") == 0).cast("int")), 6).alias("intl"), F.round(F.avg("flex"), 6).alias("flex"), F.count("*").alias("n"))
    g = joined_groups(g, fares, "segment")
    return g.where("n >= 10").drop("n")


@query(ticket_sql(f", s AS (SELECT *, {U2} AS segment FROM ticket), g AS (SELECT segment, least(greatest(lead_time, 0), 180) AS x, count(*) AS k FROM s GROUP BY 1, 2), n AS (SELECT segment, sum(k) AS n FROM g GROUP BY 1 HAVING sum(k) > 10) SELECT segment, p.x::INT AS x, round(sum(k * exp(-0.5 * ((p.x - g.x) / 10.0) ^ 2)) / (any_value(n.n) * 10 * sqrt(2 * pi())), 8) AS density FROM g JOIN n USING (segment) CROSS JOIN (SELECT unnest(range(0, 181, 20)) AS x) p GROUP BY 1, 2"))
def lead_density(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian kernel density on a grid, over counts of distinct values: 181 values by 10 points per segment, whatever the rows."""
    g = counted(labelled(spark, d).withColumn("v", clip(F.col("lead_time"), 0, 180)), "segment", "v")
    g = g.withColumn("total", F.sum("n").over(Window.partitionBy("segment"))).where("total > 10").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(180), F.lit(20))))
    kernel = F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / 10.0, F.lit(2)))
    return g.groupBy("segment", "x").agg(F.round(F.sum(kernel) / (F.first("total") * 10 * F.sqrt(2 * F.pi())), 8).alias("density"))


@query(ticket_sql("SELECT trip_od, count(*) AS n FROM ticket GROUP BY 1 ORDER BY n DESC, trip_od LIMIT 15"))
def top_sectors(spark: SparkSession, d: str) -> DataFrame:
    return counted(tickets(spark, d), "trip_od").orderBy(F.desc("n"), "trip_od").limit(15)


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown') AS priority FROM orders WHERE o_totalprice > 0 AND (nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus IN ('O', 'F'))")
def null_pass_filter(spark: SparkSession, d: str) -> DataFrame:
    status = F.nullif("o_orderstatus", F.lit("P"))
    df = star(spark, d, "orders").where((F.col("o_totalprice") > 0) & (status.isNull() | status.isin("O", "F")))
    return df.select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("Unknown")).alias("priority"))


@query("SELECT c_custkey, coalesce(nullif(c_acctbal, 0), (SELECT median(c_acctbal) FROM customer WHERE c_acctbal > 0)) AS balance, ln(1 + greatest(c_acctbal, 0)) > 5 AS rich FROM customer")
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    df = star(spark, d, "customer")
    m = percentiles(df.where("c_acctbal > 0"), [], "c_acctbal", [0.5], cut_lineage).select(F.col("q")[0].alias("m"))
    return df.crossJoin(F.broadcast(m)).select("c_custkey", F.coalesce(F.nullif("c_acctbal", F.lit(0.0)), "m").alias("balance"), (F.log1p(F.greatest("c_acctbal", F.lit(0.0))) > 5).alias("rich"))


@query("SELECT n_nationkey, count(*) FILTER (c_acctbal IS NOT NULL) AS n, rank() OVER (ORDER BY count(*) DESC) + (count(*) OVER (PARTITION BY count(*)) - 1) / 2.0 AS avg_rank FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def ranked_nations(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d, "nation").join(star(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_nationkey").agg(F.count("*").alias("k"), F.count("c_acctbal").alias("n"))
    return average_rank(g, "k", "avg_rank", descending=True).drop("k")


@query(ticket_sql(f", s AS (SELECT {U2} AS segment, * FROM ticket), f AS (SELECT segment, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, segment) AS r FROM s GROUP BY 1) SELECT segment, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM f WHERE r <= 8"))
def leading_segments(spark: SparkSession, d: str) -> DataFrame:
    return counted(labelled(spark, d), "segment").orderBy(F.desc("n"), "segment").limit(8).withColumn("share", share("n"))


@query(ticket_sql("SELECT count(*) FILTER (coalesce(lead_time <= 3, false)) AS holds, count(*) FILTER (NOT coalesce(nullif(lead_time, 5) <= 3, false)) AS fails FROM ticket"))
def null_false_masks(spark: SparkSession, d: str) -> DataFrame:
    lead = F.col("lead_time")
    return tickets(spark, d).agg(F.count_if(null_false(lead <= 3)).alias("holds"), F.count_if(~null_false(F.nullif(lead, F.lit(5)) <= 3)).alias("fails"))
