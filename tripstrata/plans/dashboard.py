"""Dashboard queries over the coupon view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripstrata.functions.columns import share
from tripstrata.operators import coupon, monitor
from tripstrata.operators import dashboard as ops
from tripstrata.plans import sql
from tripstrata.plans.base import query

Y1, Y2 = ops.YEARS
#: A pair of places, for the slicers.
OD = "NATION_3-NATION_12"
_CABIN = ", ".join(f"({i}, '{c}', '{n}', {p}::DOUBLE)" for i, (c, n, p) in enumerate(ops.CABINS))
_SHOWN = ", ".join(f"('{s}')" for s in ops.SEGMENTS)
_ADVANCE = ", ".join(f"('{s}', {p}::DOUBLE)" for s, p in ops.ADVANCE.items())
FACTS = f"""cabin_(nth, cabin_code, cabin_name, part) AS (VALUES {_CABIN}), shown(segment) AS (VALUES {_SHOWN}), adv(segment, part) AS (VALUES {_ADVANCE}),
legs AS (SELECT *, year(departure_dt)::INT AS year, month(departure_dt)::INT AS month, trip_od AS od, 'X' || (('0x' || substr(md5(trip_od), 1, 5))::INT % 600 + CASE WHEN l_linenumber > 1 THEN 101 ELSE 100 END) AS flight FROM clean),
pax AS (SELECT year, month, od, flight, cabin AS cabin_code, proxy_segment AS segment, sum(pax_count)::BIGINT AS pax, coalesce(sum(round(revenue * 100)::BIGINT) FILTER (revenue > 0 AND NOT legs.is_refund), 0)::BIGINT AS cents, max(dom_coupon) AS domestic
 FROM legs JOIN (SELECT customer_id, issue_date, proxy_segment FROM booking) USING (customer_id, issue_date) GROUP BY ALL),
seats AS (SELECT year, month, od, flight, cabin_code, cabin_name, floor({ops.SEATS} * ops * part)::INT AS seats FROM (SELECT year, month, od, flight, count(DISTINCT departure_dt::DATE) AS ops FROM legs GROUP BY ALL) CROSS JOIN cabin_)"""


def facts(text: str) -> str:
    return sql.booking(f", {FACTS} {text}")


def pax(spark: SparkSession, d: str) -> DataFrame:
    clean = coupon.clean(spark, d)
    return ops.passengers(clean, coupon.bookings(clean))


@query(facts("SELECT year, month, od, flight, cabin_code, cabin_name, segment, pax, cents / 100.0::DOUBLE AS revenue, (cents // pax) / 100.0::DOUBLE AS avg_fare FROM pax JOIN cabin_ USING (cabin_code)"))
def passenger_facts(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(c, n) for c, n, _ in ops.CABINS], "cabin_code string, cabin_name string")
    revenue = F.col("cents") / 100.0
    return pax(spark, d).join(F.broadcast(names), "cabin_code").select("year", "month", "od", "flight", "cabin_code", "cabin_name", "segment", "pax", revenue.alias("revenue"), (F.expr("cents div pax") / 100.0).alias("avg_fare"))


@query(facts("SELECT * FROM seats"))
def capacity_facts(spark: SparkSession, d: str) -> DataFrame:
    return ops.capacity(coupon.clean(spark, d))


SUMS = f"coalesce(sum({{0}}) FILTER (year = {Y1}), 0)::BIGINT AS {{0}}_y1, coalesce(sum({{0}}) FILTER (year = {Y2}), 0)::BIGINT AS {{0}}_y2"


@query(facts(f""", g AS (SELECT segment, {SUMS.format('pax')}, {SUMS.format('cents')} FROM pax WHERE cabin_code = 'Y' GROUP BY 1), s AS (SELECT segment, coalesce(pax_y1, 0) AS pax_y1, coalesce(pax_y2, 0) AS pax_y2, coalesce(cents_y1, 0) / 100.0::DOUBLE AS revenue_y1, coalesce(cents_y2, 0) / 100.0::DOUBLE AS revenue_y2 FROM shown LEFT JOIN g USING (segment))
SELECT *, round(coalesce(revenue_y1 / nullif(pax_y1, 0), 0), 4) AS fare_y1, round(coalesce(revenue_y2 / nullif(pax_y2, 0), 0), 4) AS fare_y2 FROM s"""))
def yoy_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Passengers, revenue and fare of the shown segments in economy, by year; a segment without any has zeros."""
    g = ops.sliced(pax(spark, d), cabin="Y").groupBy("segment").agg(*[ops.years(x, i).alias(f"{x}_y{i + 1}") for x in ("pax", "cents") for i in (0, 1)])
    g = ops.shown(g).na.fill(0)
    # halves go up by whole numbers: a quotient of doubles can lie on either side of a half
    fares = [F.expr(f"coalesce((200 * cents_y{i} + pax_y{i}) div (2 * nullif(pax_y{i}, 0)), 0) / 1e4").alias(f"fare_y{i}") for i in (1, 2)]
    return g.select("segment", *[F.col(f"pax_y{i}") for i in (1, 2)], *[(F.col(f"cents_y{i}") / 100.0).alias(f"revenue_y{i}") for i in (1, 2)], *fares)


@query(facts(f", n AS (SELECT segment, month, sum(pax)::BIGINT AS pax FROM pax WHERE year = {Y2} GROUP BY 1, 2) SELECT segment, list(coalesce(pax, 0) ORDER BY month)::VARCHAR AS monthly FROM (SELECT segment, unnest(range(1, 13))::INT AS month FROM shown) LEFT JOIN n USING (segment, month) GROUP BY 1"))
def monthly_vector(spark: SparkSession, d: str) -> DataFrame:
    """Twelve monthly sums per shown segment, in order, zero-filled."""
    n = pax(spark, d).where(F.col("year") == Y2).groupBy("segment", "month").agg(F.sum("pax").alias("pax"))
    grid = spark.createDataFrame([(s, m) for s in ops.SEGMENTS for m in range(1, 13)], "segment string, month int")
    full = grid.join(n, ["segment", "month"], "left").na.fill(0, ["pax"])
    values = F.transform(F.array_sort(F.collect_list(F.struct("month", "pax"))), lambda x: x["pax"].cast("string"))
    return full.groupBy("segment").agg(F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")).alias("monthly"))


@query(facts(f""", p AS (SELECT year, flight, sum(pax)::BIGINT AS pax FROM pax GROUP BY 1, 2), s AS (SELECT year, flight, sum(seats) AS seats FROM seats GROUP BY 1, 2), b AS (SELECT p.*, CASE WHEN coalesce(seats, 0) = 0 THEN 0 ELSE round(100.0::DOUBLE * pax / seats, 4) END AS lf FROM p LEFT JOIN s USING (year, flight))
SELECT flight, coalesce(max(lf) FILTER (year = {Y1}), 0) AS lf_y1, coalesce(max(pax) FILTER (year = {Y1}), 0) AS pax_y1, coalesce(max(lf) FILTER (year = {Y2}), 0) AS lf_y2, coalesce(max(pax) FILTER (year = {Y2}), 0) AS pax_y2 FROM b GROUP BY 1"""))
def load_factor(spark: SparkSession, d: str) -> DataFrame:
    clean = coupon.clean(spark, d)
    return ops.load_factor(ops.passengers(clean, coupon.bookings(clean)), ops.capacity(clean))


@query(facts(f", g AS (SELECT segment, coalesce(sum(pax) FILTER (year = {Y1}), 0) AS ly, coalesce(sum(pax) FILTER (year = {Y2}), 0) AS cy FROM pax WHERE month IN (11, 12, 1) GROUP BY 1) SELECT segment, floor(ly * part)::BIGINT AS ly_booked, floor(cy * part)::BIGINT AS cy_booked, floor(floor(cy * part) / part)::BIGINT AS projected FROM g JOIN adv USING (segment)"))
def advance_onhand(spark: SparkSession, d: str) -> DataFrame:
    """Booked ahead for the three months after October, and what that projects to."""
    return ops.advance(pax(spark, d), ops.forward(10, 3))


@query(facts("SELECT segment, round(sum(cents) / 100.0::DOUBLE / sum(pax), 4) AS revenue_per_pax, floor(100.0::DOUBLE * coalesce(sum(pax) FILTER (domestic), 0) / sum(pax))::INT AS dom_pct FROM pax GROUP BY 1"))
def behaviour(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of a passenger and the whole percent of domestic ones, by segment."""
    dom = F.sum(F.when(F.col("domestic"), F.col("pax")).otherwise(0))
    return pax(spark, d).groupBy("segment").agg(F.round(F.sum("cents") / 100.0 / F.sum("pax"), 4).alias("revenue_per_pax"), F.floor(F.lit(100.0) * dom / F.sum("pax")).cast("int").alias("dom_pct"))


YOY = "round_even((y2 - y1) / (CASE WHEN y1 = 0 THEN 1 ELSE y1 END)::DOUBLE * 100.0::DOUBLE, 0)"


@query(facts(f", g AS (SELECT od, segment, coalesce(sum(pax) FILTER (year = {Y1}), 0)::BIGINT AS y1, coalesce(sum(pax) FILTER (year = {Y2}), 0)::BIGINT AS y2 FROM pax WHERE year IN ({Y1}, {Y2}) GROUP BY 1, 2) SELECT *, {YOY} AS yoy FROM g WHERE abs({YOY}) >= 50"))
def yoy_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Sectors and segments whose passengers changed by half or more."""
    return ops.alerts(pax(spark, d), 50)


@query(facts(f""", y AS (SELECT * FROM pax WHERE year = {Y2}), g AS (SELECT coalesce(segment, 'TOTAL') AS segment, sum(pax)::BIGINT AS pax, sum(cents) / 100.0::DOUBLE AS revenue FROM y WHERE od = '{OD}' GROUP BY ROLLUP (segment) HAVING sum(pax) IS NOT NULL), n AS (SELECT segment, 100.0::DOUBLE * sum(pax) / sum(sum(pax)) OVER () AS net FROM y GROUP BY 1)
SELECT g.*, round(100.0::DOUBLE * pax / (SELECT pax FROM g WHERE segment = 'TOTAL'), 4) AS share, round(100.0::DOUBLE * pax / (SELECT pax FROM g WHERE segment = 'TOTAL') - coalesce(net, 100), 4) AS pp_delta FROM g LEFT JOIN n USING (segment)"""))
def totals_and_delta(spark: SparkSession, d: str) -> DataFrame:
    """Rows and total of a sector, shares, and the difference to the shares of the network in points."""
    df = pax(spark, d).where(F.col("year") == Y2)
    g = ops.sliced(df, od=OD).rollup("segment").agg(F.sum("pax").alias("pax"), (F.sum("cents") / 100.0).alias("revenue")).withColumn("segment", F.coalesce("segment", F.lit("TOTAL"))).where("pax IS NOT NULL")
    net = df.groupBy("segment").agg(F.sum("pax").alias("n")).withColumn("net", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).select("segment", "net")
    part = F.lit(100.0) * F.col("pax") / F.max("pax").over(Window.partitionBy())
    return g.join(net, "segment", "left").select("segment", "pax", "revenue", F.round(part, 4).alias("share"), F.round(part - F.coalesce("net", F.lit(100.0)), 4).alias("pp_delta"))


_LOSS = ", ".join(f"('{s}', {float(ops.LOSS * p)}::DOUBLE)" for s, p in monitor.PENALTY.items())


@query(sql.customer(f""", loss_(segment, loss) AS (VALUES {_LOSS}), g AS (SELECT proxy_segment AS segment, count(*) AS support, 100.0::DOUBLE * count(*) FILTER (dominant_segment = proxy_segment) / count(*) AS recall FROM booking JOIN (SELECT customer_id, dominant_segment FROM customer_) USING (customer_id) GROUP BY 1)
SELECT segment, support, round(recall, 4) AS recall, loss, floor(support * (1 - recall / 100.0::DOUBLE))::BIGINT AS missed, round(floor(support * (1 - recall / 100.0::DOUBLE)) * loss, 2) AS risk FROM g JOIN loss_ USING (segment)"""))
def revenue_risk(spark: SparkSession, d: str) -> DataFrame:
    """Revenue at risk where every booking is given its customer's dominant segment."""
    bk = coupon.bookings(coupon.clean(spark, d))
    return ops.risk(bk, coupon.customers(bk), monitor.PENALTY)


@query(facts(f"SELECT year, cabin_name, sum(pax)::BIGINT AS pax, round(100.0 * sum(pax) / sum(sum(pax)) OVER (), 4) AS share FROM pax JOIN cabin_ USING (cabin_code) WHERE month = 12 AND od = '{OD}' GROUP BY 1, 2"))
def sliced_mix(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(c, n) for c, n, _ in ops.CABINS], "cabin_code string, cabin_name string")
    return ops.sliced(pax(spark, d), month=12, od=OD).join(F.broadcast(names), "cabin_code").groupBy("year", "cabin_name").agg(F.sum("pax").alias("pax")).withColumn("share", share("pax"))


@query(facts(f", g AS (SELECT segment, sum(pax)::BIGINT AS n FROM pax GROUP BY 1), r(rate) AS (VALUES (1), (5), (10)) SELECT segment, rate, round(n * {ops.LOSS}.0::DOUBLE * rate / 100.0::DOUBLE, 2) AS uplift FROM g CROSS JOIN r"))
def uplift_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Value kept if so many percent of the misses were caught, by segment and rate."""
    g = pax(spark, d).groupBy("segment").agg(F.sum("pax").alias("n"))
    return g.withColumn("rate", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10)))).select("segment", "rate", F.round(F.col("n") * float(ops.LOSS) * F.col("rate") / 100.0, 2).alias("uplift"))
