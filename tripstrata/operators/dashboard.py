"""The dashboard's facts and measures over flown coupons: passengers and seats, load factor, alerts, advance bookings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.columns import cents

#: Code, name and part of a flight's seats.
CABINS = (("Y", "Economy", 0.8), ("W", "Premium Economy", 0.12), ("J", "Business", 0.08))
#: The segments that the dashboard shows, in this order.
SEGMENTS = ("Corporate", "OFW/Migrant", "Family", "Balikbayan/VFR", "Budget/Adventure")
#: The two years that are compared; seats of one departure.
YEARS, SEATS = (1996, 1997), 180
#: Part of the final passengers that is booked ahead, by segment.
ADVANCE = {"Corporate": 0.35, "OFW/Migrant": 0.55, "Family": 0.6, "Balikbayan/VFR": 0.65, "Budget/Adventure": 0.45}
#: What a missed record costs, by a penalty of one.
LOSS = 4000


def flight_base(od: Column) -> Column:
    """A flight number from 100 to 699 that only depends on the sector."""
    return (F.conv(F.substring(F.md5(od.cast("binary")), 1, 5), 16, 10).cast("int") % 600 + 100).cast("int")


def legs(coupons: DataFrame) -> DataFrame:
    """Coupons with year and month of departure, directed pair of places and flight; a connecting leg has the next flight number."""
    c = F.col
    flight = F.concat(F.lit("X"), (flight_base(c("trip_od")) + c("is_connecting").cast("int")).cast("string"))
    return coupons.withColumns({"year": F.year("departure_dt"), "month": F.month("departure_dt"), "od": c("trip_od"), "flight": flight})


def passengers(coupons: DataFrame, bookings: DataFrame) -> DataFrame:
    """pax, cents and domestic by year, month, od, flight, cabin and the booking's segment; refunds and missing amounts earn nothing.

    Coupons meet their booking by its key; customers without bookings are left out.
    """
    c = F.col
    segment = bookings.select("customer_id", "issue_date", c("proxy_segment").alias("segment"))
    earned = F.when(~c("is_refund") & (c("revenue") > 0), cents(c("revenue"))).otherwise(0)
    domestic = (c("origin_domestic") == 1) & (c("dest_domestic") == 1)
    return legs(coupons).join(segment, ["customer_id", "issue_date"]).groupBy("year", "month", "od", "flight", c("cabin").alias("cabin_code"), "segment").agg(
        F.sum("pax_count").alias("pax"), F.sum(earned).cast("long").alias("cents"), F.bool_or(domestic).alias("domestic"),
    )


def capacity(coupons: DataFrame) -> DataFrame:
    """Seats per flight, month and cabin: the days with a departure, by the seats of one, by the cabin's part."""
    cabin = coupons.sparkSession.createDataFrame(list(CABINS), "cabin_code string, cabin_name string, part double")
    ops = legs(coupons).groupBy("year", "month", "od", "flight").agg(F.count_distinct(F.to_date("departure_dt")).alias("ops"))
    return ops.crossJoin(F.broadcast(cabin)).withColumn("seats", F.floor(SEATS * F.col("ops") * F.col("part")).cast("int")).drop("ops", "part")


def sliced(df: DataFrame, month: int | None = None, od: str | None = None, flight: str | None = None, cabin: str | None = None) -> DataFrame:
    """The parameterised slicer; None is no filter."""
    for name, value in (("month", month), ("od", od), ("flight", flight), ("cabin_code", cabin)):
        df = df if value is None else df.where(F.col(name) == value)
    return df


def shown(df: DataFrame) -> DataFrame:
    """One row per segment that the dashboard shows, with nulls where `df` (segment, ...) has none."""
    domain = df.sparkSession.createDataFrame([(s,) for s in SEGMENTS], "segment string")
    return domain.join(df, "segment", "left")


def years(x: str, y: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("year") == YEARS[y], F.col(x))), F.lit(0))


def load_factor(pax: DataFrame, seats: DataFrame) -> DataFrame:
    """Passengers per hundred seats of a flight, by year; 0 where a flight has no seats."""
    p = pax.groupBy("year", "flight").agg(F.sum("pax").alias("pax"))
    s = seats.groupBy("year", "flight").agg(F.sum("seats").alias("seats"))
    both = p.join(s, ["year", "flight"], "left").na.fill(0, ["seats"]).withColumn("lf", F.coalesce(F.try_divide(F.lit(100.0) * F.col("pax"), F.col("seats")), F.lit(0.0)))
    wide = both.groupBy("flight").pivot("year", list(YEARS)).agg(F.round(F.first("lf"), 4).alias("lf"), F.first("pax").alias("pax"))
    return wide.select("flight", *[F.coalesce(F.col(f"{y}_{m}"), F.lit(0)).alias(f"{m}_y{i + 1}") for i, y in enumerate(YEARS) for m in ("lf", "pax")])


def alerts(pax: DataFrame, threshold: float) -> DataFrame:
    """Year-over-year change per (od, segment), where it reaches the threshold; half-even rounding, a prior year of 0 counts as 1."""
    of = lambda i: pax.where(F.col("year") == YEARS[i]).groupBy("od", "segment").agg(F.sum("pax").alias(f"y{i + 1}"))
    both = of(0).join(of(1), ["od", "segment"], "full").na.fill(0)
    yoy = F.bround((F.col("y2") - F.col("y1")) / F.when(F.col("y1") == 0, 1).otherwise(F.col("y1")) * 100.0, 0)
    return both.withColumn("yoy", yoy).where(F.abs("yoy") >= threshold).orderBy(F.desc(F.abs("yoy")), "od", "segment")


def advance(pax: DataFrame, months: list[int]) -> DataFrame:
    """Booked ahead for some months, last year and this, in whole passengers, and what that projects to."""
    part = pax.sparkSession.createDataFrame(list(ADVANCE.items()), "segment string, part double")
    g = pax.where(F.col("month").isin(*months)).groupBy("segment").agg(years("pax", 0).alias("ly"), years("pax", 1).alias("cy")).join(F.broadcast(part), "segment")
    g = g.select("segment", "part", F.floor(F.col("ly") * F.col("part")).alias("ly_booked"), F.floor(F.col("cy") * F.col("part")).alias("cy_booked"))
    return g.select("segment", "ly_booked", "cy_booked", F.floor(F.col("cy_booked") / F.col("part")).alias("projected"))


def forward(month: int, n: int) -> list[int]:
    """The n months after `month`, round the year's end."""
    return [(month + i) % 12 + 1 for i in range(n)]


def risk(bookings: DataFrame, customers: DataFrame, penalties: dict[str, int]) -> DataFrame:
    """What is lost where a customer's dominant segment misses the segment of a booking: whole misses by the loss of one."""
    both = bookings.join(customers.select("customer_id", "dominant_segment"), "customer_id")
    g = both.groupBy(F.col("proxy_segment").alias("segment")).agg(F.count("*").alias("support"), (F.lit(100.0) * F.count_if(F.col("dominant_segment") == F.col("proxy_segment")) / F.count("*")).alias("recall"))
    loss = bookings.sparkSession.createDataFrame([(s, float(LOSS * p)) for s, p in penalties.items()], "segment string, loss double")
    g = g.join(F.broadcast(loss), "segment").withColumn("missed", F.floor(F.col("support") * (1 - F.col("recall") / 100.0)))
    return g.select("segment", "support", F.round("recall", 4).alias("recall"), "loss", "missed", F.round(F.col("missed") * F.col("loss"), 2).alias("risk"))
