"""Tickets, passenger records and travellers: the feature blocks of the three older tracks, on the coupon view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.columns import bins
from tripstrata.operators.coupon import routed

CHANNELS = {"1-URGENT": "WEB/APP", "2-HIGH": "Traditional Travel Agency", "3-MEDIUM": "TMC", "4-NOT SPECIFIED": "Call Center", "5-LOW": "Sea Crew"}
REGIONS = {"MIDDLE EAST": "Middle East", "ASIA": "ASEAN", "EUROPE": "Europe", "AMERICA": "North America", "AFRICA": "Africa"}
CABIN_ORDER = {"Y": 0, "W": 1, "J": 2}


def mapped(x: Column, values: dict, default: object = None) -> Column:
    got = F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), x)
    return got if default is None else F.coalesce(got, F.lit(default))


def tickets(clean: DataFrame) -> DataFrame:
    """lead_time, fare_per_pax, booking_month, cabin_ord, is_dom and the categories of the ticket rules."""
    c = F.col
    df = routed(clean)
    pax = c("l_quantity").cast("int") % 6 + 1
    itinerary = F.when(c("dom_coupon"), "Domestic").when((c("origin_domestic") == 0) & (c("dest_domestic") == 1), "Beyonds (INT - DOM)").otherwise("International")
    return df.select(
        "customer_id", "issue_date", "departure_dt", "farebrand", "cabin", "revenue", c("lead_time_days").alias("lead_time"), pax.alias("pax"), mapped(c("dest_region"), REGIONS, "Unknown").alias("region"),
        mapped(c("channel"), CHANNELS, "Unknown").alias("channel"), itinerary.alias("itinerary"), F.month("issue_date").alias("booking_month"), mapped(c("cabin"), CABIN_ORDER, 0).alias("cabin_ord"),
        F.when(c("dom_coupon"), 1).otherwise(0).alias("is_dom"), (c("revenue") / pax).alias("fare_per_pax"), "trip_od", F.dayofweek("departure_dt").alias("dow"),
    )


def records(clean: DataFrame) -> DataFrame:
    """Engineered passenger records: value, timing, route, party and channel features; ids as in the coupons."""
    c = F.col
    whole = lambda p: F.coalesce(p, F.lit(False)).cast("int")
    df = clean.withColumns({
        "dep_dow": F.weekday("departure_dt"), "dep_month": F.month("departure_dt"), "lead_time": c("lead_time_days"), "age": c("l_quantity").cast("int") + 5,
        "cabin_ord": mapped(c("cabin"), CABIN_ORDER, 0), "ancillary": c("l_quantity") * 10 + c("origin_key"), "net_fare": F.when(c("origin_key") != 0, c("origin_key") * 100.0),
        "dest_home": c("dest_domestic") == 1, "point_of_origin": F.when(c("origin_domestic") == 1, "PH").otherwise("AE"), "is_group": c("is_group_booking").cast("int"),
        "dest_region_name": F.when(c("dest_region") == "ASIA", "Asia").when(c("dest_region") == "MIDDLE EAST", "MiddleEast").otherwise(c("dest_region")),
    })
    domestic = (c("origin_domestic") == 1) & (c("dest_domestic") == 1)
    return df.withColumns({
        "dest_region": c("dest_region_name"), "ancillary_ratio": F.round(F.try_divide(c("ancillary"), c("net_fare")), 6), "is_weekend": whole(c("dep_dow").isin(5, 6)), "is_peak_season": whole(c("dep_month").isin(12, 3, 4, 5)),
        "is_child": whole(c("age") < 12), "is_senior": whole(c("age") >= 60), "age_band": F.coalesce(bins(c("age"), [0, 12, 25, 60, 200], ["child", "youth", "adult", "senior"], right=False), F.lit("nan")),
        "is_gds": whole(c("channel") == "3-MEDIUM"), "is_ota": whole(c("channel") == "4-NOT SPECIFIED"), "is_direct": whole(~c("channel").isin("3-MEDIUM", "4-NOT SPECIFIED")),
        "pos_mismatch": whole(c("foreign_issue") & (c("point_of_origin") != "PH")), "is_codeshare": whole(c("trip_origin") != c("trip_dest")), "n_legs": F.greatest(F.floor(F.length("trip_od") / 3) - 1, F.lit(1)).cast("int"),
        "haul_type": F.when(domestic, "Domestic").when(c("dest_region_name") == "Asia", "Regional").when(c("dest_region_name").isin("MiddleEast", "AMERICA", "EUROPE"), "LongHaul").otherwise("Other"),
    }).withColumn("is_long_haul", whole(c("haul_type") == "LongHaul"))


#: The 0/1 features of record_flags(), beside those that records() makes.
FLAGS = ["red_eye", "changed_itinerary", "is_premium_cabin", "is_nonstop", "is_connecting", "is_domestic", "is_intl_pos", "gender_male", "is_indirect", "is_regional_carrier"]
#: The hours of night departures, and the carrier of regional flights.
NIGHT, REGIONAL = [22, 23, 0, 1, 2, 3, 4, 5], "2P"


def record_flags(records: DataFrame) -> DataFrame:
    """The rest of a record's features: dep_hour, fare_tier and FLAGS.

    The coupon view has no hours, carriers and genders: they follow from destination and coupon number, from the flight number,
    and from the customer, a third of whom tell none. Exchanged are coupons of another class than the one sold. A missing
    value gives 0.
    """
    c = F.col
    whole = lambda p: F.coalesce(p, F.lit(False)).cast("int")
    df = records.withColumns({
        "dep_hour": F.pmod(c("dest_key") * 5 + c("coupon_number") * 3, F.lit(24)).cast("int"), "carrier": F.when(c("flight_number").endswith("7"), REGIONAL).otherwise("PR"),
        "gender": F.element_at(F.array(F.lit(None), F.lit(" Male"), F.lit("Female")), (F.pmod("customer_id", F.lit(3)) + 1).cast("int")), "fare_tier": F.coalesce("value_tier", F.lit(0)),
    })
    return df.withColumns({
        "red_eye": whole(c("dep_hour").isin(NIGHT)), "changed_itinerary": whole(c("sold_class") != c("booking_class")), "is_premium_cabin": whole(c("cabin_ord") >= 1),
        "is_nonstop": F.coalesce("is_nonstop", F.lit(1)), "is_connecting": 1 - F.coalesce("is_nonstop", F.lit(1)), "is_domestic": whole((c("origin_domestic") == 1) & (c("dest_domestic") == 1)),
        "is_intl_pos": whole(c("foreign_issue")), "gender_male": whole(F.trim("gender") == "Male"), "is_indirect": F.greatest("is_gds", "is_ota"), "is_regional_carrier": whole(c("carrier") == REGIONAL),
    })


def travellers(clean: DataFrame) -> DataFrame:
    """Survey-like rows: seat, income, purpose, check_in, age, bags, lead_time, loyalty_ord, cabin_ord."""
    c = F.col
    n = c("l_quantity").cast("int")
    pick = lambda x, *v: F.element_at(F.array(*[F.lit(y) for y in v]), (x % len(v) + 1).cast("int"))
    return clean.select(
        "customer_id", "issue_date", pick(n, "Economy", "Economy", "Premium Economy", "Business", "First").alias("seat"), pick(c("origin_key"), "Low", "Medium", "High").alias("income"),
        pick(c("dest_key"), "Leisure", "Business", "Family", "Emergency").alias("purpose"), pick(n + c("origin_key"), "Mobile App", "Online", "Kiosk", "Counter").alias("check_in"), (n + 20).alias("age"),
        (n % 4).alias("bags"), c("lead_time_days").alias("lead_time"), (c("dest_key") % 4).cast("int").alias("loyalty_ord"), pick(n, 0, 0, 1, 2, 3).alias("cabin_ord"), "revenue",
    )
