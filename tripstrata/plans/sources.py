"""Queries over files that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.operators import coupon
from tripstrata.operators.sampling import shared_folder
from tripstrata.plans import sql
from tripstrata.plans.base import query
from tripstrata.sources import tables


def gz_files(spark: SparkSession, df: DataFrame, parts: int) -> list[str]:
    """The paths of `df` as gzipped CSV files in the shared folder."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.repartition(parts).write.option("header", True).option("compression", "gzip").csv(path)
    at, system = tables.file_at(spark, path)
    return sorted(str(f.getPath()) for f in system.listStatus(at) if f.getPath().getName().startswith("part-"))


@query("""SELECT count(*) AS n, sum(o_orderkey)::DOUBLE AS keys, count(*) FILTER (o_orderstatus = 'F') AS with_customer, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS cents, min(o_orderdate) FILTER (o_orderstatus = 'F')::DATE::VARCHAR AS first_day,
 count(o_orderpriority) FILTER (o_orderstatus <> 'F') AS with_priority, count(DISTINCT o_orderstatus = 'F') AS kinds, 'bigint,bigint,double,timestamp_ntz,string' AS types FROM orders""")
def sniffed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as gzipped files of two kinds, with other columns in another order, read back with sniffed types."""
    o = tables.star(spark, d, "orders")
    files = gz_files(spark, o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), 6)
    files += gz_files(spark, o.where("o_orderstatus <> 'F'").select("o_totalprice", "o_orderpriority", "o_orderkey"), 3)
    df = tables.read_sniffed(spark, files)
    types = dict(df.dtypes)
    return df.agg(
        F.count("*").alias("n"), F.sum("o_orderkey").cast("double").alias("keys"), F.count("o_custkey").alias("with_customer"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("cents"),
        F.min("o_orderdate").cast("date").cast("string").alias("first_day"), F.count("o_orderpriority").alias("with_priority"), F.count_distinct(F.col("o_custkey").isNotNull()).alias("kinds"),
        F.lit(",".join(types[c] for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"))).alias("types"),
    )


def stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bookings and customers as tables in the shared folder, both bucketed by customer; the customers are made from the stored bookings."""
    name = f"tripstrata_{uuid.uuid4().hex}"
    write = lambda df, of: tables.write_bucketed(df, f"{name}_{of}", f"{shared_folder(spark)}/{name}_{of}", "customer_id")
    bk = write(coupon.bookings(coupon.clean(spark, d)), "bookings")
    return bk, write(coupon.customers(bk), "customers")


@query(sql.customer("SELECT dominant_segment, proxy_segment, count(*) AS n, count(DISTINCT customer_id) AS n_customers, round(sum(round(rev_pos * 100)::BIGINT) / 100, 2)::DOUBLE AS revenue FROM booking JOIN customer_ USING (customer_id) GROUP BY 1, 2"))
def stored_segments(spark: SparkSession, d: str) -> DataFrame:
    """Bookings by their own segment and their customer's, from the stored tables: a join without an exchange of either side."""
    bk, cu = stored(spark, d)
    both = bk.join(cu.select("customer_id", "dominant_segment"), "customer_id").groupBy("customer_id", "dominant_segment", "proxy_segment").agg(F.count("*").alias("n"), F.sum(F.round(F.col("rev_pos") * 100).cast("long")).alias("cents"))
    return both.groupBy("dominant_segment", "proxy_segment").agg(F.sum("n").alias("n"), F.count("*").alias("n_customers"), F.round(F.sum("cents") / 100, 2).alias("revenue"))


@query(sql.customer("SELECT top_region, ever_award, count(*) AS n, sum(n_bookings)::BIGINT AS n_bookings, sum(n_coupons)::BIGINT AS n_coupons, max(last_issue)::VARCHAR AS last_issue FROM customer_ GROUP BY 1, 2"))
def stored_customers(spark: SparkSession, d: str) -> DataFrame:
    """The stored customers by region."""
    _, cu = stored(spark, d)
    return cu.groupBy("top_region", "ever_award").agg(F.count("*").alias("n"), F.sum("n_bookings").alias("n_bookings"), F.sum("n_coupons").alias("n_coupons"), F.max("last_issue").cast("string").alias("last_issue"))
