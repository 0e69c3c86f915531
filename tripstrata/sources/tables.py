"""Sources and sinks: raw coupon files, typed datasets, small dimensions, and the coupon view over the star tables."""

from __future__ import annotations

import csv
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstrata.functions.columns import timestamp19

# Booking class -> farebrand, tier (None: no value tier). F and G depend on the date.
FAREBRANDS = (
    ("J", "Business Flex", 7), ("C", "Business Flex", 7), ("D", "Business Flex", 7), ("I", "Business Value", 6), ("Z", "Business Value", 6),
    ("W", "Premium Economy", 5), ("N", "Premium Economy", 5), ("Y", "Economy Flex", 4), ("S", "Economy Flex", 4), ("L", "Economy Flex", 4),
    ("M", "Economy Flex", 4), ("H", "Economy Flex", 4), ("Q", "Economy Value", 3), ("V", "Economy Value", 3), ("B", "Economy Value", 3),
    ("X", "Economy Value", 3), ("K", "Economy Saver", 2), ("E", "Economy Saver", 2), ("T", "Economy Saver", 2), ("U", "Economy Supersaver", 1),
    ("O", "Economy Supersaver", 1), ("A", "Business Non-revenue", None), ("R", "Business Non-revenue", None), ("P", "Economy Non-revenue", None),
)

TIMES = ("DateOfIssuance", "DepartureDate", "DepartureDateTime", "ArrivalDateTime", "TripOD_DepartureDate", "OnlineOD_DepartureDate")
WHOLE = ("CouponNumber", "DaysBeforeMonthEnd", "Age", "Pax Count", "is_nonstop")
MONEY = ("Revenues w YQ", "Net Fare")


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The column names of one CSV file, plain or compressed, without byte-order mark, stray brackets and blanks."""
    at, system = file_at(spark, path)
    jvm = spark._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
    stream = system.open(at)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    first = lines.readLine() or ""
    lines.close()
    return tuple(c.lstrip("\ufeff").rstrip("] ").strip() for c in next(csv.reader([first]), []))


def read_united(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files as text columns, united by name, with src_file. Files with one header are one scan, so the plan grows with the
    kinds of files, not with their number."""
    kinds: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        kinds.setdefault(header(spark, path), []).append(path)
    out = None
    for names, files in kinds.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").schema(schema).csv(files)
        df = df.withColumn("src_file", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def sniffed(df: DataFrame, **fixed: str) -> dict[str, str]:
    """A type for every text column: the narrowest of bigint, double, timestamp_ntz and string that all of its values have; `fixed`
    ones aren't asked for. One pass over all rows; NULL and empty values have no say, and a column of none is text."""
    names = [c for c in df.columns if c not in fixed]
    kinds = ("bigint", "double", "timestamp_ntz")

    def fits(c: str, kind: str) -> Column:
        value = F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`")))
        return F.every(F.when(value.isNotNull(), value.try_cast(kind).isNotNull())).alias(f"{c}:{kind}")

    row = df.agg(*[fits(c, k) for c in names for k in kinds]).first() if names else {}
    return {c: fixed.get(c) or next((k for k in kinds if row[f"{c}:{k}"]), "string") for c in df.columns}


def read_sniffed(spark: SparkSession, paths: list[str], **fixed: str) -> DataFrame:
    """read_united() with the types that sniffed() finds."""
    df = read_united(spark, paths)
    kinds = sniffed(df, **{"src_file": "string", **fixed})
    return df.select(*[F.trim(F.col(f"`{c}`")).try_cast(k).alias(c) if k != "string" else F.col(f"`{c}`") for c, k in kinds.items()])


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Gzipped coupon CSVs, united by column name, typed, with src_file and iss_year.

    Gzip isn't splittable, so rows are dealt anew before a write.
    """
    out = read_united(spark, paths)
    typed = {c: timestamp19(F.col(f"`{c}`")) for c in TIMES if c in out.columns}
    typed |= {c: F.col(f"`{c}`").try_cast("int") for c in WHOLE if c in out.columns} | {c: F.col(f"`{c}`").try_cast("double") for c in MONEY if c in out.columns}
    return out.withColumns(typed).withColumn("iss_year", F.coalesce(F.year("DateOfIssuance"), F.lit(0)))


def write_by_year(df: DataFrame, path: str) -> None:
    """Parquet by iss_year, zstd; only the years in `df` are replaced."""
    df.repartition("iss_year", F.rand(7)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("iss_year").parquet(path)


def read_coupons(spark: SparkSession, parquet: str, raw: list[str]) -> DataFrame:
    """The Parquet dataset if it is there, else the raw files."""
    at, system = file_at(spark, parquet)
    return spark.read.parquet(parquet) if system.exists(at) else read_raw(spark, raw)


def write_table(df: DataFrame, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A zstd Parquet table, such as the bookings or the customers, and what it then reads as; sorted by `keys` within files, so
    that later filters on them skip row groups."""
    (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """A Parquet table `name` in `path`, bucketed and sorted by `key`, one file a bucket, and what it then reads as: later groupings by the
    key and joins with tables of as many buckets need no exchange. Without `buckets` it has as many as a shuffle has partitions."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """A CSV extract or dimension by a stated schema; what doesn't fit a type is NULL."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(tables: dict[str, DataFrame], path: str, rows: int = 50) -> None:
    """Markdown of small aggregates: at most `rows` rows of each reach the driver."""
    lines, df = [], None
    for title, df in tables.items():
        got = df.limit(rows).collect()
        lines += [f"## {title}", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in got), ""]
    write_text(df.sparkSession, "\n".join(lines), path)


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    write_text(spark, json.dumps(values, indent=1, default=str), path)


def file_at(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file."""
    at, system = file_at(spark, path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def farebrands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAREBRANDS), "bc string, farebrand string, tier int")


def dimension(spark: SparkSession, rows: list[tuple], schema: str, key: str) -> DataFrame:
    """A curated dimension, sorted by its key; a key that comes twice is an error."""
    df = spark.createDataFrame(rows, schema)
    twice = [r[key] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"repeated keys: {twice}")
    return df.orderBy(key)


def read_labels(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Expert labels (id, true_segment), if there are any."""
    if path is None:
        return None
    at, system = file_at(spark, path)
    if not system.exists(at):
        return None
    return spark.read.option("header", True).schema(T.StructType().add("id", "string").add("true_segment", "string")).csv(path)


def coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star tables as raw coupons: one row per order line.

    Dimensions are joined as the planner sees fit; the two roles of nation come to nation keys and region of each end.
    """
    nation = star(spark, sf_dir, "nation").join(star(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = star(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = star(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    end = lambda p: nation.select(F.col("n_nationkey").alias(f"{p}_key"), F.col("n_name").alias(f"{p}_name"), F.col("r_name").alias(f"{p}_region"), (F.col("n_regionkey") != 4).cast("int").alias(f"{p}_domestic"))
    part = star(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    lines = star(spark, sf_dir, "lineitem").join(star(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = lines.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return df.join(end("origin"), F.col("s_nationkey") == F.col("origin_key"), "left").join(end("dest"), F.col("c_nationkey") == F.col("dest_key"), "left")
