"""Sniffed types, union by header and null-aware NOT IN."""

import gzip

from pyspark.sql import functions as F

from tripstrata.operators import coupon
from tripstrata.operators.coupon import not_in
from tripstrata.plans import sources
from tripstrata.sources import tables


def write(path, text):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_sniffed_types(spark, tmp_path):
    a = write(tmp_path / "a.csv.gz", "\ufeffid,x,t,mixed,none,big]\n1,2,2025-01-02 03:04:05,1,,7\n 2 ,2.5,2025-01-03,2025-01-01,,9999999999\n")
    b = write(tmp_path / "b.csv.gz", "x,id,own\n1e3,,abc\n,7,\n")
    df = tables.read_sniffed(spark, [a, b])
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "t": "timestamp_ntz", "mixed": "string", "none": "string", "big": "bigint", "src_file": "string", "own": "string"}
    assert sorted((r["id"] or 0, r["x"], r["own"], r["src_file"]) for r in df.collect()) == [(0, 1000.0, "abc", "b.csv.gz"), (1, 2.0, None, "a.csv.gz"), (2, 2.5, None, "a.csv.gz"), (7, None, None, "b.csv.gz")]
    assert dict(tables.read_sniffed(spark, [a, b], id="string").dtypes)["id"] == "string"


def test_plan_does_not_grow_with_files(spark, tmp_path):
    few = [write(tmp_path / f"f{i}.csv.gz", f"{'a,b' if i % 2 else 'b,a,c'}\n{i},{i}{'' if i % 2 else ',0'}\n") for i in range(2)]
    many = [write(tmp_path / f"m{i}.csv.gz", f"{'a,b' if i % 2 else 'b,a,c'}\n{i},{i}{'' if i % 2 else ',0'}\n") for i in range(40)]
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan csv")
    assert scans(tables.read_united(spark, few)) == scans(tables.read_united(spark, many)) == 2
    assert sorted(int(r["a"]) for r in tables.read_united(spark, many).collect()) == list(range(40))


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "o int")
    got = lambda others: sorted((r["k"] for r in not_in(df, "k", others, "o").collect()), key=str)
    df.createOrReplaceTempView("left_rows")
    for others in (of(2, 2, 5), of(2, None), of(None), of()):
        others.createOrReplaceTempView("right_rows")
        assert got(others) == sorted((r[0] for r in spark.sql("SELECT k FROM left_rows WHERE k NOT IN (SELECT o FROM right_rows)").collect()), key=str)
    plan = not_in(df, "k", of(2, 2, 5), "o")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin BuildRight, LeftAnti" not in plan


def test_stored_tables_save_the_shuffle(spark):
    bk, cu = sources.stored(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rollup = coupon.customers(bk)
    assert "Exchange" not in plan(rollup)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = bk.join(cu, "customer_id").groupBy("customer_id").agg(F.sum("rev_pos").alias("rev"))
        assert "SortMergeJoin" in plan(both) and "Exchange" not in plan(both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(rollup.collect()) == sorted(cu.select(*rollup.columns).collect()) and cu.count() > 0
    assert both.count() == cu.count()
