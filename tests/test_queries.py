"""Every query with SQL against DuckDB at the smallest scale; the others have to run."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tripstrata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["labeling_scores", "leaderboard", "display_scores"])
def test_scores_of_more_rows_than_are_asked(spark, tmp_path, name):
    """Three times the rows of which silhouettes are taken: the SQL asks the same rows."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id + 1000000 * r AS vec_id, list_transform(embedding, lambda x: (x + 0.05 * sin(vec_id + r))::FLOAT) AS embedding, label FROM '{SF}/embeddings.parquet', range(12) t(r)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_methods_of_column_sketch_are_compiled(spark):
    """The JVM doesn't compile methods of over 8,000 bytes: rows then take several times as long."""
    import re

    from tripstrata.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.queries()["column_sketch"](spark, "/root/testdata/sf0.001")
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    found = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert found and max(found) < 8000


def test_display_scores_ask_all_rows():
    """Neither its SQL nor the query cuts the rows whose silhouettes are taken; the two that state such a cut keep it."""
    sql = registry.oracle_sql()
    assert "LIMIT" not in sql["display_scores"] and all("LIMIT 2000" in sql[name] for name in ("labeling_scores", "leaderboard"))
