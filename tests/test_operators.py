"""Small fixtures for rules, null handling, drift and clustering, with results worked out by hand or by numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstrata.functions.columns import average_rank, bins, clip, first_by, money, quantile_bucket, timestamp19
from tripstrata.operators import coupon, models, monitor, resample, rules, sampling
from tripstrata.sources import tables

BASE = dict(is_award=False, corp_channel=False, any_business=False, lead_days=30, pilgrimage=False, sea_crew=False, foreign_issue=False, is_international=False, max_tier=3, round_trip=False, any_premium=False, is_group=False, is_domestic=False)
KINDS = ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean'}" for k, v in BASE.items())


@pytest.mark.parametrize(
    ("change", "label"),
    [
        ({"is_award": True, "corp_channel": True}, "Mabuhay Loyalist"), ({"corp_channel": True}, "Corporate"), ({"any_business": True, "lead_days": 7}, "Corporate"), ({"pilgrimage": True}, "Pilgrimage"),
        ({"sea_crew": True}, "OFW/Migrant"), ({"foreign_issue": True, "is_international": True}, "OFW/Migrant"), ({"foreign_issue": True, "is_international": True, "round_trip": True}, "Balikbayan/VFR"),
        ({"any_premium": True, "is_international": True}, "Premium Bleisure"), ({"is_group": True}, "Family"), ({"lead_days": 3}, "Last-Minute"), ({"is_domestic": True}, "Budget/Adventure"),
        ({"foreign_issue": True, "is_international": True, "max_tier": None}, "Unassigned"), ({"is_domestic": None}, "Unassigned"), ({}, "Unassigned"),
    ],
)
def test_booking_waterfall(spark, change, label):
    row = BASE | change
    df = spark.createDataFrame([tuple(row[k] for k in BASE)], KINDS)
    assert df.select(rules.first_match(rules.booking_rules(4)).alias("s")).first()["s"] == label


def test_last_match_and_contradictions(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, x int")
    got = df.select("k", rules.last_match([("low", F.col("x") < 5), ("one", F.col("x") == 1)]).alias("s"))
    assert dict(got.collect()) == {"a": "one", "b": "Unassigned"}
    out = got.join(df, "k").select("k", rules.without_contradictions(F.col("s"), [("one", F.col("x") > 0), ("low", F.col("x") > 0)]).alias("s"))
    assert dict(out.collect()) == {"a": "Unassigned", "b": "Unassigned"}


@pytest.mark.parametrize(("cls", "late", "brand", "award", "group"), [("F", True, "Mabuhay Award", True, False), ("F", False, "Economy Non-revenue", False, False), ("G", True, "Groups", False, True), ("G", False, "Mabuhay Award", True, False)])
def test_dated_classes(spark, cls, late, brand, award, group):
    df = spark.createDataFrame([(cls, late)], "c string, late boolean")
    flags = coupon.class_flags(F.col("c"), F.col("c"), F.col("late"))
    r = df.select(coupon.dated_farebrand(F.col("c"), F.col("late"), F.lit("x")).alias("b"), flags["class_award"].alias("a"), flags["class_group"].alias("g")).first()
    assert (r["b"], r["a"], r["g"]) == (brand, award, group)


def test_columns(spark):
    df = spark.createDataFrame([(None, "$1,574", "2024-01-02 03:04:05.1234567", 1), (7, "574$", "bad", 2), (3, "x", None, 3)], "x int, m string, t string, o int")
    r = df.agg(first_by(F.col("x"), F.col("o")).alias("f")).first()
    assert r["f"] == 7
    got = df.select(clip(F.col("x"), 0, 5).alias("c"), money(F.col("m")).alias("m"), timestamp19(F.col("t")).alias("t")).collect()
    assert [g["c"] for g in got] == [None, 5, 3] and [g["m"] for g in got] == [1574.0, 574.0, None] and got[0]["t"] == dt.datetime(2024, 1, 2, 3, 4, 5) and got[1]["t"] is None
    r = spark.range(1, 13).select(quantile_bucket(F.col("id"), F.lit(12), 5).alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [x["count"] for x in r] == [3, 2, 2, 2, 3]
    r = spark.createDataFrame([(3,), (4,), (0,), (-1,)], "x int").select(bins(F.col("x"), [-1, 3, 14]).alias("r"), bins(F.col("x"), [-1, 3, 14], right=False).alias("l")).collect()
    assert [(x["r"], x["l"]) for x in r] == [(0, 1), (1, 1), (0, 0), (None, 0)]
    r = average_rank(spark.createDataFrame([(1,), (1,), (5,), (None,)], "x int"), "x", "k").orderBy(F.asc_nulls_last("x")).collect()
    assert [x["k"] for x in r] == [1.5, 1.5, 3.0, 4.0]


def test_dominant_segment_ties(spark):
    cols = "customer_id int, proxy_segment string, rev_pos double, n_coupons int, issue_date date, is_international boolean, round_trip boolean, any_premium boolean, is_award boolean, any_business boolean, dest_region string, sea_crew boolean, all_nonrev boolean"
    day = dt.date(2024, 1, 1)
    row = lambda c, s, r: (c, s, r, 1, day, False, False, False, False, False, None, False, False)
    df = spark.createDataFrame([row(1, "A", 1.0), row(1, "A", 1.0), row(1, "B", 9.0), row(2, "A", 1.0), row(2, "B", 2.0), row(3, "B", 1.0), row(3, "A", 1.0)], cols)
    assert dict(coupon.customers(df).select("customer_id", "dominant_segment").collect()) == {1: "A", 2: "B", 3: "A"}


def test_drift(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    assert monitor.psi_terms(a, a, "k").agg(F.sum("term")).first()[0] == pytest.approx(0)
    v = {r["k"]: (r["change"], r["drift"]) for r in monitor.volume_drift(a, b, "k").collect()}
    assert v["x"][0] == pytest.approx(-25) and not v["x"][1] and v["y"] == (-100.0, True) and v["z"] == (None, True)
    s = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (2, 2)], "a int, b int")
    assert monitor.adjusted_rand(s, "a", "b").first()["ari"] == pytest.approx(1)
    assert monitor.adjusted_rand(s.withColumn("b", 7 - F.col("a")), "a", "b").first()["ari"] == pytest.approx(1)
    assert monitor.retrain({"a": 0.3}, 0.95, 0.0)[0] and monitor.retrain({"a": 0.12, "b": 0.11}, 0.95, 0.0)[0] and not monitor.retrain({"a": 0.1}, 0.75, 0.12)[0]


def test_retrain_decision(spark):
    one = lambda name, v: spark.createDataFrame([(v,)], f"{name} double")

    def decided(mix, psi, ari, noise):
        features = spark.createDataFrame([(str(i), p) for i, p in enumerate(psi)], "feature string, psi double")
        r = monitor.retrain_decision(one("term", mix), features, one("ari", ari), one("noise_pct", noise)).first()
        return r["retrain"], r["reasons"]

    assert decided(0.25, [0.9, 0.1], 0.75, 12.0) == (False, "") and decided(0.1, [0.0], float("nan"), 0.0) == (False, "")
    assert decided(0.26, [0.11, 0.2], 0.74, 12.1) == (True, "segment mix, features, agreement, noise") and decided(None, [], None, 13.0) == (True, "noise")


def test_feature_psi(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 3000), rng.integers(10, 70, 2000)
    frame = lambda x: spark.createDataFrame([(int(v), 1) for v in x] + [(None, 1)], "x int, same int")
    got = {r["feature"]: r["psi"] for r in monitor.feature_psi(frame(a), frame(b), ["x", "same"]).collect()}
    inner = np.unique(np.quantile(a, np.arange(11) / 10))[1:-1]
    part = lambda x: np.maximum(np.bincount(np.searchsorted(inner, x, "right"), minlength=len(inner) + 1) / len(x), 1e-6)
    assert got["x"] == pytest.approx(((part(b) - part(a)) * np.log(part(b) / part(a))).sum()) and got["same"] == 0


def test_ranks_and_splits(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 37, F.lit(1000))).repartition(7)
    ranked, n = sampling.with_rank(df, "x")
    assert n == 1000 and ranked.where("rank <> x + 1").count() == 0
    split = sampling.stratified_split(df.withColumn("s", F.col("id") % 3), "s", "id")
    assert {tuple(r) for r in split.groupBy("s").agg(F.count("*"), F.count_if("train")).collect()} == {(0, 334, 267), (1, 333, 266), (2, 333, 266)}
    assert {r["count"] for r in sampling.folds(df.withColumn("s", F.col("id") % 3), "s", "id").groupBy("s", "fold").count().collect()} == {66, 67}
    e = spark.createDataFrame([(i, int(i < 6), [float(i), 0.0]) for i in range(30)], "id long, label int, v array<double>")
    over = dict(sampling.oversample(e, "label", "id").groupBy("label").count().collect())
    under = dict(sampling.undersample(e, "label", "id").groupBy("label").count().collect())
    assert over == {0: 24, 1: 24} and under == {0: 6, 1: 6} and resample.smote(e.where("label = 1"), "label", "id", "v", 5).count() == 5
    assert [tuple(r) for r in resample.tomek_links(spark.createDataFrame([(0, 0, [0.0]), (1, 1, [1.0]), (2, 1, [1.5]), (3, 0, [5.0])], "id int, label int, v array<double>"), "label", "id", "v").collect()] == []


def test_clustering():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    y = np.repeat([0, 1, 2], 60)
    for f in (models.ward(3), models.hdbscan(15, 5)):
        got = f(x)
        assert all(len(set(got[y == c]) - {-1}) == 1 for c in range(3)) and len(set(got) - {-1}) == 3
    assert models.dbcv(x, y) > 0.5 and np.isnan(models.dbcv(x, np.zeros(180, int)))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [[[20.0, 20.0]]])
    y = np.append(np.repeat([0, 1, 2], 60), 2)
    return x, y, spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, embedding array<double>, label int")


def test_silhouettes(blobs):
    x, y, df = blobs
    d = models.distances(x)
    n = len(x)
    a = [d[i][(y == y[i])].sum() / ((y == y[i]).sum() - 1) for i in range(n)]
    b = [min(d[i][y == c].mean() for c in range(3) if c != y[i]) for i in range(n)]
    got = models.silhouettes(df, "label", "id").first()
    assert got["asked"] == n and got["silhouette"] == pytest.approx(np.mean([(q - p) / max(p, q) for p, q in zip(a, b, strict=True)]))


def test_dbscan(blobs):
    """Against all pairs: core flags, reachable cores, border rows to the nearest core."""
    x, _, df = blobs
    d = models.distances(x)
    eps = np.quantile(np.sort(d, 1)[:, 4], 0.9)
    core = (d <= eps).sum(1) >= 6
    want = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        want = np.array([min(want[j] for j in range(len(x)) if core[j] and d[i, j] <= eps) if core[i] else -1 for i in range(len(x))])
    for i in np.flatnonzero(~core):
        near = [j for j in range(len(x)) if core[j] and d[i, j] <= eps]
        want[i] = want[min(near, key=lambda j: d[i, j])] if near else -1
    got = dict(models.dbscan(df.drop("label"), "id", 6).collect())
    assert [got[i] for i in range(len(x))] == want.tolist() and got[180] == -1


def test_tomek_and_adasyn(blobs):
    _, _, df = blobs
    e = df.withColumn("label", F.when(F.col("id") == 5, 1).otherwise(F.col("label")))
    pairs = resample.tomek_links(e, "label", "id", "embedding").collect()
    assert all(5 in (r["a"], r["b"]) for r in pairs)
    made = resample.adasyn(e, "label", "id", "embedding", 1, 12)
    assert made.count() > 0 and {r["label"] for r in made.collect()} == {1}


def test_birch_is_bounded():
    found = models.Features(0.01, 20)
    rng = np.random.default_rng(0)
    for v in rng.normal(0, 5, (600, 3)):
        found.add(1.0, v, float(v @ v))
    assert len(found.n) <= 20 and found.n.sum() == 600 and found.radius > 0.01


def test_one_way_booking(spark):
    """A booking of one coupon comes back to its origin only if the coupon ends there."""
    day = dt.date(1998, 1, 2)
    base = dict(customer_id=1, issue_date=day, departure_dt=day, lead_time_days=9, trip_origin=1, trip_dest=2, trip_od="a-b", value_tier=3, cabin="Y", is_award=False, is_group_booking=False, class_group=False, class_nonrev=False, foreign_issue=True, issue_country="X", channel="2-HIGH", segment_of_issue="FURNITURE", is_connecting=False, is_refund=False, revenue=10.0, flown=True, age=None, age_known=False, origin_key=1, dest_key=2, origin_domestic=1, dest_domestic=0, origin_region="ASIA", dest_region="EUROPE", coupon_order=1)
    rows = [base, base | {"customer_id": 2}, base | {"customer_id": 2, "trip_origin": 2, "trip_dest": 1, "coupon_order": 2, "class_group": True}, base | {"customer_id": 3, "class_nonrev": True}]
    kinds = ", ".join(f"{k} {dict(bool='boolean', int='long', float='double', str='string', date='date', NoneType='int')[type(v).__name__]}" for k, v in base.items())
    got = {r["customer_id"]: r for r in coupon.bookings(spark.createDataFrame([tuple(r.values()) for r in rows], kinds)).collect()}
    assert set(got) == {1, 2} and not got[1]["round_trip"] and got[2]["round_trip"] and got[2]["is_group"] and not got[1]["is_group"]
    assert (got[1]["proxy_segment"], got[2]["proxy_segment"]) == ("OFW/Migrant", "Balikbayan/VFR")


def test_paths_and_dates(spark):
    from tripstrata.functions.columns import place, words
    from tripstrata.operators import segments

    df = spark.createDataFrame([(" MNL HKG LAX ", "mnllax", "31/12/2024", "12/31/68"), (None, None, "12/31/2024", "31/12/70")], "p string, s string, a string, b string")
    got = df.select(words(F.col("p")), place(F.col("s"), 4), segments.date_day_first(F.col("a")), segments.date_month_first(F.col("b"))).collect()
    assert tuple(got[0]) == (3, "LAX", dt.date(2024, 12, 31), dt.date(2068, 12, 31)) and tuple(got[1]) == (None, None, None, None)
    one = spark.createDataFrame([(i, 3) for i in range(200)], "id long, month int")
    assert 60 < segments.median_month(one, "month", "id").where("reference").count() < 140


def test_latent_classes(spark):
    df = spark.createDataFrame([(0, 0, 0)] * 60 + [(1, 1, 1)] * 40, "a int, b int, c int")
    got = models.latent_classes(df, ["a", "b", "c"], 2)
    assert got["shares"] == pytest.approx([0.6, 0.4], abs=0.01)


def test_sources(spark, tmp_path):
    import gzip

    for name, extra in (("a", ""), ("b", ",Extra")):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt", encoding="utf-8") as f:
            f.write(f"﻿UniqueID,DateOfIssuance,Age,Net Fare{extra}\nu{name},2025-03-04 00:00:00.0000000,x,1.5{',e' if extra else ''}\n")
    df = tables.read_raw(spark, [str(tmp_path / "a.csv.gz"), str(tmp_path / "b.csv.gz")])
    got = {r["UniqueID"]: r for r in df.collect()}
    assert got["ua"]["iss_year"] == 2025 and got["ua"]["Age"] is None and got["ub"]["Net Fare"] == 1.5 and got["ub"]["src_file"] == "b.csv.gz"
    tables.write_by_year(df, str(tmp_path / "out"))
    assert tables.read_coupons(spark, str(tmp_path / "out"), []).where("iss_year = 2025").count() == 2
    with pytest.raises(ValueError, match="repeated"):
        tables.dimension(spark, [("A", 1), ("A", 2)], "k string, v int", "k")
    kept = tables.write_table(df.select("UniqueID", "iss_year"), str(tmp_path / "table"), ("UniqueID",))
    assert kept.count() == 2 and "parquet" in kept._jdf.queryExecution().toString().lower()
    tables.write_csv(df.select("UniqueID", "Age"), str(tmp_path / "csv"))
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "csv"), "UniqueID string, Age int").orderBy("UniqueID").collect()] == [("ua", None), ("ub", None)]
    tables.write_json(spark, {"a": 1}, str(tmp_path / "v.json"))
    assert (tmp_path / "v.json").read_text() == '{\n "a": 1\n}'
    tables.write_summary({"t": df.select("UniqueID")}, str(tmp_path / "s.md"))
    assert "## t" in (tmp_path / "s.md").read_text() and tables.read_labels(spark, str(tmp_path / "no")) is None


def test_stream(spark, tmp_path):
    from tripstrata.streaming.drift import psi_per_window, windowed_counts

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.select("ts", "event_type").write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in")), "7 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("drift_counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    counts = spark.table("drift_counts")
    assert counts.agg(F.sum("n")).first()[0] == src.count()
    ref = src.groupBy("event_type").agg((F.count("*") / src.count()).alias("p"))
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    assert psi_per_window(counts, ref).where("psi < 0").count() == 0


def test_record_flags(spark):
    """The features of single records by hand; missing values give 0 (is_nonstop: 1)."""
    from tripstrata.operators import tickets

    schema = "customer_id long, dest_key int, coupon_number int, flight_number string, value_tier int, sold_class string, booking_class string, cabin_ord int, is_nonstop int, origin_domestic int, dest_domestic int, foreign_issue boolean, is_gds int, is_ota int"
    rows = [(1, 2, 4, "T17", 5, "G", "Y", 1, 0, 1, 1, True, 1, 0), (2, 1, 1, "T71", None, "Y", "Y", 0, 1, 1, 0, False, 0, 0), (3, None, 1, None, None, None, "Y", None, None, None, 1, None, 0, 1)]
    got = tickets.record_flags(spark.createDataFrame(rows, schema)).select("dep_hour", "fare_tier", *tickets.FLAGS).collect()
    assert [tuple(r) for r in got] == [(22, 5, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1), (8, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0), (None, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)]


def times_run(spark, df, f):
    """How often the rows of `df` are made while f(df with that count) runs."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    f(df.mapInArrow(count, df.schema))
    return seen.value / df.count()


def test_rows_are_stored_or_counted_once(spark, monkeypatch):
    """What the queries are made from is made once (percentiles: stored by its caller), however many figures are taken from it."""
    from tripstrata.plans import eda, models, segments

    SF = "/root/testdata/sf0.001"
    for plan, source, query, columns in ((eda, "labelled", "radar", 1), (eda, "tickets", "group_medians", 1), (models, "codes", "k_prototypes", 1), (segments, "booked", "retrain_decision", 1)):
        made = getattr(plan, source)(spark, SF).localCheckpoint()

        def run(df, plan=plan, source=source, query=query):
            with monkeypatch.context() as m:
                m.setattr(plan, source, lambda *_: df)
                getattr(plan, query)(spark, SF).collect()

        assert times_run(spark, made, run) == columns, query


def test_weights_are_repeated_rows(spark):
    rows = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 2.0), ("c", "z", 9.0)]
    times = [5, 2, 4, 1]
    one = spark.createDataFrame([(*r, n) for r, n in zip(rows, times, strict=True)], "a string, b string, x double, n int")
    many = spark.createDataFrame([(*r, 1) for r, n in zip(rows, times, strict=True) for _ in range(n)], one.schema)
    assert monitor.adjusted_rand(one, "a", "b", "n").collect() == monitor.adjusted_rand(many, "a", "b").collect()
    terms = lambda df, *w: sorted(monitor.psi_terms(df.where("b <> 'z'"), df.where("b <> 'x'"), "a", *w).collect())
    assert terms(one, "n") == terms(many)
    bins = lambda df, *w: [r[0] for r in one.select(monitor.decile_bins(df, "x", *w)).collect()]
    assert bins(one, "n") == bins(many)
