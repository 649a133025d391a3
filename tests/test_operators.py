import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmarts.operators import clean as C
from tripmarts.operators import hypothesis as Y
from tripmarts.operators import profile as P
from tripmarts.operators import window as W
from tripmarts.operators.quantile import bin_quantile, exact_quantiles
from tripmarts.operators.rollup import dominant, rollup_sets, top_n
from tripmarts.plans.shared import mart_shared_daily


def test_exact_quantiles_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(6000)] + [("hot", 0.25)] * 3000 + [(f"k{i % 5}", rng.random()) for i in range(200)] + [("one", 7.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"p10": .1, "p50": .5, "p95": .95, "max": 1.0}, accuracy=100).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        for name, q in (("p10", .1), ("p50", .5), ("p95", .95), ("max", 1.0)):
            assert abs(got[k][name] - np.quantile(vs, q)) < 1e-12, (k, name)


def test_bin_quantile(spark):
    h = spark.createDataFrame([("a", 0.0, 2), ("a", .25, 1), ("a", .5, 1)], "s string, b double, n int")
    r = bin_quantile(h, ["s"], "b", "n", {"p50": .5, "p75": .75, "p95": .95}).first()
    assert (r["p50"], r["p75"], r["p95"]) == (0, .25, .5)


def test_window_operators(spark):
    d = lambda i: dt.date(2024, 1, i)
    df = spark.createDataFrame([("s", d(i), float(i)) for i in range(1, 10)], "s string, date date, v double")
    got = [r["m"] for r in df.withColumn("m", W.trailing_mean("v", ["s"], "date", 7)).orderBy("date").collect()]
    assert got[:7] == [None] * 7 and got[7:] == [4.0, 5.0]
    roll = [r["m"] for r in df.withColumn("m", W.rolling_mean("v", ["s"], "date", 7)).orderBy("date").collect()]
    assert roll[5] is None and roll[6] == 4.0
    idx = W.index_to_base(df, "v", ["s"], F.col("date") == F.lit("2030-01-01").cast("date"))
    assert idx.where("index_base_100 is not null").count() == 0
    own = W.index_to_base(df, "v", ["s"], F.col("date") == F.lit("2030-01-01").cast("date"), fallback="self")
    assert {r[0] for r in own.select("index_base_100").collect()} == {100.0}
    panel = spark.createDataFrame([(z, y, float(z * 3 + y)) for z in (1, 2) for y in (1, 2)], "z int, y int, v double")
    dm = W.demean(panel, ["v"], [["z"], ["y"]])
    assert all(abs(r[0]) < 1e-12 for k in ("z", "y") for r in dm.groupBy(k).agg(F.avg("v_dm")).select("avg(v_dm)").collect())


def test_global_and_average_ranks(spark):
    rng = random.Random(2)
    vals = [(i, float(rng.randrange(40))) for i in range(500)]
    df = spark.createDataFrame(vals, "id int, v double").repartition(5)
    got = {r["id"]: r["rank"] for r in W.global_rank(df, "v", ["id"]).collect()}
    want = {i: n for n, (v, i) in enumerate(sorted((v, i) for i, v in vals), start=1)}
    assert got == want
    avg = {r["id"]: r["m"] for r in W.average_rank(df, "v", "m").collect()}
    for i, v in vals:
        less, ties = sum(x < v for _, x in vals), sum(x == v for _, x in vals)
        assert avg[i] == less + (ties + 1) / 2
    bins = {r["id"]: r["bin"] for r in W.rank_bins(df, "v", 4, ["id"]).collect()}
    assert sorted(np.bincount(list(bins.values()))[1:]) == [125] * 4
    tiers = {r["id"]: r["tier"] for r in W.order_tiers(df, "v", ["id"], ["g", "a", "r"]).collect()}
    ordered = sorted(v for _, v in vals)
    t1, t2 = ordered[500 // 3], ordered[2 * 500 // 3]
    assert all(tiers[i] == ("g" if v <= t1 else "a" if v <= t2 else "r") for i, v in vals)


def test_ranks_of_a_hot_value_are_spread(spark):
    """A third of the rows share a value and some have none: the value's rows lie in several parts, ranks are those of a plain sort."""
    rng = random.Random(5)
    vals = [(i, None if i % 50 == 0 else 7.0 if i % 3 == 0 else float(rng.randrange(20))) for i in range(3000)]
    df = spark.createDataFrame(vals, "id int, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = W._ordered(df, ["v", "id"]).where("v = 7").select("_part").distinct().count()
        got = {r["id"]: r["rank"] for r in W.global_rank(df, "v", ["id"]).collect()}
        avg = [(r["id"], r["m"]) for r in W.average_rank(df, "v", "m").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    key = lambda r: (r[1] is not None, r[1] or 0.0, r[0])
    assert got == {i: n for n, (i, _) in enumerate(sorted(vals, key=key), start=1)}
    present = sorted(v for _, v in vals if v is not None)
    value = dict(vals)
    assert len(avg) == len(present) and {i for i, _ in avg} == {i for i, v in vals if v is not None}
    assert all(m == (bisect.bisect_left(present, value[i]) + 1 + bisect.bisect_right(present, value[i])) / 2 for i, m in avg)
    empty = df.where("id < 0")
    assert W.global_rank(empty, "v", ["id"]).count() == W.average_rank(empty, "v", "m").count() == 0


def test_rollups(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "x", 4)], "k string, c string, v int")
    got = {(r["k"], r["c"]): r["s"] for r in rollup_sets(df, ["k", "c"], [["k", "c"], ["c"]], [F.sum("v").alias("s")], {"k": "all"}).collect()}
    assert got[("all", "x")] == 8 and got[(None, "x")] == 4 and got[("a", "y")] == 2
    d = {r["k"]: r["dominant"] for r in dominant(df.where("k is not null"), "k", "c", ["y", "x"], "v").collect()}
    assert d == {"a": "y", "b": "x"}
    assert [r["v"] for r in top_n(df, 2, [F.desc("v")]).collect()] == [4, 3]
    assert top_n(df, 1, [F.desc("v")], ["c"]).count() == 2


def test_matched_pairs(spark):
    t = dt.datetime(2024, 1, 1, 8)
    rows = [("HV0003", t, 600, 2.0, 10.0, 6.0, "Y", "Y")] * 3 + [("HV0003", t, 600, 2.0, 8.0, 6.0, "N", "N")] * 2
    df = spark.createDataFrame(rows, "hvfhs_license_num string, pickup_datetime timestamp_ntz, trip_time int, trip_miles double, base_passenger_fare double, driver_pay double, shared_request_flag string, shared_match_flag string")
    r = mart_shared_daily(df).first()
    assert (r["total_amount_using"], r["total_amount_trips"], r["shering_amount_trips"], r["match_rate"]) == (5, 4, 1.5, 37.5)
    assert r["base_fare_shared"] == 20.0 and r["contribution_shared"] == 14.0


def test_duplicates_by_hash_equal_distinct(spark):
    rows = [(i % 50, f"s{i % 50}", None if i % 50 == 3 else i % 50 / 7) for i in range(130)] + [(1000 + i, "u", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(6)
    want = sorted(df.distinct().collect(), key=repr)
    assert sorted(C.drop_exact_duplicates(df).collect(), key=repr) == want


def test_validation_counts_unknown_apart(spark):
    df = spark.createDataFrame([(1, 1, "B", 0, 60), (0, 1, "B", 0, 60), (1, 1, "B", None, 60)], "PUlocationID int, DOlocationID int, dispatching_base_num string, p int, q int")
    df = df.withColumns({"pickup_datetime": F.timestamp_seconds("p").cast("timestamp_ntz"), "dropOff_datetime": F.timestamp_seconds("q").cast("timestamp_ntz")})
    r = C.validate(df, "fhv").first()
    assert (r["rows"], r["violations"], r["unknown"]) == (3, 1, 1)


def test_missing_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 4),)], "date date")
    assert [r[0].day for r in P.missing_dates(df, "date").orderBy("date").collect()] == [2, 3]


def test_chi_square_and_zero_cells(spark):
    c = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 20), ("b", "y", 10)], "r string, c string, n int")
    r = Y.chi_square(c, "r", "c").first()
    assert r["chi2"] == pytest.approx(6.6667, abs=1e-4) and r["cramers_v"] == pytest.approx(1 / 3) and r["dof"] == 1
    z = spark.createDataFrame([("a", "x", 10), ("b", "x", 20), ("b", "y", 10)], "r string, c string, n int")
    o = np.array([[10, 0], [20, 10]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert Y.chi_square(z, "r", "c").first()["chi2"] == pytest.approx(((o - e) ** 2 / e).sum())


def test_rank_test_and_profiles(spark):
    h = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1)], "s string, v int, n int")
    r = Y.mann_whitney(h, "s", "a", "b", "v", "n").first()
    assert (r["u"], r["p_superiority"], r["rank_biserial"]) == (2, .5, 0)
    p = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "s string, v int, n int")
    assert Y.js_distance(p, "s", ["v"], "a", "b").first()[0] == pytest.approx(1.0)
    assert Y.js_distance(h, "s", ["v"], "a", "b").first()[0] == pytest.approx(0.0)
    q = spark.createDataFrame([("a", 30, 100), ("b", 20, 100)], "g string, x int, n int")
    assert Y.two_proportions(q, "g", "a", "b", "x", "n").first()["z"] == pytest.approx(1.6330, abs=1e-4)
    c = spark.createDataFrame([(1, 5), (2, 5)], "x int, y int")
    assert Y.pearson(c, "x", "y").first()["r"] is None
