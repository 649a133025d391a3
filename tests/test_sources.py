import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tripmarts.adapter import table
from tripmarts.sources import feeds, readers, schemas
from tripmarts.sources.store import MartStore
from tripmarts.streaming import refresh as R

TS = dt.datetime(2024, 5, 1, 10)


def test_schema_drift_is_conformed(spark, tmp_path):
    a = spark.createDataFrame([("HV0003", TS, 1.5, 600)], "hvfhs_license_num string, pickup_datetime timestamp_ntz, trip_miles double, trip_time int")
    b = spark.createDataFrame([("HV0005", TS, 2, 700, 2.5)], "hvfhs_license_num string, pickup_datetime timestamp_ntz, trip_miles int, trip_time bigint, Airport_fee double")
    a.write.parquet(str(tmp_path / "m1"))
    b.write.parquet(str(tmp_path / "m2"))
    got = readers.read_family(spark, "fhvhv", str(tmp_path / "m1"), str(tmp_path / "m2"), source=True)
    assert got.columns == schemas.FHVHV.names + ["source_file"]
    rows = {r["hvfhs_license_num"]: r for r in got.collect()}
    assert rows["HV0003"]["airport_fee"] is None and rows["HV0005"]["airport_fee"] == 2.5 and rows["HV0005"]["trip_miles"] == 2.0


def test_partitioned_write_prunes(spark, sf, tmp_path):
    t = table(spark, sf, "fhvhv_trips")
    readers.write_partitioned(t, "fhvhv", str(tmp_path / "clean"))
    back = readers.read_years(spark, str(tmp_path / "clean"), [1996])
    assert back.count() == t.where(F.year("pickup_datetime") == 1996).count()
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().toString() or "year#" in back._jdf.queryExecution().toString()


def test_corrupt_files_are_found_and_skipped(spark, tmp_path):
    src = spark.createDataFrame([(i,) for i in range(10)], "x int")
    src.coalesce(1).write.parquet(str(tmp_path / "d"))
    good = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "d" / good, tmp_path / "good.parquet")
    (tmp_path / "raw").mkdir()
    shutil.copy(tmp_path / "good.parquet", tmp_path / "raw" / "a.parquet")
    (tmp_path / "raw" / "b.parquet").write_bytes((tmp_path / "good.parquet").read_bytes()[:60])
    st = {os.path.basename(r["path"]): r for r in readers.file_status(spark, str(tmp_path / "raw")).collect()}
    assert st["a.parquet"]["readable"] and st["a.parquet"]["rows"] == 10 and st["b.parquet"]["status"] == "truncated"
    assert readers.read_good(spark, str(tmp_path / "raw"), src.schema).count() == 10


def test_csv_and_stations(spark, tmp_path):
    (tmp_path / "z.csv").write_text("LocationID,Borough,Zone,service_zone\n1,EWR,Newark,EWR\n2,Queens,Bay,Boro\n")
    assert readers.read_csv(spark, str(tmp_path / "z.csv"), schemas.ZONES).schema == schemas.ZONES
    assert readers.read_csv(spark, str(tmp_path / "z.csv")).count() == 2
    (tmp_path / "s.json").write_text('{"7": [40.5, -74.0, "A"],\n "8": [40.6, -74.1, "B"]}')
    assert {r["station_id"]: r["station_name"] for r in readers.read_stations(spark, str(tmp_path / "s.json")).collect()} == {"7": "A", "8": "B"}


def test_feed_precedence(spark):
    a = spark.createDataFrame([(dt.date(2024, 1, 1), 19, "v", "NBA", "g", "t1")], schemas.EVENTS)
    b = spark.createDataFrame([(dt.date(2024, 1, 1), 20, "v", "X", "g", "t2"), (dt.date(2024, 1, 2), 20, "v", "X", "h", "t2")], schemas.EVENTS)
    got = feeds.combine([a, b]).collect()
    assert [(r["date"].day, r["start_hour"]) for r in got] == [(1, 19), (2, 20)]


def test_store(spark, tmp_path):
    schema = spark.range(1).selectExpr("id as k", "cast(id as double) v").schema
    st = MartStore(spark, str(tmp_path), {"m": schema, "free": None})
    df = spark.range(5).selectExpr("id as k", "cast(id as double) v")
    assert not st.exists("m")
    with pytest.raises(FileNotFoundError):
        st.read("m")
    assert st.once("m", lambda: df, grain=["k"]).count() == 5
    assert st.once("m", lambda: (_ for _ in ()).throw(AssertionError("rebuilt"))).count() == 5
    with pytest.raises(ValueError):
        st.write(df, "other")
    with pytest.raises(ValueError):
        st.write(df.select("k"), "m")
    with pytest.raises(ValueError):
        st.write(df.unionAll(df), "free", grain=["k"])
    r = st.records().where("mart = 'm'").first()
    assert r["rows"] == 5 and r["bytes"] > 0
    st.export("m", str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 5


def test_stream_refresh_is_incremental_and_replay_safe(spark, sf, tmp_path):
    t = table(spark, sf, "fhvhv_trips").drop("l_orderkey", "l_linenumber")
    land, out, ck = str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "ck")
    parts = t.randomSplit([.5, .5], 1)
    inc = R.daily_increment("fhvhv", (1990, 2030))
    sums = ["trips", "fare", "pay", "miles"]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(land)
        R.refresh(spark, land, t.schema, inc, out, ck)
        R.refresh(spark, land, t.schema, inc, out, ck)
        assert len([f for f in os.listdir(out) if f.startswith("batch=")]) == i + 1
    got = {(r["date"], r["provider"]): r["trips"] for r in R.current(spark, out, ["date", "provider"], sums).collect()}
    want = {(r["date"], r["provider"]): r["trips"] for p in parts for r in []}
    for p in parts:
        for r in inc(p).collect():
            want[(r["date"], r["provider"])] = want.get((r["date"], r["provider"]), 0) + r["trips"]
    assert got == want
    R.compact(spark, out, str(tmp_path / "compact"), ["date", "provider"], sums)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == len(got)


def test_a_path_whose_files_drift(spark, tmp_path):
    one = spark.createDataFrame([(1, 2.0)], "PULocationID int, trip_miles double")
    two = spark.createDataFrame([(2, 3, 1.25)], "PULocationID bigint, trip_miles bigint, airport_fee double")
    one.write.parquet(f"{tmp_path}/m/a")
    two.write.parquet(f"{tmp_path}/m/b")
    got = {r["PULocationID"]: (r["trip_miles"], r["airport_fee"]) for r in readers.read_family(spark, "fhvhv", f"{tmp_path}/m/*").collect()}
    assert got == {1: (2.0, None), 2: (3.0, 1.25)}


def test_a_mart_that_breaks_its_grain_leaves_the_old_one(spark, tmp_path):
    s = MartStore(spark, str(tmp_path), {"m": None})
    s.write(spark.createDataFrame([(1, "a")], "k int, v string"), "m", grain=["k"])
    with pytest.raises(ValueError):
        s.write(spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), "m", grain=["k"])
    assert [tuple(r) for r in s.read("m").collect()] == [(1, "a")]


def test_histogram_mart_counts_copies_once_and_keeps_medians(spark, tmp_path):
    mart = R.HistogramMart(spark, str(tmp_path / "m"), "month", ["zone"], "wait_sec", R.wait_measures(), ["fare"])
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    schema = "id long, month date, zone long, wait_sec long, fare double"
    first = spark.createDataFrame([(1, jan, 5, 10, 1.0), (2, jan, 5, 30, 1.0), (2, jan, 5, 30, 1.0), (3, feb, 5, 7, 1.0)], schema)
    second = spark.createDataFrame([(2, jan, 5, 30, 1.0), (4, jan, 5, 20, 2.0), (5, jan, 6, 1, None), (6, jan, 5, None, 1.0)], schema)

    def state():
        return {(r["month"], r["zone"]): (r["trips"], r["med_wait_sec"], r["fare"], r["refreshed_by"]) for r in mart.read().collect()}

    mart.add(first, 0, ["id", "wait_sec"])
    assert state() == {(jan, 5): (2, 20.0, 2.0, 0), (feb, 5): (1, 7.0, 1.0, 0)}
    for _ in range(2):  # the second time is a replay
        mart.add(second, 1, ["id", "wait_sec"])
        got = state()
        assert got[jan, 5] == (4, 20.0, 5.0, 1) and got[jan, 6] == (1, 1.0, None, 1) and got[feb, 5] == (1, 7.0, 1.0, 0)
    mart.add(first, 2, ["id", "wait_sec"])  # nothing new
    mart.add(first.limit(0), 3, ["id", "wait_sec"])
    assert state() == got
