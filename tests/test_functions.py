import datetime as dt
import math

from pyspark.sql import functions as F

from tripmarts.functions import calendar as cal
from tripmarts.functions import geo, hashing, tails
from tripmarts.functions import trip as X


def test_second_boundaries_ignore_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 01:59:59.9' a, timestamp_ntz'2024-03-10 03:00:02.1' b")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(X.seconds_between("a", "b")).first()[0] == 3603
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_adjusted_wait(spark):
    t = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("arrival", 0, 60, 100, True), ("late arrival", 0, 160, 100, True), ("no stamp", 0, None, 100, True), ("ordinary", 0, 60, 100, False),
            ("negative", 100, None, 0, False), ("no request", None, 60, 100, True)]
    df = spark.createDataFrame([(n, t(a), t(b), t(c), w) for n, a, b, c, w in rows],
                               "n string, request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, pickup_datetime timestamp_ntz, is_wav_trip boolean")
    got = {r["n"]: r for r in df.withColumns(X.adjusted_wait_columns()).collect()}
    assert {n: r["adjusted_wait_sec"] for n, r in got.items()} == {"arrival": 60, "late arrival": None, "no stamp": 100, "ordinary": 100, "negative": None, "no request": None}
    assert got["arrival"]["used_on_scene"] and not got["ordinary"]["used_on_scene"]
    assert got["negative"]["excluded_negative"] and got["late arrival"]["excluded_on_scene_after_pickup"]


def test_small_columns(spark):
    one = spark.range(1)
    row = one.select(X.zone_set(F.lit(12), F.lit("13, 12,14")).alias("z"), X.hour_or_default(F.lit("19:30"), 13).alias("h"), X.hour_or_default(F.lit("TBD"), 13).alias("d"),
                     X.unit_position(F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("u"), X.at_hour(F.lit("2024-01-31").cast("date"), F.lit(25)).alias("t"),
                     geo.haversine_m(F.lit(40.0), F.lit(-74.0), F.lit(41.0), F.lit(-74.0)).alias("m"), hashing.draw(1, 2).alias("r")).first()
    assert row["z"] == [12, 13, 14] and row["h"] == 19 and row["d"] == 13 and row["u"] == 0.5
    assert row["t"] == dt.datetime(2024, 2, 1, 1)
    assert abs(row["m"] - 6371000 * math.pi / 180) < 1e-3
    import hashlib
    assert row["r"] == int(hashlib.md5(b"1-2").hexdigest()[:8], 16)


def test_recurring_dates(spark):
    got = cal.recurring_dates(spark.createDataFrame([(2024,)], "year int")).collect()
    days = {}
    for r in got:
        days.setdefault(r["kind"], []).append(r["date"])
    assert days["thanksgiving_parade"] == [dt.date(2024, 11, 28)] and days["balloon_inflation"] == [dt.date(2024, 11, 27)]
    assert days["pride_march"] == [dt.date(2024, 6, 30)] and days["marathon"] == [dt.date(2024, 11, 3)]
    assert len(days["tennis_open"]) == 14 and min(days["tennis_open"]) == dt.date(2024, 8, 28)


def test_tails():
    assert abs(tails.normal_two_sided(1.959963985) - 0.05) < 1e-8
    assert abs(tails.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(tails.t_two_sided(1.96, 1e6) - 0.05) < 1e-4
    assert abs(tails.chi2_sf(3.841458821, 1) - 0.05) < 1e-8
    assert abs(tails.chi2_sf(18.307038053, 10) - 0.05) < 1e-8
