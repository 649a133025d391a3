"""Cleaning, validation, profiling and derived-column queries."""

from pyspark.sql import functions as F

from catalog.base import T, cte, register
from catalog.steps import PROVIDER4
from tripmarts import lineage
from tripmarts.functions import calendar as cal
from tripmarts.functions import geo
from tripmarts.functions import hashing as H
from tripmarts.functions import trip as X
from tripmarts.operators import clean as C
from tripmarts.operators import profile as P
from tripmarts.operators.rollup import unpivot

YEARS = (1993, 1997)
FAMILIES = {"yellow": "yellow_trips", "green": "green_trips", "fhv": "fhv_trips", "fhvhv": "raw_fhvhv"}


#: What a valid row of a family has. Money and measures: (column, least, inclusive, most); others: (column, values that are missing).
_METER = [("fare_amount", 0, True, None), ("trip_distance", 0, False, None), ("mta_tax", 0, True, None), ("tip_amount", 0, True, None), ("tolls_amount", 0, True, None), ("total_amount", 0, True, None)]
_RANGES = {"yellow": _METER, "green": _METER, "fhv": [], "fhvhv": [("trip_miles", 0, False, 100), ("trip_time", 0, False, 10800), ("base_passenger_fare", 0, True, None), ("driver_pay", 0, True, None)]}
_OPTIONAL = {"yellow": ["extra", "improvement_surcharge", "congestion_surcharge"], "green": ["extra", "improvement_surcharge", "congestion_surcharge"], "fhv": [], "fhvhv": []}
_PRESENT = {"yellow": [], "green": [], "fhv": [("PUlocationID", 0), ("DOlocationID", 0), ("dispatching_base_num", None)], "fhvhv": []}
_ENDS = {"yellow": ("tpep_pickup_datetime", "tpep_dropoff_datetime"), "green": ("lpep_pickup_datetime", "lpep_dropoff_datetime"), "fhv": ("pickup_datetime", "dropOff_datetime"), "fhvhv": ("pickup_datetime", "dropoff_datetime")}


def _predicate(f):
    out = []
    for col, least, inclusive, most in _RANGES[f]:
        out.append(f"{col} {'>=' if inclusive else '>'} {least}" + (f" AND {col} <= {most}" if most else ""))
    out += [f"coalesce({c}, 0) >= 0" for c in _OPTIONAL[f]]
    for col, missing in _PRESENT[f]:
        out.append(f"({col} IS NOT NULL)" + (f" AND ({col} <> {missing})" if missing is not None else ""))
    start, end = _ENDS[f]
    if f in ("yellow", "green"):
        out.append(f"{start} >= TIMESTAMP '{YEARS[0]}-01-01' AND {start} < TIMESTAMP '{YEARS[1] + 1}-01-01'")
    return " AND ".join([*out, f"{start} < {end}"])


PRED = {f: _predicate(f) for f in FAMILIES}
for _f, _t in FAMILIES.items():
    cte(f"clean_{_f}", f"SELECT DISTINCT * FROM {_t} WHERE {PRED[_f]}")

_OUT = {"yellow": "l_orderkey l_linenumber tpep_pickup_datetime:ts PULocationID fare_amount:real total_amount:real",
        "green": "l_orderkey l_linenumber lpep_pickup_datetime:ts PULocationID fare_amount:real total_amount:real",
        "fhv": "l_orderkey l_linenumber pickup_datetime:ts PUlocationID DOlocationID dispatching_base_num:str",
        "fhvhv": "l_orderkey l_linenumber pickup_datetime:ts PULocationID trip_miles:real trip_time base_passenger_fare:real source_month:date"}
for _f, _t in FAMILIES.items():
    # One row in seven is a copy in this raw table, so rows are shuffled once.
    register(f"clean_{_f}", _OUT[_f], f"SELECT * FROM clean_{_f}")(
        lambda spark, d, f=_f, t=_t: C.clean(T(t)(spark, d), f, years=YEARS))
    register(f"validate_{_f}", "rows violations unknown", f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT ({PRED[_f]})) AS violations, count(*) FILTER (WHERE ({PRED[_f]}) IS NULL) AS unknown FROM {_t}""")(
        lambda spark, d, f=_f, t=_t: C.validate(T(t)(spark, d), f, years=YEARS))


REPORT = """SELECT r.source_month, raw_rows, coalesce(clean_rows, 0) AS clean_rows, raw_rows - coalesce(clean_rows, 0) AS removed,
  100.0 * (raw_rows - coalesce(clean_rows, 0)) / raw_rows AS removed_pct
FROM (SELECT source_month, count(*) AS raw_rows FROM raw_fhvhv GROUP BY 1) r
LEFT JOIN (SELECT source_month, count(*) AS clean_rows FROM clean_fhvhv GROUP BY 1) c ON r.source_month = c.source_month"""


def report(spark, d):
    raw = T("raw_fhvhv")(spark, d)
    return C.counted_report(raw, C.predicate("fhvhv"), ["source_month"])


@register("clean_report", "source_month:date raw_rows clean_rows removed removed_pct:real", REPORT)
def clean_report(spark, d):
    return report(spark, d)


def _type_report(spark, d):
    out = None
    for f, t in FAMILIES.items():
        raw = T(t)(spark, d).withColumn("source", F.lit(f))
        part = C.removal_report(raw, raw.where(C.predicate(f, YEARS)).distinct(), ["source"])
        out = part if out is None else out.unionByName(part)
    return out


@register("clean_report_by_type", "source:str files raw_rows clean_rows removed removed_pct:real", "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS source, 1 AS files, (SELECT count(*) FROM {t}) AS raw_rows, (SELECT count(*) FROM clean_{f}) AS clean_rows,
  (SELECT count(*) FROM {t}) - (SELECT count(*) FROM clean_{f}) AS removed,
  100.0 * ((SELECT count(*) FROM {t}) - (SELECT count(*) FROM clean_{f})) / (SELECT count(*) FROM {t}) AS removed_pct""" for f, t in FAMILIES.items()))
def clean_report_by_type(spark, d):
    return C.report_rollup(_type_report(spark, d), ["source"])


@register("backfill_pending_sources", "source_month:date", """
SELECT DISTINCT source_month FROM raw_fhvhv WHERE source_month NOT IN (SELECT source_month FROM raw_fhvhv WHERE month(source_month) <= 6)""")
def pending(spark, d):
    raw = T("raw_fhvhv")(spark, d)
    done = raw.where(F.month("source_month") <= 6)
    return C.pending(raw, done, "source_month")


@register("reclean_failing_sources", "source_month:date violations", f"""
SELECT source_month, count(*) FILTER (WHERE NOT ({PRED['fhvhv']})) AS violations FROM raw_fhvhv GROUP BY 1
HAVING count(*) FILTER (WHERE NOT ({PRED['fhvhv']})) > 0""")
def failing(spark, d):
    return C.failing_sources(C.validate(T("raw_fhvhv")(spark, d), "fhvhv", ["source_month"]))


@register("rule_violations_fhv", "rule:str violations unknown", """
SELECT 'PUlocationID_known' AS rule, count(*) FILTER (WHERE PUlocationID IS NULL OR PUlocationID = 0) AS violations, 0 AS unknown FROM fhv_trips
UNION ALL SELECT 'DOlocationID_known', count(*) FILTER (WHERE DOlocationID IS NULL OR DOlocationID = 0), 0 FROM fhv_trips
UNION ALL SELECT 'base_known', count(*) FILTER (WHERE dispatching_base_num IS NULL), 0 FROM fhv_trips
UNION ALL SELECT 'dropoff_after_pickup', count(*) FILTER (WHERE dropOff_datetime <= pickup_datetime), count(*) FILTER (WHERE dropOff_datetime IS NULL OR pickup_datetime IS NULL) FROM fhv_trips""")
def rule_violations(spark, d):
    return C.rule_violations(T("fhv_trips")(spark, d), "fhv")


@register("trips_request_before_pickup", "l_orderkey l_linenumber wait_min:real", """
SELECT l_orderkey, l_linenumber, date_diff('second', request_datetime, pickup_datetime) / 60.0 AS wait_min FROM shared_clean""")
def request_before_pickup(spark, d):
    return C.request_before_pickup(T("fhvhv_trips")(spark, d)).withColumn("wait_min", X.minutes_between("request_datetime", "pickup_datetime"))


@register("complete_trips", "l_orderkey l_linenumber trip_time trip_miles:real", "SELECT * FROM complete_clean")
def complete(spark, d):
    return C.complete_trips(T("fhvhv_trips")(spark, d))


@register("wait_trips", "zone aggregator:str hr dow period:str wait_sec n", "SELECT zone, aggregator, hr, dow, period, wait_sec, count(*) AS n FROM waits GROUP BY ALL")
def wait_trips(spark, d):
    from tripmarts.plans.suite import wait_base
    return wait_base(C.wait_trips(T("fhvhv_trips")(spark, d)))


@register("validity_flags", "l_orderkey l_linenumber core_valid:bool wait_valid:bool arrival_wait_valid:bool boarding_valid:bool economics_valid:bool", "SELECT * FROM enriched")
def validity(spark, d):
    return C.enrich(T("fhvhv_trips")(spark, d))


# --- profiling ---------------------------------------------------------------------------------------------------

CHECKS_SQL = {
    "null_originating_base": "originating_base_num IS NULL", "null_congestion_surcharge": "congestion_surcharge IS NULL",
    "null_airport_fee": "airport_fee IS NULL", "trip_miles_le0": "trip_miles <= 0", "trip_miles_gt100": "trip_miles > 100",
    "trip_time_le0": "trip_time <= 0", "trip_time_gt3h": "trip_time > 10800", "dropoff_le_pickup": "dropoff_datetime <= pickup_datetime",
    "onscene_lt_request": "on_scene_datetime < request_datetime", "pickup_lt_request": "pickup_datetime < request_datetime",
    "duration_mismatch_gt60s": "abs(date_diff('second', pickup_datetime, dropoff_datetime) - trip_time) > 60",
    "fare_lt0": "base_passenger_fare < 0", "driver_pay_lt0": "driver_pay < 0", "driver_pay_eq0": "driver_pay = 0",
    "pu_zone_out_of_range": "PULocationID NOT BETWEEN 1 AND 265", "do_zone_out_of_range": "DOLocationID NOT BETWEEN 1 AND 265",
    "bad_license_num": "hvfhs_license_num NOT IN ('HV0002','HV0003','HV0004','HV0005')"}
cte("m_scorecard", "SELECT CAST(date_trunc('month', pickup_datetime) AS DATE) AS pickup_month, count(*) AS n_trips, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in CHECKS_SQL.items()) + " FROM fhvhv_trips GROUP BY 1")


def card(spark, d):
    return P.scorecard(T("fhvhv_trips")(spark, d), P.anomaly_checks(), {"pickup_month": X.month_of("pickup_datetime")})


@register("anomaly_scorecard", "pickup_month:date n_trips " + " ".join(CHECKS_SQL), "SELECT * FROM m_scorecard")
def scorecard(spark, d):
    return card(spark, d)


@register("anomaly_summary", "check:str count pct_of_all_trips:real", "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "check", sum({n}) AS count, 100.0 * sum({n}) / sum(n_trips) AS pct_of_all_trips FROM m_scorecard""" for n in CHECKS_SQL))
def summary(spark, d):
    return P.scorecard_summary(card(spark, d), list(P.anomaly_checks()))


@register("anomaly_percent_by_month", "pickup_month:date pct_null_originating_base:real pct_null_airport_fee:real pct_onscene_lt_request:real "
          "pct_pickup_lt_request:real pct_trip_miles_le0:real is_november:bool", """
SELECT pickup_month, 100.0 * null_originating_base / n_trips AS pct_null_originating_base, 100.0 * null_airport_fee / n_trips AS pct_null_airport_fee,
  100.0 * onscene_lt_request / n_trips AS pct_onscene_lt_request, 100.0 * pickup_lt_request / n_trips AS pct_pickup_lt_request,
  100.0 * trip_miles_le0 / n_trips AS pct_trip_miles_le0, month(pickup_month) = 11 AS is_november FROM m_scorecard""")
def percent(spark, d):
    return P.scorecard_percent(card(spark, d), list(P.anomaly_checks()), "pickup_month")


@register("discovery_yellow", "rows fare_lt0 dist_le0 extra_null pax_eq0 bad_year dropoff_le_pickup min_pickup:ts max_pickup:ts", """
SELECT count(*) AS rows, count(*) FILTER (WHERE fare_amount < 0) AS fare_lt0, count(*) FILTER (WHERE trip_distance <= 0) AS dist_le0,
  count(*) FILTER (WHERE extra IS NULL) AS extra_null, count(*) FILTER (WHERE passenger_count = 0) AS pax_eq0,
  count(*) FILTER (WHERE year(tpep_pickup_datetime) NOT BETWEEN 1993 AND 1997) AS bad_year,
  count(*) FILTER (WHERE tpep_dropoff_datetime <= tpep_pickup_datetime) AS dropoff_le_pickup, min(tpep_pickup_datetime) AS min_pickup,
  max(tpep_pickup_datetime) AS max_pickup FROM yellow_trips""")
def discovery(spark, d):
    c = F.col
    return P.discovery(T("yellow_trips")(spark, d), {
        "fare_lt0": c("fare_amount") < 0, "dist_le0": c("trip_distance") <= 0, "extra_null": c("extra").isNull(), "pax_eq0": c("passenger_count") == 0,
        "bad_year": ~C.year_range("tpep_pickup_datetime", YEARS), "dropoff_le_pickup": c("tpep_dropoff_datetime") <= c("tpep_pickup_datetime")}, "tpep_pickup_datetime")


@register("duplicate_groups", "duplicate_groups extra_rows", """
SELECT count(*) AS duplicate_groups, sum(n - 1) AS extra_rows FROM (SELECT r.*, count(*) AS n FROM raw_fhvhv r GROUP BY ALL HAVING count(*) > 1) q""")
def duplicates(spark, d):
    return P.duplicate_groups(T("raw_fhvhv")(spark, d))


_NULLS = ["dispatching_base_num", "pickup_datetime", "dropOff_datetime", "PUlocationID", "DOlocationID", "l_orderkey", "l_linenumber"]


@register("null_profile", "column:str nulls null_pct:real", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, 100.0 * (count(*) - count({c})) / count(*) AS null_pct FROM fhv_trips""" for c in _NULLS))
def nulls(spark, d):
    return P.null_profile(T("fhv_trips")(spark, d))


_NUM = ["fare_amount", "trip_distance", "tip_amount", "passenger_count"]


@register("describe_yellow", "column:str count mean:real std:real min:real max:real p25:real p50:real p75:real", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
  quantile_cont({c}, .25) AS p25, quantile_cont({c}, .5) AS p50, quantile_cont({c}, .75) AS p75 FROM yellow_trips""" for c in _NUM))
def describe(spark, d):
    return P.describe(T("yellow_trips")(spark, d), _NUM)


@register("value_counts_airport_fee", "value:real n", "SELECT airport_fee AS value, count(*) AS n FROM fhvhv_trips GROUP BY 1")
def value_counts(spark, d):
    return P.value_counts(T("fhvhv_trips")(spark, d), "airport_fee")


@register("time_range_and_duration", "min_pickup:ts max_pickup:ts mean_min:real p50_min:real p99_min:real", """
SELECT min(pickup_datetime) AS min_pickup, max(pickup_datetime) AS max_pickup, avg(s) / 60 AS mean_min, quantile_cont(s, .5) / 60 AS p50_min, quantile_cont(s, .99) / 60 AS p99_min
FROM (SELECT pickup_datetime, date_diff('second', pickup_datetime, dropoff_datetime) AS s FROM fhvhv_trips) q""")
def time_range(spark, d):
    from tripmarts.operators.quantile import hist_mean, hist_quantile
    t = T("fhvhv_trips")(spark, d).withColumn("s", X.seconds_between("pickup_datetime", "dropoff_datetime"))
    hist = t.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("pickup_datetime").alias("a"), F.max("pickup_datetime").alias("b"))
    return hist.agg(F.min("a").alias("min_pickup"), F.max("b").alias("max_pickup"), (hist_mean("s") / 60).alias("mean_min"),
                    (hist_quantile("s", .5) / 60).alias("p50_min"), (hist_quantile("s", .99) / 60).alias("p99_min"))


@register("clipped_histogram", "bin n", """
SELECT CAST(least(49, floor((x - lo) / ((hi - lo) / 50))) AS BIGINT) AS bin, count(*) AS n FROM (
  SELECT x, hi, min(x) OVER () AS lo FROM (SELECT least(trip_distance, hi) AS x, hi FROM (SELECT trip_distance, quantile_cont(trip_distance, .99) OVER () AS hi FROM yellow_trips) p) q) r GROUP BY 1""")
def clipped(spark, d):
    return P.clipped_histogram(T("yellow_trips")(spark, d), "trip_distance")


@register("clipped_histogram_money", "bin n", """
SELECT CAST(least(49, floor((x - lo) / ((hi - lo) / 50))) AS BIGINT) AS bin, count(*) AS n FROM (
  SELECT x, hi, min(x) OVER () AS lo FROM (SELECT least(greatest(v, 0), hi) AS x, hi FROM (
    SELECT v, quantile_cont(v, .99) OVER () AS hi FROM (SELECT total_amount - 10 AS v FROM yellow_trips) o) p) q) r GROUP BY 1""")
def clipped_low(spark, d):
    return P.clipped_histogram(T("yellow_trips")(spark, d).withColumn("v", F.col("total_amount") - 10), "v", lower=0.0)


@register("adhoc_anomalies", "n_trips zero_distance negative_fare zero_passengers long_trip same_zone negative_total reversed_time", """
SELECT count(*) AS n_trips, count(*) FILTER (WHERE trip_distance = 0) AS zero_distance, count(*) FILTER (WHERE fare_amount < 0) AS negative_fare,
  count(*) FILTER (WHERE passenger_count = 0) AS zero_passengers, count(*) FILTER (WHERE date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) > 5000) AS long_trip,
  count(*) FILTER (WHERE PULocationID = DOLocationID) AS same_zone, count(*) FILTER (WHERE total_amount < 0) AS negative_total,
  count(*) FILTER (WHERE tpep_dropoff_datetime <= tpep_pickup_datetime) AS reversed_time FROM yellow_trips""")
def adhoc(spark, d):
    c = F.col
    return P.scorecard(T("yellow_trips")(spark, d), {
        "zero_distance": c("trip_distance") == 0, "negative_fare": c("fare_amount") < 0, "zero_passengers": c("passenger_count") == 0,
        "long_trip": X.seconds_between("tpep_pickup_datetime", "tpep_dropoff_datetime") > 5000, "same_zone": c("PULocationID") == c("DOLocationID"),
        "negative_total": c("total_amount") < 0, "reversed_time": c("tpep_dropoff_datetime") <= c("tpep_pickup_datetime")})


@register("payment_type_share", "label:str n share:real", """
SELECT label, n, 1.0 * n / sum(n) OVER () AS share FROM (SELECT CASE payment_type WHEN 1 THEN 'Credit card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No charge'
  ELSE 'other' END AS label, count(*) AS n FROM yellow_trips GROUP BY 1) q""")
def coded(spark, d):
    return P.coded_share(T("yellow_trips")(spark, d), "payment_type", {1: "Credit card", 2: "Cash", 3: "No charge"})


@register("card_tip_percent", "column:str count mean:real std:real min:real max:real p25:real p50:real p75:real", """
SELECT 'tip_pct' AS "column", count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, .25) AS p25,
  quantile_cont(x, .5) AS p50, quantile_cont(x, .75) AS p75 FROM (SELECT 100.0 * tip_amount / fare_amount AS x FROM yellow_trips WHERE payment_type = 1 AND fare_amount > 0) q""")
def tips(spark, d):
    t = T("yellow_trips")(spark, d).where((F.col("payment_type") == 1) & (F.col("fare_amount") > 0))
    return P.describe(t.withColumn("tip_pct", F.col("tip_amount") * 100.0 / F.col("fare_amount")), ["tip_pct"])


_CORR = ["fare_amount", "trip_distance", "tip_amount", "tolls_amount", "total_amount"]


@register("correlation_matrix", "a:str b:str r:real", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM yellow_trips" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def correlations(spark, d):
    return P.correlation_matrix(T("yellow_trips")(spark, d), _CORR)


@register("calendar_gaps", "date:date", """
SELECT CAST(g AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM weather), (SELECT max(date) FROM weather), INTERVAL 1 DAY)) AS g) s
WHERE CAST(g AS DATE) NOT IN (SELECT date FROM weather)""")
def gaps(spark, d):
    return P.missing_dates(T("weather")(spark, d), "date")


# --- derived columns ---------------------------------------------------------------------------------------------

@register("trip_features", "l_orderkey l_linenumber provider:str period:str wait_sec arrival_sec:real boarding_sec:real duration_sec speed_mph:real date:date month:date dow hour "
          "week_day:str is_shared:int exact_segment:str access_segment:str segment:str duration_group:str mile_bin:str mile_order business:str "
          "log_miles:real log1p_miles:real pct_effect:real take:real bookings:real hourly_pay:real is_premium weekend", f"""
SELECT l_orderkey, l_linenumber, {PROVIDER4} AS provider,
  CASE WHEN hour(request_datetime) BETWEEN 7 AND 10 THEN 'morning' WHEN hour(request_datetime) BETWEEN 11 AND 15 THEN 'day'
       WHEN hour(request_datetime) BETWEEN 16 AND 18 THEN 'evening' ELSE 'night' END AS period,
  request_to_pickup_sec AS wait_sec, arrival_offset_sec AS arrival_sec, boarding_sec, timestamp_trip_sec AS duration_sec, speed_mph,
  pickup_date AS date, pickup_month AS month, dow, pickup_hour AS hour, strftime(pickup_datetime, '%A') AS week_day,
  CASE WHEN shared_request_flag = 'Y' OR shared_match_flag = 'Y' THEN 1 ELSE 0 END AS is_shared,
  exact_segment, accessibility_segment AS access_segment, segment,
  CASE WHEN trip_time < 600 THEN '0-10' WHEN trip_time < 1200 THEN '10-20' WHEN trip_time < 1800 THEN '20-30'
       WHEN trip_time < 2700 THEN '30-45' WHEN trip_time < 3600 THEN '45-60' ELSE '60+' END AS duration_group,
  CASE WHEN trip_miles < 1 THEN '0-1' WHEN trip_miles < 2 THEN '1-2' WHEN trip_miles < 5 THEN '2-5' WHEN trip_miles < 10 THEN '5-10'
       WHEN trip_miles < 20 THEN '10-20' ELSE '20+' END AS mile_bin,
  CASE WHEN trip_miles < 1 THEN 0 WHEN trip_miles < 2 THEN 1 WHEN trip_miles < 5 THEN 2 WHEN trip_miles < 10 THEN 3 WHEN trip_miles < 20 THEN 4 ELSE 5 END AS mile_order,
  CASE WHEN access_code > 1 THEN 'wav' WHEN shared_request_flag = 'Y' OR shared_match_flag = 'Y' THEN 'shared' ELSE 'regular' END AS business,
  ln(greatest(trip_miles, 1)) AS log_miles, ln(1 + trip_miles) AS log1p_miles, 100 * (exp(10 * trip_miles / 1000) - 1) AS pct_effect,
  base_passenger_fare - driver_pay AS take,
  base_passenger_fare + tolls + bcf + sales_tax + congestion_surcharge + cbd_congestion_fee + coalesce(airport_fee, 0) AS bookings,
  CASE WHEN trip_time > 60 THEN driver_pay / (trip_time / 3600.0) END AS hourly_pay,
  CASE WHEN base_passenger_fare > 50 THEN 1 ELSE 0 END AS is_premium, CASE WHEN dow IN (0, 6) THEN 1 ELSE 0 END AS weekend FROM enriched""")
def features(spark, d):
    t = lineage.compiled_apart(C.enrich(lineage.compiled_apart(T("fhvhv_trips")(spark, d))))
    return t.withColumns({
        "provider": X.provider(), "period": X.day_period(F.hour("request_datetime")), "wait_sec": X.wait_seconds(), "arrival_sec": F.col("arrival_offset_sec"),
        "duration_sec": F.col("timestamp_trip_sec"), "date": F.col("pickup_date"), "month": F.col("pickup_month"), "hour": F.col("pickup_hour"),
        "week_day": X.weekday_name("pickup_datetime"), "is_shared": X.is_shared(), "exact_segment": X.exact_segment(), "access_segment": X.access_segment(),
        "segment": X.inclusive_segment(), "duration_group": X.duration_bucket(), "mile_bin": X.mile_bin(), "mile_order": X.mile_bin_order(),
        "business": X.business_segment(), "log_miles": X.log_clip1("trip_miles"), "log1p_miles": X.log1p("trip_miles"),
        "pct_effect": X.pct_effect(F.col("trip_miles") / 1000), "take": X.take(), "bookings": X.gross_bookings(), "hourly_pay": X.hourly_pay(),
        "is_premium": X.flag_int(F.col("base_passenger_fare") > 50), "weekend": X.flag_int(F.col("dow").isin(0, 6))})


@register("adjusted_wait", "l_orderkey l_linenumber adjusted_wait_min:real used_on_scene:bool used_pickup_proxy:bool excluded_negative:bool excluded_on_scene_after_pickup:bool", """
SELECT l_orderkey, l_linenumber, adjusted_wait_sec / 60.0 AS adjusted_wait_min, used_on_scene, used_pickup_proxy, coalesce(excluded_negative, FALSE) AS excluded_negative,
  coalesce(excluded_on_scene_after_pickup, FALSE) AS excluded_on_scene_after_pickup FROM adjusted""")
def adjusted(spark, d):
    t = C.access_trips(T("fhvhv_trips")(spark, d)).withColumns(X.adjusted_wait_columns())
    return t.withColumn("adjusted_wait_min", F.col("adjusted_wait_sec") / F.lit(60.0))


@register("peak_flags", "dow hour shared_peak:bool access_peak:bool rush:bool n", """
SELECT dow, pickup_hour AS hour, (dow NOT IN (0, 6) AND pickup_hour IN (7, 8, 9, 17, 18, 19)) OR (dow IN (0, 6) AND pickup_hour IN (0, 1, 2, 10, 11, 12, 13, 14, 15)) AS shared_peak,
  (dow IN (0, 6) AND (pickup_hour = 0 OR pickup_hour BETWEEN 17 AND 23)) OR (dow NOT IN (0, 6) AND (pickup_hour = 8 OR pickup_hour BETWEEN 17 AND 21)) AS access_peak,
  dow NOT IN (0, 6) AND pickup_hour IN (7, 8, 9, 17, 18, 19) AS rush, count(*) AS n FROM enriched_base GROUP BY ALL""")
def peaks(spark, d):
    t = T("fhvhv_trips")(spark, d).select(X.dow_sunday0("pickup_datetime").alias("dow"), F.hour("pickup_datetime").alias("hour"))
    return (t.groupBy("dow", "hour").agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"shared_peak": X.shared_peak(), "access_peak": X.access_peak(), "rush": X.rush_hour()}))


@register("wait_groups", "wait_group:str trips", """
SELECT 'citywide' AS wait_group, count(*) AS trips FROM fhvhv_trips UNION ALL SELECT 'jfk', count(*) FROM fhvhv_trips WHERE PULocationID = 132
UNION ALL SELECT 'lga', count(*) FROM fhvhv_trips WHERE PULocationID = 138""")
def wait_groups(spark, d):
    per_zone = T("fhvhv_trips")(spark, d).groupBy("PULocationID").agg(F.count(F.lit(1)).alias("n"))
    return per_zone.select(F.explode(X.wait_group()).alias("wait_group"), "n").groupBy("wait_group").agg(F.sum("n").alias("trips"))


cte("yrs", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")


@register("recurring_event_dates", "year kind:str start_hour date:date", """
SELECT y AS year, k AS kind, h AS start_hour, CAST(dt AS DATE) AS date FROM (
  SELECT y, 'thanksgiving_parade' AS k, 9 AS h, make_date(y, 11, 1) + CAST((11 - dayofweek(make_date(y, 11, 1))) % 7 + 21 AS INTEGER) AS dt FROM yrs
  UNION ALL SELECT y, 'balloon_inflation', 18, make_date(y, 11, 1) + CAST((11 - dayofweek(make_date(y, 11, 1))) % 7 + 20 AS INTEGER) FROM yrs
  UNION ALL SELECT y, 'st_patricks_parade', 11, make_date(y, 3, 17) FROM yrs
  UNION ALL SELECT y, 'new_year_eve', 18, make_date(y, 12, 31) FROM yrs
  UNION ALL SELECT y, 'pride_march', 12, make_date(y, 6, 30) - CAST(dayofweek(make_date(y, 6, 30)) AS INTEGER) FROM yrs
  UNION ALL SELECT y, 'marathon', 8, make_date(y, 11, 1) + CAST((7 - dayofweek(make_date(y, 11, 1))) % 7 AS INTEGER) FROM yrs
  UNION ALL SELECT y, 'tennis_open', 11, make_date(y, 8, 28) + CAST(i AS INTEGER) FROM yrs, (SELECT unnest(range(0, 14)) AS i) s) q""")
def recurring(spark, d):
    years = T("orders")(spark, d).select(F.year("o_orderdate").alias("year")).distinct()
    return cal.recurring_dates(years)


@register("venue_pickups", "venue_id:str zone trips", """
SELECT venue_id, zone, count(*) AS trips FROM (SELECT DISTINCT venue_id, zone FROM (SELECT venue_id, primary_zone AS zone FROM venues
  UNION ALL SELECT venue_id, CAST(trim(unnest(string_split(buffer_zones, ','))) AS BIGINT) FROM venues) q) b JOIN fhvhv_trips f ON f.PULocationID = b.zone GROUP BY 1, 2""")
def venue_pickups(spark, d):
    bridge = T("venues")(spark, d).select("venue_id", F.explode(X.zone_set()).alias("zone"))
    per_zone = T("fhvhv_trips")(spark, d).groupBy(F.col("PULocationID").alias("zone")).agg(F.count(F.lit(1)).alias("trips"))
    return bridge.join(per_zone, "zone")


@register("event_times_and_labels", "venue_id:str event_time:ts label:str year_start:date", """
SELECT venue_id, CAST(date AS TIMESTAMP) + start_hour * INTERVAL '1' HOUR AS event_time, left(title, 40) || ' (' || CAST(date AS VARCHAR) || ')' AS label,
  make_date(CAST(year(date) AS INTEGER), 1, 1) AS year_start FROM event_calendar""")
def event_times(spark, d):
    e = T("event_calendar")(spark, d)
    return e.select("venue_id", X.at_hour("date", "start_hour").alias("event_time"), X.event_label().alias("label"), X.year_start(F.year("date")).alias("year_start"))


@register("local_time_of_utc", "l_orderkey l_linenumber local:ts", """
SELECT l_orderkey, l_linenumber, CAST(timezone('America/New_York', timezone('UTC', request_datetime)) AS TIMESTAMP) AS local FROM fhvhv_trips""")
def local_time(spark, d):
    return T("fhvhv_trips")(spark, d).withColumn("local", cal.local_time(F.col("request_datetime")))


@register("start_hour_from_text", "priority:str hour n", """
SELECT o_orderpriority AS priority, coalesce(TRY_CAST(split_part(t, ':', 1) AS INTEGER), 13) AS hour, count(*) AS n FROM (
  SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'TBD' ELSE concat(CAST(o_orderkey % 24 AS VARCHAR), ':30') END AS t FROM orders) q GROUP BY 1, 2""")
def start_hours(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "TBD").otherwise(F.concat((k % 24).cast("string"), F.lit(":30")))
    o = T("orders")(spark, d).select(F.col("o_orderpriority").alias("priority"), text.alias("t"))
    return o.groupBy("priority", X.hour_or_default("t", 13).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@register("point_projection", "c_custkey x:real y:real", """
SELECT c_custkey, (-74.2 + (c_custkey * 71 % 1000) * 0.0005) * cos(radians(40.7)) * 1000 AS x, -(40.5 + (c_custkey * 53 % 1000) * 0.0004) * 1000 AS y FROM customer""")
def projection(spark, d):
    k = F.col("c_custkey")
    x, y = geo.plane_xy(F.lit(40.5) + (k * 53 % 1000) * F.lit(0.0004), F.lit(-74.2) + (k * 71 % 1000) * F.lit(0.0005), 40.7, 1000.0)
    return T("customer")(spark, d).select("c_custkey", x.alias("x"), y.alias("y"))


@register("hash_draws", "o_orderkey draw", "SELECT o_orderkey, CAST('0x' || substr(md5('7-' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS draw FROM orders")
def draws(spark, d):
    return T("orders")(spark, d).select("o_orderkey", H.draw(7, F.col("o_orderkey")).alias("draw"))


@register("renamed_without_flags", "l_orderkey l_linenumber month:date total_miles:real", """
SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', pickup_datetime) AS DATE) AS month, trip_miles AS total_miles FROM fhvhv_trips""")
def renamed(spark, d):
    t = T("fhvhv_trips")(spark, d).drop("shared_request_flag", "shared_match_flag", "wav_request_flag", "wav_match_flag")
    return t.withColumn("month", X.month_of("pickup_datetime")).withColumnRenamed("trip_miles", "total_miles")


@register("segment_counts_long", "date:date segment:str trips", """
SELECT date, 'accessibility_trips' AS segment, sum(accessibility_trips) AS trips FROM m_cells GROUP BY 1
UNION ALL SELECT date, 'ordinary_trips', sum(ordinary_trips) FROM m_cells GROUP BY 1""")
def segment_long(spark, d):
    from catalog.access import cells
    daily = cells(spark, d).groupBy("date").agg(F.sum("accessibility_trips").alias("accessibility_trips"), F.sum("ordinary_trips").alias("ordinary_trips"))
    return unpivot(daily, ["date"], ["accessibility_trips", "ordinary_trips"], "segment", "trips")
