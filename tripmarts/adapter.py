"""Trip-shaped tables derived from the test tables, so that every mart has the columns it needs.

The SQL is plain enough to run on Spark and on an ANSI engine alike; `{lineitem}`-style tokens stand
for the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CALENDAR = """(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, month(o_orderdate) AS m, day(o_orderdate) AS dd,
       year(o_orderdate) AS y FROM {orders}) t"""

TABLES = {
    "trips": """
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber WHEN 5 THEN 'yellow' WHEN 6 THEN 'green' WHEN 7 THEN 'fhv' ELSE 'fhvhv' END AS taxi_type,
  CASE l_suppkey % 4 WHEN 0 THEN 'HV0002' WHEN 1 THEN 'HV0003' WHEN 2 THEN 'HV0004' ELSE 'HV0005' END AS hvfhs_license_num,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE concat('B', CAST(l_suppkey % 50 AS VARCHAR(6))) END AS originating_base_num,
  d0 + INTERVAL '1' SECOND * (req_s) AS request_datetime,
  CASE WHEN l_partkey % 10 = 0 THEN NULL
       ELSE d0 + INTERVAL '1' SECOND * (req_s + wait_s - (l_partkey*13 + l_linenumber) % 180) END AS on_scene_datetime,
  d0 + INTERVAL '1' SECOND * (req_s + wait_s) AS pickup_datetime,
  d0 + INTERVAL '1' SECOND * (req_s + wait_s + dur_s) AS dropoff_datetime,
  1 + o_custkey % 263 AS PULocationID, 1 + (l_partkey*7 + l_orderkey) % 265 AS DOLocationID,
  CASE WHEN l_orderkey % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE q * CAST(0.5 AS DOUBLE) END AS trip_miles,
  dur_s AS trip_time,
  l_extendedprice / 1000 AS base_passenger_fare,
  l_extendedprice / 1000 * (CAST(0.65 AS DOUBLE) + l_discount) AS driver_pay,
  CASE WHEN l_tax > 0.05 THEN l_tax * 10 ELSE CAST(0 AS DOUBLE) END AS tips,
  CASE WHEN l_partkey % 9 = 0 THEN CAST(6.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS tolls,
  l_extendedprice * CAST(0.00003 AS DOUBLE) AS bcf, l_extendedprice * CAST(0.00008 AS DOUBLE) AS sales_tax,
  CASE WHEN o_custkey % 5 = 0 THEN CAST(2.75 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS congestion_surcharge,
  CASE WHEN l_partkey % 30 = 0 THEN NULL WHEN l_partkey % 15 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS airport_fee,
  CASE WHEN l_suppkey % 6 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cbd_congestion_fee,
  CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS shared_request_flag,
  CASE WHEN (l_returnflag = 'R' AND l_linestatus = 'O') OR (l_suppkey % 4 = 3 AND l_partkey % 20 = 0)
       THEN 'Y' ELSE 'N' END AS shared_match_flag,
  CASE WHEN l_partkey % 50 = 0 THEN 'Y' ELSE 'N' END AS wav_request_flag,
  CASE WHEN l_partkey % 50 = 0 OR l_suppkey % 10 = 3 THEN 'Y' ELSE 'N' END AS wav_match_flag,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL WHEN l_orderkey % 40 = 0 THEN 'Y' ELSE 'N' END AS access_a_ride_flag,
  1 + l_partkey % 4 AS payment_type, l_partkey % 8 AS passenger_count
FROM (
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_extendedprice, l_discount, l_tax,
        l_returnflag, l_linestatus, o_custkey, o_orderdate AS d0,
        (l_partkey*7919 + l_linenumber*3571 + l_orderkey*131) % 86400 AS req_s,
        (l_suppkey*613 + l_partkey*97 + CAST(l_quantity AS BIGINT)*31 + l_orderkey*17) % 1500 - 20 AS wait_s,
        CASE WHEN l_orderkey % 97 = 0 THEN 0
             ELSE 60 + (l_partkey*53 + CAST(l_quantity AS BIGINT)*211 + l_orderkey*29) % 5400 END AS dur_s
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) b""",
    "zones": """
SELECT CAST(n_nationkey + 25*k + 1 AS BIGINT) AS LocationID, r_name AS borough,
  concat(n_name, '-', CAST(k AS VARCHAR(3))) AS zone,
  CAST(40.5 AS DOUBLE) + ((n_nationkey + 25*k) % 17) * CAST(0.02 AS DOUBLE) AS lat,
  CAST(-74.2 AS DOUBLE) + ((n_nationkey + 25*k) % 23) * CAST(0.02 AS DOUBLE) AS lon
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS t(k)
WHERE n_nationkey + 25*k + 1 <= 263""",
    "weather": """
SELECT d AS date,
 CASE WHEN (m*31+dd) % 3 = 0 THEN CAST((m*37+dd*11+y*5) % 40 AS DOUBLE)/4 ELSE CAST(0 AS DOUBLE) END AS prcp_mm,
 CASE WHEN m IN (12,1,2) AND (dd+m*7) % 11 = 0 THEN CAST(dd % 9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS snow_mm,
 CAST(30 - abs(m-7)*5 + (dd*7+y) % 6 AS DOUBLE) AS tmax_c,
 CAST((dd*13+m*3+y) % 17 AS DOUBLE)/2 AS awnd_ms
FROM """ + _CALENDAR,
    "transit": """
SELECT d AS date, CAST(2000000 + ((m*53+dd*17+y) % 97) * 20000 AS BIGINT) AS subway,
       CAST(400000 + ((m*11+dd*29+y) % 31) * 5000 AS BIGINT) AS crz_entries
FROM """ + _CALENDAR,
    "stations": """
SELECT s_suppkey AS station_id, s_name AS station_name,
  CAST(40.5 AS DOUBLE) + (s_suppkey*37 % 100) * CAST(0.004 AS DOUBLE) AS lat,
  CAST(-74.2 AS DOUBLE) + (s_suppkey*61 % 100) * CAST(0.005 AS DOUBLE) AS lon
FROM {supplier}""",
    "venues": """
SELECT * FROM (VALUES
 ('v1','Arena One',   12, '13,14,15', 5), ('v2','Park Two',  40, '41,42', 3),
 ('v3','Stadium Three',77, '78',      4), ('v4','Route Four', 100, '101,102,103,104', 1),
 ('v5','Outside Five',264, '132',     4)) AS v(venue_id, name, primary_zone, buffer_zones, price_tier)""",
    "event_calendar": """
SELECT d AS date, CAST(18 + dd % 4 AS INT) AS start_hour, concat('v', CAST(1 + (dd + m) % 5 AS VARCHAR(2))) AS venue_id,
  CASE (dd + y) % 3 WHEN 0 THEN 'Concert' WHEN 1 THEN 'League' ELSE 'StreetClosure' END AS event_type,
  concat('Event ', CAST(y AS VARCHAR(4)), '-', CAST(m AS VARCHAR(2)), '-', CAST(dd AS VARCHAR(2))) AS title
FROM """ + _CALENDAR + """
WHERE dd % 6 = 0""",
    "way_vertices": """
SELECT l_orderkey AS way_id, l_linenumber AS seq, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS oneway,
  CASE l_orderkey % 5 WHEN 0 THEN 'footway' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'primary' ELSE 'secondary_link' END AS highway,
  CAST(40.5 AS DOUBLE) + (l_orderkey % 3) + (p*37 % 997) * CAST(0.0004 AS DOUBLE) AS lat,
  CAST(-74.2 AS DOUBLE) + (p*61 % 991) * CAST(0.0005 AS DOUBLE) AS lon
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM {lineitem} GROUP BY 1, 2) v""",
    "rings": """
SELECT CAST(floor(c_custkey / CAST(8 AS DOUBLE)) AS BIGINT) AS ring_id, c_custkey % 8 AS seq,
  (c_custkey * 7 % 50) * CAST(0.01 AS DOUBLE) + floor(c_custkey / CAST(8 AS DOUBLE)) % 100 + cos(c_custkey % 8 * CAST(0.7853981 AS DOUBLE)) * 3 AS x,
  (c_custkey * 11 % 50) * CAST(0.01 AS DOUBLE) + floor(c_custkey / CAST(8 AS DOUBLE)) % 70 + sin(c_custkey % 8 * CAST(0.7853981 AS DOUBLE)) * 3 AS y
FROM {customer}""",
}
TABLES["fhvhv_trips"] = "SELECT * FROM {trips} WHERE taxi_type = 'fhvhv'"
TABLES["raw_fhvhv"] = """
SELECT r.* FROM (
  SELECT CAST(concat(substr(CAST(pickup_datetime AS VARCHAR(30)), 1, 7), '-01') AS DATE) AS source_month, f.*
  FROM {fhvhv_trips} f
  UNION ALL
  SELECT CAST(concat(substr(CAST(pickup_datetime AS VARCHAR(30)), 1, 7), '-01') AS DATE) AS source_month, f.*
  FROM {fhvhv_trips} f WHERE l_orderkey % 7 = 0) r"""
_METERED = """
SELECT pickup_datetime AS {p}_pickup_datetime, dropoff_datetime AS {p}_dropoff_datetime, PULocationID, DOLocationID,
  passenger_count, payment_type, trip_miles AS trip_distance, base_passenger_fare - CAST(2 AS DOUBLE) AS fare_amount,
  airport_fee AS extra, bcf AS mta_tax, tips AS tip_amount, tolls AS tolls_amount, cbd_congestion_fee AS improvement_surcharge,
  base_passenger_fare + tips + tolls - CAST(3 AS DOUBLE) AS total_amount, congestion_surcharge, l_orderkey, l_linenumber
FROM {{trips}} WHERE taxi_type = '{f}'"""
TABLES["yellow_trips"] = _METERED.format(p="tpep", f="yellow")
TABLES["green_trips"] = _METERED.format(p="lpep", f="green")
TABLES["fhv_trips"] = """
SELECT originating_base_num AS dispatching_base_num, pickup_datetime, dropoff_datetime AS dropOff_datetime,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE PULocationID END AS PUlocationID,
  CASE WHEN l_orderkey % 29 = 0 THEN 0 ELSE DOLocationID END AS DOlocationID, l_orderkey, l_linenumber
FROM {trips} WHERE taxi_type = 'fhv'"""
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or one of the derived trip-shaped tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _expand(name)
    return spark.sql(text, **{b: scan(spark, sf_dir, b) for b in BASE if "{" + b + "}" in text})


def _expand(name: str) -> str:
    """SQL of a derived table with nested tables spelled out; tokens of base tables stay."""
    text = TABLES[name]
    for other in TABLES:
        token = "{" + other + "}"
        if token in text:
            text = text.replace(token, f"({_expand(other)})")
    return text


def family(spark: SparkSession, sf_dir: str, taxi_type: str) -> DataFrame:
    """One trip family."""
    t = table(spark, sf_dir, "trips")
    return t.where(t.taxi_type == taxi_type)


def oracle_cte(name: str) -> str:
    return TABLES[name].format(**{b: b for b in [*BASE, *TABLES]})
