"""Sources and sinks: trips are written to the shared folder, drifting as monthly files do, and read back."""

import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from catalog import shared
from catalog.base import T, cte, register
from catalog.clean import PRED, YEARS
from tripmarts import lineage
from tripmarts.operators import clean as C
from tripmarts.plans import shared as S
from tripmarts.sources import readers as RD
from tripmarts.sources.clean_store import CleanStore
from tripmarts.sources.footers import open_file
from tripmarts.sources.schemas import FAMILIES, PICKUP
from tripmarts.sources.store import MartStore
from tripmarts.streaming import refresh as ST


def landed(spark, d):
    """Trips in one folder per year: the first years without the airport fee, one with whole miles."""
    folder = lineage.shared_folder(spark, "landing")
    trips = T("fhvhv_trips")(spark, d).withColumn("y", F.year("pickup_datetime"))
    trips.where("y < 1995").drop("airport_fee", "y").write.parquet(f"{folder}/early")
    trips.where("y = 1995").withColumn("trip_miles", F.col("trip_miles").cast("bigint")).drop("y").write.parquet(f"{folder}/whole")
    trips.where("y > 1995").drop("y").write.parquet(f"{folder}/late")
    return folder


cte("landed_trips", """SELECT year(pickup_datetime) AS y, PULocationID, CASE WHEN year(pickup_datetime) = 1995 THEN trunc(trip_miles) ELSE trip_miles END AS trip_miles,
  CASE WHEN year(pickup_datetime) >= 1995 THEN airport_fee END AS airport_fee FROM fhvhv_trips""")


@register("read_family_drifting", "y trips fees miles:real", "SELECT y, count(*) AS trips, count(airport_fee) AS fees, sum(trip_miles) AS miles FROM landed_trips GROUP BY y")
def q_drift(spark, d):
    got = RD.read_family(spark, "fhvhv", f"{landed(spark, d)}/*")
    return got.groupBy(F.year("pickup_datetime").alias("y")).agg(F.count(F.lit(1)).alias("trips"), F.count("airport_fee").alias("fees"), F.sum("trip_miles").alias("miles"))


@register("read_pruned_years", "year month trips", "SELECT year(pickup_datetime) AS year, month(pickup_datetime) AS month, count(*) AS trips FROM fhvhv_trips WHERE year(pickup_datetime) IN (1996, 1997) GROUP BY ALL")
def q_pruned(spark, d):
    folder = lineage.shared_folder(spark, "clean")
    RD.write_partitioned(T("fhvhv_trips")(spark, d), "fhvhv", folder)
    return RD.read_years(spark, folder, [1996, 1997]).groupBy("year", "month").agg(F.count(F.lit(1)).alias("trips"))


def put(uri, data):
    """A small file of given bytes."""
    from pyarrow import fs
    system, path = (fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)) if uri.startswith("file:") or "://" not in uri else fs.FileSystem.from_uri(uri)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)


def head(uri, n):
    with open_file(uri) as f:
        return f.read_at(n, 0)


@register("readable_files", "status:str rows complete:bool", """
SELECT 'readable' AS status, count(*) AS rows, TRUE AS complete FROM fhvhv_trips
UNION ALL SELECT s, 0, TRUE FROM (VALUES ('empty'), ('foreign'), ('truncated')) AS v(s)""")
def q_status(spark, d):
    folder = lineage.shared_folder(spark, "status")
    trips = T("fhvhv_trips")(spark, d)
    trips.write.parquet(f"{folder}/trips")
    trips.limit(0).write.parquet(f"{folder}/none")  # a valid file without rows
    written = [f for part in ("trips", "none") for f in spark.read.parquet(f"{folder}/{part}").inputFiles()]
    put(f"{folder}/trips/cut.parquet", head(written[0], 200))
    put(f"{folder}/trips/text.parquet", b"no parquet at all")
    put(f"{folder}/none/empty.parquet", b"")
    expected = F.when(F.col("status") == "readable", len(written)).otherwise(1)
    found = RD.file_status(spark, folder, pattern="*.parquet").groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
    return found.withColumn("complete", F.col("files") == expected)


def land(spark, d, family, table, root, names):
    """Write the rows of a raw table as sources of a family, {name: condition}, in one pass over the table; a source without rows is an empty file."""
    source = F.coalesce(*[F.when(condition, name) for name, condition in names.items()])
    raw = T(table)(spark, d).withColumn("source", source).where("source IS NOT NULL")
    schema = FAMILIES[family]
    RD.conform(raw, T_.StructType([*schema.fields, T_.StructField("source", T_.StringType())])).write.mode("append").partitionBy("source").parquet(f"{root}/{family}")
    for name in names:
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{root}/{family}/source={name}")


YEARS_OF_FHVHV = range(1995, 2002)
_COLUMNS = ", ".join(c for c in FAMILIES["fhvhv"].names)
cte("yearly_sources", f"SELECT concat('trips_', year(source_month)) AS source, {_COLUMNS} FROM raw_fhvhv")
cte("yearly_twins", f"SELECT DISTINCT * FROM yearly_sources WHERE {PRED['fhvhv']}")


@register("clean_store_rounds", "source:str raw_rows clean_rows removed removed_pct:real round violations", """
SELECT r.source, raw_rows, clean_rows, raw_rows - clean_rows AS removed, 100.0 * (raw_rows - clean_rows) / raw_rows AS removed_pct,
  CASE r.source WHEN 'trips_1995' THEN 1 WHEN 'trips_1997' THEN 3 ELSE 2 END AS round, 0 AS violations
FROM (SELECT source, count(*) AS raw_rows FROM yearly_sources GROUP BY 1) r JOIN (SELECT source, count(*) AS clean_rows FROM yearly_twins GROUP BY 1) c USING (source)""")
def q_rounds(spark, d):
    """Three years are cleaned; then the others land, one twin loses its end, one is as an older rule left it; backfill and cleaning again mend all."""
    folder = lineage.shared_folder(spark, "family")
    store_ = CleanStore(spark, f"{folder}/raw", f"{folder}/clean", "fhvhv", partitioned=True)
    sources = {f"trips_{y}": F.year("source_month") == y for y in YEARS_OF_FHVHV}
    land(spark, d, "fhvhv", "raw_fhvhv", f"{folder}/raw", dict(list(sources.items())[:3]))
    rounds = [store_.backfill()]
    land(spark, d, "fhvhv", "raw_fhvhv", f"{folder}/raw", dict(list(sources.items())[3:]))
    some = next(f for f in spark.read.parquet(store_.clean).inputFiles() if "trips_1996" in f)
    put(f"{store_.clean}/source=trips_1996/part-cut.parquet", head(some, 300))
    (store_.read_raw(["trips_1997"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(store_.clean))
    rounds += [store_.backfill(), *store_.reclean()]
    last = {name: i + 1 for i, names in enumerate(rounds) for name in names}
    round_of = F.coalesce(*[F.when(F.col("source") == n, i) for n, i in last.items()])
    return store_.report().join(store_.validate().select("source", "violations"), "source").withColumn("round", round_of)


_SPANS = {"early": (None, 1997), "middle": (1997, 1999), "late": (1999, None)}
_FROM = {"yellow": "yellow_trips", "green": "green_trips", "fhv": "fhv_trips", "fhvhv": "raw_fhvhv"}


_METER = ["PULocationID", "DOLocationID", "passenger_count", "payment_type", "trip_distance", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
          "improvement_surcharge", "total_amount", "congestion_surcharge"]


def _span_case(ts):
    return f"CASE WHEN year({ts}) < 1997 THEN 'early' WHEN year({ts}) < 1999 THEN 'middle' ELSE 'late' END"


def _family_columns(f):
    """The columns of the family that its table has."""
    have = {"yellow": _METER, "green": _METER, "fhv": FAMILIES["fhv"].names, "fhvhv": FAMILIES["fhvhv"].names}[f]
    return ", ".join([*have, *([f"{'tpep' if f == 'yellow' else 'lpep'}_{end}_datetime" for end in ("pickup", "dropoff")] if have is _METER else [])])


for _f, _t in _FROM.items():
    cte(f"spans_{_f}", f"SELECT {_span_case(PICKUP[_f])} AS source, {_family_columns(_f)} FROM {_t}")


@register("clean_store_by_type", "type:str files raw_rows clean_rows removed removed_pct:real", "\nUNION ALL\n".join(f"""
SELECT type, files, raw_rows, clean_rows, raw_rows - clean_rows AS removed, 100.0 * (raw_rows - clean_rows) / raw_rows AS removed_pct FROM (
  SELECT '{f}' AS type, (SELECT count(DISTINCT source) FROM spans_{f}) AS files, (SELECT count(*) FROM spans_{f}) AS raw_rows,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM spans_{f} WHERE {PRED[f]})) AS clean_rows) q""" for f in _FROM))
def q_by_type(spark, d):
    folder, reports = lineage.shared_folder(spark, "families"), []
    for family, name in _FROM.items():
        y = F.year(PICKUP[family])
        spans = {s: (F.lit(True) if lo is None else y >= lo) & (F.lit(True) if hi is None else y < hi) for s, (lo, hi) in _SPANS.items()}
        land(spark, d, family, name, f"{folder}/raw", spans)
        store_ = CleanStore(spark, f"{folder}/raw", f"{folder}/clean", family, YEARS, partitioned=True)
        store_.backfill()
        reports.append(store_.report().withColumn("type", F.lit(family)))
    return C.report_rollup(reduce(lambda a, b: a.unionByName(b), reports), ["type"])


def store(spark):
    return MartStore(spark, lineage.shared_folder(spark, "marts"), {"shared_daily": None})


@register("stored_mart_once", "builds provider:str trips", "SELECT 1 AS builds, provider, CAST(sum(n) AS BIGINT) AS trips FROM shared_sums GROUP BY provider")
def q_store(spark, d):
    s, built = store(spark), []

    def build():
        built.append(1)
        return S.mart_shared_daily(shared.clean(spark, d))

    s.once("shared_daily", build, grain=["date", "provider"])
    mart = s.once("shared_daily", build, grain=["date", "provider"])
    return mart.groupBy("provider").agg(F.sum("total_amount_using").alias("trips")).withColumn("builds", F.lit(len(built)))


@register("stored_mart_record", "mart:str rows has_bytes:bool", "SELECT 'shared_daily' AS mart, count(*) AS rows, TRUE AS has_bytes FROM shared_sums")
def q_record(spark, d):
    s = store(spark)
    s.write(S.mart_shared_daily(shared.clean(spark, d)), "shared_daily", grain=["date", "provider"])
    return s.records().select("mart", "rows", (F.col("bytes") > 0).alias("has_bytes"))


@register("exported_mart", "date:date provider:str trips", "SELECT date, provider, n AS trips FROM shared_sums")
def q_export(spark, d):
    s, folder = store(spark), lineage.shared_folder(spark, "export")
    s.write(S.mart_shared_daily(shared.clean(spark, d)).select("date", "provider", F.col("total_amount_using").alias("trips")), "shared_daily")
    s.export("shared_daily", folder)
    return RD.read_csv(spark, folder, T_.StructType([T_.StructField("date", T_.DateType()), T_.StructField("provider", T_.StringType()), T_.StructField("trips", T_.LongType())]))


@register("stream_refreshed_clean_daily", "date:date provider:str trips fare:real miles:real", """
SELECT CAST(pickup_datetime AS DATE) AS date, CASE hvfhs_license_num WHEN 'HV0002' THEN 'Juno' WHEN 'HV0003' THEN 'Uber' WHEN 'HV0004' THEN 'Via' WHEN 'HV0005' THEN 'Lyft' END AS provider,
  count(*) AS trips, sum(base_passenger_fare) AS fare, sum(trip_miles) AS miles FROM (SELECT * FROM clean_fhvhv WHERE source_month IS NOT NULL) q GROUP BY ALL""")
def q_refreshed(spark, d):
    landing, out, progress = (lineage.shared_folder(spark, n) for n in ("stream", "mart", "progress"))
    raw = T("raw_fhvhv")(spark, d)
    schema = raw.schema
    inc = ST.daily_increment("fhvhv")
    for first in (True, False):  # two landings: copies of a trip share its month, so they land together
        part = f"{landing}/{'early' if first else 'late'}"
        raw.where((F.year("source_month") < 1998) if first else (F.year("source_month") >= 1998)).write.parquet(part)
        files = len(spark.read.parquet(part).inputFiles())
        ST.refresh(spark, f"{landing}/*", schema, inc, out, progress, files_per_batch=files)
    return ST.current(spark, out, ["date", "provider"], ["trips", "fare", "miles"])


@register("stream_refreshed_waits", "month:date provider:str zone trips med_wait_sec:real p90_wait_sec:real avg_wait_sec:real fare:real refreshed_by", """
WITH w AS (
  SELECT CAST(date_trunc('month', pickup_datetime) AS DATE) AS month, l_orderkey, PULocationID AS zone, base_passenger_fare,
    CASE hvfhs_license_num WHEN 'HV0002' THEN 'Juno' WHEN 'HV0003' THEN 'Uber' WHEN 'HV0004' THEN 'Via' WHEN 'HV0005' THEN 'Lyft' END AS provider,
    date_diff('second', request_datetime, pickup_datetime) AS wait_sec
  FROM clean_fhvhv WHERE pickup_datetime > request_datetime AND PULocationID IS NOT NULL),
late AS (SELECT month, max(CASE WHEN l_orderkey % 2 = 1 THEN 1 ELSE 0 END) AS batch FROM w WHERE wait_sec < 3600 AND provider IS NOT NULL GROUP BY 1)
SELECT month, provider, zone, count(*) AS trips, quantile_cont(wait_sec, .5) AS med_wait_sec, quantile_cont(wait_sec, .9) AS p90_wait_sec,
  avg(wait_sec) AS avg_wait_sec, sum(base_passenger_fare) AS fare, any_value(CASE WHEN year(month) >= 1999 THEN 2 ELSE batch END) AS refreshed_by
FROM w JOIN late USING (month) WHERE wait_sec < 3600 AND provider IS NOT NULL GROUP BY month, provider, zone""")
def q_refreshed_waits(spark, d):
    """Three landings: even orders, odd orders before 1999 with copies of even ones, and the rest with copies of trips from both other landings."""
    root, landing = (lineage.shared_folder(spark, n) for n in ("waits", "landing"))
    trips = T("raw_fhvhv")(spark, d)
    schema = trips.schema
    mart = ST.HistogramMart(spark, root, "month", ["provider", "zone"], "wait_sec", ST.wait_measures(), ["fare"])
    even, late = F.col("l_orderkey") % 2 == 0, F.year("pickup_datetime") >= 1999
    copies = F.col("l_orderkey") % 7 == 0
    for i, rows in enumerate([even, (~even & ~late) | (copies & ~late), late]):
        trips.where(rows).write.parquet(f"{landing}/{i}")
        files = len(spark.read.parquet(f"{landing}/{i}").inputFiles())
        mart.refresh(f"{landing}/*", schema, ST.monthly_waits, schema.names, files_per_batch=files)
    return mart.read()
