"""Accessibility marts and the analyses that read them. Input: core-valid enriched trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import trip as X
from tripmarts.operators.quantile import hist_mean, hist_quantile
from tripmarts.operators.rollup import count_if, pivot_sum, ratio, rollup_sets, rows, top_n
from tripmarts.operators.window import rolling_mean, share



def _accessible() -> Column:
    return F.col("is_wav_request") | F.col("is_aar")


def dashboard_cells(trips: DataFrame) -> DataFrame:
    """date x dow x hour x provider x zone: six counts."""
    ordinary = ~_accessible()
    return trips.groupBy(F.col("pickup_date").alias("date"), "dow", F.col("pickup_hour").alias("hour"), "provider", "PULocationID").agg(
        rows().alias("all_trips"), count_if(F.col("is_wav_trip")).alias("wav_trips"), count_if(_accessible()).alias("accessibility_trips"),
        count_if(ordinary).alias("ordinary_trips"), count_if(ordinary & F.col("is_wav_trip")).alias("ordinary_wav_trips"),
        count_if(ordinary & ~F.col("is_wav_trip")).alias("ordinary_nonwav_trips"))


def wait_summary(trips: DataFrame) -> DataFrame:
    """Adjusted waits by provider and segment with an all-provider row. Rows are first folded into a histogram of
    waits and provenance, so exact quantiles need no row-level shuffle."""
    prepared = trips.withColumns({"segment": X.inclusive_segment(), **X.adjusted_wait_columns()})
    flags = ["used_on_scene", "used_pickup_proxy", "excluded_negative", "excluded_on_scene_after_pickup"]
    hist = prepared.groupBy("provider", "segment", "adjusted_wait_sec", *flags).agg(rows().alias("n"))

    def where(c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))

    valid = F.col("adjusted_wait_sec").isNotNull()
    weight = F.when(valid, F.col("n")).otherwise(F.lit(0))
    measures = [
        F.sum("n").alias("trips"), F.sum(weight).alias("valid_wait_n"), where("used_on_scene").alias("on_scene_wait_n"),
        where("used_pickup_proxy").alias("pickup_proxy_n"), where("excluded_negative").alias("excluded_negative_n"),
        where("excluded_on_scene_after_pickup").alias("excluded_on_scene_after_pickup_n"),
        F.try_divide(F.sum(F.col("adjusted_wait_sec") * F.col("n")) / 60.0, F.sum(weight)).alias("mean_min"),
        (hist_quantile("adjusted_wait_sec", .5) / 60).alias("p50_min"), (hist_quantile("adjusted_wait_sec", .95) / 60).alias("p95_min")]
    return rollup_sets(hist, ["provider", "segment"], [["provider", "segment"], ["segment"]], measures, {"provider": X.ALL_LABEL})


def date_hour(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.col("pickup_date").alias("date"), F.col("pickup_hour").alias("hour"), "provider",
                         X.exact_segment().alias("exact_segment"), X.access_segment().alias("accessibility_segment")).agg(rows().alias("trips"))


_MONTH_SETS = [["month", "provider", "accessibility_segment"], ["month", "accessibility_segment"],
               ["provider", "accessibility_segment"], ["accessibility_segment"]]


def monthly_metrics(trips: DataFrame) -> DataFrame:
    """Month x provider x segment measures over four grouping sets.

    One scan of the trips: additive measures and second-level histograms are combined at the finest grain in one pass, and the
    grouping-set expansion works on that small table.
    """
    keys = ["month", "provider", "accessibility_segment"]
    econ = F.col("economics_valid")
    timed = econ & (F.col("timestamp_trip_sec") > 0)
    moved = econ & (F.col("trip_miles") > 0)
    minutes = F.col("timestamp_trip_sec") / 60.0
    def one(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False)).cast("long")

    sums = {"trips": F.lit(1).cast("long"), "wav_request_n": one(F.col("is_wav_request")), "wav_match_n": one(F.col("is_wav_request") & F.col("is_wav_trip")),
            "economics_n": one(moved), "fare_moved": F.when(moved, F.col("base_passenger_fare")), "miles_moved": F.when(moved, F.col("trip_miles")),
            "fare_timed": F.when(timed, F.col("base_passenger_fare")), "min_timed": F.when(timed, minutes), "n_timed": one(timed),
            "miles_timed": F.when(timed, F.col("trip_miles")), "miles_econ": F.when(econ & (F.col("trip_miles") >= 0), F.col("trip_miles")), "n_econ": one(econ),
            "tipped_n": one(econ & (F.col("tips") > 0)), "tip_sum": F.when(econ & (F.col("tips") > 0), F.col("tips"))}
    first = {n: F.when(F.col("kind") == 0, c) for n, c in sums.items()}
    # a trip counts once with its sums and once in each histogram (kinds 1 and 2, by second)
    arrival, boarding = F.when(F.col("arrival_wait_valid"), F.col("arrival_offset_sec")), F.when(F.col("boarding_valid"), F.col("boarding_sec"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("long").alias("sec")) for k, c in ((0, F.lit(None)), (1, arrival), (2, boarding))])
    spread = trips.select("*", F.explode(kinds).alias("x")).select("*", "x.*").where("kind = 0 OR sec IS NOT NULL")
    spread = spread.select(F.col("pickup_month").alias("month"), "provider", X.access_segment().alias("accessibility_segment"), "kind", "sec", *[c.alias(n) for n, c in first.items()])
    fine = lineage.cut(spread.groupBy(*keys, "kind", "sec").agg(rows().alias("n"), *[F.sum(n).alias(n) for n in sums]))
    s = F.sum
    measures = [
        *[s(c).alias(c) for c in ("trips", "wav_request_n", "wav_match_n", "economics_n", "tipped_n")],
        ratio(s("fare_moved"), s("miles_moved")).alias("base_fare_per_mile"), ratio(s("fare_timed"), s("min_timed")).alias("base_fare_per_min"),
        ratio(s("miles_econ"), s("n_econ")).alias("mean_miles"), ratio(s("min_timed"), s("n_timed")).alias("mean_duration_min"),
        (ratio(s("miles_timed"), s("min_timed")) * 60).alias("aggregate_speed_mph"),
        (ratio(s("tipped_n"), s("n_econ")) * 100).alias("tipped_share_pct"), ratio(s("tip_sum"), s("tipped_n")).alias("mean_tip_positive")]
    label = {"provider": X.ALL_LABEL}
    base = rollup_sets(fine.where("kind = 0"), keys, _MONTH_SETS, measures, label).withColumn("kind", F.lit(0))
    spread_of = [F.sum("n").alias("_n"), (hist_mean("sec") / 60).alias("_mean_min"), (hist_quantile("sec", .5) / 60).alias("_p50_min"), (hist_quantile("sec", .95) / 60).alias("_p95_min")]
    waits = rollup_sets(fine.where("kind > 0"), [*keys, "kind"], [[*s_, "kind"] for s_ in _MONTH_SETS], spread_of, label)
    # both in one layout: a grouping treats null months as equal, a join would not
    together = base.unionByName(waits, allowMissingColumns=True)
    plain = [c for c in base.columns if c not in (*keys, "kind")]
    parts = [F.max(F.when(F.col("kind") == k, F.col(f"_{m}"))).alias(f"{name}_{m}") for k, name in ((1, "arrival"), (2, "boarding")) for m in ("n", "mean_min", "p50_min", "p95_min")]
    return together.groupBy(*keys).agg(*[F.max(c).alias(c) for c in plain], *parts).fillna(0, ["arrival_n", "boarding_n"])


def zone_metrics(trips: DataFrame) -> DataFrame:
    """Both ends of every trip in one pass: explode the pair instead of scanning twice."""
    ends = F.array(F.struct(F.lit("Pickup").alias("direction"), F.col("PULocationID").alias("LocationID")),
                   F.struct(F.lit("Dropoff").alias("direction"), F.col("DOLocationID").alias("LocationID")))
    # Fold to zone pairs and flags first; the explode then doubles a small table.
    pairs = trips.groupBy("PULocationID", "DOLocationID", "is_wav_request", "is_aar").agg(rows().alias("n"))
    long = pairs.select(F.explode(ends).alias("e"), "is_wav_request", "is_aar", "n").select("e.*", "is_wav_request", "is_aar", "n")

    def part(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return long.groupBy("direction", "LocationID").agg(
        F.sum("n").alias("total_trips"), part(_accessible()).alias("accessibility_trips"), part(F.col("is_wav_request")).alias("wav_request_trips"),
        part(F.col("is_aar") & ~F.col("is_wav_request")).alias("aar_no_request_trips"),
        (ratio(part(_accessible()), F.sum("n")) * 100).alias("accessibility_share_pct"))


def wait_hist_daily(trips: DataFrame, step_sec: int = 15, cap_min: int = 180) -> DataFrame:
    """date x segment histogram of adjusted waits in quarter-minute bins; the last bin is open."""
    prepared = trips.withColumns({"segment": X.inclusive_segment(), **X.adjusted_wait_columns()}).where("adjusted_wait_sec is not null")
    width = step_sec / 60.0
    bin_min = F.least(F.lit(float(cap_min)), F.floor(F.col("adjusted_wait_sec") / step_sec) * width)
    return prepared.groupBy(F.col("pickup_date").alias("date"), "segment", bin_min.alias("wait_bin_min")).agg(rows().alias("trips"))


# --- re-rolls of the cells mart ----------------------------------------------------------------------------------

def _ordinary(cells: DataFrame, keys: list[str]) -> DataFrame:
    return (cells.withColumn("high_demand", X.access_peak()).groupBy(*keys, "high_demand")
            .agg(F.sum("ordinary_trips").alias("ordinary_trips"), F.sum("ordinary_wav_trips").alias("ordinary_wav_trips")))


def peak_counts(cells: DataFrame) -> DataFrame:
    return _ordinary(cells, [])


def peak_daily(cells: DataFrame) -> DataFrame:
    return _ordinary(cells, ["date"])


def peak_zone(cells: DataFrame) -> DataFrame:
    return _ordinary(cells.withColumnRenamed("PULocationID", "zone_id"), ["provider", "zone_id"]).where("ordinary_trips > 0")


def hourly_daily(cells: DataFrame) -> DataFrame:
    return cells.groupBy("date", "provider", "dow", "hour").agg(
        *[F.sum(c).alias(c) for c in ("all_trips", "accessibility_trips", "ordinary_trips")])


# --- analyses ----------------------------------------------------------------------------------------------------

def _labels(spark: SparkSession, labels: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], f"{name} string")


def exact_segment_counts(dh: DataFrame) -> DataFrame:
    """All eight combinations, absent ones as zero."""
    counts = dh.groupBy("exact_segment").agg(F.sum("trips").alias("trips"))
    out = _labels(dh.sparkSession, X.EXACT_SEGMENTS, "exact_segment").join(counts, "exact_segment", "left").fillna(0, ["trips"])
    return share(out, "trips").orderBy(F.desc("trips"))


def access_segment_counts(dh: DataFrame) -> DataFrame:
    """Three segments: share of all trips and, for the accessible two, of accessible trips."""
    counts = share(dh.groupBy("accessibility_segment").agg(F.sum("trips").alias("trips")), "trips")
    inside = F.when(F.col("accessibility_segment") != X.ACCESS_OTHER, F.col("trips"))
    total = counts.agg(F.sum(inside)).scalar()
    return counts.withColumn("share_inside_pct", F.try_divide(inside * 100.0, total.cast("double")))


def daily_segments(dh: DataFrame, window: int = 7) -> DataFrame:
    """Daily volume and share of the accessible segments with trailing means."""
    wide = pivot_sum(dh, ["date"], "accessibility_segment", X.ACCESS_SEGMENTS, "trips")
    req, aar, other = (F.col(f"`{c}`") for c in X.ACCESS_SEGMENTS)
    out = wide.select("date", req.alias("wav_request"), aar.alias("aar_no_request"), (req + aar + other).alias("all_trips"))
    out = out.withColumn("access_share_pct", F.try_divide((F.col("wav_request") + F.col("aar_no_request")) * 100.0, F.col("all_trips").cast("double")))
    # One row per day: the whole series is a few thousand rows.
    one = out.withColumn("_series", F.lit(1))
    return one.withColumns({f"{c}_ma{window}": rolling_mean(c, ["_series"], "date", window)
                            for c in ("wav_request", "aar_no_request", "access_share_pct")}).drop("_series")


def latest_vs_year_before(monthly: DataFrame) -> DataFrame:
    """Latest month against the same month a year earlier: counts and share of the month, by accessible segment."""
    rows = monthly.where((F.col("provider") == X.ALL_LABEL) & F.col("month").isNotNull()).select("month", "accessibility_segment", "trips")
    latest = rows.agg(F.max("month")).scalar()
    two = rows.withColumn("latest", latest).where((F.col("month") == F.col("latest")) | (F.col("month") == F.add_months("latest", -12)))
    two = share(two, "trips", ["month"])
    is_latest = F.col("month") == F.col("latest")
    out = two.where(F.col("accessibility_segment") != X.ACCESS_OTHER).groupBy("accessibility_segment").agg(
        F.max("latest").alias("month"), F.coalesce(F.max(F.when(is_latest, F.col("trips"))), F.lit(0)).alias("trips"),
        F.coalesce(F.max(F.when(~is_latest, F.col("trips"))), F.lit(0)).alias("trips_prev"), F.max(F.when(is_latest, F.col("share_pct"))).alias("share_pct"),
        F.max(F.when(~is_latest, F.col("share_pct"))).alias("share_prev_pct"))
    return out.withColumns({"change_pct": (F.try_divide(F.col("trips").cast("double"), F.col("trips_prev").cast("double")) - 1) * 100,
                            "share_change_pp": F.col("share_pct") - F.col("share_prev_pct")})


def match_share(monthly: DataFrame) -> DataFrame:
    rows = monthly.where((F.col("provider") == X.ALL_LABEL) & F.col("month").isNotNull() & (F.col("accessibility_segment") == X.ACCESS_REQUEST))
    return rows.select("month", "wav_request_n", "wav_match_n",
                       F.try_divide(F.col("wav_match_n") * 100.0, F.col("wav_request_n").cast("double")).alias("match_share_pct"))


def coverage(monthly: DataFrame) -> DataFrame:
    """Trips with a usable arrival or boarding stamp, per provider and segment over the whole period."""
    rows = monthly.where(F.col("month").isNull())
    return rows.select("provider", "accessibility_segment", "trips",
                       F.try_divide(F.col("arrival_n") * 100.0, F.col("trips").cast("double")).alias("arrival_coverage_pct"),
                       F.try_divide(F.col("boarding_n") * 100.0, F.col("trips").cast("double")).alias("boarding_coverage_pct"))


def provider_comparison(monthly: DataFrame) -> DataFrame:
    rows = monthly.where(F.col("month").isNull() & (F.col("provider") != X.ALL_LABEL))
    return share(rows.select("provider", "accessibility_segment", "trips", "arrival_mean_min", "base_fare_per_mile"), "trips", ["provider"])


def weekly_profile(cells: DataFrame) -> DataFrame:
    """dow x hour share of the week for accessible and ordinary trips."""
    grid = cells.groupBy("dow", "hour").agg(F.sum("accessibility_trips").alias("accessibility"), F.sum("ordinary_trips").alias("ordinary"))
    long = grid.unpivot(["dow", "hour"], ["accessibility", "ordinary"], "segment", "trips")
    return share(long, "trips", ["segment"])


def period_shares(cells: DataFrame) -> DataFrame:
    """Share of each segment's trips on weekdays 9-16, at weekends and at night 0-5."""
    weekend, day, night = F.col("dow").isin(0, 6), F.col("hour").between(9, 16), F.col("hour").between(0, 5)
    grid = cells.groupBy("dow", "hour").agg(F.sum("accessibility_trips").alias("accessibility"), F.sum("ordinary_trips").alias("ordinary"))
    long = grid.unpivot(["dow", "hour"], ["accessibility", "ordinary"], "segment", "trips")

    def part(cond: Column) -> Column:
        return ratio(F.sum(F.when(cond, F.col("trips"))), F.sum("trips")) * 100

    return long.groupBy("segment").agg(part(~weekend & day).alias("weekday_9_16_pct"), part(weekend).alias("weekend_pct"), part(night).alias("night_0_5_pct"))


def zone_choropleth(zm: DataFrame, zones: DataFrame) -> DataFrame:
    return zm.join(zones.select("LocationID", "zone", "borough"), "LocationID", "left")


def top_zones(zm: DataFrame, zones: DataFrame, n: int = 10) -> DataFrame:
    """Zones with most accessible trips per direction."""
    return zone_choropleth(top_n(zm, n, [F.desc("accessibility_trips"), F.asc("LocationID")], ["direction"]), zones)
