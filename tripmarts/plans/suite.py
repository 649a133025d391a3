"""Main-suite marts: waits, volumes by family and provider, recovery indices, dominance, product metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import trip as X
from tripmarts.operators.quantile import approx_quantile, exact_quantiles, hist_mean, hist_quantile
from tripmarts.operators.rollup import count_if, dominant, pivot_sum, ratio, rollup_sets, rows
from tripmarts.operators.window import index_to_base, share

# Column order that settles ties between families.
FAMILY_ORDER = ["yellow", "green", "fhvhv", "fhv"]
PROVIDER_ORDER = ["Juno", "Lyft", "Uber", "Via"]


# --- waits -------------------------------------------------------------------------------------------------------

def wait_base(waits: DataFrame) -> DataFrame:
    """Histogram of waits at the finest grain. At most 3600 values per cell, additive, and enough for every
    exact median below; it is the one pass over the trips."""
    return waits.groupBy("zone", "aggregator", "period", "hr", "dow", "wait_sec").agg(rows().alias("n"))


def wait_rows(waits: DataFrame) -> DataFrame:
    """The waits in the shape of the base, one row per trip: for building a single mart, whose own first
    grouping then makes the histogram at the mart's grain."""
    return waits.withColumn("n", F.lit(1).cast("bigint"))


def _wait_measures() -> list[Column]:
    return [hist_quantile("wait_sec", 0.5).alias("med_wait_sec"), hist_mean("wait_sec").alias("avg_wait_sec"), F.sum("n").alias("n_trips")]


def _regroup(base: DataFrame, keys: list[str]) -> DataFrame:
    return base.groupBy(*keys, "wait_sec").agg(F.sum("n").alias("n"))


def zone_wait_time(base: DataFrame) -> DataFrame:
    return _regroup(base, ["zone"]).groupBy("zone").agg(*_wait_measures())


def zone_wait_by_period(base: DataFrame) -> DataFrame:
    return rollup_sets(_regroup(base, ["zone", "period"]), ["zone", "period"], [["zone", "period"], ["zone"]],
                       _wait_measures(), {"period": "all"})


def zone_wait_by_aggregator(base: DataFrame) -> DataFrame:
    return _regroup(base, ["zone", "aggregator"]).groupBy("zone", "aggregator").agg(*_wait_measures())


def zone_wait_cube(base: DataFrame) -> DataFrame:
    """zone x period x provider with 'all' rows for both."""
    keys = ["zone", "period", "aggregator"]
    return rollup_sets(_regroup(base, keys), keys, [keys, ["zone", "aggregator"], ["zone", "period"], ["zone"]],
                       _wait_measures(), {"period": "all", "aggregator": "all"})


def wait_by_hour_dow(base: DataFrame, by_provider: bool = False) -> DataFrame:
    keys = ["hr", "dow"] + (["aggregator"] if by_provider else [])
    out = _regroup(base, keys).groupBy(*keys).agg(*_wait_measures())
    return out.withColumnRenamed("hr", "hour")


def provider_peek(by_aggregator: DataFrame) -> DataFrame:
    """Median of zone medians and trips per provider, from the mart."""
    return by_aggregator.groupBy("aggregator").agg(F.median("med_wait_sec").alias("city_med"), F.sum("n_trips").alias("trips"))


def wait_marts(base: DataFrame) -> dict[str, DataFrame]:
    base = lineage.cut(base)  # six marts, one scan of the trips
    return {"zone_wait_time": zone_wait_time(base), "zone_wait_by_period": zone_wait_by_period(base),
            "zone_wait_by_aggregator": zone_wait_by_aggregator(base), "zone_wait_by_period_agg": zone_wait_cube(base),
            "wait_by_hour_dow": wait_by_hour_dow(base), "wait_by_hour_dow_aggregator": wait_by_hour_dow(base, True)}


# --- volumes -----------------------------------------------------------------------------------------------------

def union_families(families: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One (taxi_type, pickup_datetime, zone) relation from {family: (trips, pickup column, zone column)}."""
    out = None
    for name, (df, ts, zone) in families.items():
        part = df.select(F.lit(name).alias("taxi_type"), F.col(ts).alias("pickup_datetime"), F.col(zone).cast("bigint").alias("zone"))
        out = part if out is None else out.unionByName(part)
    return out


def monthly_by_type(all_trips: DataFrame) -> DataFrame:
    return all_trips.groupBy(X.month_of("pickup_datetime").alias("month"), "taxi_type").agg(rows().alias("trips"))


def monthly_by_type_indexed(monthly: DataFrame, base_month: str, fallback: str | None = None) -> DataFrame:
    return index_to_base(monthly, "trips", ["taxi_type"], F.col("month") == F.lit(base_month).cast("date"), fallback=fallback)


def aggregator_monthly(fhvhv: DataFrame) -> DataFrame:
    counts = fhvhv.groupBy(X.month_of("pickup_datetime").alias("month"), X.provider().alias("aggregator")).agg(rows().alias("trips"))
    return share(counts, "trips", ["month"])


def aggregator_monthly_indexed(monthly: DataFrame, base_month: str, fallback: str | None = None) -> DataFrame:
    return index_to_base(monthly, "trips", ["aggregator"], F.col("month") == F.lit(base_month).cast("date"), fallback=fallback)


def yearly_aggregator_indexed(monthly: DataFrame, base_year: int, fallback: str | None = None) -> DataFrame:
    yearly = monthly.groupBy(F.year("month").alias("year"), "aggregator").agg(F.sum("trips").alias("trips"))
    return index_to_base(yearly, "trips", ["aggregator"], F.col("year") == base_year, fallback=fallback)


def daily_citywide(fhvhv: DataFrame, weather: DataFrame, transit: DataFrame) -> DataFrame:
    daily = fhvhv.groupBy(X.day_of("pickup_datetime").alias("date")).agg(
        rows().alias("trips"), ratio(F.sum("base_passenger_fare"), F.sum("trip_miles")).alias("fare_per_mile"))
    return (daily.join(weather.select("date", "prcp_mm", "snow_mm", "tmax_c"), "date", "left")
            .join(transit.select("date", F.col("subway").alias("subway_ridership")), "date", "left"))


def daily_by_borough(fhvhv: DataFrame, zones: DataFrame, exclude: str | None = "EWR") -> DataFrame:
    """Day x zone first, then boroughs: the dimension meets one row per day and zone."""
    per_zone = fhvhv.groupBy(X.day_of("pickup_datetime").alias("date"), F.col("PULocationID").alias("LocationID")).agg(
        rows().alias("trips"), F.sum("base_passenger_fare").alias("fare"), F.sum("trip_miles").alias("miles"))
    named = per_zone.join(zones.select("LocationID", "borough"), "LocationID")
    if exclude is not None:
        named = named.where(F.col("borough") != exclude)
    return named.groupBy("date", "borough").agg(F.sum("trips").alias("trips"), ratio(F.sum("fare"), F.sum("miles")).alias("fare_per_mile"))


def monthly_by_borough(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.trunc("date", "MM").alias("month"), "borough").agg(F.sum("trips").alias("trips"))


def monthly_transit(citywide: DataFrame) -> DataFrame:
    return (citywide.where(F.col("subway_ridership").isNotNull()).groupBy(F.trunc("date", "MM").alias("month"))
            .agg(F.avg("subway_ridership").alias("ridership")))


def monthly_recovery(by_borough: DataFrame, transit_monthly: DataFrame, citywide: DataFrame, base_month: str,
                     transit_base: tuple[str, str], transit_label: str = "transit") -> DataFrame:
    """Borough indices to a base month, and transit to its mean over the base days."""
    boroughs = index_to_base(by_borough, "trips", ["borough"], F.col("month") == F.lit(base_month).cast("date")).select(
        "month", F.col("borough").alias("series"), F.col("trips").cast("double").alias("trips"), "index_base_100")
    base = citywide.where(F.col("date").between(F.lit(transit_base[0]).cast("date"), F.lit(transit_base[1]).cast("date"))).agg(
        F.avg("subway_ridership")).scalar()
    metro = transit_monthly.select("month", F.lit(transit_label).alias("series"), F.col("ridership").alias("trips"),
                                   F.try_divide(F.col("ridership") * 100.0, base).alias("index_base_100"))
    return boroughs.unionByName(metro)


def yearly_recovery(recovery: DataFrame) -> DataFrame:
    return recovery.groupBy(F.year("month").alias("year"), "series").agg(
        F.avg("index_base_100").alias("index_base_100"), F.sum("trips").alias("trips"))


def in_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    """Year filter as a timestamp range, so that it reaches the scan."""
    return df.where((F.col(ts) >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col(ts) < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))


def provider_by_borough(fhvhv: DataFrame, zones: DataFrame, year: int) -> DataFrame:
    """Provider shares per borough; zones without a borough stay as NULL."""
    per_zone = in_year(fhvhv, "pickup_datetime", year).groupBy(F.col("PULocationID").alias("LocationID"), X.provider().alias("aggregator")).agg(rows().alias("trips"))
    counts = (per_zone.join(zones.select("LocationID", "borough"), "LocationID", "left")
              .groupBy("borough", "aggregator").agg(F.sum("trips").alias("trips")))
    return share(counts, "trips", ["borough"])


def zone_dominant_type(all_trips: DataFrame, zones: DataFrame, year: int) -> DataFrame:
    counts = in_year(all_trips, "pickup_datetime", year).where("zone is not null").groupBy("zone", "taxi_type").agg(rows().alias("trips"))
    out = dominant(counts, "zone", "taxi_type", FAMILY_ORDER)
    return out.withColumnRenamed("dominant", "dominant_type").join(_zone_names(zones), "zone", "left")


def zone_dominant_aggregator(fhvhv: DataFrame, zones: DataFrame, year: int) -> DataFrame:
    counts = in_year(fhvhv, "pickup_datetime", year).groupBy(F.col("PULocationID").alias("zone"), X.provider().alias("aggregator")).agg(rows().alias("trips"))
    out = dominant(counts, "zone", "aggregator", PROVIDER_ORDER)
    return out.withColumnRenamed("dominant", "dominant_aggregator").join(_zone_names(zones), "zone", "left")


def _zone_names(zones: DataFrame) -> DataFrame:
    return zones.select(F.col("LocationID").alias("zone"), F.col("zone").alias("zone_name"), "borough")


def zone_access(fhvhv: DataFrame, zone_distance: DataFrame, year: int) -> DataFrame:
    """Zone volume and price of a year next to the distance to the nearest station."""
    vol = in_year(fhvhv, "pickup_datetime", year).groupBy(F.col("PULocationID").alias("LocationID")).agg(
        rows().alias("annual_trips"), F.avg("trip_miles").alias("avg_trip_miles"),
        ratio(F.sum("base_passenger_fare"), F.sum("trip_miles")).alias("fare_per_mile"))
    return zone_distance.join(vol, "LocationID")


def day_zone_volume(fhvhv: DataFrame) -> DataFrame:
    return fhvhv.groupBy(X.day_of("pickup_datetime").alias("date"), F.col("PULocationID").alias("zone")).agg(
        rows().alias("trips"), F.sum("base_passenger_fare").alias("fare"), F.sum("trip_miles").alias("miles"))


def daily_families(all_trips: DataFrame, weather: DataFrame, families: list[str]) -> DataFrame:
    """Daily counts per family joined with the weather of the day."""
    counts = all_trips.groupBy(X.day_of("pickup_datetime").alias("date"), "taxi_type").agg(rows().alias("trips"))
    wide = pivot_sum(counts, ["date"], "taxi_type", families, "trips")
    return wide.join(weather, "date").withColumn("is_weekend", F.dayofweek("date").isin(1, 7))


# --- yearly product metrics --------------------------------------------------------------------------------------

def north_star(all_trips: DataFrame) -> DataFrame:
    """Trips per active day and year: days are counted from the daily rollup, not by a distinct over trips."""
    daily = all_trips.groupBy(X.day_of("pickup_datetime").alias("d")).agg(rows().alias("trips"))
    return daily.groupBy(F.year("d").alias("year")).agg(
        F.sum("trips").alias("trips"), rows().alias("n_days"), ratio(F.sum("trips"), rows()).alias("avg_daily_trips"))


def _metrics(fhvhv: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Per trip: year, guarded wait and the three continuous metrics whose yearly medians are reported; more columns on request."""
    wait = X.wait_seconds()
    return fhvhv.select(
        *(more or []), F.year("pickup_datetime").alias("year"),
        F.when((F.col("pickup_datetime") > F.col("request_datetime")) & (wait < 3600), wait).alias("wait_sec"),
        X.hourly_pay().alias("med_hourly_pay"), F.when(F.col("trip_time") > 60, F.col("driver_pay")).alias("med_pay_per_trip"),
        F.when(F.col("trip_miles") > 0.1, F.col("base_passenger_fare") / F.col("trip_miles")).alias("med_fare_per_mile"))


def yearly_medians(fhvhv: DataFrame, metrics: list[str], exact: bool = True) -> DataFrame:
    """Yearly medians of several metrics in one pass over a (year, metric, value) relation."""
    rows_ = _metrics(fhvhv)
    if not exact:
        return rows_.groupBy("year").agg(*[approx_quantile(m, .5).alias(m) for m in metrics])
    long = rows_.unpivot(["year"], metrics, "metric", "value").where("value is not null")
    medians = exact_quantiles(long, ["year", "metric"], "value", {"p50": .5})
    return medians.groupBy("year").agg(*[F.max(F.when(F.col("metric") == m, F.col("p50"))).alias(m) for m in metrics])


def yearly_waits(fhvhv: DataFrame, exact: bool = True) -> DataFrame:
    """Median and p90 wait by year; exact from a histogram of whole seconds."""
    rows_ = _metrics(fhvhv).where("wait_sec is not null")
    if not exact:
        return rows_.groupBy("year").agg(approx_quantile("wait_sec", .5).alias("med_wait_sec"), approx_quantile("wait_sec", .9).alias("p90_wait_sec"))
    return rows_.groupBy("year", "wait_sec").agg(rows().alias("n")).groupBy("year").agg(
        hist_quantile("wait_sec", .5).alias("med_wait_sec"), hist_quantile("wait_sec", .9).alias("p90_wait_sec"))


def wait_and_pay(fhvhv: DataFrame, exact: bool = True) -> DataFrame:
    """Median and p90 wait, median hourly pay and median pay per trip, by year."""
    return yearly_waits(fhvhv, exact).join(yearly_medians(fhvhv, ["med_hourly_pay", "med_pay_per_trip"], exact), "year", "full")


def shared_match_by_year(fhvhv: DataFrame) -> DataFrame:
    requested = F.col("shared_request_flag") == "Y"
    return fhvhv.groupBy(F.year("pickup_datetime").alias("year")).agg(
        count_if(requested).alias("requested"), count_if(requested & (F.col("shared_match_flag") == "Y")).alias("n_matched"))


def fare_per_mile_by_year(fhvhv: DataFrame, exact: bool = True) -> DataFrame:
    return yearly_medians(fhvhv, ["med_fare_per_mile"], exact)


def liquidity_by_year(fhvhv: DataFrame) -> DataFrame:
    """Trips per active pickup zone and hour, averaged over hours."""
    cells = fhvhv.groupBy(X.day_of("pickup_datetime").alias("d"), F.hour("pickup_datetime").alias("h"), "PULocationID").agg(rows().alias("trips"))
    hours = cells.groupBy("d", "h").agg(F.sum("trips").alias("trips"), rows().alias("zones"))
    return hours.groupBy(F.year("d").alias("year")).agg(
        F.avg(F.col("trips") / F.col("zones")).alias("avg_trips_per_active_zone_hour"), F.avg("zones").alias("avg_active_zones"))


#: Bins of the sketch of a continuous metric: their width grows with the value, to some 0.2 % of it.
BINS = 500
MEDIANS = ["med_hourly_pay", "med_pay_per_trip", "med_fare_per_mile"]


def _bin(value: str) -> Column:
    """A bin number that grows with the value."""
    return F.floor(F.asinh(F.col(value) * 1000) * BINS)


def yearly_sums(fhvhv: DataFrame) -> DataFrame:
    """All that yearly metrics need of the trips, in one pass: counts by (day, hour, zone), by (year, wait) and by (year, bin) of each median.

    `kind` tells the relations apart (cells, waits, then MEDIANS); each is combined in the tasks before it is shuffled."""
    metrics = _metrics(fhvhv.withColumns({"_d": X.day_of("pickup_datetime"), "_h": F.hour("pickup_datetime"), "_r": (F.col("shared_request_flag") == "Y").cast("int"),
                                          "_m": ((F.col("shared_request_flag") == "Y") & (F.col("shared_match_flag") == "Y")).cast("int")}), ["_d", "_h", "PULocationID", "_r", "_m"])
    none = F.lit(None)
    wait = F.struct(F.lit(1).alias("kind"), none.cast("date").alias("d"), none.cast("int").alias("h"), F.col("wait_sec").cast("long").alias("v"), F.lit(0).alias("r"), F.lit(0).alias("m"))
    bins = [F.struct(F.lit(i + 2).alias("kind"), none.cast("date").alias("d"), none.cast("int").alias("h"), _bin(m).alias("v"), F.lit(0).alias("r"), F.lit(0).alias("m")) for i, m in enumerate(MEDIANS)]
    cell = F.struct(F.lit(0).alias("kind"), F.col("_d").alias("d"), F.col("_h").alias("h"), F.col("PULocationID").cast("long").alias("v"), F.coalesce("_r", F.lit(0)).alias("r"), F.coalesce("_m", F.lit(0)).alias("m"))
    long = metrics.select("year", F.explode(F.array(cell, wait, *bins)).alias("x")).select("year", "x.*").where("kind = 0 OR v IS NOT NULL")
    return long.groupBy("year", "kind", "d", "h", "v").agg(rows().alias("n"), F.sum("r").alias("requested"), F.sum("m").alias("n_matched"))


def medians_from_bins(fhvhv: DataFrame, sums: DataFrame) -> DataFrame:
    """Exact yearly medians: the counts of the bins tell which one or two hold the middle, a second pass counts values in these alone."""
    bins = sums.where("kind >= 2").select("year", "kind", "v", "n")
    by = Window.partitionBy("year", "kind")
    ranked = bins.withColumns({"hi": F.sum("n").over(by.orderBy("v")), "total": F.sum("n").over(by)}).withColumn("lo", F.col("hi") - F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    wanted = ranked.where(((F.col("lo") <= low) & (low < F.col("hi"))) | ((F.col("lo") <= high) & (high < F.col("hi"))))
    middle = wanted.select("year", "kind", "v", F.col("lo").alias("before"), low.alias("low"), high.alias("high"))
    long = _metrics(fhvhv).select("year", F.explode(F.array(*[F.struct(F.lit(i + 2).alias("kind"), F.col(m).alias("value")) for i, m in enumerate(MEDIANS)])).alias("x"))
    values = long.select("year", "x.kind", "x.value").where("value IS NOT NULL").withColumn("v", _bin("value"))
    # at most two bins for a year and metric: Spark broadcasts them by size
    inside = values.join(middle, ["year", "kind", "v"]).groupBy("year", "kind", "v", "before", "low", "high", "value").agg(rows().alias("n"))
    placed = inside.withColumn("hi", F.col("before") + F.sum("n").over(Window.partitionBy("year", "kind", "v").orderBy("value"))).withColumn("lo", F.col("hi") - F.col("n"))
    at = [F.max(F.when((F.col("lo") <= F.col(p)) & (F.col(p) < F.col("hi")), F.col("value"))) for p in ("low", "high")]
    medians = placed.groupBy("year", "kind").agg((at[0] + (at[1] - at[0]) * 0.5).alias("p50"))
    return medians.groupBy("year").agg(*[F.max(F.when(F.col("kind") == i + 2, F.col("p50"))).alias(m) for i, m in enumerate(MEDIANS)])


def product_metrics_yearly(all_trips: DataFrame, fhvhv: DataFrame, exact: bool = True) -> DataFrame:
    """All yearly metrics. Exact: one pass over all families for the days, two over the high-volume trips."""
    out = north_star(all_trips)
    if not exact:
        medians = yearly_medians(fhvhv, MEDIANS, exact)
        for part in (yearly_waits(fhvhv, exact), medians, shared_match_by_year(fhvhv), liquidity_by_year(fhvhv)):
            out = out.join(part, "year", "left")
        return out
    sums = lineage.cut(yearly_sums(fhvhv))
    waits = sums.where("kind = 1").groupBy("year").agg(hist_quantile("v", .5).alias("med_wait_sec"), hist_quantile("v", .9).alias("p90_wait_sec"))
    cells = sums.where("kind = 0")
    matches = cells.groupBy("year").agg(F.sum("requested").alias("requested"), F.sum("n_matched").alias("n_matched"))
    hours = cells.groupBy("year", "d", "h").agg(F.sum("n").alias("trips"), rows().alias("zones"))
    liquid = hours.groupBy("year").agg(F.avg(F.col("trips") / F.col("zones")).alias("avg_trips_per_active_zone_hour"), F.avg("zones").alias("avg_active_zones"))
    for part in (waits, medians_from_bins(fhvhv, sums), matches, liquid):
        out = out.join(part, "year", "left")
    return out


# --- timelapse and map -------------------------------------------------------------------------------------------

def zone_timelapse(fhvhv: DataFrame) -> DataFrame:
    """Mean daily trips by zone and hour for weekdays and weekends; days without trips are not counted."""
    daily = fhvhv.where(F.col("PULocationID").isNotNull()).groupBy(
        F.col("PULocationID").alias("zone"), F.hour("pickup_datetime").alias("hr"), X.day_of("pickup_datetime").alias("d")).agg(rows().alias("trips"))
    profile = F.when(F.dayofweek("d").isin(1, 7), "weekend").otherwise("weekday")
    return daily.groupBy(profile.alias("profile"), "zone", "hr").agg(F.avg("trips").alias("avg_trips"))


def ramp_domain(df: DataFrame, value: str, by: list[str], lo: float = .05, hi: float = .95) -> DataFrame:
    """Clipping domain of a map metric from its own marginal quantiles."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(lo)).alias("lo"), F.percentile(value, F.lit(hi)).alias("hi"))


def ramp_position(df: DataFrame, value: str, by: list[str], lo: float = .05, hi: float = .95) -> DataFrame:
    """Each value's place on the colour ramp of its group."""
    return (df.join(ramp_domain(df, value, by, lo, hi), by)
            .withColumn("position", X.unit_position(value, F.col("lo"), F.col("hi"))))


def zone_metric_matrix(cube: DataFrame, zones: DataFrame, min_n: int = 50) -> DataFrame:
    """zone x period x provider medians, hidden below min_n trips, with the ramp position among visible cells."""
    shown = F.when(F.col("n_trips") >= min_n, F.col("med_wait_sec"))
    cells = lineage.cut(cube.withColumn("shown_wait_sec", shown))
    dom = cells.where("shown_wait_sec is not null").groupBy("period", "aggregator").agg(
        F.percentile("shown_wait_sec", F.lit(.05)).alias("lo"), F.percentile("shown_wait_sec", F.lit(.95)).alias("hi"))
    return (cells.join(_zone_names(zones), "zone", "left").join(dom, ["period", "aggregator"], "left")
            .withColumn("position", F.when(F.col("shown_wait_sec").isNotNull(), X.unit_position("shown_wait_sec", F.col("lo"), F.col("hi")))))


# --- panels over years -------------------------------------------------------------------------------------------

def zone_year_panel(all_trips: DataFrame) -> DataFrame:
    """zone x year counts by family with logs, shares of metered trips and of all trips."""
    counts = all_trips.where("zone is not null").groupBy("zone", F.year("pickup_datetime").alias("year"), "taxi_type").agg(rows().alias("trips"))
    wide = pivot_sum(counts, ["zone", "year"], "taxi_type", FAMILY_ORDER, "trips")
    total = F.col("yellow") + F.col("green") + F.col("fhvhv") + F.col("fhv")
    return wide.withColumns({
        "total": total, "log_yellow": X.log_clip1("yellow"), "log_green": X.log_clip1("green"), "log_fhvhv": X.log_clip1("fhvhv"),
        "fhvhv_share": F.try_divide(F.col("fhvhv").cast("double"), total.cast("double")),
        "fhvhv_share_of_pair": F.try_divide(F.col("fhvhv").cast("double"), (F.col("fhvhv") + F.col("green")).cast("double"))})


def recovery_by_type(monthly: DataFrame, base_year: int, years: list[int]) -> DataFrame:
    """Trips of each family in given years as percent of a base year."""
    yearly = monthly.groupBy("taxi_type").agg(
        F.sum(F.when(F.year("month") == base_year, F.col("trips"))).alias("base_trips"),
        *[F.sum(F.when(F.year("month") == y, F.col("trips"))).alias(f"trips_{y}") for y in years])
    return yearly.withColumns({f"recovery_{y}_pct": F.try_divide(F.col(f"trips_{y}") * 100.0, F.col("base_trips").cast("double")) for y in years})
