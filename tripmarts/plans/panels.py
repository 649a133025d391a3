"""Serving queries over marts: `panel(name, marts, **params)`.

`marts` maps mart names to DataFrames. List parameters are the multi-select filters of a dashboard; None
means no filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts.functions import trip as X
from tripmarts.operators.rollup import correlation, pivot_sum, ratio, rows, top_n
from tripmarts.operators.window import share, year_before

Marts = dict[str, DataFrame]
PANELS: dict[str, Callable[..., DataFrame]] = {}


def panel(name: str, marts: Marts, **params) -> DataFrame:
    return PANELS[name](marts, **params)


def _panel(fn):
    PANELS[fn.__name__] = fn
    return fn


def chosen(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Multi-select filter."""
    return df if values is None else df.where(F.col(column).isin(values))


def between(df: DataFrame, column: str, dates: tuple[str, str] | None) -> DataFrame:
    """Date-range filter, both ends included."""
    if dates is None:
        return df
    return df.where(F.col(column).between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))


def filter_values(df: DataFrame, column: str) -> DataFrame:
    """Choices of a filter."""
    return df.select(column).distinct().orderBy(column)


def _weighted(value: str, weight: str, cond: Column | None = None) -> Column:
    w = F.col(weight) if cond is None else F.when(cond, F.col(weight))
    return ratio(F.sum(F.col(value) * w), F.sum(w))


@_panel
def yearly_provider_share(m: Marts, provider: str = "Uber") -> DataFrame:
    yearly = m["aggregator_monthly"].groupBy(F.year("month").alias("year"), "aggregator").agg(F.sum("trips").alias("trips"))
    return share(yearly, "trips", ["year"]).where(F.col("aggregator") == provider).select(X.year_start("year").alias("time"), "aggregator", "share_pct").orderBy("time")


@_panel
def yearly_kpis(m: Marts, years: list[int] | None = None) -> DataFrame:
    return chosen(m["product_metrics_yearly"], "year", years).select(
        X.year_start("year").alias("time"), "avg_daily_trips", (F.col("med_wait_sec") / 60).alias("med_wait_min"), "med_hourly_pay",
        "med_fare_per_mile", "avg_trips_per_active_zone_hour").orderBy("time")


@_panel
def significance(m: Marts, table: str, effect: str, level: float = 0.05) -> DataFrame:
    """Effects ordered by size with a marker for p below the level."""
    return m[table].withColumn("significant", F.col("p_value") < level).orderBy(F.desc_nulls_last(effect))


@_panel
def yoy_bars(m: Marts, boroughs: list[str] | None = None) -> DataFrame:
    return chosen(m["policy_yoy"], "borough", boroughs).select("borough", "trips_yoy_pct", "fare_yoy_pct").orderBy("trips_yoy_pct")


@_panel
def wait_heatmap(m: Marts, aggregators: list[str] | None = None) -> DataFrame:
    """Trip-weighted wait in minutes, one row per hour, one column per weekday (Monday first)."""
    rows_ = chosen(m["wait_by_hour_dow_aggregator"], "aggregator", aggregators)
    days = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    return rows_.groupBy("hour").agg(*[(_weighted("med_wait_sec", "n_trips", F.col("dow") == i) / 60).alias(day) for i, day in enumerate(days)]).orderBy("hour")


@_panel
def provider_wait(m: Marts, aggregators: list[str] | None = None, min_n: int = 50) -> DataFrame:
    rows_ = chosen(m["zone_wait_by_aggregator"], "aggregator", aggregators).where(F.col("n_trips") >= min_n)
    return rows_.agg(*[(_weighted("med_wait_sec", "n_trips", F.col("aggregator") == p) / 60).alias(p) for p in ("Uber", "Lyft", "Via", "Juno")])


@_panel
def worst_wait_zones(m: Marts, aggregators: list[str] | None = None, min_n: int = 50, n: int = 15) -> DataFrame:
    waits = chosen(m["zone_wait_by_aggregator"], "aggregator", aggregators).where(F.col("n_trips") >= min_n)
    per_zone = waits.groupBy("zone").agg(F.sum(F.col("med_wait_sec") * F.col("n_trips")).alias("w"), F.sum("n_trips").alias("n"))
    named = (per_zone.join(m["zone_access"].select(F.col("LocationID").alias("zone"), F.col("zone").alias("zone_name")), "zone")
             .join(m["zone_dominant_type"].select("zone"), "zone", "left_semi"))
    out = named.groupBy("zone_name").agg((ratio(F.sum("w"), F.sum("n")) / 60).alias("med_wait_min"))
    return top_n(out, n, [F.desc_nulls_last("med_wait_min"), F.asc("zone_name")])


@_panel
def zones_by_type(m: Marts, types: list[str] | None = None, n: int = 30) -> DataFrame:
    return top_n(chosen(m["zone_dominant_type"], "dominant_type", types), n, [F.desc("dominant_share_pct"), F.asc("zone")])


@_panel
def cluster_sizes(m: Marts, clusters: list[str] | None = None, boroughs: list[str] | None = None) -> DataFrame:
    return chosen(chosen(m["zone_clusters"], "cluster_label", clusters), "borough", boroughs).groupBy("cluster_label").agg(rows().alias("n_zones"))


@_panel
def airport_table(m: Marts, airports: list[int]) -> DataFrame:
    """Volume, wait and price of airport zones; the wait may be missing."""
    z = m["zone_access"].where(F.col("LocationID").isin(airports))
    wait = m["zone_wait_time"].select(F.col("zone").alias("LocationID"), (F.col("med_wait_sec") / 60).alias("med_wait_min"))
    return z.join(wait, "LocationID", "left").select("zone", "annual_trips", "med_wait_min", "fare_per_mile").orderBy(F.desc_nulls_last("med_wait_min"))


@_panel
def recovery_pct(m: Marts, base: int, year: int) -> DataFrame:
    t = m["monthly_by_type"].groupBy("taxi_type").agg(F.sum(F.when(F.year("month") == base, F.col("trips"))).alias("a"),
                                                      F.sum(F.when(F.year("month") == year, F.col("trips"))).alias("b"))
    return t.select("taxi_type", F.try_divide(F.col("b") * 100.0, F.col("a").cast("double")).alias("recovery_pct"))


@_panel
def index_series(m: Marts, types: list[str] | None = None, transit_label: str = "transit") -> DataFrame:
    """Family indices with the transit index appended."""
    fam = chosen(m["monthly_by_type_indexed"], "taxi_type", types).select(F.col("month").alias("time"), F.col("taxi_type").alias("series"), "index_base_100")
    transit = m["monthly_recovery_indexed"].where(F.col("series") == transit_label).select(F.col("month").alias("time"), "series", "index_base_100")
    return fam.unionByName(transit).orderBy("time", "series")


@_panel
def recovery_series(m: Marts, boroughs: list[str] | None = None, yearly: bool = False, transit_label: str = "transit") -> DataFrame:
    src = m["yearly_recovery_indexed"] if yearly else m["monthly_recovery_indexed"]
    time = X.year_start("year") if yearly else F.col("month")
    keep = F.lit(True) if boroughs is None else (F.col("series") == transit_label) | F.col("series").isin(boroughs)
    return src.where(keep).select(time.alias("time"), "series", F.col("index_base_100").alias("recovery_idx")).orderBy("time", "series")


@_panel
def trough(m: Marts, before: str) -> DataFrame:
    """Lowest index of each family before a date, with its month; the earlier month wins a tie."""
    rows_ = m["monthly_by_type_indexed"].where((F.col("month") < F.lit(before).cast("date")) & F.col("index_base_100").isNotNull())
    return rows_.groupBy("taxi_type").agg(F.min("index_base_100").alias("min_index_pct"),
                                          F.min_by("month", F.struct("index_base_100", "month")).alias("bottom_month")).orderBy("min_index_pct")


@_panel
def provider_share_by_borough(m: Marts, boroughs: list[str] | None = None) -> DataFrame:
    return chosen(m["aggregator_by_borough"], "borough", boroughs).groupBy("borough").agg(
        *[F.max(F.when(F.col("aggregator") == p, F.col("share_pct"))).alias(p) for p in ("Uber", "Lyft")]).orderBy("borough")


@_panel
def zone_counts(m: Marts, by: str = "dominant_type", boroughs: list[str] | None = None) -> DataFrame:
    table = "zone_dominant_type" if by == "dominant_type" else "zone_dominant_aggregator"
    return chosen(m[table], "borough", boroughs).groupBy(F.col(by).alias("dominant")).agg(rows().alias("n_zones"))


@_panel
def dominance_exceptions(m: Marts, usual_provider: str = "Uber", usual_type: str = "fhvhv") -> DataFrame:
    a = m["zone_dominant_aggregator"].where(F.col("dominant_aggregator") != usual_provider).select("zone_name", "borough", F.col("dominant_aggregator").alias("dominant"), "dominant_share_pct")
    t = m["zone_dominant_type"].where(F.col("dominant_type") != usual_type).select("zone_name", "borough", F.col("dominant_type").alias("dominant"), "dominant_share_pct")
    return a.unionByName(t).orderBy(F.desc("dominant_share_pct"))


@_panel
def event_kpis(m: Marts, event_types: list[str] | None = None) -> DataFrame:
    """Mean lifts and count of the chosen events; correlation of price tier and lift over all events."""
    kpi = chosen(m["event_impact"], "event_type", event_types).agg(
        F.avg("post_pu_lift_pct").alias("avg_post_pu"), F.avg("pre_do_lift_pct").alias("avg_pre_do"), rows().alias("n_events"))
    r = m["event_hypothesis"].agg(correlation("price_tier", "post_pu_lift_pct")).scalar()
    return kpi.withColumn("price_lift_r", r)


@_panel
def lift_by_tier(m: Marts) -> DataFrame:
    return m["event_hypothesis_venue"].groupBy(F.col("price_tier").cast("string").alias("tier")).agg(F.percentile("post_pu_lift", F.lit(.5)).alias("post_pu_lift")).orderBy("tier")


@_panel
def lift_by_type(m: Marts) -> DataFrame:
    return m["event_impact"].groupBy("event_type").agg(
        F.percentile("post_pu_lift_pct", F.lit(.5)).alias("post_pu_lift"), F.percentile("pre_do_lift_pct", F.lit(.5)).alias("pre_do_lift")).orderBy(F.desc("post_pu_lift"))


@_panel
def top_events(m: Marts, event_types: list[str] | None = None, n: int = 20) -> DataFrame:
    ev = chosen(m["event_impact"], "event_type", event_types).select(X.event_label().alias("event"), F.col("post_pu_lift_pct").alias("lift_pct"))
    return top_n(ev, n, [F.desc("lift_pct"), F.asc("event")])


@_panel
def event_table(m: Marts, event_types: list[str] | None = None, n: int = 30) -> DataFrame:
    ev = chosen(m["event_hypothesis"], "event_type", event_types).select(
        "date", "event_type", "title", "venue_name", "price_tier", "dist_m", "pre_do_lift_pct", "post_pu_lift_pct")
    return top_n(ev, n, [F.desc("post_pu_lift_pct"), F.asc("date"), F.asc("title")])


# --- overview dashboards -----------------------------------------------------------------------------------------

_SUMS = ["trips", "pay_sum", "base_passenger_fare_sum"]


def _providers(df: DataFrame, providers: list[str] | None) -> DataFrame:
    return chosen(df, "provider", providers)


@_panel
def kpis_yoy(m: Marts, providers: list[str] | None = None) -> DataFrame:
    """Monthly trips, pay, fare and commission with change against the same month a year earlier."""
    monthly = _providers(m["trips_daily"], providers).groupBy(F.trunc("date", "MM").alias("month")).agg(*[F.sum(c).alias(c) for c in _SUMS])
    monthly = monthly.withColumn("commission", F.col("base_passenger_fare_sum") - F.col("pay_sum"))
    out = year_before(monthly, [], "month", [*_SUMS, "commission"])
    return out.withColumns({f"{c}_yoy_pct": (F.try_divide(F.col(c).cast("double"), F.col(f"{c}_prev").cast("double")) - 1) * 100 for c in [*_SUMS, "commission"]})


@_panel
def bookings_ytd(m: Marts) -> DataFrame:
    """Gross bookings from January to each month, with change against the year before."""
    monthly = m["trips_monthly_provider"].groupBy("month").agg(F.sum("bookings").alias("bookings"))
    ytd = monthly.withColumn("ytd", F.sum("bookings").over(Window.partitionBy(F.year("month")).orderBy("month")))
    out = year_before(ytd, [], "month", ["ytd"])
    return out.withColumn("ytd_yoy_pct", (F.try_divide(F.col("ytd"), F.col("ytd_prev")) - 1) * 100)


@_panel
def daily_by_provider(m: Marts, dates: tuple[str, str] | None = None) -> DataFrame:
    """Daily volume, fare, pay and commission with the provider's share of the day."""
    rows_ = between(m["trips_daily"], "date", dates).select(
        "date", "provider", "trips", F.col("base_passenger_fare_sum").alias("fare"), F.col("pay_sum").alias("pay"),
        (F.col("base_passenger_fare_sum") - F.col("pay_sum")).alias("commission"))
    return share(rows_, "trips", ["date"])


@_panel
def top_pickup_zones(m: Marts, dates: tuple[str, str] | None = None, n: int = 20) -> DataFrame:
    z = between(m["trips_by_zone_daily"], "date", dates).groupBy("LocationID", "zone").agg(F.sum("trips").alias("trips"))
    return top_n(z, n, [F.desc("trips"), F.asc("LocationID")])


@_panel
def hour_dow(m: Marts, dates: tuple[str, str] | None = None) -> DataFrame:
    grid = between(m["trips_hourly_dow_daily"], "date", dates).groupBy(X.dow_sunday0("date").alias("dow"), "hour").agg(F.sum("trips").alias("trips"))
    named = grid.withColumn("_h", F.concat(F.lit("h"), F.col("hour").cast("string")))
    return pivot_sum(named, ["dow"], "_h", [f"h{h}" for h in range(24)], "trips")


@_panel
def take_rate_by_month(m: Marts) -> DataFrame:
    return m["trips_monthly_provider"].groupBy("month").agg(((1 - ratio(F.sum("pay_sum"), F.sum("fare_sum"))) * 100).alias("take_rate_pct")).orderBy("month")


@_panel
def per_mile_and_hour(m: Marts) -> DataFrame:
    """Revenue and pay per mile and the driver's effective hourly rate, by month."""
    d = m["trips_daily"].groupBy(F.trunc("date", "MM").alias("month"))
    return d.agg(ratio(F.sum("base_passenger_fare_sum"), F.sum("miles_sum")).alias("revenue_per_mile"), ratio(F.sum("pay_sum"), F.sum("miles_sum")).alias("pay_per_mile"),
                 (ratio(F.sum("pay_sum"), F.sum("time_sum")) * 3600).alias("driver_hourly"))


@_panel
def airports_vs_rest(m: Marts, airports: list[int]) -> DataFrame:
    g = F.when(F.col("LocationID").isin(airports), "airports").otherwise("rest")
    return m["trips_by_zone"].groupBy(g.alias("area")).agg(
        F.sum("trips").alias("trips"), ratio(F.sum("fare_sum"), F.sum("trips")).alias("avg_fare"), (ratio(F.sum("pay_sum"), F.sum("time_sum")) * 3600).alias("driver_hourly"))


@_panel
def revenue_concentration(m: Marts, n: int = 10) -> DataFrame:
    """Share of fare revenue taken by the n largest zones."""
    z = m["trips_by_zone"].groupBy("LocationID").agg(F.sum("fare_sum").alias("fare"))
    total = z.agg(F.sum("fare")).scalar()
    return top_n(z, n, [F.desc("fare"), F.asc("LocationID")]).agg(F.sum("fare").alias("top_fare")).withColumn(
        "top_share_pct", F.try_divide(F.col("top_fare") * 100.0, total))


@_panel
def weather_correlations(m: Marts) -> DataFrame:
    d = m["trips_daily"].groupBy("date").agg(F.sum("trips").cast("double").alias("trips"), ratio(F.sum("base_passenger_fare_sum"), F.sum("trips")).alias("avg_fare"))
    return d.join(m["weather_daily"], "date").agg(correlation("prcp_mm", "trips").alias("rain_trips_r"), correlation("tmax_c", "avg_fare").alias("temp_fare_r"))


@_panel
def driver_hourly_map(m: Marts, end: str = "pickup") -> DataFrame:
    src = m["trips_by_zone"] if end == "pickup" else m["trips_by_zone_do"]
    z = src.groupBy("LocationID").agg((ratio(F.sum("pay_sum"), F.sum("time_sum")) * 3600).alias("driver_hourly"), F.sum("trips").alias("trips"))
    return z.join(m["zone_centroids"].select("LocationID", "lat", "lon"), "LocationID")


@_panel
def fee_breakdown(m: Marts, providers: list[str] | None = None) -> DataFrame:
    fees = ["base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "cbd_congestion_fee", "airport_fee"]
    wide = _providers(m["trips_daily"], providers).agg(*[F.sum(f"{c}_sum").alias(c) for c in fees])
    return share(wide.unpivot([], [F.col(c) for c in fees], "fee", "amount"), "amount")


@_panel
def bookings_share(m: Marts) -> DataFrame:
    return share(m["trips_monthly_provider"].select("month", "provider", "bookings"), "bookings", ["month"])


@_panel
def ride_types(m: Marts) -> DataFrame:
    """Take and trips by ride type and provider."""
    return m["mart_segment_daily"].groupBy("provider", "segment").agg(
        F.sum("trips").alias("trips"), F.sum("take").alias("take"), (ratio(F.sum("take"), F.sum("fare")) * 100).alias("take_pct"))


@_panel
def wait_gap(m: Marts, by_hour: bool = False) -> DataFrame:
    """Mean wait of Lyft minus Uber per wait group (and hour), weighted by trips."""
    keys = ["wait_group"] + (["hour"] if by_hour else [])
    w = m["wait_hourly_provider"].groupBy(*keys).agg(
        _weighted("avg_wait", "trips", F.col("provider") == "Uber").alias("uber"), _weighted("avg_wait", "trips", F.col("provider") == "Lyft").alias("lyft"))
    return w.withColumn("gap_sec", F.col("lyft") - F.col("uber"))


@_panel
def distance_pricing(m: Marts, providers: list[str] | None = None) -> DataFrame:
    return _providers(m["mile_bin_pricing"], providers).select("provider", "mile_bin", "mile_bin_order", "take_rate_pct", "fare_per_mile").orderBy("provider", "mile_bin_order")
