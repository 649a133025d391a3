"""All marts by name: grain, builder and what they are built from.

`build` stores marts one by one; a mart made from other marts reads their stored form, so trips are scanned only
by the marts at the bottom.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmarts.operators import clean as C
from tripmarts.operators import spatial
from tripmarts.plans import access as A
from tripmarts.plans import events as E
from tripmarts.plans import overview as O
from tripmarts.plans import shared as S
from tripmarts.plans import suite as M
from tripmarts.sources.store import MartStore


@dataclass
class Settings:
    """Dates that depend on the archive at hand."""

    base_month: str = "2019-01-01"
    base_year: int = 2019
    year: int = 2024
    transit_base: tuple[str, str] = ("2020-03-01", "2020-03-11")


@dataclass
class Inputs:
    """Cleaned trips and dimensions. `all_trips` is (taxi_type, pickup_datetime, zone) over all families."""

    fhvhv: DataFrame
    all_trips: DataFrame
    zones: DataFrame
    weather: DataFrame
    transit: DataFrame
    stations: DataFrame
    venues: DataFrame
    events: DataFrame


@dataclass
class Mart:
    grain: list[str]
    build: Callable[[Inputs, Callable[[str], DataFrame], Settings], DataFrame]


def _valid(i: Inputs) -> DataFrame:
    return C.complete_trips(i.fhvhv)


def _sharing(i: Inputs) -> DataFrame:
    return C.request_before_pickup(i.fhvhv)


def _core(i: Inputs) -> DataFrame:
    return C.access_trips(i.fhvhv)


MARTS: dict[str, Mart] = {
    "trips_daily": Mart(["date", "provider"], lambda i, m, s: O.trips_daily(i.fhvhv)),
    "trips_cbd_daily": Mart(["date", "provider"], lambda i, m, s: O.trips_cbd_daily(i.fhvhv)),
    "trips_hourly_dow_daily": Mart(["date", "hour"], lambda i, m, s: O.trips_hourly_dow_daily(i.fhvhv)),
    "trips_hourly_dow": Mart(["dow", "hour"], lambda i, m, s: O.trips_hourly_dow(m("trips_hourly_dow_daily"))),
    "trips_heatmap": Mart(["dow"], lambda i, m, s: O.trips_heatmap(m("trips_hourly_dow"))),
    "trips_by_zone": Mart(["month", "LocationID"], lambda i, m, s: O.trips_by_zone(i.fhvhv, i.zones)),
    "trips_by_zone_daily": Mart(["date", "LocationID"], lambda i, m, s: O.trips_by_zone_daily(i.fhvhv, i.zones)),
    "trips_by_zone_do": Mart(["month", "LocationID"], lambda i, m, s: O.trips_by_zone_do(i.fhvhv, i.zones)),
    "trips_monthly_provider": Mart(["month", "provider"], lambda i, m, s: O.trips_monthly_provider(i.fhvhv)),
    "wav_hourly_zone": Mart(["hour", "provider", "PULocationID"], lambda i, m, s: O.wav_hourly_zone(_valid(i))),
    "mart_shared_zone": Mart(["date", "provider", "LocationID"], lambda i, m, s: O.mart_shared_zone(_valid(i), i.zones)),
    "mart_segment_daily": Mart(["date", "provider", "segment"], lambda i, m, s: O.mart_segment_daily(_valid(i))),
    "wait_hourly_provider": Mart(["hour", "dow", "provider", "wait_group"], lambda i, m, s: O.wait_hourly_provider(_valid(i))),
    "surge_hourly_provider": Mart(["hour", "dow", "provider"], lambda i, m, s: O.surge_hourly_provider(_valid(i))),
    "mile_bin_pricing": Mart(["provider", "mile_bin"], lambda i, m, s: O.mile_bin_pricing(_valid(i))),
    "mart_shared_daily": Mart(["date", "provider"], lambda i, m, s: S.mart_shared_daily(_sharing(i))),
    "shared_heatmap": Mart(["provider", "week_day", "hour"], lambda i, m, s: S.shared_heatmap(_sharing(i))),
    "wait_histogram": Mart(["zone", "aggregator", "period", "hr", "dow", "wait_sec"], lambda i, m, s: M.wait_base(C.wait_trips(i.fhvhv))),
    "zone_wait_time": Mart(["zone"], lambda i, m, s: M.zone_wait_time(m("wait_histogram"))),
    "zone_wait_by_period": Mart(["zone", "period"], lambda i, m, s: M.zone_wait_by_period(m("wait_histogram"))),
    "zone_wait_by_aggregator": Mart(["zone", "aggregator"], lambda i, m, s: M.zone_wait_by_aggregator(m("wait_histogram"))),
    "zone_wait_by_period_agg": Mart(["zone", "period", "aggregator"], lambda i, m, s: M.zone_wait_cube(m("wait_histogram"))),
    "wait_by_hour_dow": Mart(["hour", "dow"], lambda i, m, s: M.wait_by_hour_dow(m("wait_histogram"))),
    "wait_by_hour_dow_aggregator": Mart(["hour", "dow", "aggregator"], lambda i, m, s: M.wait_by_hour_dow(m("wait_histogram"), True)),
    "monthly_by_type": Mart(["month", "taxi_type"], lambda i, m, s: M.monthly_by_type(i.all_trips)),
    "monthly_by_type_indexed": Mart(["month", "taxi_type"], lambda i, m, s: M.monthly_by_type_indexed(m("monthly_by_type"), s.base_month)),
    "aggregator_monthly": Mart(["month", "aggregator"], lambda i, m, s: M.aggregator_monthly(i.fhvhv)),
    "aggregator_monthly_indexed": Mart(["month", "aggregator"], lambda i, m, s: M.aggregator_monthly_indexed(m("aggregator_monthly"), s.base_month)),
    "yearly_aggregator_indexed": Mart(["year", "aggregator"], lambda i, m, s: M.yearly_aggregator_indexed(m("aggregator_monthly"), s.base_year)),
    "daily_citywide": Mart(["date"], lambda i, m, s: M.daily_citywide(i.fhvhv, i.weather, i.transit)),
    "daily_by_borough": Mart(["date", "borough"], lambda i, m, s: M.daily_by_borough(i.fhvhv, i.zones)),
    "monthly_by_borough": Mart(["month", "borough"], lambda i, m, s: M.monthly_by_borough(m("daily_by_borough"))),
    "monthly_transit": Mart(["month"], lambda i, m, s: M.monthly_transit(m("daily_citywide"))),
    "monthly_recovery_indexed": Mart(["month", "series"], lambda i, m, s: M.monthly_recovery(
        m("monthly_by_borough"), m("monthly_transit"), m("daily_citywide"), s.base_month, s.transit_base)),
    "yearly_recovery_indexed": Mart(["year", "series"], lambda i, m, s: M.yearly_recovery(m("monthly_recovery_indexed"))),
    "aggregator_by_borough": Mart(["borough", "aggregator"], lambda i, m, s: M.provider_by_borough(i.fhvhv, i.zones, s.year)),
    "zone_dominant_type": Mart(["zone"], lambda i, m, s: M.zone_dominant_type(i.all_trips, i.zones, s.year)),
    "zone_dominant_aggregator": Mart(["zone"], lambda i, m, s: M.zone_dominant_aggregator(i.fhvhv, i.zones, s.year)),
    "zone_distance": Mart(["LocationID"], lambda i, m, s: spatial.nearest(i.zones, "LocationID", i.stations)),
    "zone_access": Mart(["LocationID"], lambda i, m, s: M.zone_access(
        i.fhvhv, i.zones.where(F.col("borough") != "EWR").join(m("zone_distance"), "LocationID"), s.year)),
    "product_metrics_yearly": Mart(["year"], lambda i, m, s: M.product_metrics_yearly(i.all_trips, i.fhvhv)),
    "zone_timelapse": Mart(["profile", "zone", "hr"], lambda i, m, s: M.zone_timelapse(i.fhvhv)),
    "zone_metric_matrix": Mart(["zone", "period", "aggregator"], lambda i, m, s: M.zone_metric_matrix(m("zone_wait_by_period_agg"), i.zones)),
    "zone_year_panel": Mart(["zone", "year"], lambda i, m, s: M.zone_year_panel(i.all_trips)),
    "wav_dashboard_cells": Mart(["date", "dow", "hour", "provider", "PULocationID"], lambda i, m, s: A.dashboard_cells(_core(i))),
    "wav_dashboard_wait_summary": Mart(["provider", "segment"], lambda i, m, s: A.wait_summary(_core(i))),
    "wav_v2_date_hour": Mart(["date", "hour", "provider", "exact_segment", "accessibility_segment"], lambda i, m, s: A.date_hour(_core(i))),
    "wav_v2_monthly_metrics": Mart(["month", "provider", "accessibility_segment"], lambda i, m, s: A.monthly_metrics(_core(i))),
    "wav_v2_zone_metrics": Mart(["direction", "LocationID"], lambda i, m, s: A.zone_metrics(_core(i))),
    "wait_hist_daily": Mart(["date", "segment", "wait_bin_min"], lambda i, m, s: A.wait_hist_daily(_core(i))),
    "event_impact": Mart(E.EVENT_KEYS, lambda i, m, s: E.event_impact(i.events, i.venues, i.fhvhv)),
    "event_impact_by_type": Mart(["event_type"], lambda i, m, s: E.impact_by_type(m("event_impact"))),
    "event_hypothesis": Mart(E.EVENT_KEYS, lambda i, m, s: E.event_hypothesis(m("event_impact"), i.venues, m("zone_distance"))),
    "event_hypothesis_venue": Mart(["venue_id"], lambda i, m, s: E.hypothesis_by_venue(m("event_hypothesis"))),
    "event_timelapse": Mart(["venue_id", "hr", "zone"], lambda i, m, s: E.event_timelapse(i.fhvhv, i.events, i.venues)),
    "event_wait_vs_baseline": Mart(E.EVENT_KEYS, lambda i, m, s: E.event_wait_vs_baseline(i.fhvhv, i.events, i.venues, m("event_impact"))),
}


def store(spark, root: str) -> MartStore:
    """A store that accepts exactly the registered marts."""
    return MartStore(spark, root, dict.fromkeys(MARTS))


def build(st: MartStore, inputs: Inputs, names: list[str] | None = None, settings: Settings | None = None, rebuild: bool = False) -> dict[str, DataFrame]:
    """Build the named marts (all by default) and what they need; stored ones are reused unless `rebuild`."""
    s, done = settings or Settings(), {}

    def mart(name: str) -> DataFrame:
        if name not in done:
            spec = MARTS[name]
            make = lambda: spec.build(inputs, mart, s)
            done[name] = st.write(make(), name, grain=spec.grain) if rebuild else st.once(name, make, grain=spec.grain)
        return done[name]

    for n in names or list(MARTS):
        mart(n)
    return done
