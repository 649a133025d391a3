"""Event-window demand: lift around events against the same weekday's ordinary days.

Baselines depend on (venue, start hour, weekday) only, so they are summed once per such slot. An event's
own day is then added to its slot, which replaces an event x day pairing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import trip as X
from tripmarts.operators.quantile import hist_mean, hist_quantile
from tripmarts.operators.rollup import rows

# Hours relative to the start, end excluded.
WINDOWS = {"pre": (-2, 0), "event": (0, 3), "post": (3, 5)}
EVENT_KEYS = ["date", "venue_id", "event_type", "title", "start_hour"]


def venue_zones(venues: DataFrame) -> DataFrame:
    return venues.select("venue_id", F.explode(X.zone_set()).alias("zone"))


def zone_hourly(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Pickups and drop-offs per day, hour and venue zone; drop-offs count at the pickup hour. One scan for both ends."""
    ends = F.array(F.struct(F.col("PULocationID").cast("bigint").alias("zone"), F.lit(1).alias("pu"), F.lit(0).alias("do_")),
                   F.struct(F.col("DOLocationID").cast("bigint").alias("zone"), F.lit(0).alias("pu"), F.lit(1).alias("do_")))
    long = trips.select(X.day_of("pickup_datetime").alias("d"), F.hour("pickup_datetime").alias("hr"), F.explode(ends).alias("e")).select("d", "hr", "e.*")
    return (long.join(zones.select("zone").distinct(), "zone", "left_semi").groupBy("d", "hr", "zone")
            .agg(F.sum("pu").alias("pu_trips"), F.sum("do_").alias("do_trips")).withColumn("dow", X.dow_sunday0("d")))


def _spill_midnight(hourly: DataFrame) -> DataFrame:
    """Also offer each hour as hour + 24 of the day before."""
    both = F.array(F.struct(F.col("d"), F.col("hr")), F.struct(F.date_sub("d", 1).alias("d"), (F.col("hr") + 24).alias("hr")))
    rest = [c for c in hourly.columns if c not in ("d", "hr", "dow")]
    return hourly.select(F.explode(both).alias("x"), *rest).select("x.*", *rest).withColumn("dow", X.dow_sunday0("d"))


def _in_window(name: str) -> Column:
    a, b = WINDOWS[name]
    return (F.col("hr") >= F.col("start_hour") + a) & (F.col("hr") < F.col("start_hour") + b)


def _slots(events: DataFrame, zones: DataFrame) -> DataFrame:
    return events.select("venue_id", "start_hour").distinct().join(zones, "venue_id")


def day_windows(events: DataFrame, zones: DataFrame, hourly: DataFrame) -> DataFrame:
    """Sums per (venue, start hour, day) and window over the venue's zones. Joined on the zone, hours as a filter."""
    lo, hi = min(a for a, _ in WINDOWS.values()), max(b for _, b in WINDOWS.values())
    near = (F.col("hr") >= F.col("start_hour") + lo) & (F.col("hr") < F.col("start_hour") + hi)
    joined = hourly.join(_slots(events, zones), "zone").where(near)
    aggs = []
    for w in WINDOWS:
        inside = _in_window(w)
        aggs += [F.sum(F.when(inside, F.col("pu_trips"))).alias(f"{w}_pu"), F.sum(F.when(inside, F.col("do_trips"))).alias(f"{w}_do")]
    return joined.groupBy("venue_id", "start_hour", "d", "dow").agg(*aggs)


def event_impact(events: DataFrame, venues: DataFrame, trips: DataFrame, exclude_self: bool = False, cross_midnight: bool = False) -> DataFrame:
    """Lift of each window against the mean of same-weekday days that are no other event's date; the mean is at
    least 1. By default an event's own day belongs to its baseline and windows stop at midnight."""
    zones = venue_zones(venues)
    hourly = lineage.cut(zone_hourly(trips, zones))  # venue zones x hours, read by days and by windows: scan the trips once
    days = hourly.select("d").distinct()
    if cross_midnight:
        hourly = _spill_midnight(hourly)
    per_day = day_windows(events, zones, hourly)
    cols = [f"{w}_{s}" for w in WINDOWS for s in ("pu", "do")]
    ordinary = per_day.join(events.select(F.col("date").alias("d")).distinct(), "d", "left_anti")
    slot = ordinary.groupBy("venue_id", "start_hour", "dow").agg(
        *[F.sum(c).alias(f"{c}_base") for c in cols], *[F.count(f"{w}_pu").alias(f"{w}_days") for w in WINDOWS])
    own = per_day.select("venue_id", "start_hour", F.col("d").alias("date"), *cols)
    seen = (events.join(days.withColumnRenamed("d", "date"), "date", "left_semi")
            .join(zones.select("venue_id").distinct(), "venue_id", "left_semi").withColumn("dow", X.dow_sunday0("date")))
    wide = seen.join(own, ["venue_id", "start_hour", "date"], "left").join(slot, ["venue_id", "start_hour", "dow"], "left")
    out = []
    for w in WINDOWS:
        own_day = F.lit(0) if exclude_self else F.col(f"{w}_pu").isNotNull().cast("int")
        n = F.coalesce(F.col(f"{w}_days"), F.lit(0)) + own_day
        for s in ("pu", "do"):
            seen_n = F.coalesce(F.col(f"{w}_{s}"), F.lit(0))
            total = F.coalesce(F.col(f"{w}_{s}_base"), F.lit(0)) + (F.lit(0) if exclude_self else seen_n)
            base = F.greatest(F.coalesce(F.try_divide(total.cast("double"), n), F.lit(1.0)), F.lit(1.0))
            out.append((F.lit(100.0) * (seen_n / base - 1)).alias(f"{w}_{s}_lift_pct"))
    return wide.select(*EVENT_KEYS, *out, F.coalesce("post_pu", F.lit(0)).alias("post_pu_trips"), F.coalesce("post_do", F.lit(0)).alias("post_do_trips"))


def impact_by_type(impact: DataFrame) -> DataFrame:
    return impact.groupBy("event_type").agg(
        rows().alias("n_events"), F.avg("pre_do_lift_pct").alias("avg_pre_do_lift"), F.avg("post_pu_lift_pct").alias("avg_post_pu_lift"),
        F.avg("event_pu_lift_pct").alias("avg_event_pu_lift"), F.median("post_pu_lift_pct").alias("median_post_pu_lift"))


def annotations(events: DataFrame) -> DataFrame:
    return events.select(X.at_hour("date", "start_hour").alias("event_time"), "title", F.lower("event_type").alias("tags"))


def event_hypothesis(impact: DataFrame, venues: DataFrame, zone_distance: DataFrame) -> DataFrame:
    """Events with their venue's price tier and the distance from its primary zone to the nearest station."""
    v = venues.join(zone_distance.select(F.col("LocationID").alias("primary_zone"), "dist_m"), "primary_zone", "left")
    return (impact.join(v.select("venue_id", F.col("name").alias("venue_name"), "price_tier", "dist_m"), "venue_id", "left")
            .withColumn("log_dist_m", F.log1p(F.coalesce("dist_m", F.lit(500.0)))))


def hypothesis_by_venue(hyp: DataFrame) -> DataFrame:
    return hyp.where("dist_m is not null").groupBy("venue_id", "venue_name", "price_tier", "dist_m").agg(
        rows().alias("n_events"), F.median("post_pu_lift_pct").alias("post_pu_lift"), F.median("pre_do_lift_pct").alias("pre_do_lift"),
        F.avg("post_pu_lift_pct").alias("post_pu_avg"))


def event_timelapse(trips: DataFrame, events: DataFrame, venues: DataFrame, min_days: int = 3) -> DataFrame:
    """Per venue, hour and zone: mean pickups on event days, the same-weekday baseline and their ratio."""
    zones = venue_zones(venues)
    pickups = (trips.select(X.day_of("pickup_datetime").alias("d"), F.hour("pickup_datetime").alias("hr"), F.col("PULocationID").cast("bigint").alias("zone"))
               .join(zones.select("zone").distinct(), "zone", "left_semi").groupBy("d", "hr", "zone").agg(rows().alias("trips")))
    dates = events.select("venue_id", F.col("date").alias("d"), F.lit(True).alias("_event")).distinct()
    enough = dates.groupBy("venue_id").agg(rows().alias("_n")).where(F.col("_n") >= min_days).select("venue_id")
    rows_ = lineage.cut(pickups.join(zones.join(enough, "venue_id", "left_semi"), "zone").join(dates, ["venue_id", "d"], "left")
                         .withColumns({"_event": F.coalesce("_event", F.lit(False)), "dow": X.dow_sunday0("d")}))
    evt = rows_.where("_event").groupBy("venue_id", "hr", "zone").agg(F.avg("trips").alias("evt"))
    event_dows = rows_.where("_event").select("venue_id", "dow").distinct()
    base = (rows_.where("not _event").groupBy("venue_id", "hr", "zone", "dow").agg(F.avg("trips").alias("base"))
            .join(event_dows, ["venue_id", "dow"], "left_semi").groupBy("venue_id", "hr", "zone").agg(F.avg("base").alias("base")))
    return (evt.join(base, ["venue_id", "hr", "zone"], "full").fillna(0.0, ["evt", "base"])
            .withColumn("lift", F.when(F.col("base") > 0, F.col("evt") / F.col("base")).otherwise(F.lit(0.0))))


def timelapse_domain(frames: DataFrame) -> DataFrame:
    """Clipping range of each venue's colours: p8 to p92 of positive event means, at least 1 wide."""
    dom = frames.where("evt > 0").groupBy("venue_id").agg(F.percentile("evt", F.lit(.08)).alias("lo"), F.percentile("evt", F.lit(.92)).alias("hi"))
    return dom.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))


def wait_histogram(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Counts of waits above zero and below an hour per request day, hour and venue zone; known providers only."""
    waits = (trips.where((F.col("pickup_datetime") > F.col("request_datetime")) & X.known_license())
             .select(X.day_of("request_datetime").alias("d"), F.hour("request_datetime").alias("hr"),
                     F.col("PULocationID").cast("bigint").alias("zone"), X.wait_seconds().alias("wait_sec")).where("wait_sec < 3600"))
    return (waits.join(zones.select("zone").distinct(), "zone", "left_semi").groupBy("d", "hr", "zone", "wait_sec").agg(rows().alias("n"))
            .withColumn("dow", X.dow_sunday0("d")))


def _wait_stats(hist: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    return hist.groupBy(*by, "wait_sec").agg(F.sum("n").alias("n")).groupBy(*by).agg(
        hist_mean("wait_sec").alias(f"{prefix}avg_wait_sec"), hist_quantile("wait_sec", .5).alias(f"{prefix}med_wait_sec"),
        F.sum("n").alias(f"{prefix}n"))


def _venue_dates(events: DataFrame) -> DataFrame:
    return events.select("venue_id", F.col("date").alias("d")).distinct()


def event_case(trips: DataFrame, events: DataFrame, venues: DataFrame) -> DataFrame:
    """Per event day, venue and hour: waits by request hour and pickups by pickup hour, against the venue's
    same-weekday days without an event. A single case is the same call on a filtered calendar."""
    zones = venue_zones(venues)
    local = lineage.cut(wait_histogram(trips, zones)).join(zones, "zone")
    pickups = (trips.where(X.known_license()).select(X.day_of("pickup_datetime").alias("d"), F.hour("pickup_datetime").alias("hr"),
                                                     F.col("PULocationID").cast("bigint").alias("zone"))
               .join(zones, "zone").groupBy("venue_id", "d", "hr").agg(rows().alias("pickups")).withColumn("dow", X.dow_sunday0("d")))
    pickups = lineage.cut(pickups)
    dates = _venue_dates(events)
    base = _wait_stats(local.join(dates, ["venue_id", "d"], "left_anti"), ["venue_id", "dow", "hr"], "base_")
    base_pu = pickups.join(dates, ["venue_id", "d"], "left_anti").groupBy("venue_id", "dow", "hr").agg(F.avg("pickups").alias("base_pickups"))
    evt = _wait_stats(local.join(dates, ["venue_id", "d"], "left_semi"), ["venue_id", "d", "dow", "hr"])
    out = (evt.join(pickups.drop("dow"), ["venue_id", "d", "hr"], "left").join(base, ["venue_id", "dow", "hr"], "left")
           .join(base_pu, ["venue_id", "dow", "hr"], "left"))
    return out.withColumnRenamed("d", "date")


def event_zone_delta(trips: DataFrame, events: DataFrame, venues: DataFrame, hours: tuple[int, int] = (22, 24)) -> DataFrame:
    """Change of a zone's median wait (minutes) on event days in the late hours."""
    zones = venue_zones(venues)
    local = lineage.cut(wait_histogram(trips, zones)).where((F.col("hr") >= hours[0]) & (F.col("hr") < hours[1])).join(zones, "zone")
    dates = _venue_dates(events)
    base = _wait_stats(local.join(dates, ["venue_id", "d"], "left_anti"), ["venue_id", "zone", "dow"], "base_")
    evt = _wait_stats(local.join(dates, ["venue_id", "d"], "left_semi"), ["venue_id", "zone", "d", "dow"])
    return (evt.join(base, ["venue_id", "zone", "dow"]).where("base_med_wait_sec > 0")
            .withColumn("delta_min", (F.col("med_wait_sec") - F.col("base_med_wait_sec")) / 60).withColumnRenamed("d", "date"))


def event_wait_vs_baseline(trips: DataFrame, events: DataFrame, venues: DataFrame, impact: DataFrame) -> DataFrame:
    """One row per event: waits in the hours after it and on the venue's ordinary same-weekday days."""
    zones = venue_zones(venues)
    local = lineage.cut(wait_histogram(trips, zones)).join(_slots(events, zones), "zone").where(_in_window("post"))
    keys = ["venue_id", "start_hour"]
    base = _wait_stats(local.join(_venue_dates(events), ["venue_id", "d"], "left_anti"), [*keys, "dow"], "base_")
    own = _wait_stats(local, [*keys, "d", "dow"]).withColumnRenamed("d", "date").withColumnRenamed("n", "n_wait")
    out = impact.select(*EVENT_KEYS, "post_pu_trips", "post_pu_lift_pct").join(own, [*keys, "date"]).join(base, [*keys, "dow"])
    minutes = {f"{c}_wait_min": F.col(f"{c}_wait_sec") / 60 for c in ("avg", "base_avg", "med", "base_med")}
    diffs = {}
    for c in ("avg", "med"):
        diffs[f"{c}_delta_min"] = (F.col(f"{c}_wait_sec") - F.col(f"base_{c}_wait_sec")) / 60
        diffs[f"{c}_lift_pct"] = (F.try_divide(F.col(f"{c}_wait_sec"), F.col(f"base_{c}_wait_sec")) - 1) * 100
    return out.withColumns({**minutes, **diffs})
