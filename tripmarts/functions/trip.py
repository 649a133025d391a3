"""Derived columns of a ride trip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence codes of the high-volume providers.
PROVIDERS = {"HV0002": "Juno", "HV0003": "Uber", "HV0004": "Via", "HV0005": "Lyft"}
# Labels of the accessibility segments, in the order of the dashboards.
SEG_NONE = "Не WAV, не AAR, не WAV request"
SEG_WAV = "WAV без AAR и WAV request"
SEG_AAR = "AAR без WAV и WAV request"
SEG_REQ = "WAV request без WAV и AAR"
SEG_WAV_REQ = "WAV + WAV request, не AAR"
SEG_AAR_REQ = "AAR + WAV request, не WAV"
SEG_WAV_AAR = "WAV + AAR, без WAV request"
SEG_ALL = "WAV + AAR + WAV request"
EXACT_SEGMENTS = [SEG_NONE, SEG_WAV, SEG_AAR, SEG_REQ, SEG_WAV_REQ, SEG_AAR_REQ, SEG_WAV_AAR, SEG_ALL]
ACCESS_REQUEST, ACCESS_AAR, ACCESS_OTHER = "WAV request", "AAR без WAV request", "Остальные"
ACCESS_SEGMENTS = [ACCESS_REQUEST, ACCESS_AAR, ACCESS_OTHER]
INCLUSIVE, ORDINARY = "Инклюзивные", "Обычные"
ALL_LABEL = "Все"
# Hours of the two peak definitions.
SHARED_PEAK_WEEKDAY = [7, 8, 9, 17, 18, 19]
SHARED_PEAK_WEEKEND = [0, 1, 2, 10, 11, 12, 13, 14, 15]
ACCESS_PEAK_WEEKDAY = [8, 17, 18, 19, 20, 21]
ACCESS_PEAK_WEEKEND = [0, 17, 18, 19, 20, 21, 22, 23]
# Duration bins (upper bound in seconds) and mile bins (upper bound in miles).
DURATION_BINS = [(600, "0-10"), (1200, "10-20"), (1800, "20-30"), (2700, "30-45"), (3600, "45-60"), (None, "60+")]
MILE_BINS = [(1, "0-1"), (2, "1-2"), (5, "2-5"), (10, "5-10"), (20, "10-20"), (None, "20+")]
AIRPORT_ZONES = {132: "jfk", 138: "lga"}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _binned(value: Column, bins) -> Column:
    out = None
    for upper, label in bins:
        if upper is None:
            return out.otherwise(label)
        out = F.when(value < upper, label) if out is None else out.when(value < upper, label)
    return out


def provider(license_col="hvfhs_license_num") -> Column:
    """Four-way provider name; an unknown licence passes through."""
    c = col(license_col)
    out = None
    for code, name in PROVIDERS.items():
        out = F.when(c == code, name) if out is None else out.when(c == code, name)
    return out.otherwise(c)


def provider_two(license_col="hvfhs_license_num") -> Column:
    """Uber/Lyft only; other licences pass through."""
    c = col(license_col)
    return F.when(c == "HV0003", "Uber").when(c == "HV0005", "Lyft").otherwise(c)


def known_license(license_col="hvfhs_license_num") -> Column:
    return col(license_col).isin(list(PROVIDERS))


def second_of_day(ts) -> Column:
    t = col(ts)
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("bigint")


def seconds_between(start, end) -> Column:
    """Second boundaries crossed from start to end; independent of the session time zone."""
    days = F.datediff(F.to_date(col(end)), F.to_date(col(start))).cast("bigint")
    return days * 86400 + second_of_day(end) - second_of_day(start)


def minutes_between(start, end) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def wait_seconds() -> Column:
    return seconds_between("request_datetime", "pickup_datetime")


def day_of(ts) -> Column:
    return F.to_date(col(ts))


def month_of(ts) -> Column:
    return F.trunc(F.to_date(col(ts)), "MM")


def dow_sunday0(ts) -> Column:
    return F.dayofweek(col(ts)) - 1


def dow_monday0(ts) -> Column:
    return F.weekday(col(ts))


def weekday_name(ts) -> Column:
    return F.date_format(F.to_date(col(ts)), "EEEE")


def day_period(hour) -> Column:
    """morning 7-10, day 11-15, evening 16-18, night otherwise."""
    h = col(hour)
    return (F.when(h.between(7, 10), "morning").when(h.between(11, 15), "day")
            .when(h.between(16, 18), "evening").otherwise("night"))


def speed_mph(miles="trip_miles", seconds="trip_time") -> Column:
    return F.when(col(seconds) > 0, col(miles) * 3600.0 / col(seconds))


def flag(name) -> Column:
    """'Y' flag with NULL read as false."""
    return F.coalesce(col(name) == "Y", F.lit(False))


def is_shared(req="shared_request_flag", match="shared_match_flag") -> Column:
    return F.when((col(req) == "Y") | (col(match) == "Y"), 1).otherwise(0)


def exact_segment(wav="is_wav_trip", aar="is_aar", request="is_wav_request") -> Column:
    """Eight-way combination of the three accessibility flags (flags are never NULL)."""
    code = col(wav).cast("int") + col(aar).cast("int") * 2 + col(request).cast("int") * 4
    by_code = {0: SEG_NONE, 1: SEG_WAV, 2: SEG_AAR, 4: SEG_REQ, 5: SEG_WAV_REQ, 6: SEG_AAR_REQ, 3: SEG_WAV_AAR, 7: SEG_ALL}
    return F.element_at(F.array(*[F.lit(by_code[i]) for i in range(8)]), code + 1)


def access_segment(aar="is_aar", request="is_wav_request") -> Column:
    return F.when(col(request), ACCESS_REQUEST).when(col(aar), ACCESS_AAR).otherwise(ACCESS_OTHER)


def inclusive_segment(aar="is_aar", request="is_wav_request") -> Column:
    return F.when(col(request) | col(aar), INCLUSIVE).otherwise(ORDINARY)


def business_segment() -> Column:
    """wav > shared > regular, wav meaning an accessible request or a paratransit trip."""
    return (F.when(flag("wav_request_flag") | flag("access_a_ride_flag"), "wav")
            .when(flag("shared_request_flag") | flag("shared_match_flag"), "shared").otherwise("regular"))


def arrival_valid() -> Column:
    """request <= on_scene <= pickup with nothing missing."""
    return F.coalesce((col("request_datetime") <= col("on_scene_datetime"))
                      & (col("on_scene_datetime") <= col("pickup_datetime")), F.lit(False))


def wait_is_valid() -> Column:
    return F.coalesce(col("request_datetime") <= col("pickup_datetime"), F.lit(False))


def boarding_is_valid() -> Column:
    return F.coalesce(col("on_scene_datetime") <= col("pickup_datetime"), F.lit(False))


def adjusted_wait_columns() -> dict[str, Column]:
    """Adjusted wait (seconds) with its four provenance flags.

    Accessible vehicles with an arrival stamp use the arrival when the chronology holds and nothing
    otherwise; every other trip uses the pickup as a proxy when it follows the request.
    """
    by_arrival = F.col("is_wav_trip") & F.col("on_scene_datetime").isNotNull()
    complete = F.col("request_datetime").isNotNull() & F.col("pickup_datetime").isNotNull()
    arrival, pickup = arrival_valid(), wait_is_valid()
    late_request = F.coalesce(F.col("request_datetime") > F.when(by_arrival, F.col("on_scene_datetime"))
                              .otherwise(F.col("pickup_datetime")), F.lit(False))
    return {
        "adjusted_wait_sec": F.when(complete & by_arrival & arrival, seconds_between("request_datetime", "on_scene_datetime"))
        .when(complete & ~by_arrival & pickup, wait_seconds()),
        "used_on_scene": by_arrival & arrival,
        "used_pickup_proxy": ~by_arrival & pickup,
        "excluded_negative": late_request,
        "excluded_on_scene_after_pickup": by_arrival & F.coalesce(
            F.col("on_scene_datetime") > F.col("pickup_datetime"), F.lit(False)),
    }


def _peak(dow0, hour, weekday_hours, weekend_hours) -> Column:
    weekend = col(dow0).isin(0, 6)
    return (weekend & col(hour).isin(weekend_hours)) | (~weekend & col(hour).isin(weekday_hours))


def shared_peak(dow0="dow", hour="hour") -> Column:
    return _peak(dow0, hour, SHARED_PEAK_WEEKDAY, SHARED_PEAK_WEEKEND)


def access_peak(dow0="dow", hour="hour") -> Column:
    return _peak(dow0, hour, ACCESS_PEAK_WEEKDAY, ACCESS_PEAK_WEEKEND)


def rush_hour(dow0="dow", hour="hour") -> Column:
    return ~col(dow0).isin(0, 6) & col(hour).isin(SHARED_PEAK_WEEKDAY)


def duration_bucket(seconds="trip_time") -> Column:
    return _binned(col(seconds), DURATION_BINS)


def mile_bin(miles="trip_miles") -> Column:
    return _binned(col(miles), MILE_BINS)


def mile_bin_order(miles="trip_miles") -> Column:
    return _binned(col(miles), [(u, i) for i, (u, _) in enumerate(MILE_BINS)])


def wait_group(zone="PULocationID") -> Column:
    """Every trip counts citywide and, when it starts at an airport, also there: explode this array."""
    airport = None
    for z, name in AIRPORT_ZONES.items():
        airport = F.when(col(zone) == z, name) if airport is None else airport.when(col(zone) == z, name)
    return F.array_compact(F.array(F.lit("citywide"), airport))


def log_clip1(c) -> Column:
    return F.log(F.greatest(col(c).cast("double"), F.lit(1.0)))


def log1p(c) -> Column:
    return F.log1p(col(c).cast("double"))


def pct_effect(coef, step: float = 10.0) -> Column:
    """Percent effect of `step` units from a coefficient on a log outcome."""
    return (F.exp(col(coef) * step) - 1) * 100


def take(fare="base_passenger_fare", pay="driver_pay") -> Column:
    return col(fare) - col(pay)


def gross_bookings() -> Column:
    parts = ["base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "cbd_congestion_fee", "airport_fee"]
    total = F.coalesce(F.col(parts[0]), F.lit(0.0))
    for p in parts[1:]:
        total = total + F.coalesce(F.col(p), F.lit(0.0))
    return total


def hourly_pay(pay="driver_pay", seconds="trip_time") -> Column:
    return F.when(col(seconds) > 60, col(pay) / (col(seconds) / F.lit(3600.0)))


def unit_position(value, lo, hi) -> Column:
    """Place of a value in [lo, hi], clipped to [0, 1]: the ramp position of a map cell."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(col(value) - lo, hi - lo)))


def event_label(title="title", date="date", width: int = 40) -> Column:
    return F.concat(F.left(col(title), F.lit(width)), F.lit(" ("), col(date).cast("string"), F.lit(")"))


def hour_or_default(text, default: int) -> Column:
    """Hour of an 'HH:MM' text, or the default when it cannot be read."""
    return F.coalesce(F.split(col(text), ":").getItem(0).try_cast("int"), F.lit(default))


def zone_set(primary="primary_zone", buffers="buffer_zones") -> Column:
    """Primary zone plus the comma-separated buffer zones, without repeats."""
    listed = F.transform(F.filter(F.split(F.coalesce(col(buffers), F.lit("")), ","), lambda z: F.trim(z) != ""),
                         lambda z: F.trim(z).cast("bigint"))
    return F.array_distinct(F.concat(F.array(col(primary).cast("bigint")), listed))


def at_hour(date, hour) -> Column:
    """Timestamp without zone of a date plus whole hours."""
    return col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), col(hour).cast("int"), F.lit(0), F.lit(0))


def year_start(year) -> Column:
    return F.make_date(col(year).cast("int"), F.lit(1), F.lit(1))


def flag_int(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")
