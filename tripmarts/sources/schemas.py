"""Canonical schemas. Monthly files drift; these are what readers produce."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _N = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


FHVHV = _struct(
    hvfhs_license_num=_S, originating_base_num=_S, request_datetime=_N, on_scene_datetime=_N, pickup_datetime=_N, dropoff_datetime=_N,
    PULocationID=_L, DOLocationID=_L, trip_miles=_D, trip_time=_L, base_passenger_fare=_D, tolls=_D, bcf=_D, sales_tax=_D,
    congestion_surcharge=_D, airport_fee=_D, tips=_D, driver_pay=_D, shared_request_flag=_S, shared_match_flag=_S,
    access_a_ride_flag=_S, wav_request_flag=_S, wav_match_flag=_S, cbd_congestion_fee=_D)


def _metered(prefix: str) -> T.StructType:
    return _struct(**{
        "VendorID": _L, f"{prefix}_pickup_datetime": _N, f"{prefix}_dropoff_datetime": _N, "passenger_count": _D, "trip_distance": _D, "RatecodeID": _D,
        "store_and_fwd_flag": _S, "PULocationID": _L, "DOLocationID": _L, "payment_type": _L, "fare_amount": _D, "extra": _D, "mta_tax": _D, "tip_amount": _D,
        "tolls_amount": _D, "improvement_surcharge": _D, "total_amount": _D, "congestion_surcharge": _D, "airport_fee": _D, "cbd_congestion_fee": _D})


YELLOW, GREEN = _metered("tpep"), _metered("lpep")
FHV = _struct(dispatching_base_num=_S, pickup_datetime=_N, dropOff_datetime=_N, PUlocationID=_L, DOlocationID=_L)
FAMILIES = {"yellow": YELLOW, "green": GREEN, "fhv": FHV, "fhvhv": FHVHV}
PICKUP = {"yellow": "tpep_pickup_datetime", "green": "lpep_pickup_datetime", "fhv": "pickup_datetime", "fhvhv": "pickup_datetime"}
ZONES = _struct(LocationID=_L, Borough=_S, Zone=_S, service_zone=_S)
WEATHER = _struct(date=T.DateType(), prcp_mm=_D, snow_mm=_D, snwd_mm=_D, tmax_c=_D, tmin_c=_D, awnd_ms=_D, wsf5_ms=_D)
VENUES = _struct(venue_id=_S, name=_S, league=_S, primary_zone=_L, buffer_zones=_S, lat=_D, lon=_D, price_tier=_L, notes=_S)
EVENTS = _struct(date=T.DateType(), start_hour=T.IntegerType(), venue_id=_S, event_type=_S, title=_S, tags=_S)
