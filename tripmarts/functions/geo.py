"""Distances and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dlat, half_dlon = (p2 - p1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def plane_xy(lat, lon, lat0: float, scale: float = 1.0) -> tuple[Column, Column]:
    """Equirectangular projection around latitude `lat0`; y grows southwards as on a screen."""
    return lon * F.cos(F.radians(F.lit(lat0))) * scale, -lat * scale
