"""Distances on the sphere, bounding boxes and location scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    root = F.sqrt(h)
    return 2 * EARTH_KM * F.asin(F.when(root > 1, 1.0).otherwise(root))  # null without a place


def bounding_box(lat: float, lon: float, radius_km: float) -> tuple[float, float, float | None, float | None]:
    """(least and largest latitude, least and largest longitude); no longitudes near a pole or across the date line."""
    if not (-90 <= lat <= 90 and -180 <= lon <= 180 and radius_km > 0 and math.isfinite(radius_km)):
        raise ValueError("latitude, longitude or radius out of range")
    span = radius_km / KM_PER_DEGREE
    low, high, shrink = max(-90.0, lat - span), min(90.0, lat + span), math.cos(math.radians(lat))
    if abs(shrink) < 1e-6:
        return low, high, None, None
    wide = radius_km / (KM_PER_DEGREE * abs(shrink))
    return (low, high, None, None) if lon - wide < -180 or lon + wide > 180 else (low, high, lon - wide, lon + wide)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float | None, float | None]) -> Column:
    """Plain range predicates, which reach the scan."""
    inside = lat.between(box[0], box[1])
    return inside if box[2] is None else inside & lon.between(box[2], box[3])


def in_box_of(lat: Column, lon: Column, at_lat: Column, at_lon: Column, radius_km: Column) -> Column:
    """The same for boxes that differ by row."""
    shrink = F.abs(F.cos(F.radians(at_lat)))
    wide = radius_km / (KM_PER_DEGREE * F.greatest(shrink, F.lit(1e-6)))
    open_ = (shrink < 1e-6) | (at_lon - wide < -180) | (at_lon + wide > 180)
    return lat.between(at_lat - radius_km / KM_PER_DEGREE, at_lat + radius_km / KM_PER_DEGREE) & (open_ | lon.between(at_lon - wide, at_lon + wide))


def geo_score(distance: Column, radius_km: float | Column | None, city_match: Column, district_match: Column) -> Column:
    """``radius_km`` may be a column, null where a row has none."""
    far = 1 / (1 + distance / 10)
    if isinstance(radius_km, Column):
        near = F.when(radius_km.isNull(), far).otherwise(F.greatest(F.lit(0.0), 1 - distance / radius_km))
    else:
        near = F.greatest(F.lit(0.0), 1 - distance / radius_km) if radius_km else far
    total = F.coalesce(0.70 * near, F.lit(0.0)) + F.when(city_match, 0.20).otherwise(0.0) + F.when(district_match, 0.10).otherwise(0.0)
    return F.least(F.lit(1.0), total)
