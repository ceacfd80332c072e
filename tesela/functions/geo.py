"""Points, distances and polygons as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres (a fixed value).
EARTH = 6_371_008.8


def point(lat: Column, lon: Column) -> Column:
    """A point, null if a part is; parts beyond their range are an error."""
    bad = (F.abs(lat) > 90) | (F.abs(lon) > 180)
    made = F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    return F.when(bad, F.raise_error(F.lit("coordinates out of range"))).when(lat.isNotNull() & lon.isNotNull(), made)


def distance(a: Column, b: Column, metric: str = "haversine") -> Column:
    """Metres over the sphere, or (euclidean) degrees in the plane."""
    name = {"haversine": "haversine", "geodesica": "haversine", "euclidiana": "euclidean", "euclidean": "euclidean"}.get(metric.lower())
    if name is None:
        raise ValueError(f"unknown metric {metric!r}")
    if name == "euclidean":
        return F.hypot(a["lat"] - b["lat"], a["lon"] - b["lon"])
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
    return 2 * EARTH * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))  # null stays null


def near_box(p: Column, lat: float, lon: float, metres: float) -> Column:
    """A cheap condition that all points within ``metres`` meet; it prunes before the distance."""
    dlat = math.degrees(metres / EARTH) * (1 + 1e-9) + 1e-9
    box = p["lat"].between(lat - dlat, lat + dlat)
    reach = abs(lat) + dlat
    if reach < 89 and dlat < 45:
        dlon = math.degrees(math.asin(min(1.0, math.sin(math.radians(dlat)) / math.cos(math.radians(reach))))) + 1e-9
        if -180 <= lon - dlon and lon + dlon <= 180:
            box = box & p["lon"].between(lon - dlon, lon + dlon)
    return box


def in_polygon(p: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule over (lat, lon) vertices; a point on the border is inside."""
    if len(set(vertices)) < 3:
        raise ValueError("a polygon needs three distinct vertices")
    x, y = p["lon"], p["lat"]
    on, crossings = [], []
    for (y1, x1), (y2, x2) in zip(vertices, vertices[1:] + vertices[:1]):
        if (y1, x1) == (y2, x2):
            continue
        side = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on.append((side == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            crossings.append((((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)))).cast("int"))
    lats, lons = [v[0] for v in vertices], [v[1] for v in vertices]
    box = y.between(min(lats), max(lats)) & x.between(min(lons), max(lons))
    return box & (reduce(Column.__or__, on) | (reduce(Column.__add__, crossings) % 2 == 1))
