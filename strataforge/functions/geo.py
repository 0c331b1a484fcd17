"""Geospatial expressions: formats, distances, geohashes, polygons and boxes. All are column expressions in double precision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371009.0
GYRATION_RADIUS = 6378126.0
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Fixed values: (major axis, minor axis, flattening) in metres.
ELLIPSOIDS = {"WGS-84": (6378137.0, 6356752.314245179, 1 / 298.257223563), "GRS-80": (6378137.0, 6356752.314140356, 1 / 298.257222101), "Airy (1830)": (6377563.396, 6356256.909, 1 / 299.3249646), "Intl 1924": (6378388.0, 6356911.946, 1 / 297.0), "Clarke (1880)": (6378249.145, 6356514.86955, 1 / 293.465), "GRS-67": (6378160.0, 6356774.719, 1 / 298.25)}


def dms(dd: Column) -> Column:
    """[degrees, minutes, seconds]; the sign is that of the degrees by floor."""
    minutes = F.floor(dd * 60)
    return F.array(F.floor(minutes / 60).cast("double"), (minutes - F.floor(minutes / 60) * 60).cast("double"), dd * 3600 - minutes * 60)


def from_dms(x: Column) -> Column:
    return x[0] + x[1] / 60 + x[2] / 3600


def cartesian(lat: Column, lon: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b) * radius, F.cos(a) * F.sin(b) * radius, F.sin(a) * radius


def from_cartesian(x: Column, y: Column, z: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
    return F.degrees(F.asin(z / radius)), F.degrees(F.atan2(y, x))


def geohash(lat: Column, lon: Column, precision: int = 8) -> Column:
    """Bits alternate from longitude to latitude, five to a character. Null outside the ranges."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << n_lon)), F.lit((1 << n_lon) - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90) / 180 * (1 << n_lat)), F.lit((1 << n_lat) - 1)).cast("bigint")
    out = []
    for k in range(precision):
        digit = F.lit(0).cast("bigint")
        for i in range(5 * k, 5 * k + 5):
            source, place = (x, n_lon - 1 - i // 2) if i % 2 == 0 else (y, n_lat - 1 - i // 2)
            digit = digit * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1).cast("bigint"))
        out.append(F.substr(F.lit(_BASE32), (digit + 1).cast("int"), F.lit(1)))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(*out))


def from_geohash(text: Column) -> tuple[Column, Column]:
    """The middle of a geohash's cell; null for a text that is none."""
    ok = text.rlike("^[" + _BASE32 + "]{1,12}$")
    bits = F.concat_ws("", F.transform(F.split(F.lower(text), ""), lambda c: F.when(c == "", "").otherwise(F.lpad(F.bin(F.instr(F.lit(_BASE32), c) - 1), 5, "0"))))
    one = F.filter(F.split(bits, ""), lambda b: b != "")

    def side(first: int, low: float, high: float) -> Column:
        mine = F.filter(one, lambda b, i: i % 2 == first)
        value = F.aggregate(mine, F.lit(0.0), lambda a, b: a * 2 + b.cast("double"))
        cells = F.pow(F.lit(2.0), F.size(mine))
        return F.when(ok, low + (high - low) * (value + 0.5) / cells)

    return side(1, -90.0, 90.0), side(0, -180.0, 180.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def euclidean(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (F.pow(p - q, F.lit(2.0)) for p, q in zip(cartesian(lat1, lon1, radius), cartesian(lat2, lon2, radius), strict=True))))


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ellipsoid: str = "WGS-84") -> Column:
    """Geodesic in metres on an ellipsoid, by Vincenty's inverse formula in Arrow batches; null where it does not settle."""
    a, b, f = ELLIPSOIDS[ellipsoid]

    @F.pandas_udf("double")
    def distance(p: pd.Series, q: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            u1, u2 = np.arctan((1 - f) * np.tan(np.radians(p))), np.arctan((1 - f) * np.tan(np.radians(r)))
            span = np.radians(s - q)
            lam = span.copy()
            for _ in range(100):
                sin_s = np.sqrt((np.cos(u2) * np.sin(lam)) ** 2 + (np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)) ** 2)
                cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                sigma = np.arctan2(sin_s, cos_s)
                sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
                cos2 = 1 - sin_a**2
                mid = np.where(cos2 == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 == 0, 1, cos2))
                c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
                new = span + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
                done = np.abs(new - lam)
                lam = new
                if not (done > 1e-12).any():
                    break
            k = cos2 * (a * a - b * b) / (b * b)
            big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
            small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
            delta = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
            out = b * big * (sigma - delta)
            return out.where(~(done > 1e-9))

    return distance(lat1, lon1, lat2, lon2)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """``box``: west, south, east, north."""
    return lat.between(box[1], box[3]) & lon.between(box[0], box[2])


def polygons_of(geojson: Mapping) -> list[list[Sequence[float]]]:
    """Outer rings of a Polygon, MultiPolygon, Feature or FeatureCollection, as lists of (lon, lat)."""
    kind = geojson["type"]
    if kind == "FeatureCollection":
        return [r for f in geojson["features"] for r in polygons_of(f)]
    if kind == "Feature":
        return polygons_of(geojson["geometry"])
    if kind == "Polygon":
        return [geojson["coordinates"][0]]
    if kind == "MultiPolygon":
        return [p[0] for p in geojson["coordinates"]]
    raise TypeError("Invalid input for polygon")


def in_polygon(lat: Column, lon: Column, ring: Sequence[Sequence[float]]) -> Column:
    """Ray casting over an array literal of edges; points on the boundary are inside."""
    points = [(float(p[0]), float(p[1])) for p in ring]
    if points[0] != points[-1]:
        points.append(points[0])
    edges = F.array(*(F.array(*(F.lit(v) for v in (*p, *q))) for p, q in zip(points, points[1:])))
    xs, ys = [p[0] for p in points], [p[1] for p in points]

    def on(e: Column) -> Column:
        cross = (e[2] - e[0]) * (lat - e[1]) - (e[3] - e[1]) * (lon - e[0])
        return (cross == 0) & lon.between(F.least(e[0], e[2]), F.greatest(e[0], e[2])) & lat.between(F.least(e[1], e[3]), F.greatest(e[1], e[3]))

    def crosses(e: Column) -> Column:
        return ((e[1] > lat) != (e[3] > lat)) & (lon < (e[2] - e[0]) * F.try_divide(lat - e[1], e[3] - e[1]) + e[0])

    inside = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return in_box(lat, lon, (min(xs), min(ys), max(xs), max(ys))) & (F.exists(edges, on) | inside)
