"""Web Mercator and UTM (WGS84), forward and inverse, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and UTM's scale and false easting.
A, FLATTENING, SCALE, EASTING = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
INVERSE = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
TO_LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude."""
    return F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2), F.degrees(x / A)


def utm_zone(lon: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1


def utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (negative south of the equator) by the third-order series."""
    d = F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(N) / (1 + N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1)), F.lit(0.0))
    return EASTING + SCALE * RECTIFYING * east, SCALE * RECTIFYING * north


def from_utm(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Latitude and longitude."""
    xi, eta = north / (SCALE * RECTIFYING), (east - EASTING) / (SCALE * RECTIFYING)
    x = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(INVERSE, 1)), F.lit(0.0))
    e = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(INVERSE, 1)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(TO_LATITUDE, 1)), F.lit(0.0))
    return F.degrees(lat), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x)))
