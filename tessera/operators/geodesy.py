"""Ground sizes and map projections as column expressions: pixel sizes, UTM zones and the transverse Mercator projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of a unit by its name; the WGS 84 ellipsoid; scale and offsets of UTM.
UNITS = {"m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "foot": 0.3048, "feet": 0.3048, "us survey foot": 0.30480060960121924}
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0

_n = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
#: Coefficients of the projection's series in the third flattening.
SERIES = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)


def cm_per_pixel(a: Column, b: Column, d: Column, e: Column, unit: Column | float) -> tuple[Column, Column]:
    """Ground size of a pixel of the transform (a, b, d, e) whose map unit is so many metres; null where that is not positive."""
    size = lambda p, q: F.sqrt(p * p + q * q) * unit * 100
    return tuple(F.when(x > 0, x) for x in (size(a, d), size(b, e)))


def manual_cm(both: float | None = None, x: float | None = None, y: float | None = None) -> tuple[float, float] | None:
    """What the user set: one size, or one for each axis; None if nothing."""
    if both is not None:
        x = y = both
    if (x is None) != (y is None):
        raise ValueError("sizes of both axes are needed")
    if x is not None and min(x, y) <= 0:
        raise ValueError("a pixel's size must be positive")
    return None if x is None else (x, y)


def unit_metres(name: str) -> float:
    try:
        return UNITS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown unit {name!r}") from None


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def utm_epsg(lon: Column, lat: Column) -> Column:
    return utm_zone(lon) + F.when(lat < 0, 32700).otherwise(32600)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone; northings south of the equator have the false origin."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(SERIES, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EAST + SCALE * RADIUS * x, SCALE * RADIUS * y + F.when(lat < 0, SOUTH).otherwise(0.0)


def refined(transform: tuple[float, ...], factor: int) -> tuple[float, ...]:
    """The transform (a, b, c, d, e, f) of a raster whose pixels are factor times smaller."""
    a, b, c, d, e, f = transform
    return a / factor, b / factor, c, d / factor, e / factor, f


def utm_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """The same projection in SQL."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians({lat}))))"
    lam = f"radians({lon} - ({zone} * 6 - 183))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    x = eta + "".join(f" + {c!r}::DOUBLE * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, c in enumerate(SERIES, 1))
    y = xi + "".join(f" + {c!r}::DOUBLE * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, c in enumerate(SERIES, 1))
    scale = f"{SCALE * RADIUS!r}::DOUBLE"
    return f"{EAST} + {scale} * ({x})", f"{scale} * ({y}) + CASE WHEN {lat} < 0 THEN {SOUTH} ELSE 0 END"
