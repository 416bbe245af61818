"""Map-frame column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0

# fixed values: WGS84 ellipsoid (half axis, flattening), Bessel 1841 ellipsoid, and the shift of geocentric metres between them
WGS84 = (6378137.0, 1 / 298.257223563)
BESSEL = (6377397.155, 1 / 299.1528128)
SHIFT_M = (-674.374, -15.056, -405.346)
# fixed values: origin of the LV95 grid on the Bessel ellipsoid (degrees) and its false coordinates
ORIGIN_LAT, ORIGIN_LON = 46 + 57 / 60 + 8.66 / 3600, 7 + 26 / 60 + 22.50 / 3600
FALSE_EAST, FALSE_NORTH = 2600000.0, 1200000.0


# The rigorous projection in steps. Each takes the columns of the step before, so that no expression is repeated inside another.

def _geocentric(lat: Column, lon: Column) -> tuple[Column, ...]:
    """WGS84 degrees at height 0 -> geocentric metres of the Bessel system."""
    a, f = WGS84
    e2 = f * (2 - f)
    phi, lam = F.radians(lat), F.radians(lon)
    normal = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (normal * F.cos(phi) * F.cos(lam) + SHIFT_M[0], normal * F.cos(phi) * F.sin(lam) + SHIFT_M[1],
            normal * (1 - e2) * F.sin(phi) + SHIFT_M[2])


def _reduced(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Distance from the axis, height over the equator, reduced latitude and longitude."""
    a, f = BESSEL
    across = F.sqrt(x * x + y * y)
    return across, z, F.atan2(z, across * (1 - f)), F.atan2(y, x)


def _bessel(across: Column, z: Column, reduced: Column, lam: Column) -> tuple[Column, ...]:
    """Geodetic radians; the closed form is exact to well below a millimetre near the ground."""
    a, f = BESSEL
    b, e2 = a * (1 - f), f * (2 - f)
    up, out = F.sin(reduced), F.cos(reduced)
    return F.atan2(z + e2 / (1 - e2) * b * up * up * up, across - e2 * a * out * out * out), lam


def _sphere_constants() -> tuple[float, float, float, float, float]:
    """Eccentricity of the ellipsoid; radius, stretch, origin and offset of the conformal sphere."""
    a, f = BESSEL
    e2 = f * (2 - f)
    e, phi0 = math.sqrt(e2), math.radians(ORIGIN_LAT)
    radius = a * math.sqrt(1 - e2) / (1 - e2 * math.sin(phi0) ** 2)
    alpha = math.sqrt(1 + e2 / (1 - e2) * math.cos(phi0) ** 4)
    b0 = math.asin(math.sin(phi0) / alpha)
    return e, radius, alpha, b0, math.atanh(math.sin(b0)) - alpha * (math.atanh(math.sin(phi0)) - e * math.atanh(e * math.sin(phi0)))


def _sphere(phi: Column, lam: Column) -> tuple[Column, ...]:
    """Isometric latitude and longitude from the origin on the sphere."""
    e, _, alpha, _, offset = _sphere_constants()
    return alpha * (F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi))) + offset, alpha * (lam - math.radians(ORIGIN_LON))


def _grid(isometric: Column, turn: Column) -> tuple[Column, ...]:
    """Easting and northing on an oblique Mercator cylinder through the origin."""
    _, radius, _, b0, _ = _sphere_constants()
    sin_b, cos_b = F.tanh(isometric), 1 / F.cosh(isometric)
    east = F.atan2(F.sin(turn) * cos_b, math.sin(b0) * sin_b + math.cos(b0) * F.cos(turn) * cos_b)
    north = F.atanh(math.cos(b0) * sin_b - math.sin(b0) * cos_b * F.cos(turn))
    return radius * east + FALSE_EAST, radius * north + FALSE_NORTH


#: Bessel radians -> LV95 metres, and WGS84 degrees -> LV95 metres.
SWISS_GRID = (_sphere, _grid)
LV95 = (_geocentric, _reduced, _bessel, *SWISS_GRID)


def local_enu(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres on the tangent plane at the origin."""
    east = (F.radians(lon) - F.radians(lon0)) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M
    north = (F.radians(lat) - F.radians(lat0)) * EARTH_RADIUS_M
    return east, north
