"""Unit-quaternion algebra on (w, x, y, z) tuples of columns; everything stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]
Vec = tuple[Column, Column, Column]


def quat(prefix: str = "q", suffix: str = "") -> Quat:
    return tuple(F.col(f"{prefix}{axis}{suffix}") for axis in "wxyz")


def constant(values) -> Quat:
    return tuple(F.lit(float(v)) for v in values)


def multiply(p: Quat, q: Quat) -> Quat:
    pw, px, py, pz = p
    qw, qx, qy, qz = q
    return (
        pw * qw - px * qx - py * qy - pz * qz,
        pw * qx + px * qw + py * qz - pz * qy,
        pw * qy - px * qz + py * qw + pz * qx,
        pw * qz + px * qy - py * qx + pz * qw,
    )


def conjugate(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def norm(q: Quat) -> Column:
    return F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])


def normalize(q: Quat) -> Quat:
    """Unit length; a zero quaternion stays zero."""
    n = norm(q)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return tuple(c / safe for c in q)


def canonical(q: Quat, slack: float = 0.0) -> Quat:
    """The representative with w >= 0; one that is no further than ``slack`` below 0 stays."""
    flip = F.when(q[0] < -slack, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(c * flip for c in q)


def from_rpy_degrees(roll: float, pitch: float, yaw: float) -> tuple[float, float, float, float]:
    """Driver-side constant: turn about z by yaw, then y by pitch, then x by roll."""

    def turn(degrees: float, axis: int):
        half = math.radians(degrees) / 2.0
        return tuple(math.cos(half) if i == 0 else math.sin(half) * (i == axis) for i in range(4))

    return unit_constant(multiply(multiply(turn(yaw, 3), turn(pitch, 2)), turn(roll, 1)))


def unit_constant(values) -> tuple[float, float, float, float]:
    size = math.hypot(*values) or 1.0
    return tuple(float(v) / size for v in values)


def rotation_constant(spec: dict | None) -> tuple[float, float, float, float] | None:
    """Rotation given as ``{"quat": [w,x,y,z]}`` or ``{"rpy_deg": [r,p,y]}``."""
    if not spec:
        return None
    if spec.get("quat") is not None:
        return unit_constant([float(v) for v in spec["quat"]])
    if spec.get("rpy_deg") is not None:
        return from_rpy_degrees(*[float(v) for v in spec["rpy_deg"]])
    return None


def apply_offset(q: Quat, offset: Quat, invert: bool = True) -> Quat:
    """``q * inverse(offset)`` (or ``q * offset``), unit length, w >= 0."""
    return canonical(normalize(multiply(q, conjugate(offset) if invert else offset)))


def rotate(q: Quat, v: Vec) -> Vec:
    """Active rotation of a vector."""
    w, x, y, z = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return (
        v[0] + w * tx + (y * tz - z * ty),
        v[1] + w * ty + (z * tx - x * tz),
        v[2] + w * tz + (x * ty - y * tx),
    )



def axis_vector(x: float, y: float, z: float) -> Vec:
    return (F.lit(x), F.lit(y), F.lit(z))


def heading(q: Quat) -> Column:
    """East-north direction of the body's forward axis."""
    east, north, _ = rotate(normalize(q), axis_vector(1.0, 0.0, 0.0))
    return F.atan2(north, east)


def _body_axes(q: Quat) -> tuple[Vec, Vec, Vec]:
    """Forward, left and up axes of the body in the world frame."""
    return tuple(rotate(q, axis_vector(*[float(i == k) for i in range(3)])) for k in range(3))


def euler_zyx_degrees(q: Quat, yaw_sign: float = 1.0, pitch_sign: float = 1.0) -> Vec:
    """(yaw, pitch, roll) with the flips used for display as parameters."""
    forward, left, up = _body_axes(normalize(q))
    level = F.greatest(F.sqrt(forward[0] * forward[0] + forward[1] * forward[1]), F.lit(1e-12))
    return (
        F.degrees(F.atan2(forward[1], forward[0])) * F.lit(yaw_sign),
        F.degrees(F.atan2(-forward[2], level)) * F.lit(pitch_sign),
        F.degrees(F.atan2(left[2], up[2])),
    )


def _arcsine_degrees(c: Column) -> Column:
    """asin of a value clipped to [-1, 1]; null stays null although greatest/least skip nulls."""
    return F.when(c.isNotNull(), F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))))


def rpy_degrees(q: Quat, flip: bool = False) -> Vec:
    """(roll, pitch, yaw) of an already unit quaternion with arcsine pitch; ``flip`` negates pitch and yaw."""
    forward, left, up = _body_axes(q)
    sign = F.lit(-1.0 if flip else 1.0)
    return (
        F.degrees(F.atan2(left[2], up[2])),
        _arcsine_degrees(-forward[2]) * sign,
        F.degrees(F.atan2(forward[1], forward[0])) * sign,
    )


def tilt_degrees(q: Quat) -> tuple[Column, Column]:
    """(pitch, roll): elevation of the rotated forward and left axes."""
    forward, left, _ = _body_axes(normalize(q))
    return _arcsine_degrees(forward[2]), _arcsine_degrees(left[2])
