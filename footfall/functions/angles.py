"""Angle column functions (radians unless the name says otherwise)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2.0 * math.pi


def wrap_pi(a: Column) -> Column:
    """Map to [-pi, pi)."""
    return F.pmod(a + F.lit(math.pi), F.lit(TAU)) - F.lit(math.pi)


def unwrap_jump_sql(step: str) -> str:
    """Correction to add from this row on so that consecutive angles differ by at most pi; SQL text over the text of a step."""
    pi, tau = f"{math.pi!r}D", f"{TAU!r}D"
    folded = f"(pmod({step} + {pi}, {tau}) - {pi})"
    folded = f"CASE WHEN {folded} = -{pi} AND {step} > 0 THEN {pi} ELSE {folded} END"
    return f"CASE WHEN abs({step}) < {pi} THEN 0.0D ELSE {folded} - {step} END"


def circular_rmse(a: Column, b: Column) -> Column:
    """Aggregate: root mean square of the wrapped difference."""
    d = wrap_pi(a - b)
    return F.sqrt(F.avg(d * d))


def circular_mean(a: Column) -> Column:
    """Aggregate: direction of the mean unit vector, null when it has no direction."""
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    return F.when((s == 0) & (c == 0), F.lit(None)).otherwise(F.atan2(s, c))
