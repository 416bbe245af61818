"""Group-level orientation operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import quaternions as qf
from footfall.functions.angles import unwrap_jump_sql, wrap_pi
from footfall.operators import filters, ordered as o
from footfall.operators.ordered import Axis

WORLD_BASE_BLOCK = ("qw_WB", "qx_WB", "qy_WB", "qz_WB")
PLAIN_BLOCK = ("qw", "qx", "qy", "qz")
# dot products this small are rounding noise of a right angle
RIGHT_ANGLE_SLACK = 1e-12


def quaternion_blocks(df: DataFrame) -> list[tuple[str, ...]]:
    """Orientation blocks present in a table, preferred one first."""
    return [b for b in (WORLD_BASE_BLOCK, PLAIN_BLOCK) if set(b) <= set(df.columns)]


def average_quaternion(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                       names: Sequence[str] = ("qw", "qx", "qy", "qz"), slack: float = 0.0) -> DataFrame:
    """Mean orientation per group: rows turned to the hemisphere of the first one, averaged, normalised, w >= 0.

    The mean of the first block with any complete row is taken. The per-group base row comes from a partial
    aggregate, so the rows of a group are never gathered. A row at a right angle to the base counts as its side. A mean
    whose w is no further than ``slack`` below 0 is not turned.
    """
    position = F.struct(*order)
    blocks = quaternion_blocks(df)
    if not blocks:
        return df.select(*keys).distinct().withColumns({n: F.lit(None).cast("double") for n in names})
    unit, rows = "wxyz", df
    for k, block in enumerate(blocks):
        q = qf.normalize(tuple(F.col(c) for c in block))
        complete = q[0].isNotNull() & q[1].isNotNull() & q[2].isNotNull() & q[3].isNotNull()
        rows = rows.withColumn(f"_q{k}", F.when(complete, F.struct(*[c.alias(n) for c, n in zip(q, unit)])))
    lean = rows.select(*keys, position.alias("_at"), *[f"_q{k}" for k in range(len(blocks))])
    base = lean.groupBy(*keys).agg(*[
        F.min_by(f"_q{k}", F.when(F.col(f"_q{k}").isNotNull(), F.col("_at"))).alias(f"_b{k}") for k in range(len(blocks))])
    joined, sums = lean.join(base, list(keys)), []
    for k in range(len(blocks)):
        dot = sum((F.col(f"_q{k}.{n}") * F.col(f"_b{k}.{n}") for n in unit), F.lit(0.0))
        sign = F.when(dot < -RIGHT_ANGLE_SLACK, F.lit(-1.0)).otherwise(F.lit(1.0))
        sums += [F.avg(F.col(f"_q{k}.{n}") * sign).alias(f"_{n}{k}") for n in unit]
    mean = joined.groupBy(*keys).agg(*sums)
    options = []
    for k in range(len(blocks)):
        m = tuple(F.col(f"_{n}{k}") for n in unit)
        options.append(F.when(qf.norm(m) > 0, F.struct(*[c.alias(n) for c, n in zip(qf.canonical(qf.normalize(m), slack), names)])))
    return mean.withColumn("_m", F.coalesce(*options)).select(*keys, *[F.col(f"_m.{n}").alias(n) for n in names])


def unwrap(df: DataFrame, axis: Axis, column: str, out: str | None = None, origin: float | None = None, position: str | None = None) -> DataFrame:
    """Remove jumps of more than half a turn between consecutive rows; optionally move the first value to ``origin``, and
    number the rows of each group in a column ``position``."""
    specs = {"_turns": o.pairwise(lambda here, prev: unwrap_jump_sql(f"({here('a')} - {prev('a')})"), "0.0D", {"a": F.col(column).cast("double")}, total=True)}
    if origin is not None:
        specs["_first"] = o.group_first(column)
    if position:
        specs[position] = o.row_index()
    summed = o.running(df, axis, **specs)
    value = F.col(column) + F.col("_turns")
    if origin is not None:
        value = value + (F.lit(float(origin)) - F.col("_first"))
    return summed.withColumn(out or column, value).drop("_turns", "_first")


def smooth_angles(df: DataFrame, axis: Axis, columns: Sequence[str], median_rows: int = 1, mean_rows: int = 1) -> DataFrame:
    """Unwrap, rolling median, rolling mean, wrap again, in place; all columns share the shuffles."""
    def turns(c: str) -> o.Running:
        return o.pairwise(lambda here, prev: unwrap_jump_sql(f"({here('a')} - {prev('a')})"), "0.0D", {"a": F.col(c).cast("double")}, total=True)

    flat = o.running(df, axis, **{f"_turns_{c}": turns(c) for c in columns}, _row=o.row_index())
    flat = flat.withColumns({c: F.col(c) + F.col(f"_turns_{c}") for c in columns}).drop(*[f"_turns_{c}" for c in columns])
    chain = [{"type": "moving_median", "window": median_rows}, {"type": "moving_average", "window": mean_rows}]
    flat = filters.apply_chains(flat, axis, {c: chain for c in columns}, pos="_row")
    return flat.withColumns({c: wrap_pi(F.col(c)) for c in columns}).drop("_row")


def smooth_angle(df: DataFrame, axis: Axis, column: str, out: str | None = None,
                 median_rows: int = 1, mean_rows: int = 1) -> DataFrame:
    """One angle smoothed, by default in place."""
    target = out or column
    source = df if target == column else df.withColumn(target, F.col(column))
    return smooth_angles(source, axis, [target], median_rows, mean_rows)
