"""Putting irregular streams of many recordings on one uniform clock."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators import ordered as o
from footfall.operators.ordered import CHUNK, Axis
from footfall.operators.quantiles import quantiles

TICKS_PER_TASK = 65_536


def master_clock(streams: Sequence[DataFrame], keys: Sequence[str], order: str, hz: float) -> DataFrame:
    """One row per tick between the first and the last sample of any stream; ``i`` is the dense tick number."""
    spans = None
    for s in streams:
        part = s.groupBy(*keys).agg(F.min(order).alias("_t0"), F.max(order).alias("_t1"))
        spans = part if spans is None else spans.unionByName(part)
    dt = F.lit(1.0 / hz)
    spans = spans.groupBy(*keys).agg(F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"))
    spans = spans.withColumn("_n", F.floor((F.col("_t1") - F.col("_t0")) / dt) + 1)
    # a long recording is cut into runs of ticks first, so no single row has to hold its whole clock
    step = F.lit(TICKS_PER_TASK)
    runs = spans.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / step))))
    runs = runs.repartition(*keys, "_run")
    ticks = runs.withColumn(
        "i", F.explode(F.sequence(F.col("_run") * step, F.least(F.col("_n"), (F.col("_run") + 1) * step) - 1))
    )
    return ticks.select(*keys, "i", F.round(F.col("_t0") + F.col("i") * dt, 9).alias(order))


def shift_time(df: DataFrame, order: str, seconds: float) -> DataFrame:
    """Lag compensation: move a stream later by ``seconds``."""
    return df.withColumn(order, F.col(order) + F.lit(float(seconds)))


@dataclass(frozen=True)
class Stream:
    """A right-hand side of an as-of join: which columns to take, from which direction, how far away."""

    df: DataFrame
    columns: Mapping[str, str] = field(default_factory=dict)
    direction: str = "nearest"
    tolerance: float | None = None

    def with_columns(self, base: set[str]) -> "Stream":
        return self if self.columns else replace(self, columns={c: c for c in self.df.columns if c not in base})


def asof_join(left: DataFrame, right: DataFrame, axis: Axis, direction: str = "nearest",
              tolerance: float | None = None, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Attach to each left row the right row chosen by direction, at most ``tolerance`` away (inclusive)."""
    return asof_join_all(left, {"r": Stream(right, columns or {}, direction, tolerance)}, axis)


def asof_join_all(left: DataFrame, streams: Mapping[str, Stream], axis: Axis) -> DataFrame:
    """As-of join many streams to one clock with a single shuffle of the union of all rows.

    With a finite tolerance a right row only matters near its own time, so it is copied across a chunk edge no further
    than the tolerance. Streams without a tolerance use carried neighbours instead.
    """
    base = {*axis.keys, axis.order}
    streams = {n: s.with_columns(base) for n, s in streams.items()}
    bounded = {n: s for n, s in streams.items() if s.tolerance is not None}
    open_ended = {n: s for n, s in streams.items() if s.tolerance is None}
    out = left
    if bounded:
        out = _asof(out, bounded, axis, max(s.tolerance for s in bounded.values()))
    if open_ended:
        out = _asof(out, open_ended, axis, None)
    return out


def _asof(left: DataFrame, streams: Mapping[str, Stream], axis: Axis, reach: float | None) -> DataFrame:
    keys, t = list(axis.keys), axis.order
    carried = [c for c in left.columns if c not in (*keys, t)]
    # the marker keeps "left row without further columns" distinct from "right row"
    own = F.struct(F.lit(True).alias("_row"), *[F.col(c) for c in carried])
    rows = left.select(*keys, F.col(t).cast("double").alias(t), F.lit(1).alias("_side"), own.alias("_left"))
    for name, s in streams.items():
        boxed = F.struct(F.col(t).cast("double").alias("_at"), *[F.col(src).alias(dst) for src, dst in s.columns.items()])
        rows = rows.unionByName(
            s.df.select(*keys, F.col(t).cast("double").alias(t), F.lit(0).alias("_side"), boxed.alias(f"_r_{name}")),
            allowMissingColumns=True,
        )
    placed = Axis(axis.keys, t, axis.width, ("_side",))
    if reach is None:
        specs = {}
        for name in streams:
            specs[f"_p_{name}"] = o.last_valid(f"_r_{name}")
            specs[f"_n_{name}"] = o.next_valid(f"_r_{name}")
        seen = o.running(rows, placed, **specs).where(F.col("_left").isNotNull())
    else:
        slack = reach * (1 + 1e-9) + 1e-6
        width = F.lit(float(max(axis.width, 2 * slack)))
        mine = F.floor(F.col(t) / width)
        near = F.sequence(F.floor((F.col(t) - F.lit(slack)) / width), F.floor((F.col(t) + F.lit(slack)) / width))
        rows = rows.withColumn(CHUNK, F.explode(F.when(F.col("_side") == 0, near).otherwise(F.array(mine))))
        ahead = placed.forward().rowsBetween(Window.unboundedPreceding, 0)
        behind = placed.backward().rowsBetween(Window.unboundedPreceding, 0)
        seen = rows.withColumns({
            **{f"_p_{n}": F.last(f"_r_{n}", ignorenulls=True).over(ahead) for n in streams},
            **{f"_n_{n}": F.last(f"_r_{n}", ignorenulls=True).over(behind) for n in streams},
        }).where(F.col("_left").isNotNull())
    chosen = seen.select(
        *keys, t, "_left", *[_choose(F.col(t), n, s).alias(f"_m_{n}") for n, s in streams.items()]
    )
    return chosen.select(
        *keys, t, *[F.col(f"_left.{c}").alias(c) for c in carried],
        *[F.col(f"_m_{n}.{c}").alias(c) for n, s in streams.items() for c in s.columns.values()],
    )


def _choose(t: Column, name: str, s: Stream) -> Column:
    before, after = F.col(f"_p_{name}"), F.col(f"_n_{name}")
    gap_before, gap_after = t - before["_at"], after["_at"] - t
    if s.direction == "backward":
        pick = before
    elif s.direction == "forward":
        pick = F.when(gap_before == 0, before).otherwise(after)
    elif s.direction == "nearest":
        # equally near on both sides: the earlier sample
        pick = F.when(after.isNull() | (gap_before <= gap_after), before).otherwise(after)
    else:
        raise ValueError(f"unknown as-of direction {s.direction!r}; use nearest, backward or forward")
    if s.tolerance is None:
        return pick
    return F.when(F.abs(pick["_at"] - t) <= F.lit(float(s.tolerance)), pick)


def rename_block(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    """Give a block of columns a suffix so that blocks of several sources can live in one table."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def interpolate(df: DataFrame, axis: Axis, columns: Sequence[str], limit: int | Column, pos: str | None = None) -> DataFrame:
    """Linear by position between valid neighbours, at most ``limit`` rows away from either; ends take the nearest value."""
    if isinstance(limit, int) and limit < 1:
        raise ValueError("interpolation limit must be at least one sample")
    n = F.lit(limit) if isinstance(limit, int) else limit
    specs, p = {}, pos or "_pos"
    for c in columns:
        if pos:
            box = F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).cast("double").alias("v")))
            specs[f"_b_{c}"], specs[f"_a_{c}"] = o.last_valid(box), o.next_valid(box)
        else:
            value = F.col(c).cast("double")
            specs[f"_b_{c}"], specs[f"_a_{c}"] = o.last_valid_at(value), o.next_valid_at(value)
    near = o.running(df, axis, **specs, **({} if pos else {p: o.row_index()}))
    filled = {}
    for c in columns:
        b, a, here = F.col(f"_b_{c}"), F.col(f"_a_{c}"), F.col(p)
        within = (here - b["p"] <= n) | (a["p"] - here <= n)
        line = b["v"] + (a["v"] - b["v"]) * (here - b["p"]) / (a["p"] - b["p"])
        value = F.when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).otherwise(line)
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(within, value)
    return near.withColumns(filled).select(*df.columns)


def median_step(df: DataFrame, axis: Axis, name: str = "median_dt") -> DataFrame:
    """Median time between consecutive samples, per group."""
    steps = o.running(df.select(*axis.keys, axis.order, *axis.ties), axis, _prev=o.lag(axis.order))
    return quantiles(steps, axis.keys, F.col(axis.order) - F.col("_prev"), [0.5], [name])


def interpolate_seconds(df: DataFrame, axis: Axis, columns: Sequence[str], limit_s: float) -> DataFrame:
    """``interpolate`` with the limit given in seconds, turned into samples by each group's median step."""
    steps = median_step(df, axis, "_dt")
    limited = df.join(steps, list(axis.keys), "left").withColumn(
        "_limit", F.rint(F.lit(float(limit_s)) / F.coalesce(F.nullif(F.col("_dt"), F.lit(0.0)), F.lit(1e-9)))
    )
    return interpolate(limited, axis, columns, F.col("_limit")).select(*df.columns)


def planar_speeds(df: DataFrame) -> DataFrame:
    """Commanded and measured planar speed, where their components exist."""
    have = set(df.columns)
    added = {}
    if {"v_cmd_x", "v_cmd_y"} <= have:
        added["v_cmd"] = F.hypot("v_cmd_x", "v_cmd_y")
    if {"vx", "vy"} <= have:
        added["v_actual"] = F.hypot("vx", "vy")
    return df.withColumns(added) if added else df


def add_distance(df: DataFrame, axis: Axis) -> DataFrame:
    """Step length (first 0) and its running sum; a step across a missing position is null and adds nothing."""
    if not {"x", "y"} <= set(df.columns):
        raise KeyError("distance needs the columns x and y")
    between = lambda here, prev: f"hypot({here('x')} - {prev('x')}, {here('y')} - {prev('y')})"
    place = {"x": "x", "y": "y"}
    return o.running(df, axis, dist_m_per_step=o.pairwise(between, "0.0D", place), dist_m=o.pairwise(between, "0.0D", place, total=True))


def smooth_seconds(df: DataFrame, axis: Axis, columns: Sequence[str], window_s: float, step_s: float,
                   pos: str | None = None) -> DataFrame:
    """Centred rolling mean over about ``window_s`` seconds of a clock with step ``step_s``."""
    size = max(1, round(window_s / step_s)) if window_s > 0 and step_s > 0 else 1
    if size == 1:
        return df
    before, after = size // 2, (size - 1) // 2
    return o.framed(df, axis, before, after, lambda d, w: d.withColumns(
        {c: F.avg(c).over(w.rowsBetween(-before, after)) for c in columns if c in df.columns}), pos)


def coverage(df: DataFrame, keys: Sequence[str], blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Share of rows where every present column of a block is known."""
    have = set(df.columns)
    aggregates = []
    for block, columns in blocks.items():
        present = [F.col(c).isNotNull() for c in columns if c in have]
        if present:
            full = present[0]
            for more in present[1:]:
                full = full & more
            aggregates.append(F.avg(full.cast("double")).alias(block))
    return df.groupBy(*keys).agg(*aggregates)


def relative_axes(df: DataFrame, axis: Axis, distance: str | None = None) -> DataFrame:
    """Time since the first row, and distance (null counts as 0) since the first row."""
    t = axis.order
    specs = {"_t0": o.group_first(t)}
    if distance:
        specs["_d0"] = o.group_first(F.coalesce(F.col(distance), F.lit(0.0)))
    out = o.running(df, axis, **specs).withColumn("t_rel", F.col(t) - F.col("_t0"))
    if distance:
        out = out.withColumn("dist_rel", F.coalesce(F.col(distance), F.lit(0.0)) - F.col("_d0"))
    return out.drop("_t0", "_d0")
