"""The data behind mission reports (drawing is left to the reader)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.angles import circular_rmse
from footfall.operators import filters, ordered as o
from footfall.operators.ordered import Axis
from footfall.operators.orientation import smooth_angles
from footfall.operators.quantiles import quantiles
from footfall.operators.raster import local_coordinates

QUARTER_TURNS = (0, 90, 180, 270)
LEAST_MOVING = 10  # fixed value: moving rows a heading comparison needs


def mean_per_pixel(points: DataFrame, value: str) -> DataFrame:
    """Mean of the known in-bounds samples of each raster cell."""
    inside = points.where((F.col("row") >= 0) & (F.col("row") < F.col("h")) & (F.col("col") >= 0) & (F.col("col") < F.col("w")))
    return inside.where(F.col(value).isNotNull()).groupBy("raster_id", "row", "col").agg(F.avg(value).alias("val"))


def colour_limits(df: DataFrame, keys: Sequence[str], value: str, percentile: float | None = 95.0,
                  from_zero: bool = True) -> DataFrame:
    """Lower and upper end of a colour scale, never equal."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if percentile:
        ends = ends.drop("_hi").join(quantiles(df, keys, value, [percentile / 100.0], ["_hi"]), list(keys))
    top = F.greatest(F.col("_hi"), F.lit(1e-9))
    low = F.lit(0.0) if from_zero else F.coalesce("_lo", F.lit(0.0))
    return ends.select(*keys, low.alias("vmin"), F.when(top <= low, low + 1e-6).otherwise(top).alias("vmax"))


def distance_segments(df: DataFrame, axis: Axis, requests: DataFrame, metrics: Mapping[str, object],
                      cumulative: Sequence[str] = ()) -> DataFrame:
    """Stretches of path for comparison: ``requests`` has mission, label, metric, start_m, length_m.

    Distances restart at 0; cumulative metrics do too. ``metrics`` maps each metric to its filter spec.
    """
    smoothed = filters.apply_chains(df, axis, metrics)
    long = smoothed.select("mission", axis.order, *axis.ties, "dist_m", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    cut = long.join(requests, ["mission", "metric"]).where(
        F.col("dist_m").between(F.col("start_m"), F.col("start_m") + F.col("length_m")))
    line = Axis(("mission", "label", "metric"), axis.order, axis.width, axis.ties)
    based = o.running(cut, line, _d0=o.group_first("dist_m"), _v0=o.group_first("value", valid_only=True))
    grows = F.col("metric").isin(list(cumulative)) if cumulative else F.lit(False)
    return based.select("mission", "label", "metric", axis.order, *axis.ties, (F.col("dist_m") - F.col("_d0")).alias("dist_rel"),
                        F.when(grows, F.col("value") - F.col("_v0")).otherwise(F.col("value")).alias("value"))


def parse_windows(specs: DataFrame) -> DataFrame:
    """``KEY:START:END`` texts to key, start_s, end_s; open ends are null, reversed ends are swapped."""
    part = lambda k: F.nullif(F.trim(F.get(F.split("spec", ":"), F.lit(k))), F.lit("")).try_cast("double")
    start, end = part(1), part(2)
    swap = start > end
    return specs.select("spec", F.trim(F.get(F.split("spec", ":"), F.lit(0))).alias("key"),
                        F.when(swap, end).otherwise(start).alias("start_s"), F.when(swap, start).otherwise(end).alias("end_s"))


def resolve_windows(windows: DataFrame, missions: DataFrame) -> DataFrame:
    """Window per mission: matched by the given argument, then id, folder, display name. ``missions``: id, arg, folder, display."""
    names = missions.select("id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("_rank"), F.col(c).cast("string").alias("key")) for k, c in enumerate(("arg", "id", "folder", "display"))])))
    hits = names.join(windows, "key")
    return hits.groupBy("id").agg(F.min_by(F.struct("start_s", "end_s"), F.struct("_rank", "spec")).alias("_w")).select("id", "_w.*")


def focus_window(df: DataFrame, axis: Axis, start: Column, end: Column) -> DataFrame:
    """Rows inside the window on relative time (swapped if reversed); an empty window means everything. Adds ``t_rel``."""
    t = axis.order
    swap = F.coalesce(start > end, F.lit(False))
    low, high = F.when(swap, end).otherwise(start), F.when(swap, start).otherwise(end)
    timed = df.join(df.groupBy(*axis.keys).agg(F.min(t).alias("_t0")), list(axis.keys)).withColumn("t_rel", F.col(t) - F.col("_t0"))
    inside = (low.isNull() | (F.col("t_rel") >= low)) & (high.isNull() | (F.col("t_rel") <= high))
    flagged = timed.withColumn("_in", inside)
    some = flagged.groupBy(*axis.keys).agg(F.bool_or("_in").alias("_any"))
    return flagged.join(some, list(axis.keys)).where(F.col("_in") | ~F.col("_any")).drop("_t0", "_in", "_any")


def cumulative_series(df: DataFrame, axis: Axis, metrics: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Windowed series with time from its first row and every metric minus its first known value."""
    kept = focus_window(df, axis, start, end)
    based = o.running(kept, axis, _t0=o.group_first("t_rel"), **{f"_v_{m}": o.group_first(m, valid_only=True) for m in metrics})
    return based.withColumns({"t_rel": F.col("t_rel") - F.col("_t0"), **{m: F.col(m) - F.col(f"_v_{m}") for m in metrics}}).drop(
        "_t0", *[f"_v_{m}" for m in metrics])


def missing_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mission) pairs without any value; metrics that nobody has are left out."""
    have = df.groupBy("mission").agg(*[F.count(m).alias(m) for m in metrics])
    long = have.select("mission", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in metrics])))
    known = long.groupBy("metric").agg(F.sum("n").alias("_all")).where("_all > 0").select("metric")
    return long.where("n = 0").join(known, "metric", "left_semi").select("metric", "mission")


def path_motion(df: DataFrame, axis: Axis, min_speed: float = 0.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Path direction and speed from positions by central differences (one-sided at the ends); ``moving`` marks fast rows."""
    placed = local_coordinates(df, axis, lat, lon)
    near = o.running(placed, axis, **{f"_b{c}": o.lag(c) for c in ("enu_x", "enu_y", axis.order)},
                     **{f"_a{c}": o.lead(c) for c in ("enu_x", "enu_y", axis.order)})

    def slope(c: str) -> Column:
        back, ahead = F.col(f"_b{c}"), F.col(f"_a{c}")
        return F.when(back.isNotNull() & ahead.isNotNull(), (ahead - back) / 2).otherwise(F.coalesce(ahead - F.col(c), F.col(c) - back))

    moved = near.withColumns({"dx": slope("enu_x"), "dy": slope("enu_y"), "_dt": slope(axis.order)})
    speed = F.hypot("dx", "dy") / F.greatest(F.col("_dt"), F.lit(1e-6))
    return moved.select(*df.columns, "dx", "dy", F.atan2("dy", "dx").alias("path_yaw"), speed.alias("path_speed"),
                        (speed >= min_speed).alias("moving"))


def best_quarter_turn(df: DataFrame, axis: Axis, heading: str = "heading", median_rows: int = 1, mean_rows: int = 1,
                      least: int = LEAST_MOVING) -> DataFrame:
    """Of four rotations of the path the one whose smoothed direction fits the heading best on moving rows (first on ties).

    Recordings with fewer than ``least`` moving rows have their count and no turn.
    """
    dx, dy = F.col("dx"), F.col("dy")
    turns = dict(zip(QUARTER_TURNS, ((dx, dy), (-dy, dx), (-dx, -dy), (dy, -dx))))
    # the four directions travel in one row
    yaw = df.select(*axis.keys, axis.order, *axis.ties, heading, "moving", *[
        F.atan2(y + 0.0, x + 0.0).alias(f"_yaw_{rot}") for rot, (x, y) in turns.items()])
    smooth = smooth_angles(yaw, axis, [f"_yaw_{rot}" for rot in turns], median_rows, mean_rows)
    scored = smooth.groupBy(*axis.keys).agg(F.count_if("moving").alias("n_moving"), F.array_min(F.array(*[
        F.struct(circular_rmse(F.when(F.col("moving"), F.col(heading)), F.col(f"_yaw_{rot}")).alias("rmse"), F.lit(rot).alias("rot"))
        for rot in turns])).alias("_b"))
    enough = F.col("n_moving") >= least
    return scored.select(*axis.keys, F.when(enough, F.col("_b.rot")).alias("rot"), F.when(enough, F.col("_b.rmse")).alias("rmse"), "n_moving")


def difference_histogram(df: DataFrame, keys: Sequence[str], value: str, min_bins: int = 20, max_bins: int = 120) -> DataFrame:
    """Equal-width counts over [-L, L] with L the largest magnitude rounded up to 5; plus mean and deviation.

    There are two bins to a unit, but no fewer than ``min_bins`` and no more than ``max_bins``; every row is counted.
    """
    known = df.where(F.col(value).isNotNull())
    spans = known.groupBy(*keys).agg(F.max(F.abs(value)).alias("_top"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    spans = spans.withColumn("limit", 5.0 * F.ceil(F.col("_top") / 5.0)).withColumn(
        "bins", F.greatest(F.lit(min_bins), F.least(F.lit(max_bins), F.floor(2 * F.col("limit")))))
    placed = known.join(spans, list(keys)).withColumn(
        "bin", F.least(F.floor((F.col(value) + F.col("limit")) / (2 * F.col("limit")) * F.col("bins")), F.col("bins") - 1))
    return placed.groupBy(*keys, "limit", "bins", "mean", "std", "bin").agg(F.count("*").alias("n"))


def rmse_and_bias(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))


def smooth_columns(df: DataFrame, axis: Axis, columns: Sequence[str], window: int) -> DataFrame:
    return filters.apply_chains(df, axis, {c: {"type": "moving_average", "window": window} for c in columns})


def time_to_distance(queries: DataFrame, path: DataFrame, axis: Axis, distance: str = "dist_m") -> DataFrame:
    """Running-max distance at given times: linear between samples, clamped at the ends."""
    t = axis.order
    monotone = o.running(path.where(F.col(distance).isNotNull()), axis, _d=o.running_max(distance))
    samples = monotone.groupBy(*axis.keys, t).agg(F.max("_d").alias("_d"))
    box = F.struct(F.col(t).alias("t"), F.col("_d").alias("d"))
    rows = queries.withColumns({"_at": F.lit(None).cast("struct<t:double,d:double>"), "_side": F.lit(1)}).unionByName(
        samples.select(*axis.keys, t, box.alias("_at"), F.lit(0).alias("_side")), allowMissingColumns=True)
    near = o.running(rows, Axis(axis.keys, t, axis.width, ("_side",)), _b=o.last_valid("_at"), _a=o.next_valid("_at")).where("_side = 1")
    b, a = F.col("_b"), F.col("_a")
    line = b["d"] + (a["d"] - b["d"]) * (F.col(t) - b["t"]) / F.nullif(a["t"] - b["t"], F.lit(0.0))
    return near.withColumn(distance, F.coalesce(line, b["d"], a["d"])).select(*queries.columns, distance)


def paired_frames(primary: DataFrame, secondary: DataFrame, axis: Axis, t_min: float, t_max: float) -> DataFrame:
    """Primary frames in a window of relative time with the latest secondary frame at or before them, else the first one."""
    t = axis.order
    starts = primary.groupBy(*axis.keys).agg(F.min(t).alias("_t0"))
    shown = primary.join(starts, list(axis.keys)).where((F.col(t) - F.col("_t0")).between(t_min, t_max)).drop("_t0")
    box = F.struct("frame", F.col(t).alias("at"))
    rows = shown.withColumn("_side", F.lit(1)).unionByName(
        secondary.select(*axis.keys, t, box.alias("_f"), F.lit(0).alias("_side")), allowMissingColumns=True)
    near = o.running(rows, Axis(axis.keys, t, axis.width, ("_side",)), _b=o.last_valid("_f"), _first=o.group_first("_f", valid_only=True))
    return near.where("_side = 1").select(*shown.columns, F.coalesce(F.col("_b.frame"), F.col("_first.frame")).alias("secondary_frame"))


def normalise_time(df: DataFrame, column: str, keys: Sequence[str], out: str = "t_ns") -> DataFrame:
    """Integer nanoseconds, timestamps or float seconds to nanoseconds since the group's first."""
    kind = dict(df.dtypes)[column]
    if kind in ("bigint", "int"):
        ns = F.col(column).cast("bigint")
    elif kind.startswith("timestamp"):
        ns = F.unix_micros(F.col(column).cast("timestamp")) * 1000
    else:
        ns = F.rint(F.col(column) * 1e9).cast("bigint")
    named = df.withColumn(out, ns)
    return named.join(named.groupBy(*keys).agg(F.min(out).alias("_n0")), list(keys)).withColumn(out, F.col(out) - F.col("_n0")).drop("_n0")
