"""The processing chain for all recordings at once: streams -> synced -> metrics -> slopes -> patches.

Every stage writes its table (in folders of recordings) and the next one reads it back, as the stages are also useful on
their own: a stage can be rerun, and no stage drags the lineage of the ones before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from footfall.functions import quaternions as qf
from footfall.operators import alignment as al, metrics as me, ordered as o, patches as pa, raster as ra
from footfall.operators.ordered import Axis
from footfall.operators.orientation import quaternion_blocks
from footfall.sources.signals import signal_scan
from footfall.sources.storage import manifest, read_table, write_metrics, write_patches, write_table


@dataclass(frozen=True)
class SyncSettings:
    # fixed values: defaults of the alignment stage
    hz: float = 10.0
    direction: str = "nearest"
    tolerance_s: float = 0.12
    interpolate_s: float = 0.1
    command_lag_s: float = 0.15
    smooth_s: float = 0.5
    chunk_s: float = 3600.0
    renames: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {
        "imu": {f"q{c}": f"q{c}_imu" for c in "wxyz"},
        "odom": {f"q{c}": f"q{c}_odom" for c in "wxyz"},
        "base_orientation": {**{f"q{c}": f"q{c}_WB" for c in "wxyz"}, **{f"q{c}_map": f"q{c}_WB_map" for c in "wxyz"}},
    })


# signals that span the clock; the orientation table only joins it
CLOCK_SIGNALS = ("cmd_vel", "odom", "gps", "imu", "joint_states")


def sync(signals: Mapping[str, DataFrame], cfg: SyncSettings = SyncSettings()) -> DataFrame:
    """All signals of all recordings on their uniform clocks; ``i`` numbers the ticks."""
    axis = Axis(("mission",), "t", cfg.chunk_s)
    clean = {n: signal_scan(df, ["mission"]) for n, df in signals.items()}
    clock = al.master_clock([clean[n] for n in CLOCK_SIGNALS if n in clean], ["mission"], "t", cfg.hz)
    streams = {}
    for name, df in clean.items():
        if name == "cmd_vel" and cfg.command_lag_s:
            df = al.shift_time(df, "t", cfg.command_lag_s)
        names = cfg.renames.get(name, {})
        columns = {c: names.get(c, c) for c in df.columns if c not in ("mission", "t")}
        streams[name] = al.Stream(df, columns, cfg.direction, cfg.tolerance_s)
    joined = al.asof_join_all(clock, streams, axis)
    for suffix in ("_WB", "_WB_map"):
        if f"qw{suffix}" in joined.columns:
            turned = qf.canonical(qf.quat(suffix=suffix))
            joined = joined.withColumns({f"q{c}{suffix}": q for c, q in zip("wxyz", turned)})
    numeric = [f.name for f in joined.schema if isinstance(f.dataType, NumericType) and f.name not in ("mission", "t", "i")]
    limit = round(cfg.interpolate_s * cfg.hz)
    filled = al.interpolate(joined, axis, numeric, limit, pos="i")
    measured = al.add_distance(al.planar_speeds(filled), axis)
    return al.smooth_seconds(measured, axis, ["v_cmd", "v_actual"], cfg.smooth_s, 1.0 / cfg.hz, pos="i")


def slopes(synced: DataFrame, cells: DataFrame, georef: DataFrame, rasters: DataFrame, half: int = 3,
           method: str = "gaussian", sigma: float = 2.25) -> DataFrame:
    """Terrain slope along and across the heading. ``rasters``: mission, raster_id."""
    blocks = quaternion_blocks(synced)
    if not blocks:
        raise KeyError("slopes need an orientation block")
    headed = synced.withColumn("heading", qf.heading(tuple(F.col(c) for c in blocks[0])))
    placed = ra.project(headed.join(rasters, "mission", "left"), names=("x_map", "y_map"))
    sampled = ra.heading_slopes(ra.plane_slopes(ra.world_to_cell(placed, georef, "x_map", "y_map"), cells, half, method, sigma))
    wanted = ["dem_grad_e", "dem_grad_n", "dem_slope_long", "dem_slope_lat", "dem_slope_long_deg", "dem_slope_lat_deg"]
    return ra.replace_columns(synced, sampled.select("mission", "t", *wanted), ["mission", "t"])


def patches(table: DataFrame, cfg: Mapping[str, Any], size: float = 5.0, stride: float = 2.5, ranges: DataFrame | None = None,
            metrics: Sequence[str] = (), cells: DataFrame | None = None, georef: DataFrame | None = None,
            rasters: DataFrame | None = None, chunk_s: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """(patches, skip counts) of a metrics table. Map coordinates are used where there are positions, else odometry."""
    axis = Axis(("mission", "segment_id"), "t", chunk_s)
    rows = table.withColumn("segment_id", F.lit(0))
    if ranges is not None:
        rows = pa.cut_segments(pa.select_ranges(table, ranges), ranges)
    if {"lat", "lon"} <= set(table.columns):
        rows = ra.project(rows)
        located = rows.groupBy("mission").agg(F.bool_or(F.col("easting_m").isNotNull()).alias("_gps"))
        rows = rows.join(located, "mission").withColumns({
            "px": F.when(F.col("_gps"), F.col("easting_m")).otherwise(F.col("x")),
            "py": F.when(F.col("_gps"), F.col("northing_m")).otherwise(F.col("y"))}).drop("_gps")
    else:
        rows = rows.withColumns({"px": F.col("x"), "py": F.col("y")})
    walked = pa.travelled(rows, axis, ["px", "py"])
    line = Axis(("mission", "segment_id"), "center_dist", stride * pa.CENTRES_PER_CHUNK)
    centers = o.positions(pa.patch_centers(walked, axis, stride).withColumns(
        {"center_e": F.col("px"), "center_n": F.col("py")}), line, "patch_id")
    if rasters is not None:
        centers = centers.join(rasters, "mission", "left")
    else:
        cells = georef = None
    return pa.build_patches(walked, centers, axis, cfg, size, stride, "px", "py", metrics, cells, georef)


def run(spark: SparkSession, signals: Mapping[str, DataFrame], out: str, cfg: Mapping[str, Any], metric_names: Sequence[str],
        settings: SyncSettings = SyncSettings(), **patch_options) -> DataFrame:
    """Write synced, manifest, metrics, slopes and patch tables under ``out`` and return the patches.

    Slopes need a raster (``cells``, ``georef``, ``rasters``), positions and an attitude; without them the stage is left out.
    """
    hz = int(settings.hz)
    write_metrics(sync(signals, settings), f"{out}/synced", hz, separate=False)
    synced = read_table(spark, f"{out}/synced").where(f"kind = 'synced' AND hz = {hz}").drop("kind", "hz")
    manifest(synced, {"hz": hz, "tolerance_s": settings.tolerance_s, "direction": settings.direction}).write.mode(
        "overwrite").parquet(f"{out}/manifest")
    axis = Axis(("mission",), "t", settings.chunk_s)
    write_metrics(me.compute(synced, metric_names, cfg, axis), f"{out}/metrics", hz)
    table = read_table(spark, f"{out}/metrics").drop("kind", "hz")
    terrain = {k: patch_options.get(k) for k in ("cells", "georef", "rasters")}
    if all(v is not None for v in terrain.values()) and {"lat", "lon"} <= set(table.columns) and quaternion_blocks(table):
        write_table(slopes(table, **terrain), f"{out}/slopes", overwrite=True)
        table = read_table(spark, f"{out}/slopes")
    found, _ = patches(table, cfg, metrics=metric_names, chunk_s=settings.chunk_s, **patch_options)
    write_patches(found, {"hz": hz, **{k: v for k, v in patch_options.items() if isinstance(v, (int, float))}}, f"{out}/patches")
    return read_table(spark, f"{out}/patches")
