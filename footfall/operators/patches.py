"""Cutting trajectories into square terrain patches and summarising robot and terrain per patch."""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions import quaternions as qf
from footfall.operators import metrics as me, ordered as o
from footfall.operators.ordered import Axis
from footfall.operators.orientation import RIGHT_ANGLE_SLACK, average_quaternion, quaternion_blocks
from footfall.operators.quantiles import quantiles
from footfall.operators.raster import CELL, world_to_cell
from footfall.session import materialize

ROWS_PER_TASK = 200_000  # rows of one bucket of space that meet its centres in one task
CENTRES_PER_CHUNK = 20_000  # at least one stride lies between two centres
STRIDES_PER_CHUNK = 500  # strides of path whose rows are numbered in one chunk
BLOCK_ROWS, FANOUT = 65_536, 64  # rows of one block of path, and blocks that are composed into one
CHUNK_S = 3600.0  # seconds of one chunk where patches are scanned by time
DISTANCE_SHARE = 0.9  # fixed value: a patch must be walked for this share of its size
TIME_SLACK_S = 1e-3  # fixed value: tolerance of the time-containment rule
BUCKET_SLACK = 1e-6  # share of a square by which it is searched further, so that no last digit loses a row at its edge
DISTANCE_SLACK_M = 1e-6  # fixed value: distances along a path are sums, whose last digits depend on their order
TRIM = (0.05, 0.95)  # fixed values: percentiles of the robust summaries


# ---- selection ------------------------------------------------------------------------------------------------------

def select_ranges(df: DataFrame, ranges: DataFrame, t: str = "t") -> DataFrame:
    """Keep rows whose time since the recording's start lies in one of its ranges (inclusive).

    ``ranges``: mission, range_id (0-based order), start_s, end_s. Overlapping ranges repeat rows. ``t_rel`` restarts at
    the first kept row plus the first range's start. Recordings without ranges are kept whole.
    """
    starts = df.groupBy("mission").agg(F.min(t).alias("_t0"))
    wanted = starts.join(ranges, "mission", "left").select(
        "mission", "_t0", F.coalesce("range_id", F.lit(0)).alias("range_id"), "start_s", "end_s")
    since = F.col(t) - F.col("_t0")
    kept = df.join(wanted, "mission").where(
        F.col("start_s").isNull() | ((since >= F.col("start_s")) & (since <= F.col("end_s"))))
    first = kept.groupBy("mission").agg(
        F.min(t).alias("_first"), F.min_by("start_s", "range_id").alias("_base"))
    # the first configured range counts even when it kept nothing
    offsets = ranges.groupBy("mission").agg(F.min_by("start_s", "range_id").alias("_offset"))
    first = first.join(offsets, "mission", "left")
    return kept.join(first, "mission").withColumn(
        "t_rel", F.col(t) - F.col("_first") + F.coalesce("_offset", F.lit(0.0))
    ).select(*df.columns, "t_rel")


def cut_segments(selected: DataFrame, ranges: DataFrame) -> DataFrame:
    """Give each row the ranges its ``t_rel`` falls in; every range is its own trajectory (``segment_id``)."""
    named = ranges.select("mission", F.col("range_id").alias("segment_id"), "start_s", "end_s")
    ranged = selected.join(named, "mission").where("t_rel >= start_s AND t_rel <= end_s").drop("start_s", "end_s")
    whole = selected.join(ranges.select("mission").distinct(), "mission", "left_anti")
    return ranged.unionByName(whole.withColumn("segment_id", F.lit(0)))


def travelled(df: DataFrame, axis: Axis, coordinates: Sequence[str], distance: str = "dist_m",
              out: str = "dist_run") -> DataFrame:
    """Rows with known distance and coordinates; distance since the first of them, made monotone."""
    valid = F.col(distance).isNotNull()
    for c in coordinates:
        valid = valid & F.col(c).isNotNull()
    based = o.running(df.where(valid), axis, _d0=o.group_first(distance), _max=o.running_max(distance))
    return based.withColumn(out, F.col("_max") - F.col("_d0")).drop("_d0", "_max")


class Chains:
    """Rows of a block in path order; every entry row is followed to the target it leaves with. Chains that meet go on as one."""

    def __init__(self, first: float, stride: float):
        self.reach, self.stride, self.entering = first + stride, stride, True
        self.entries, self.joined, self.targets, self.live = [], [], [], deque()

    def add(self, d: float) -> None:
        enters, self.entering = self.entering, self.entering and d < self.reach
        if not enters and self.targets[self.live[0]] > d:
            return
        here = len(self.joined)
        while self.live and self.targets[self.live[0]] <= d:
            self.joined[self.live.popleft()] = here
        self.joined.append(here)
        self.targets.append(d + self.stride)
        self.live.append(here)
        if enters:
            self.entries.append((d, here))

    def exits(self) -> list[tuple[float, float]]:
        for k in range(len(self.joined) - 1, -1, -1):
            self.targets[k] = self.targets[self.joined[k]]
        return [(d, self.targets[k]) for d, k in self.entries]


@dataclass(frozen=True)
class Passage:
    """What a stretch of path does to the wanted distance: entering with a target at or below ``at[k]`` (and above ``at[k-1]``), one
    leaves with ``leave[k]``; a target beyond the last entry passes through unchanged."""

    at: np.ndarray
    leave: np.ndarray

    def __call__(self, targets: np.ndarray) -> np.ndarray:
        hit = np.searchsorted(self.at, targets, side="left")
        return np.where(hit < len(self.at), self.leave[np.minimum(hit, len(self.at) - 1)], targets)

    def then(self, after: Passage) -> Passage:
        beyond = after.at > self.at[-1]
        return Passage(np.concatenate([self.at, after.at[beyond]]), np.concatenate([after(self.leave), after.leave[beyond]]))

    def within(self, reach: float) -> Passage:
        """Only the entries that targets below ``reach`` can meet."""
        n = min(int(np.searchsorted(self.at, reach, side="left")) + 1, len(self.at))
        return Passage(self.at[:n], self.leave[:n])


def _passages(entries: pd.DataFrame, part: str) -> Iterator[tuple[int, Passage]]:
    ordered = entries.sort_values([part, "_d"])
    for k, block in ordered.groupby(part, sort=True):
        yield k, Passage(block["_d"].to_numpy(), block["_exit"].to_numpy())


def _targets(entries: DataFrame, keys: list[str], key_schema: str, stride: float, fanout: int) -> DataFrame:
    """(keys, _blk, _target): the distance wanted on entering each block, from the blocks' passages (keys, _blk, _d, _exit).

    ``fanout`` neighbouring blocks are composed into one passage, and these again, until few are left for a recording; what
    they are entered with is then handed down level by level. So a task meets ``fanout`` passages, not a recording.
    """
    def chain(group: pd.DataFrame) -> pd.DataFrame:
        target, found = group["_from"].iloc[0] if "_from" in group else -math.inf, []
        for k, passage in _passages(group, "_blk"):
            found.append((k, target))
            target = float(passage(np.array([target]))[0])
        out = pd.DataFrame(found, columns=["_blk", "_target"])
        return out.assign(**{k: group[k].iloc[0] for k in keys})[[*keys, "_blk", "_target"]]

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, passage in _passages(group, "_blk"):
            whole = passage if whole is None else whole.then(passage).within(whole.at[0] + stride)
        return pd.DataFrame({"_blk": group["_sup"].iloc[0], "_d": whole.at, "_exit": whole.leave}).assign(
            **{k: group[k].iloc[0] for k in keys})[[*keys, "_blk", "_d", "_exit"]]

    result = f"{key_schema}, _blk bigint, _target double"
    last = entries.agg(F.max("_blk")).first()[0]
    if last is None or last < fanout:
        return entries.groupBy(*keys).applyInPandas(chain, result)
    above = entries.withColumn("_sup", F.floor(F.col("_blk") / fanout))
    composed = materialize(above.groupBy(*keys, "_sup").applyInPandas(compose, f"{key_schema}, _blk bigint, _d double, _exit double"))
    begun = _targets(composed, keys, key_schema, stride, fanout).withColumnsRenamed({"_blk": "_sup", "_target": "_from"})
    return above.join(begun, [*keys, "_sup"]).groupBy(*keys, "_sup").applyInPandas(chain, result)


def patch_centers(df: DataFrame, axis: Axis, stride: float, distance: str = "dist_run", block_rows: int = BLOCK_ROWS,
                  fanout: int = FANOUT) -> DataFrame:
    """First row at or beyond each target distance; the next target is the chosen row's own distance plus the stride.

    The rule is sequential. It is split into blocks of rows, however far apart these are: inside a block every possible
    entry row is followed to the target it leaves with (entries lie within one stride of the block's start). These maps are
    composed in a tree (``_targets``), and the blocks are walked again from their real entries. Blocks run in parallel, and a task
    streams through many of them, as most recordings are one short block.
    """
    if stride <= 0:
        raise ValueError("the stride must be positive")
    keys = list(axis.keys)
    # one row per distance: rows of a robot at rest are the same target
    first_rows = df.groupBy(*keys, distance).agg(F.min(axis.position()).alias("_at"))
    numbered = o.positions(first_rows, Axis(axis.keys, distance, stride * STRIDES_PER_CHUNK), "_row")
    first_rows = materialize(numbered.withColumn("_blk", F.floor(F.col("_row") / block_rows)).drop("_row"))
    lean = first_rows.select(*keys, "_blk", F.col(distance).alias("_d")).dropna(subset=keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields if f.name in keys)
    names = [*keys, "_blk", "_d"]

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, chains = None, None
        for batch in batches:
            found = []
            for *at, d in zip(*[batch[c].tolist() for c in names], strict=True):
                if at != block:
                    found += [(*block, *e) for e in chains.exits()] if chains else []
                    block, chains = at, Chains(d, stride)
                chains.add(d)
            yield pd.DataFrame(found, columns=[*names, "_exit"])
        yield pd.DataFrame([(*block, *e) for e in chains.exits()] if chains else [], columns=[*names, "_exit"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, target = None, None
        for batch in batches:
            found = []
            for row, (*at, d, start) in enumerate(zip(*[batch[c].tolist() for c in (*names, "_target")], strict=True)):
                if at != block:
                    block, target = at, start
                if d >= target:
                    found.append(row)
                    target = d + stride
            yield batch.iloc[found][[*keys, "_d"]]

    def in_path_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys, "_blk").sortWithinPartitions(*names)

    # a recording of one block is entered at its first row; only longer ones need to know what they are entered with
    long = materialize(lean.groupBy(*keys).agg(F.max("_blk").alias("_top")).where("_top > 0").drop("_top"))
    wanted = lean.withColumn("_target", F.lit(-math.inf))
    if not long.isEmpty():
        entries = materialize(in_path_order(lean.join(long, keys)).mapInPandas(exits, f"{key_schema}, _blk bigint, _d double, _exit double"))
        entered = _targets(entries, keys, key_schema, stride, fanout)
        wanted = lean.join(entered, [*keys, "_blk"], "left").withColumn("_target", F.coalesce("_target", F.lit(-math.inf)))
    walked = in_path_order(wanted).mapInPandas(walk, f"{key_schema}, _d double")
    at = first_rows.select(*keys, F.col(distance).alias("_d"), "_at")
    located = walked.join(at, [*keys, "_d"]).select(
        *keys, F.col("_d").alias("center_dist"), *[F.col(f"_at.{c}").alias(c) for c in (axis.order, *axis.ties)])
    rest = [c for c in df.columns if c not in (*keys, axis.order, *axis.ties)]
    return located.join(df.select(*keys, axis.order, *axis.ties, *rest), [*keys, axis.order, *axis.ties])


# ---- membership -----------------------------------------------------------------------------------------------------

def _bucket_join(placed: DataFrame, spread: DataFrame, on: Sequence[str], order: str, rows_per_task: int) -> DataFrame:
    """Join rows and centres by bucket. Rows of a bucket with more than ``rows_per_task`` (a robot at rest) are dealt out over as
    many parts as that takes, by their ``order``; the centres near such a bucket, and only these, are repeated for each part.
    """
    sizes = placed.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows_per_task)
    busy = materialize(sizes.select(*on, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_parts")))
    if busy.isEmpty():
        return placed.withColumn("_part", F.lit(0)).join(spread.withColumn("_part", F.lit(0)), [*on, "_part"])
    # at most one bucket in rows_per_task rows is busy: broadcast, the rows are not shuffled for them
    busy, parts = F.broadcast(busy), F.coalesce("_parts", F.lit(1))
    dealt = placed.join(busy, list(on), "left").withColumn("_part", F.pmod(F.xxhash64(order), parts).cast("int")).drop("_parts")
    repeated = spread.join(busy, list(on), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"])


def members_in_square(rows: DataFrame, centers: DataFrame, keys: Sequence[str], size: float, e: str, n: str,
                      order: str = "t", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pair every row with the patches of its trajectory whose square covers it.

    ``centers`` has the keys, patch_id, center_e, center_n. Squares are matched by buckets of their own size, of which a square
    meets two each way.
    """
    side, reach = F.lit(float(size)), F.lit(size / 2 * (1 + BUCKET_SLACK))
    placed = rows.where(F.col(e).isNotNull() & F.col(n).isNotNull()).withColumns({
        "_be": F.floor(F.col(e) / side), "_bn": F.floor(F.col(n) / side)})
    spread = centers.select(*keys, "patch_id", "center_e", "center_n")
    for bucket, value in (("_be", "center_e"), ("_bn", "center_n")):
        spread = spread.withColumn(bucket, F.explode(F.sequence(F.floor((F.col(value) - reach) / side), F.floor((F.col(value) + reach) / side))))
    inside = (F.abs(F.col(e) - F.col("center_e")) <= side / 2) & (F.abs(F.col(n) - F.col("center_n")) <= side / 2)
    return _bucket_join(placed, spread, [*keys, "_be", "_bn"], order, rows_per_task).where(inside).select(*rows.columns, "patch_id")


def members_in_distance(rows: DataFrame, centers: DataFrame, keys: Sequence[str], size: float, distance: str = "dist_run",
                        order: str = "t", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Without coordinates: rows within half a patch of the centre along the path (``centers`` has center_dist).

    A row at just half a patch belongs to it, whatever the last digits of the summed distances are.
    """
    side = F.lit(float(size))
    placed = rows.where(F.col(distance).isNotNull()).withColumn("_b", F.floor(F.col(distance) / side))
    spread = centers.select(*keys, "patch_id", "center_dist").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("center_dist") / side) - 1, F.floor(F.col("center_dist") / side) + 1)))
    inside = F.abs(F.col(distance) - F.col("center_dist")) <= side / 2 + F.lit(DISTANCE_SLACK_M)
    return _bucket_join(placed, spread, [*keys, "_b"], order, rows_per_task).where(inside).select(*rows.columns, "patch_id")


# ---- terrain --------------------------------------------------------------------------------------------------------

@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "abcdef"]))
def _solve_quadratic(sums: pd.Series) -> pd.DataFrame:
    """Six coefficients from the 15 moments x^i y^j (i + j <= 4, i-major) and the 6 right-hand sums of each window."""
    powers = [(i, j) for i in range(5) for j in range(5 - i)]
    terms = [(2, 0), (0, 2), (1, 1), (1, 0), (0, 1), (0, 0)]
    where = {p: k for k, p in enumerate(powers)}
    table = np.array([np.asarray(s, dtype=float) for s in sums]).reshape(len(sums), -1)
    pick = [[where[p[0] + q[0], p[1] + q[1]] for q in terms] for p in terms]
    normal, right = table[:, :15][:, np.array(pick)], table[:, 15:]
    out = np.full((len(sums), 6), np.nan)
    ok = (table[:, where[0, 0]] >= 6) & (np.linalg.matrix_rank(normal, hermitian=True, tol=1e-8) == 6)
    if ok.any():
        out[ok] = np.linalg.solve(normal[ok], right[ok][:, :, None])[:, :, 0]
    return pd.DataFrame(out, columns=list("abcdef")).astype(object).where(~np.isnan(out), None)


def terrain_windows(centers: DataFrame, cells: DataFrame, georef: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Per patch: share of known cells, plane slopes, quadratic surface, curvatures; ``inside`` tells whether the window
    lies on the raster.

    Windows are joined to the cells by (raster, row, col) and reduced to sums of moments, so no window is ever gathered. Patches
    around the same cell have the same window: it is read and fitted once, so there are no more windows than cells.
    """
    ids, place = [*keys, "patch_id"], [*CELL, "_half"]
    placed = world_to_cell(centers, georef, "center_e", "center_n")
    half = F.greatest(F.lit(1), F.rint(F.lit(size / 2.0) / F.abs("a")).cast("int"))
    placed = placed.withColumn("_half", half)
    inside = (F.col("row") - F.col("_half") >= 0) & (F.col("col") - F.col("_half") >= 0) & (
        F.col("row") + F.col("_half") < F.col("h")) & (F.col("col") + F.col("_half") < F.col("w"))
    placed = placed.withColumns({
        "inside": F.coalesce(inside, F.lit(False)),
        "patch_side_m_actual": (2 * F.col("_half") + 1) * F.abs("a")})
    window = placed.where("inside").select(*place).distinct().select(
        "raster_id", F.col("row").alias("_r"), F.col("col").alias("_c"), "_half", F.explode(F.sequence(-F.col("_half"), F.col("_half"))).alias("_dr"))
    window = window.withColumn("_dc", F.explode(F.sequence(-F.col("_half"), F.col("_half")))).withColumns(
        {"row": F.col("_r") + F.col("_dr"), "col": F.col("_c") + F.col("_dc")})
    z = window.join(cells.select(*CELL, "z"), CELL, "left").where(F.col("z").isNotNull())
    x, y = F.col("_dc").cast("double"), F.col("_dr").cast("double")

    def power(i: int, j: int) -> Column:
        p = F.lit(1.0)
        for factor in [x] * i + [y] * j:
            p = p * factor
        return p

    moments = [F.sum(power(i, j)).alias(f"_m{i}{j}") for i in range(5) for j in range(5 - i)]
    rights = [F.sum(power(i, j) * F.col("z")).alias(f"_z{i}{j}") for i, j in ((2, 0), (0, 2), (1, 1), (1, 0), (0, 1), (0, 0))]
    sums = z.groupBy("raster_id", F.col("_r").alias("row"), F.col("_c").alias("col"), "_half").agg(*moments, *rights)
    m, s = (lambda k: F.col(f"_m{k}")), (lambda k: F.col(f"_z{k}"))
    n = m("00")
    cov = {"xx": m("20") - m("10") ** 2 / n, "yy": m("02") - m("01") ** 2 / n, "xy": m("11") - m("10") * m("01") / n,
           "xz": s("10") - m("10") * s("00") / n, "yz": s("01") - m("01") * s("00") / n}
    det = cov["xx"] * cov["yy"] - cov["xy"] * cov["xy"]
    fits = (n >= 3) & (det > 1e-9)
    quadratic = _solve_quadratic(F.array(
        *[m(f"{i}{j}") for i in range(5) for j in range(5 - i)], *[s(k) for k in ("20", "02", "11", "10", "01", "00")]))
    fitted = sums.withColumns({
        "_p": F.when(fits, (cov["xz"] * cov["yy"] - cov["yz"] * cov["xy"]) / det),
        "_q": F.when(fits, (cov["yz"] * cov["xx"] - cov["xz"] * cov["xy"]) / det),
        "_quad": quadratic, "_known": n,
    }).select(*place, "_p", "_q", "_quad", "_known")
    out = placed.join(fitted, place, "left").withColumns({
        "height_valid_fraction": F.when(F.col("inside"), F.coalesce("_known", F.lit(0.0)) / F.pow(2 * F.col("_half") + 1, 2)),
        "slope_e": F.col("_p") / F.col("a"), "slope_n": F.col("_q") / F.col("e"),
        "quad_xx": F.col("_quad.a") / (F.col("a") * F.col("a")), "quad_yy": F.col("_quad.b") / (F.col("e") * F.col("e")),
        "quad_xy": F.col("_quad.c") / (F.col("a") * F.col("e")), "quad_x": F.col("_quad.d") / F.col("a"),
        "quad_y": F.col("_quad.e") / F.col("e"), "quad_0": F.col("_quad.f"),
    })
    out = out.withColumns({"slope_mag": F.hypot("slope_e", "slope_n"), "grad_orientation": F.atan2("slope_n", "slope_e")})
    return add_curvatures(out).select(
        *ids, "inside", "patch_side_m_actual", "height_valid_fraction", "slope_e", "slope_n", "slope_mag", "grad_orientation",
        "quad_xx", "quad_yy", "quad_xy", "quad_x", "quad_y", "quad_0", "k1", "k2", "curvature_mean", "curvature_abs")


def add_curvatures(df: DataFrame) -> DataFrame:
    """Mean and principal curvatures of the fitted surface at the patch centre."""
    gx, gy = F.col("quad_x"), F.col("quad_y")
    xx, yy, xy = 2 * F.col("quad_xx"), 2 * F.col("quad_yy"), F.col("quad_xy")
    g = 1 + gx * gx + gy * gy
    mean = ((1 + gy * gy) * xx - 2 * gx * gy * xy + (1 + gx * gx) * yy) / (2 * F.pow(g, 1.5))
    gauss = (xx * yy - xy * xy) / (g * g)
    df = df.withColumns({"curvature_mean": mean, "_root": F.sqrt(F.greatest(mean * mean - gauss, F.lit(0.0)))})
    df = df.withColumns({"k1": F.col("curvature_mean") + F.col("_root"), "k2": F.col("curvature_mean") - F.col("_root")})
    return df.withColumn("curvature_abs", F.abs("k1") + F.abs("k2")).drop("_root")


def add_heading_curvatures(df: DataFrame, yaw: str = "heading_yaw_rad") -> DataFrame:
    """Normal curvature along and across the heading: second over first fundamental form."""
    gx, gy = F.col("quad_x"), F.col("quad_y")
    norm = F.sqrt(1 + gx * gx + gy * gy)

    def along(u: Column, v: Column) -> Column:
        second = (2 * F.col("quad_xx") * u * u + 2 * F.col("quad_xy") * u * v + 2 * F.col("quad_yy") * v * v) / norm
        first = (1 + gx * gx) * u * u + 2 * gx * gy * u * v + (1 + gy * gy) * v * v
        return second / F.nullif(first, F.lit(0.0))

    c, s = F.cos(yaw), F.sin(yaw)
    return df.withColumns({"curvature_heading": along(c, s), "curvature_cross_heading": along(-s, c)})


# ---- robot ----------------------------------------------------------------------------------------------------------

def robust_summary(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Mean, 5th and 95th percentile of several columns per group: ``<name>_mean``, ``_min``, ``_max``."""
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("_name"), c.cast("double").alias("_value")) for n, c in values.items()])))
    ends = quantiles(long, [*keys, "_name"], "_value", TRIM, ["_lo", "_hi"])
    both = long.groupBy(*keys, "_name").agg(F.avg("_value").alias("_mean")).join(ends, [*keys, "_name"], "left")
    at = lambda n, c: F.max(F.when(F.col("_name") == n, F.col(c)))
    return both.groupBy(*keys).agg(*[
        at(n, c).alias(f"{n}_{s}") for n in values for c, s in (("_mean", "mean"), ("_lo", "min"), ("_hi", "max"))])


def robot_summary(members: DataFrame, keys: Sequence[str], metrics: Sequence[str], t: str = "t",
                  ties: Sequence[str] = ()) -> DataFrame:
    """All robot features of a patch except its cost of transport."""
    return patch_spans(members, keys, t).join(robot_features(members, keys, metrics, t, ties), list(keys), "left")


def patch_spans(members: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Rows of a patch, their span of time and the distance walked between them."""
    return members.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.min(t).alias("t_start"), F.max(t).alias("t_end"),
        (F.max(t) - F.min(t)).alias("time_span_s"),
        (F.max("dist_m") - F.min("dist_m")).alias("distance_traveled_m"))


def robot_features(members: DataFrame, keys: Sequence[str], metrics: Sequence[str], t: str = "t",
                   ties: Sequence[str] = ()) -> DataFrame:
    """Mean and percentiles of metrics, speeds and pitch, and the mean bearing."""
    values = {f"metric_{m}": F.col(m) if m in members.columns else F.lit(None).cast("double") for m in metrics}
    values["speed"], values["v_cmd"] = me.measured_speed(members), me.commanded_speed(members)
    blocks = quaternion_blocks(members)
    values["pitch_deg"] = (
        qf.euler_zyx_degrees(tuple(F.col(c) for c in blocks[0]), pitch_sign=-1.0)[1] if blocks else F.lit(None).cast("double"))
    bearing = average_quaternion(members, keys, [t, *ties], [f"bearing_q{n}" for n in "wxyz"], RIGHT_ANGLE_SLACK)
    return robust_summary(members, keys, values).join(bearing, list(keys), "left")


def patch_cost_of_transport(members: DataFrame, axis: Axis, cfg: Mapping, power: str = "power") -> DataFrame:
    """Energy per weight and distance over pairs of neighbouring valid rows of a patch; also with power trimmed to its
    5..95 percentile. ``axis`` is keyed by the patch."""
    robot = me.mass_and_gravity(cfg)
    keys, t, p = list(axis.keys), axis.order, cfg.get("params") or {}
    if robot is None or power not in members.columns:
        return members.select(*keys).distinct().withColumns(
            {c: F.lit(None).cast("double") for c in ("cot_patch", "cot_patch_p95")})
    least = float(p.get("min_cmd_speed_for_power_norm", p.get("min_speed_for_power_norm", 0.0)))
    turn_rate, turn_speed = float(p.get("turn_only_min_w_cmd_z", 0.0)), float(p.get("turn_only_max_v_cmd_for_turn", least))
    work = members.withColumns({"_c": me.commanded_speed(members), "_p": F.col(power)})
    # known and finite
    ok = F.coalesce((F.abs("_p") < math.inf) & (F.abs("dist_m") < math.inf) & (F.abs("_c") < math.inf) & (F.abs(t) < math.inf), F.lit(False))
    turning = F.lit(False)
    if turn_rate > 0 and "w_cmd_z" in members.columns:
        turning = F.coalesce(ok & (F.abs("w_cmd_z") >= turn_rate) & (F.col("_c") < turn_speed), F.lit(False))
    work = work.withColumns({"_ok": ok, "_idle": F.coalesce(F.col("_c") < max(least, 0.0), F.lit(False)), "_turn": turning})
    work = me.dilate(work.select(*keys, t, *axis.ties, "_p", "dist_m", "_ok", "_idle", "_turn"), axis, {
        "_idle": float(p.get("min_cmd_speed_pad_s", 0.0)), "_turn": float(p.get("turn_only_pad_s", 0.0))})
    # read by every pass of the quantiles and by the join with them
    work = materialize(work.withColumn("_ok", F.col("_ok") & ~F.col("_idle") & ~F.col("_turn")).drop("_idle", "_turn"))
    ends = quantiles(work.where("_ok"), keys, "_p", TRIM, ["_lo", "_hi"])
    work = work.join(ends, keys, "left").withColumn(
        "_core", F.coalesce(F.col("_ok") & (F.col("_p") >= F.col("_lo")) & (F.col("_p") <= F.col("_hi")), F.lit(False)))
    work = o.running(work, axis, _pt=o.lag(t), _pd=o.lag("dist_m"), _pok=o.lag("_ok"), _pcore=o.lag("_core"))
    dt = F.greatest(F.coalesce(F.col(t) - F.col("_pt"), F.lit(0.0)), F.lit(0.0))
    step = F.greatest(F.coalesce(F.col("dist_m") - F.col("_pd"), F.lit(0.0)), F.lit(0.0))

    def ratio(here: str, before: str) -> Column:
        both = F.col(here) & F.col(before)
        distance = F.sum(F.when(both, step))
        energy = F.sum(F.when(both, F.col("_p") * dt))
        return F.when(distance > 0, F.coalesce(energy, F.lit(0.0)) / (F.lit(robot[0] * robot[1]) * distance))

    return work.groupBy(*keys).agg(ratio("_ok", "_pok").alias("cot_patch"), ratio("_core", "_pcore").alias("cot_patch_p95"))


# ---- reduction ------------------------------------------------------------------------------------------------------

def drop_exact_duplicates(patches: DataFrame) -> DataFrame:
    """Of patches with the same centre and time span (to 3 decimals) the first stays; incomplete keys always stay."""
    names = ("center_e", "center_n", "t_start", "t_end")
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    keyed = patches.withColumns({f"_k_{c}": F.bround(c, 3) for c in names})
    same = [f"_k_{c}" for c in names]
    first = keyed.where(complete).groupBy("mission", *same).agg(F.min("patch_index").alias("patch_index"))
    kept = keyed.where(complete).join(first.select("mission", "patch_index"), ["mission", "patch_index"], "left_semi")
    return kept.unionByName(keyed.where(~complete)).drop(*same)


def _pieces(spans: DataFrame, slack: float, chunk_s: float) -> DataFrame:
    """Number runs of patches that no containment in time leaves (``_piece``); ``_alone`` marks runs of one.

    By start time, a run may end where everything before ends earlier than anything after it, and starts earlier too. A robot
    that walks on has patches whose starts and ends both grow: each is alone. Only patches that it came back to, and what lies
    between, make longer runs.
    """
    line = Axis(("mission",), "t_start", chunk_s, ("patch_index",))
    seen = o.running(spans, line, _top=o.running_max("t_end", include_current=False), _low=o.remaining_min("t_end"), _before=o.lag("t_start"))
    cut = F.col("_top").isNull() | ((F.col("_top") + slack < F.col("_low")) & (F.col("_before") + slack < F.col("t_start")))
    seen = seen.withColumn("_cut", cut.cast("int")).drop("_top", "_low", "_before")
    seen = o.running(seen, line, _piece=o.running_sum("_cut"), _next=o.lead("_cut"))
    return seen.withColumn("_alone", (F.col("_cut") == 1) & (F.coalesce("_next", F.lit(1)) == 1)).drop("_cut", "_next")


class Frontier:
    """Spans of time of which none lies in another one, to ask whether a new span lies in any: both ends grow together."""

    def __init__(self, slack: float):
        self.starts, self.ends, self.slack = [], [], slack

    def holds(self, start: float, end: float) -> bool:
        k = bisect.bisect_right(self.starts, start + self.slack) - 1  # the latest end among those that start in time
        return k >= 0 and end <= self.ends[k] + self.slack

    def add(self, start: float, end: float) -> None:
        k = bisect.bisect_left(self.starts, start)
        if k and self.ends[k - 1] >= end or k < len(self.starts) and self.starts[k] == start and self.ends[k] >= end:
            return
        last = bisect.bisect_right(self.ends, end)
        del self.starts[k:max(k, last)], self.ends[k:max(k, last)]
        self.starts.insert(k, start)
        self.ends.insert(k, end)


class Places:
    """Kept squares by cell of half a side, to ask whether a new one lies within half a side of a kept one that spans its time."""

    def __init__(self, half: float):
        self.half, self.cells = half, {}

    def _cell(self, e: float, n: float) -> tuple[int, int]:
        return math.floor(e / self.half), math.floor(n / self.half)

    def holds(self, start: float, end: float, e: float, n: float) -> bool:
        ce, cn = self._cell(e, n)
        near = (self.cells.get((ce + i, cn + j), ()) for i in (-1, 0, 1) for j in (-1, 0, 1))
        return any(abs(e - oe) <= self.half and abs(n - on) <= self.half and start >= s and end <= t for cell in near for s, t, oe, on in cell)

    def add(self, start: float, end: float, e: float, n: float) -> None:
        cell = self.cells.setdefault(self._cell(e, n), [])
        # a square at the very place whose time lies in the new one's asks nothing more
        cell[:] = [c for c in cell if not (c[2] == e and c[3] == n and start <= c[0] and end >= c[1])]
        cell.append((start, end, e, n))


def _swept(patches: DataFrame, spans: DataFrame, values: Sequence[str], slack: float, chunk_s: float, empty: Callable[[], Frontier | Places]) -> DataFrame:
    """Keep a patch unless an earlier *kept* one holds it. Runs that containment cannot leave are swept in parallel, in the order
    of patches and row by row: a task holds the kept spans of a run. Patches without spans stay.
    """
    ids = ["mission", "patch_index"]
    pieces = materialize(_pieces(spans, slack, chunk_s))
    runs = pieces.where("NOT _alone").repartition("mission", "_piece").sortWithinPartitions("mission", "_piece", "patch_index")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, kept = None, empty()
        for batch in batches:
            gone = []
            for mission, index, piece, *span in zip(*[batch[c] for c in (*ids, "_piece", *values)], strict=True):
                if (mission, piece) != run:
                    run, kept = (mission, piece), empty()
                if kept.holds(*span):
                    gone.append((mission, index))
                else:
                    kept.add(*span)
            yield pd.DataFrame(gone, columns=ids).astype(batch[ids].dtypes)

    return patches.join(materialize(runs.mapInPandas(sweep, runs.select(*ids).schema)), ids, "left_anti")


def drop_contained(patches: DataFrame, size: float, chunk_s: float = CHUNK_S) -> DataFrame:
    """Drop patches inside an earlier kept one in space (half a patch either way) and time."""
    half, values = size / 2.0, ("t_start", "t_end", "center_e", "center_n")
    spans = patches.dropna(subset=list(values)).select("mission", "patch_index", *[F.col(c).cast("double").alias(c) for c in values])
    return _swept(patches, spans, values, 0.0, chunk_s, lambda: Places(half))


def drop_time_subsets(patches: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Drop patches whose time span lies in an earlier kept one's (1 ms tolerance), wherever they are."""
    values = ("t_start", "t_end")
    spans = patches.dropna(subset=list(values)).select("mission", "patch_index", *[F.col(c).cast("double").alias(c) for c in values])
    return _swept(patches, spans, values, TIME_SLACK_S, chunk_s, lambda: Frontier(TIME_SLACK_S))


def robot_reason(samples: Column, travelled_m: Column, min_samples: int, size: float) -> Column:
    """True where a patch has too few samples or was hardly walked."""
    short = F.coalesce(travelled_m < F.lit(DISTANCE_SHARE * size), F.lit(False))
    return (F.coalesce(samples, F.lit(0)) < min_samples) | short


def cut_patches(rows: DataFrame, centers: DataFrame, axis: Axis, size: float, stride: float, e: str, n: str,
                cells: DataFrame | None = None, georef: DataFrame | None = None, min_valid: float = 0.6, min_samples: int = 5,
                chunk_s: float = CHUNK_S) -> tuple[DataFrame, DataFrame]:
    """(kept patches with centre, span and ``patch_index``, skip counts).

    What decides on a patch is its window, its span and its place: only these are read, and its members are counted where they
    are found, not stored.
    """
    keys, ids = list(axis.keys), [*axis.keys, "patch_id"]
    lean = rows.select(*keys, axis.order, e, n, "dist_m")
    spans = patch_spans(members_in_square(lean, centers, keys, size, e, n, axis.order), ids, axis.order)
    judged = centers.select(*ids, "center_dist", "center_e", "center_n", F.col(axis.order).alias("center_t"))
    inside, known = F.lit(True), F.lit(None).cast("double")
    if cells is not None and georef is not None:
        windows = terrain_windows(centers, cells, georef, keys, size).select(*ids, "inside", "height_valid_fraction")
        judged, inside, known = judged.join(windows, ids, "left"), F.col("inside"), F.col("height_valid_fraction")
    reason = F.when(~inside, "edges").when(known < min_valid, "height").when(
        robot_reason(F.col("samples"), F.col("distance_traveled_m"), min_samples, size), "robot")
    judged = materialize(judged.join(spans, ids, "left").withColumn("reason", reason).drop("inside", "height_valid_fraction"))
    accepted = judged.where(F.col("reason").isNull()).drop("reason")
    # segments follow one another; inside one the centres are in path order
    line = Axis(("mission",), "_line", stride * CENTRES_PER_CHUNK, ("patch_id",))
    far = F.lit(1e12)
    numbered = o.positions(accepted.withColumn("_line", F.col("segment_id") * far + F.col("center_dist")), line, "patch_index")
    numbered = materialize(numbered.drop("_line", "center_dist"))
    unique = materialize(drop_exact_duplicates(numbered))
    apart = materialize(drop_contained(unique, size, chunk_s))
    final = materialize(drop_time_subsets(apart, chunk_s))
    stages = [("dupes", numbered, unique), ("contained", unique, apart), ("time_subset", apart, final)]
    skipped = judged.where(F.col("reason").isNotNull()).groupBy("mission", "reason").agg(F.count("*").alias("patches"))
    for name, before, after in stages:
        lost = before.join(after.select("mission", "patch_index"), ["mission", "patch_index"], "left_anti")
        skipped = skipped.unionByName(lost.groupBy("mission").agg(F.count("*").alias("patches")).select(
            "mission", F.lit(name).alias("reason"), "patches"))
    return final, skipped


def build_patches(rows: DataFrame, centers: DataFrame, axis: Axis, cfg: Mapping, size: float, stride: float,
                  e: str, n: str, metrics: Sequence[str] = (), cells: DataFrame | None = None, georef: DataFrame | None = None,
                  min_valid: float = 0.6, min_samples: int = 5, chunk_s: float = CHUNK_S) -> tuple[DataFrame, DataFrame]:
    """(patches, skip counts). ``rows`` and ``centers`` share ``axis.keys`` (mission, segment_id); centres carry patch_id.

    With a raster the centres also name their raster_id; without one the terrain columns are null. ``patch_index`` counts accepted patches
    before the reduction passes. Patches are cut first, and only those that stay are described, from the columns that this takes.
    """
    keys, ids = list(axis.keys), [*axis.keys, "patch_id"]
    final, skipped = cut_patches(rows, centers, axis, size, stride, e, n, cells, georef, min_valid, min_samples, chunk_s)
    wanted = {axis.order, *axis.ties, "dist_m", "power", "w_cmd_z", *metrics, *[c for b in quaternion_blocks(rows) for c in b]}
    for speed, components in (("v_cmd", {"v_cmd_x", "v_cmd_y"}), ("v_actual", {"vx", "vy"})):
        wanted |= {speed} if speed in rows.columns else components
    lean = rows.select(*keys, *[c for c in rows.columns if c not in keys and c in wanted | {e, n}])
    members = members_in_square(lean, final, keys, size, e, n, axis.order)
    members = materialize(members.select(*ids, *[c for c in lean.columns if c in wanted]))
    robot = robot_features(members, ids, metrics, axis.order, axis.ties)
    cot = patch_cost_of_transport(members, Axis(tuple(ids), axis.order, axis.width, axis.ties), cfg)
    if cells is not None and georef is not None:
        kept = centers.join(final.select(*ids), ids, "left_semi")
        shaped = final.join(terrain_windows(kept, cells, georef, keys, size).drop("inside"), ids, "left")
    else:
        empty = ("height_valid_fraction", "slope_e", "slope_n", "slope_mag", "grad_orientation", "quad_xx", "quad_yy",
                 "quad_xy", "quad_x", "quad_y", "quad_0", "k1", "k2", "curvature_mean", "curvature_abs")
        shaped = final.withColumns({**{c: F.lit(None).cast("double") for c in empty}, "patch_side_m_actual": F.lit(float(size))})
    shaped = shaped.join(robot, ids, "left").join(cot, ids, "left")
    bearing = tuple(F.col(f"bearing_q{c}") for c in "wxyz")
    p = cfg.get("params") or {}
    shaped = add_heading_curvatures(shaped.withColumn("heading_yaw_rad", qf.heading(bearing))).withColumns({
        "patch_size_m": F.lit(float(size)), "patch_stride_m": F.lit(float(stride)),
        "cot_min_cmd_speed": F.lit(float(p.get("min_cmd_speed_for_power_norm", 0.0)))})
    return shaped.drop("quad_xx", "quad_yy", "quad_xy", "quad_x", "quad_y", "quad_0"), skipped
