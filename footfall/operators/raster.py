"""Raster algebra on cell tables ``(raster_id, row, col, z)`` with one ``georef`` row per raster.

Rasters are joined by (raster, row, col), so one large raster is spread over the cluster. Georef tables have one row per
raster and are left to the optimizer to broadcast by their measured size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import geodesy
from footfall.functions.kernels import plane_kernel
from footfall.operators import ordered as o
from footfall.operators.ordered import Axis
from footfall.operators.quantiles import quantiles

CELL = ["raster_id", "row", "col"]


def project(df: DataFrame, lat: str = "lat", lon: str = "lon", names: Sequence[str] = ("easting_m", "northing_m"),
            steps: Sequence[Callable[..., tuple[Column, ...]]] = geodesy.LV95) -> DataFrame:
    """Add map coordinates; ``steps`` are column functions from (lat, lon) to (east, north), each fed by the one before."""
    given, out = [lat, lon], df
    for k, step in enumerate(steps):
        last = k == len(steps) - 1
        values = step(*[F.col(c) for c in given])
        given = list(names) if last else [f"_step{k}_{i}" for i in range(len(values))]
        out = out.withColumns(dict(zip(given, values)))
    return out.select(*dict.fromkeys([*df.columns, *names]))


def local_coordinates(df: DataFrame, axis: Axis, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """East/north metres around each recording's first sample."""
    anchored = o.running(df, axis, _lat0=o.group_first(lat), _lon0=o.group_first(lon))
    east, north = geodesy.local_enu(F.col(lat), F.col(lon), F.col("_lat0"), F.col("_lon0"))
    return anchored.withColumns({"enu_x": east, "enu_y": north}).drop("_lat0", "_lon0")


def world_to_cell(points: DataFrame, georef: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Fractional ``row_f``/``col_f`` and nearest cell ``row``/``col`` (half to even) with the raster's size."""
    placed = points.join(georef.select("raster_id", "a", "c", "e", "f", "h", "w"), "raster_id", "left")
    placed = placed.withColumns({
        "row_f": (F.col(y) - F.col("f")) / F.col("e"), "col_f": (F.col(x) - F.col("c")) / F.col("a")})
    return placed.withColumns({"row": F.rint("row_f").cast("int"), "col": F.rint("col_f").cast("int")})


def sample_nearest(points: DataFrame, cells: DataFrame, value: str = "label") -> DataFrame:
    """Value of the nearest cell; outside or missing is null. ``points`` come from ``world_to_cell``."""
    return points.join(cells.select(*CELL, value), CELL, "left")


def label_maximum(cells: DataFrame, value: str = "label") -> DataFrame:
    return cells.groupBy("raster_id").agg(F.max(value).alias("max_label"))


def _gather(points: DataFrame, cells: DataFrame, offsets: Column, values: Mapping[str, str]) -> DataFrame:
    """One row per distinct (cell, offset entry): the cell's window joined to the cell table."""
    spread = points.select("raster_id", F.col("row").alias("_r"), F.col("col").alias("_c")).distinct().select(
        "*", F.inline(offsets))
    spread = spread.withColumns({"row": F.col("_r") + F.col("dr"), "col": F.col("_c") + F.col("dc")})
    return spread.join(cells.select(*CELL, *[F.col(s).alias(n) for s, n in values.items()]), CELL, "left")


def sample_bilinear(points: DataFrame, cells: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Bilinear value of several cell columns (``{column: output}``); null unless all four neighbours are known.

    Points are grouped by their upper-left cell, so each cell's neighbours are fetched once.
    """
    ul = points.withColumns({"_i": F.floor("row_f").cast("int"), "_j": F.floor("col_f").cast("int")})
    corners = ul.where("_i >= 0 AND _i < h - 1 AND _j >= 0 AND _j < w - 1").select(
        "raster_id", F.col("_i").alias("row"), F.col("_j").alias("col"))
    offsets = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (0, 1) for c in (0, 1)])
    near = _gather(corners, cells, offsets, {v: f"_z_{n}" for v, n in values.items()})
    square = near.groupBy("raster_id", F.col("_r").alias("_i"), F.col("_c").alias("_j")).agg(*[
        F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col(f"_z_{n}"))).alias(f"_{n}_{r}{c}")
        for n in values.values() for r in (0, 1) for c in (0, 1)])
    out = ul.join(square, ["raster_id", "_i", "_j"], "left")
    di, dj = F.col("row_f") - F.col("_i"), F.col("col_f") - F.col("_j")
    sampled = {
        n: F.col(f"_{n}_00") * (1 - di) * (1 - dj) + F.col(f"_{n}_10") * di * (1 - dj)
        + F.col(f"_{n}_01") * (1 - di) * dj + F.col(f"_{n}_11") * di * dj
        for n in values.values()
    }
    return out.withColumns(sampled).select(*points.columns, *values.values())


def plane_slopes(points: DataFrame, cells: DataFrame, half: int = 3, method: str = "gaussian",
                 sigma: float = 2.25) -> DataFrame:
    """East and north slope of a weighted plane fit around each point's cell; null if a cell is missing.

    The fit's design never changes, so a slope is a fixed linear combination of the window: a weighted sum after an
    equi-join, computed once per distinct cell.
    """
    kernel = F.array(*[
        F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(p).alias("p"), F.lit(q).alias("q"))
        for r, c, p, q in plane_kernel(half, method, sigma)])
    inner = points.where((F.col("row") >= half) & (F.col("row") < F.col("h") - half)
                         & (F.col("col") >= half) & (F.col("col") < F.col("w") - half))
    size = (2 * half + 1) ** 2
    fitted = _gather(inner, cells, kernel, {"z": "_z"}).groupBy(
        "raster_id", F.col("_r").alias("row"), F.col("_c").alias("col")
    ).agg(F.count("_z").alias("_n"), F.sum(F.col("p") * F.col("_z")).alias("_p"), F.sum(F.col("q") * F.col("_z")).alias("_q"))
    full = fitted.where(F.col("_n") == size).drop("_n")
    return points.join(full, CELL, "left").withColumns({
        "dem_grad_e": F.col("_p") / F.col("a"), "dem_grad_n": F.col("_q") / F.col("e")}).drop("_p", "_q")


def heading_slopes(df: DataFrame, heading: str = "heading", east: str = "dem_grad_e", north: str = "dem_grad_n") -> DataFrame:
    """Slope along and across the heading, unitless and in degrees."""
    c, s = F.cos(heading), F.sin(heading)
    along = F.col(east) * c + F.col(north) * s
    across = F.col(north) * c - F.col(east) * s
    return df.withColumns({
        "dem_slope_long": along, "dem_slope_lat": across,
        "dem_slope_long_deg": F.degrees(F.atan(along)), "dem_slope_lat_deg": F.degrees(F.atan(across)),
    })


def replace_columns(df: DataFrame, extra: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Append columns by key; columns of the same name (and their ``_dup`` copies) are replaced."""
    fresh = [c for c in extra.columns if c not in on]
    stale = [c for c in df.columns if c in fresh or (c.endswith("_dup") and c[:-4] in fresh)]
    return df.drop(*stale).join(extra, list(on), how)


def complete_grid(cells: DataFrame, georef: DataFrame) -> DataFrame:
    """Every cell of every raster, missing ones with null z."""
    rows = georef.select("raster_id", "a", "e", "h", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"))
    grid = rows.repartition("raster_id", "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return grid.join(cells.select(*CELL, "z"), CELL, "left")


def _difference(line: str, across: str, size: str, second_order: bool) -> Column:
    w = Window.partitionBy("raster_id", line).orderBy(across)
    z = F.col("z")
    inside = (F.lead(z).over(w) - F.lag(z).over(w)) / 2
    if second_order:
        first = (-3 * z + 4 * F.lead(z).over(w) - F.lead(z, 2).over(w)) / 2
        last = (3 * z - 4 * F.lag(z).over(w) + F.lag(z, 2).over(w)) / 2
    else:
        first, last = F.lead(z).over(w) - z, z - F.lag(z).over(w)
    return F.when(F.col(across) == 0, first).when(F.col(across) == F.col(size) - 1, last).otherwise(inside)


def grid_gradient(cells: DataFrame, georef: DataFrame, second_order: bool = True) -> DataFrame:
    """East/north slope of every cell by differences (central inside, one-sided at the border), magnitude, direction."""
    grid = complete_grid(cells, georef)
    steps = grid.withColumns({
        "_dc": _difference("row", "col", "w", second_order), "_dr": _difference("col", "row", "h", second_order)})
    out = steps.withColumns({"grad_e": F.col("_dc") / F.col("a"), "grad_n": F.col("_dr") / F.col("e")})
    return out.select(*CELL, "z", "grad_e", "grad_n", F.hypot("grad_e", "grad_n").alias("grad_mag"),
                      F.atan2("grad_n", "grad_e").alias("grad_theta"))


def _sampled_gradient(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``grid_gradient`` at the four cells around each point, bilinearly: dem_grad_e and dem_grad_n, null unless all four are known.

    The differences at the corners of a square need the twelve cells in and beside it, also at the border of the raster. So the
    cells that are read are those near points, twelve for each square with a point in it, and no gradient of the raster is made.
    """
    placed = points.withColumns({"_i": F.floor("row_f").cast("int"), "_j": F.floor("col_f").cast("int")})
    inner = placed.where("_i >= 0 AND _i < h - 1 AND _j >= 0 AND _j < w - 1")
    squares = inner.select("raster_id", F.col("_i").alias("row"), F.col("_j").alias("col"))
    beside = [(r, c) for r in range(-1, 3) for c in range(-1, 3) if r in (0, 1) or c in (0, 1)]
    near = _gather(squares, cells, F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in beside]), {"z": "_z"})
    name = lambda r, c: f"_z_{r + 1}{c + 1}"
    corner = near.groupBy("raster_id", F.col("_r").alias("_i"), F.col("_c").alias("_j")).agg(*[
        F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("_z"))).alias(name(r, c)) for r, c in beside])
    out = placed.join(corner, ["raster_id", "_i", "_j"], "left")

    def difference(z: Callable[[int], Column], k: int, first: Column, last: Column) -> Column:
        inside = (z(k + 1) - z(k - 1)) / 2
        if k == 0:
            return F.when(first, (-3 * z(0) + 4 * z(1) - z(2)) / 2).otherwise(inside)
        return F.when(last, (3 * z(1) - 4 * z(0) + z(-1)) / 2).otherwise(inside)

    di, dj = F.col("row_f") - F.col("_i"), F.col("col_f") - F.col("_j")
    first_row, last_row = F.col("_i") == 0, F.col("_i") + 1 == F.col("h") - 1
    first_col, last_col = F.col("_j") == 0, F.col("_j") + 1 == F.col("w") - 1
    east, north = F.lit(0.0), F.lit(0.0)
    for r in (0, 1):
        for c in (0, 1):
            share = (di if r else 1 - di) * (dj if c else 1 - dj)
            east = east + share * difference(lambda k, r=r: F.col(name(r, k)), c, first_col, last_col)
            north = north + share * difference(lambda k, c=c: F.col(name(k, c)), r, first_row, last_row)
    return out.withColumns({"dem_grad_e": east / F.col("a"), "dem_grad_n": north / F.col("e")}).select(*points.columns, "dem_grad_e", "dem_grad_n")


def sampled_gradient_slopes(points: DataFrame, cells: DataFrame, georef: DataFrame, heading: str = "heading") -> DataFrame:
    """Slopes in the heading frame from the gradient grid at the points; stored slopes, where present, win."""
    stored = [c for c in ("dem_slope_long_deg", "dem_slope_lat_deg") if c in points.columns]
    kept = points.withColumnsRenamed({c: f"_stored_{c}" for c in stored})
    sloped = heading_slopes(_sampled_gradient(kept, cells), heading)
    return sloped.withColumns({c: F.coalesce(f"_stored_{c}", c) for c in stored}).drop(*[f"_stored_{c}" for c in stored])


def track_chip(df: DataFrame, axis: Axis, side_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Square around the centre of each track's bounding box, for tracks with two known points or more."""
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    box = project(known, lat, lon, ("_e", "_n_m")).groupBy(*axis.keys).agg(
        F.count("*").alias("_n"), ((F.min("_e") + F.max("_e")) / 2).alias("_ce"), ((F.min("_n_m") + F.max("_n_m")) / 2).alias("_cn"))
    half = side_m / 2.0
    return box.where("_n >= 2").select(
        *axis.keys, (F.col("_ce") - half).alias("min_e"), (F.col("_cn") - half).alias("min_n"),
        (F.col("_ce") + half).alias("max_e"), (F.col("_cn") + half).alias("max_n"))


def tile_cover(boxes: DataFrame, tile_m: float = 1000.0) -> DataFrame:
    """Tiles a box touches; the upper edge is exclusive."""
    size = F.lit(float(tile_m))

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1e-6) / size)))

    return boxes.withColumn("e_km", span("min_e", "max_e")).withColumn("n_km", span("min_n", "max_n"))


def choose_tiles(cover: DataFrame, inventory: DataFrame, years: Sequence[int], resolutions: Sequence[float]) -> DataFrame:
    """For each covered tile the first available version by year order, then resolution order; misses have null."""
    rank = lambda column, wanted: F.array_position(F.array(*[F.lit(v) for v in wanted]), F.col(column))
    ranked = inventory.withColumns({"_y": rank("year", years), "_s": rank("res_m", resolutions)}).where("_y > 0 AND _s > 0")
    best = ranked.groupBy("e_km", "n_km").agg(F.min_by(F.struct("year", "res_m"), F.struct("_y", "_s")).alias("_best"))
    return cover.join(best.select("e_km", "n_km", "_best.*"), ["e_km", "n_km"], "left")


def mosaic(sources: DataFrame, frame: DataFrame) -> DataFrame:
    """Cells of several sources (x, y, z, source_rank) on one target grid: the first source with a value wins.

    ``frame`` has raster_id, x0 (left), y1 (top), res, h, w; whatever falls outside is cropped.
    """
    placed = sources.join(frame, "raster_id").withColumns({
        "row": F.floor((F.col("y1") - F.col("y")) / F.col("res")).cast("int"),
        "col": F.floor((F.col("x") - F.col("x0")) / F.col("res")).cast("int"),
    }).where("row >= 0 AND row < h AND col >= 0 AND col < w")
    return placed.where(F.col("z").isNotNull()).groupBy(*CELL).agg(F.min_by("z", F.struct("source_rank", "z")).alias("z"))


def raster_coverage(cells: DataFrame, frame: DataFrame) -> DataFrame:
    """Percent of the target grid that has a value."""
    known = cells.groupBy("raster_id").agg(F.count("z").alias("_n"))
    return frame.join(known, "raster_id", "left").select(
        "raster_id", (100.0 * F.coalesce("_n", F.lit(0)) / (F.col("h") * F.col("w"))).alias("coverage_percent"))


def scale_minmax(cells: DataFrame, value: str = "z", out: str = "gray") -> DataFrame:
    """Valid cells scaled to 0..255 (truncated); constant rasters and missing cells are 0."""
    spans = cells.groupBy("raster_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)
    return cells.join(spans, "raster_id").withColumn(
        out, F.when((F.col("_hi") > F.col("_lo")) & F.col(value).isNotNull(), scaled).otherwise(0).cast("int")
    ).drop("_lo", "_hi")


def stretch_percentiles(cells: DataFrame, value: str = "z", low: float = 0.02, high: float = 0.98, out: str = "level") -> DataFrame:
    """Clip to two percentiles of the raster and scale to 0..255 (rounded half up)."""
    ends = quantiles(cells, ["raster_id"], value, [low, high], ["_lo", "_hi"])
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span > 1e-6, (F.col(value) - F.col("_lo")) / span).otherwise(F.col(value))
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)))
    return cells.join(ends, "raster_id").withColumn(out, F.floor(clipped * 255 + 0.5).cast("int")).drop("_lo", "_hi")


def thin_grid(cells: DataFrame, step: int) -> DataFrame:
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def thin_track(df: DataFrame, axis: Axis, step: int, valid: Column) -> DataFrame:
    """Every ``step``-th valid sample of each track."""
    return o.positions(df.where(valid), axis, "_k").where(F.col("_k") % step == 0).drop("_k")


def track_ends(df: DataFrame, axis: Axis, columns: Sequence[str]) -> DataFrame:
    box = F.struct(*columns)
    return df.groupBy(*axis.keys).agg(
        F.min_by(box, axis.position()).alias("start"), F.max_by(box, axis.position()).alias("end"))


def lowest_corner_bearing(cells: DataFrame, georef: DataFrame, default: float = -60.0) -> DataFrame:
    """Bearing in degrees from the raster's middle to its lowest corner."""
    corners = cells.join(georef, "raster_id").where(
        ((F.col("row") == 0) | (F.col("row") == F.col("h") - 1)) & ((F.col("col") == 0) | (F.col("col") == F.col("w") - 1))
        & F.col("z").isNotNull())
    low = corners.groupBy("raster_id").agg(F.min_by(F.struct("row", "col"), F.struct("z", "row", "col")).alias("_at"))
    angled = georef.join(low, "raster_id", "left")
    dx = F.col("a") * (F.col("_at.col") - (F.col("w") - 1) / 2)
    dy = F.col("e") * (F.col("_at.row") - (F.col("h") - 1) / 2)
    angle = F.when((dx == 0) & (dy == 0), F.lit(None)).otherwise(F.degrees(F.atan2(dy, dx)))
    return angled.select("raster_id", F.coalesce(angle, F.lit(float(default))).alias("bearing"))


def slope_coverage(df: DataFrame, keys: Sequence[str], column: str = "dem_grad_e") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.avg(F.col(column).isNotNull().cast("double")).alias("valid_share"))
