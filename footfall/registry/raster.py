"""G: geometry and raster algebra."""

import numpy as np
from pyspark.sql import functions as F

from footfall.operators import raster as ra
from footfall.registry import fixtures as fx
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import GEO_AXIS, sql

POINTS = """SELECT l_suppkey mission, l_orderkey, l_linenumber, 'dem' raster_id, (l_orderkey % 500) / 20.0::DOUBLE x,
    (l_partkey % 500) / 20.0::DOUBLE y, l_linenumber * 0.7::DOUBLE heading, CAST(l_quantity AS DOUBLE) v FROM lineitem"""
CELLED = """SELECT *, (y - 24.0) / -0.5 row_f, x / 0.5 col_f, CAST(round_even((y - 24.0) / -0.5, 0) AS INTEGER) AS "row",
    CAST(round_even(x / 0.5, 0) AS INTEGER) col FROM points"""
PKEY = ["mission", "l_orderkey", "l_linenumber"]
P = "mission, l_orderkey, l_linenumber"
PV = dict(points=POINTS, celled=CELLED)


def points(spark, sf):
    lines = fx.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS mission", "l_orderkey", "l_linenumber", "'dem' AS raster_id", "(l_orderkey % 500) / 20.0D AS x",
        "(l_partkey % 500) / 20.0D AS y", "l_linenumber * 0.7D AS heading", "CAST(l_quantity AS DOUBLE) AS v")
    return ra.world_to_cell(lines, fx.georef(spark, sf))


# the projection by its textbook logarithms and half-angle tangents; constants of the grid are worked out by the database
EN_SQL = """SELECT *, 2600000 + rad * atan(sin(l) / (sin(b0) * tan(b) + cos(b0) * cos(l))) e,
    1200000 + rad / 2 * ln((1 + cos(b0)*sin(b) - sin(b0)*cos(b)*cos(l)) / (1 - cos(b0)*sin(b) + sin(b0)*cos(b)*cos(l))) n
    FROM (SELECT *, 2 * (atan(exp(al * ln(tan(pi()/4 + phi/2)) - al * ec/2 * ln((1 + ec*sin(phi)) / (1 - ec*sin(phi))) + k)) - pi()/4) b,
        al * (lam - l0) l
    FROM (SELECT *, ln(tan(pi()/4 + b0/2)) - al * ln(tan(pi()/4 + p0/2)) + al * ec/2 * ln((1 + ec*sin(p0)) / (1 - ec*sin(p0))) k,
        atan2(z + e2 / (1 - e2) * bb * pow(sin(th), 3), hyp - e2 * ba * pow(cos(th), 3)) phi, atan2(y, x) lam
    FROM (SELECT *, asin(sin(p0) / al) b0, atan2(z * ba, hyp * bb) th
    FROM (SELECT *, sqrt(x*x + y*y) hyp, sqrt(e2) ec, ba * sqrt(1 - e2) / (1 - e2 * pow(sin(p0), 2)) rad,
        sqrt(1 + e2 / (1 - e2) * pow(cos(p0), 4)) al
    FROM (SELECT *, v * cos(radians(lat)) * cos(radians(lon)) - 674.374 x, v * cos(radians(lat)) * sin(radians(lon)) - 15.056 y,
        v * pow(1 - f, 2) * sin(radians(lat)) - 405.346 z, ba * (1 - bf) bb, bf * (2 - bf) e2,
        radians(46 + 57/60 + 8.66::DOUBLE/3600) p0, radians(7 + 26/60 + 22.5::DOUBLE/3600) l0
    FROM (SELECT *, 6378137.0::DOUBLE / sqrt(1 - f * (2 - f) * pow(sin(radians(lat)), 2)) v
    FROM (SELECT mission, i, lat, lon, 1 / 298.257223563::DOUBLE f, 6377397.155::DOUBLE ba, 1 / 299.1528128::DOUBLE bf FROM fx_geo)))))))"""


@query("G1_map_projection", sql(
    f"SELECT mission, i, round(e, 2) + 0.0 easting_m, round(n, 2) + 0.0 northing_m FROM ({EN_SQL})", "fx_geo"))
def _(spark, sf):
    return rounded(ra.project(fx.geo(spark, sf)), ["mission", "i"], ["easting_m", "northing_m"], 2)


ENU_SQL = """SELECT *, (radians(lon) - radians(lon0)) * cos(radians(lat0)) * 6378137.0 enu_x,
    (radians(lat) - radians(lat0)) * 6378137.0 enu_y FROM (SELECT *, first_value(lat) OVER w lat0, first_value(lon) OVER w lon0
    FROM fx_geo WINDOW w AS (PARTITION BY mission ORDER BY i))"""


@query("G2_local_coordinates", sql(f"SELECT mission, i, {r('enu_x', 'enu_y', digits=4)} FROM ({ENU_SQL})", "fx_geo"))
def _(spark, sf):
    return rounded(ra.local_coordinates(fx.geo(spark, sf), GEO_AXIS), ["mission", "i"], ["enu_x", "enu_y"], 4)


@query("G3_world_to_cell", sql(f'SELECT {P}, "row", col, {r("row_f", "col_f")} FROM celled', **PV))
def _(spark, sf):
    return rounded(points(spark, sf), [*PKEY, "row", "col"], ["row_f", "col_f"])


@query("G4_nearest_sample", sql(
    f'SELECT {P}, CAST(label AS BIGINT) label FROM celled LEFT JOIN fx_cells USING (raster_id, "row", col)', "fx_cells", **PV))
def _(spark, sf):
    return ra.sample_nearest(points(spark, sf), fx.cells(spark, sf)).select(*PKEY, F.col("label").cast("long"))


def bilinear_sql(source, cells, values):
    joins = " ".join(
        f'LEFT JOIN {cells} z{i}{j} ON z{i}{j}."row" = ci + {i} AND z{i}{j}.col = cj + {j}' for i in (0, 1) for j in (0, 1))
    inside = "ci >= 0 AND ci < 47 AND cj >= 0 AND cj < 47"
    columns = ", ".join(
        f"CASE WHEN {inside} THEN z00.{v}*(1-di)*(1-dj) + z10.{v}*di*(1-dj) + z01.{v}*(1-di)*dj + z11.{v}*di*dj END {n}"
        for v, n in values.items())
    return f"""SELECT s.*, {columns} FROM (SELECT *, row_f - ci di, col_f - cj dj FROM (SELECT *, CAST(floor(row_f) AS INTEGER) ci,
        CAST(floor(col_f) AS INTEGER) cj FROM {source})) s {joins}"""


@query("G5_bilinear_sample", sql(
    f"SELECT {P}, {r('height')} FROM ({bilinear_sql('celled', 'fx_cells', {'z': 'height'})})", "fx_cells", **PV))
def _(spark, sf):
    return rounded(ra.sample_bilinear(points(spark, sf), fx.cells(spark, sf), {"z": "height"}), PKEY, ["height"])


def _kernel_sql(half, sigma):
    """Weighted normal equations solved with numpy, independent of the library's pseudo-inverse."""
    rows = []
    w2 = {}
    for dr in range(-half, half + 1):
        for dc in range(-half, half + 1):
            w2[dr, dc] = float(np.exp(-(dr * dr + dc * dc) / (2 * sigma**2)) ** 2)
    sxx = sum(w * dc * dc for (dr, dc), w in w2.items())
    syy = sum(w * dr * dr for (dr, dc), w in w2.items())
    for (dr, dc), w in w2.items():
        rows.append(f"({dr}, {dc}, {w * dc / sxx!r}::DOUBLE, {w * dr / syy!r}::DOUBLE)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) k(dr, dc, p, q)"


PLANE_SQL = """SELECT c."row", c.col, sum(p * z) / 0.5 dem_grad_e, sum(q * z) / -0.5 dem_grad_n FROM
    (SELECT DISTINCT "row", col FROM celled WHERE "row" >= 3 AND "row" < 45 AND col >= 3 AND col < 45) c, kernel k
    JOIN fx_cells z ON z."row" = c."row" + dr AND z.col = c.col + dc GROUP BY 1, 2 HAVING count(z) = 49"""
PLANE = dict(**PV, kernel=_kernel_sql(3, 2.25), plane=PLANE_SQL)


@query("G7_plane_fit_slope", sql(
    f'SELECT {P}, {r("dem_grad_e", "dem_grad_n")} FROM celled LEFT JOIN plane USING ("row", col)', "fx_cells", **PLANE))
def _(spark, sf):
    return rounded(ra.plane_slopes(points(spark, sf), fx.cells(spark, sf)), PKEY, ["dem_grad_e", "dem_grad_n"])


SLOPES = ["dem_slope_long", "dem_slope_lat", "dem_slope_long_deg", "dem_slope_lat_deg"]
HEADED = """SELECT *, degrees(atan(dem_slope_long)) dem_slope_long_deg, degrees(atan(dem_slope_lat)) dem_slope_lat_deg FROM (
    SELECT *, dem_grad_e*cos(heading) + dem_grad_n*sin(heading) dem_slope_long,
    dem_grad_n*cos(heading) - dem_grad_e*sin(heading) dem_slope_lat FROM {source})"""


@query("G8_heading_slopes", sql(
    f"SELECT {P}, {r(*SLOPES)} FROM (" + HEADED.format(source='celled LEFT JOIN plane USING ("row", col)') + ")",
    "fx_cells", **PLANE))
def _(spark, sf):
    return rounded(ra.heading_slopes(ra.plane_slopes(points(spark, sf), fx.cells(spark, sf))), PKEY, SLOPES)


@query("G9_append_columns", sql(
    "SELECT mission, t, round(v_cmd_x, 6) + 0.0 v_cmd_x, round(vx + 1, 6) + 0.0 vx FROM fx_motion", "fx_motion"))
def _(spark, sf):
    motion = fx.motion(spark, sf).select("mission", "t", "v_cmd_x", "vx", F.col("vx").alias("vx_dup"))
    fresh = motion.select("mission", "t", (F.col("vx") + 1).alias("vx"))
    return rounded(ra.replace_columns(motion, fresh, ["mission", "t"]), ["mission", "t"], ["v_cmd_x", "vx"])


GRID_SQL = """SELECT 'dem' raster_id, CAST(g.r AS INTEGER) AS "row", CAST(g.c AS INTEGER) AS col, z FROM (SELECT a.i r, b.i c FROM range(48) a(i), range(48) b(i)) g
    LEFT JOIN fx_cells f ON f."row" = g.r AND f.col = g.c"""


def gradient_sql(second):
    def d(line, across):
        w = f"(PARTITION BY {line} ORDER BY {across})"
        if second:
            first = f"(-3*z + 4*lead(z) OVER {w} - lead(z, 2) OVER {w})/2"
            last = f"(3*z - 4*lag(z) OVER {w} + lag(z, 2) OVER {w})/2"
        else:
            first, last = f"lead(z) OVER {w} - z", f"z - lag(z) OVER {w}"
        return (f"CASE WHEN {across} = 0 THEN {first} WHEN {across} = 47 THEN {last} "
                f"ELSE (lead(z) OVER {w} - lag(z) OVER {w})/2 END")

    return f"""SELECT *, sqrt(grad_e**2 + grad_n**2) grad_mag, atan2(grad_n, grad_e) grad_theta FROM (SELECT raster_id, "row", col, z,
        {d('"row"', 'col')} / 0.5 grad_e, {d('col', '"row"')} / -0.5 grad_n FROM grid)"""


GRADS = ["grad_e", "grad_n", "grad_mag", "grad_theta"]


def _gradient(name, second):
    @query(name, sql(f'SELECT "row", col, {r(*GRADS)} FROM ({gradient_sql(second)})', "fx_cells", grid=GRID_SQL))
    def _(spark, sf):
        out = ra.grid_gradient(fx.cells(spark, sf), fx.georef(spark, sf), second)
        return rounded(out, ["row", "col"], GRADS)


_gradient("G10_gradient_second_order", True)
_gradient("G11_gradient_first_order", False)


@query("G12_slope_by_sampled_gradient", sql(
    f"SELECT {P}, {r(*SLOPES)} FROM (" + HEADED.format(
        source="(" + bilinear_sql("celled", "grad", {"grad_e": "dem_grad_e", "grad_n": "dem_grad_n"}) + ")") + ")",
    "fx_cells", **PV, grid=GRID_SQL, grad=gradient_sql(True)))
def _(spark, sf):
    out = ra.sampled_gradient_slopes(points(spark, sf), fx.cells(spark, sf), fx.georef(spark, sf))
    return rounded(out, PKEY, SLOPES)


CHIP_SQL = f"""SELECT mission, (min(e)+max(e))/2 - 128 min_e, (min(n)+max(n))/2 - 128 min_n, (min(e)+max(e))/2 + 128 max_e,
    (min(n)+max(n))/2 + 128 max_n FROM ({EN_SQL}) GROUP BY 1 HAVING count(*) >= 2"""
BOX = ["min_e", "min_n", "max_e", "max_n"]


@query("G13_track_chip", sql(f"SELECT mission, {r(*BOX, digits=3)} FROM ({CHIP_SQL})", "fx_geo"))
def _(spark, sf):
    return rounded(ra.track_chip(fx.geo(spark, sf), GEO_AXIS, 256.0), ["mission"], BOX, 3)


TILES_SQL = f"""SELECT mission, e_km, unnest(range(CAST(floor(min_n/50) AS BIGINT), CAST(floor((max_n-1e-6)/50) AS BIGINT) + 1)) n_km FROM (
    SELECT *, unnest(range(CAST(floor(min_e/50) AS BIGINT), CAST(floor((max_e-1e-6)/50) AS BIGINT) + 1)) e_km FROM ({CHIP_SQL}))"""


@query("G14_tile_cover", sql(TILES_SQL, "fx_geo"))
def _(spark, sf):
    chips = ra.track_chip(fx.geo(spark, sf), GEO_AXIS, 256.0)
    return ra.tile_cover(chips, 50.0).select("mission", "e_km", "n_km")


YEARS, RESOLUTIONS = [2021, 2024, 2022, 2020], [0.5, 2.0]
COVER_SQL = "SELECT DISTINCT l_partkey % 24 e_km, l_suppkey % 6 n_km FROM lineitem"


@query("G15_tile_version", sql(
    """SELECT c.e_km, c.n_km, CAST("year" AS BIGINT) AS "year", res_m FROM cover c LEFT JOIN (SELECT *, row_number() OVER (
       PARTITION BY e_km, n_km ORDER BY list_position([2021, 2024, 2022, 2020], "year"), list_position([0.5, 2.0]::DOUBLE[], res_m)) k
       FROM fx_tiles WHERE "year" IN (2021, 2024, 2022, 2020)) b ON b.e_km = c.e_km AND b.n_km = c.n_km AND k = 1""",
    "fx_tiles", cover=COVER_SQL))
def _(spark, sf):
    cover = fx.table(spark, sf, "lineitem").selectExpr("l_partkey % 24 AS e_km", "l_suppkey % 6 AS n_km").distinct()
    inventory = fx.tiles(spark, sf).withColumn("year", F.col("year").cast("int"))
    out = ra.choose_tiles(cover, inventory, YEARS, RESOLUTIONS)
    return out.select("e_km", "n_km", F.col("year").cast("long"), "res_m")


SOURCES_SQL = """SELECT 'dem' raster_id, l_linenumber source_rank, l_orderkey % 64 * 0.5 + 0.25 x, l_partkey % 64 * 0.5 + 0.25 y,
    CASE WHEN min(l_quantity) > 20 THEN NULL ELSE avg(l_extendedprice) END z FROM lineitem GROUP BY 1, 2, 3, 4"""
MOSAIC_SQL = """SELECT CAST(floor((28.5 - y) / 0.5) AS INTEGER) AS "row", CAST(floor((x - 3.5) / 0.5) AS INTEGER) col,
    min_by(z, source_rank) z FROM sources WHERE z IS NOT NULL AND y <= 28.5 AND y > 3.5 AND x >= 3.5 AND x < 28.5 GROUP BY 1, 2"""


def _mosaic(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    sources = lines.groupBy(
        F.lit("dem").alias("raster_id"), F.col("l_linenumber").alias("source_rank"),
        ((F.col("l_orderkey") % 64) * 0.5 + 0.25).alias("x"), ((F.col("l_partkey") % 64) * 0.5 + 0.25).alias("y"),
    ).agg(F.when(~(F.min("l_quantity") > 20), F.avg("l_extendedprice")).alias("z"))
    frame = fx.georef(spark, sf).select(
        "raster_id", F.lit(3.5).alias("x0"), F.lit(28.5).alias("y1"), F.lit(0.5).alias("res"), F.lit(50).alias("h"),
        F.lit(50).alias("w"))
    return ra.mosaic(sources, frame), frame


@query("G16_mosaic", sql(f'SELECT "row", col, {r("z", digits=4)} FROM ({MOSAIC_SQL})', sources=SOURCES_SQL))
def _(spark, sf):
    return rounded(_mosaic(spark, sf)[0], ["row", "col"], ["z"], 4)


@query("G16_mosaic_coverage", sql(
    f"SELECT 'dem' raster_id, round(100.0 * count(z) / 2500, 6) + 0.0 coverage_percent FROM ({MOSAIC_SQL})", sources=SOURCES_SQL))
def _(spark, sf):
    return rounded(ra.raster_coverage(*_mosaic(spark, sf)), ["raster_id"], ["coverage_percent"])


@query("G17_minmax_scaling", sql(
    """SELECT "row", col, CASE WHEN z IS NULL OR hi <= lo THEN 0 ELSE CAST(floor((z - lo) / (hi - lo) * 255) AS INTEGER) END gray
       FROM fx_cells, (SELECT min(z) lo, max(z) hi FROM fx_cells)""", "fx_cells"))
def _(spark, sf):
    return ra.scale_minmax(fx.cells(spark, sf)).select("row", "col", "gray")


@query("G18_percentile_stretch", sql(
    """SELECT "row", col, CASE WHEN z IS NOT NULL THEN CAST(floor(greatest(0.0, least(1.0, (z - lo) / (hi - lo))) * 255 + 0.5) AS INTEGER) END AS level
       FROM fx_cells, (SELECT quantile_cont(z, 0.02) lo, quantile_cont(z, 0.98) hi FROM fx_cells)""", "fx_cells"))
def _(spark, sf):
    return ra.stretch_percentiles(fx.cells(spark, sf)).select("row", "col", "level")


@query("G19_thin_grid", sql(
    f'SELECT "row", col, {r("z")} FROM fx_cells WHERE "row" % 3 = 0 AND col % 3 = 0', "fx_cells"))
def _(spark, sf):
    return rounded(ra.thin_grid(fx.cells(spark, sf), 3), ["row", "col"], ["z"])


TRACK_SQL = "SELECT mission, i, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY i) - 1 k FROM fx_geo WHERE v > 10) WHERE k % 7 = 0"


@query("G19_thin_track", sql(f"SELECT mission, i, {r('lat', 'lon')} FROM ({TRACK_SQL})", "fx_geo"))
def _(spark, sf):
    return rounded(ra.thin_track(fx.geo(spark, sf), GEO_AXIS, 7, F.col("v") > 10), ["mission", "i"], ["lat", "lon"])


@query("G19_track_ends", sql(
    "SELECT mission, round(min_by(lat, i), 6) + 0.0 start_lat, round(max_by(lat, i), 6) + 0.0 end_lat FROM fx_geo GROUP BY 1", "fx_geo"))
def _(spark, sf):
    ends = ra.track_ends(fx.geo(spark, sf), GEO_AXIS, ["lat", "lon"])
    return rounded(ends.select("mission", F.col("start.lat").alias("start_lat"), F.col("end.lat").alias("end_lat")),
                   ["mission"], ["start_lat", "end_lat"])


@query("G20_lowest_corner", sql(
    """SELECT 'dem' raster_id, round(degrees(atan2(-0.5 * ("row" - 23.5), 0.5 * (col - 23.5))), 6) + 0.0 bearing FROM fx_cells
       WHERE "row" IN (0, 47) AND col IN (0, 47) AND z IS NOT NULL ORDER BY z LIMIT 1""", "fx_cells"))
def _(spark, sf):
    return rounded(ra.lowest_corner_bearing(fx.cells(spark, sf), fx.georef(spark, sf)), ["raster_id"], ["bearing"])
