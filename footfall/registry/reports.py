"""J: report queries."""

from pyspark.sql import functions as F

from footfall.functions import quaternions as qf
from footfall.operators import alignment as al, raster as ra, reports as rp
from footfall.registry import fixtures as fx
from footfall.registry.alignment import DIST_SQL
from footfall.registry.base import query, r, rounded
from footfall.registry.filters import average_sql
from footfall.registry.fixtures import GEO_AXIS, GRID_AXIS, STREAM_AXIS, sql
from footfall.registry.orientation import KEY, PI, VIEWS, WRAP, tilted
from footfall.registry.raster import ENU_SQL, PLANE, PV, points
from footfall.session import materialize

PIXEL_SQL = 'SELECT "row", col, avg(v) val FROM celled WHERE "row" BETWEEN 0 AND 47 AND col BETWEEN 0 AND 47 AND v IS NOT NULL GROUP BY 1, 2'


@query("J1_mean_per_pixel", sql(f'SELECT "row", col, {r("val")} FROM ({PIXEL_SQL})', "fx_cells", **PV))
def _(spark, sf):
    return rounded(rp.mean_per_pixel(points(spark, sf), "v"), ["row", "col"], ["val"])


@query("J2_colour_limits", sql(
    f"SELECT 'dem' raster_id, round(min(val), 6) + 0.0 vmin, round(quantile_cont(val, 0.95), 6) + 0.0 vmax FROM ({PIXEL_SQL})", "fx_cells", **PV))
def _(spark, sf):
    limits = rp.colour_limits(rp.mean_per_pixel(points(spark, sf), "v"), ["raster_id"], "val", 95.0, from_zero=False)
    return rounded(limits, ["raster_id"], ["vmin", "vmax"])


SEGMENT_SQL = """SELECT mission, label, metric, seq, dist_m - first_value(dist_m) OVER w dist_rel, CASE WHEN metric = 'tau_a' THEN value - first_value(value IGNORE NULLS)
    OVER (PARTITION BY mission, label, metric ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE value END value
    FROM (SELECT d.mission, q.label, q.metric, t, seq, dist_m, CASE q.metric WHEN 'vx' THEN vx_s ELSE tau_a END AS value FROM (
      SELECT *, avg(vx) OVER (PARTITION BY mission ORDER BY t, seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) vx_s FROM ({dist})) d
      JOIN ({requests}) q ON q.mission = d.mission AND dist_m BETWEEN start_m AND start_m + length_m)
    WINDOW w AS (PARTITION BY mission, label, metric ORDER BY t, seq)"""


def _segments(name, requests_sql, requests):
    @query(name, sql("SELECT mission, label, metric, seq, " + r("dist_rel", "value") + " FROM ("
                     + SEGMENT_SQL.format(dist=DIST_SQL, requests=requests_sql) + ")", "fx_motion"))
    def _(spark, sf):
        walked = materialize(al.add_distance(fx.motion(spark, sf), STREAM_AXIS))
        out = rp.distance_segments(walked, STREAM_AXIS, requests(walked), {
            "vx": {"type": "moving_average", "window": 3}, "tau_a": {"type": "none"}}, ["tau_a"])
        return rounded(out, ["mission", "label", "metric", "seq"], ["dist_rel", "value"])


_segments(
    "J3_distance_segment", "SELECT DISTINCT mission, 'all' AS label, 'vx' AS metric, 200.0::DOUBLE start_m, 500.0::DOUBLE length_m FROM fx_motion",
    lambda d: d.select("mission").distinct().select("mission", F.lit("all").alias("label"), F.lit("vx").alias("metric"),
                                                    F.lit(200.0).alias("start_m"), F.lit(500.0).alias("length_m")))
_segments(
    "J4_mission_comparison",
    """SELECT DISTINCT mission, CASE WHEN mission % 2 = 0 THEN 'first' ELSE 'second' END AS label, CASE WHEN mission % 2 = 0 THEN 'vx' ELSE 'tau_a' END AS metric,
       CASE WHEN mission % 2 = 0 THEN 100.0::DOUBLE ELSE 300.0::DOUBLE END start_m, 400.0::DOUBLE length_m FROM fx_motion""",
    lambda d: d.select("mission").distinct().select(
        "mission", F.when(F.col("mission") % 2 == 0, "first").otherwise("second").alias("label"),
        F.when(F.col("mission") % 2 == 0, "vx").otherwise("tau_a").alias("metric"),
        F.when(F.col("mission") % 2 == 0, 100.0).otherwise(300.0).alias("start_m"), F.lit(400.0).alias("length_m")))

SPEC_SQL = """SELECT CASE WHEN id % 3 = 0 THEN folder WHEN id % 3 = 1 THEN name ELSE CAST(id AS VARCHAR) END || ':' || CASE WHEN id % 4 = 0 THEN '' ELSE CAST(id % 90 AS VARCHAR) END
    || ':' || CASE WHEN id % 5 = 0 THEN '' ELSE CAST(id % 70 AS VARCHAR) END spec FROM fx_catalog"""


@query("J5_time_windows", sql(
    """SELECT c.id, CASE WHEN s > e THEN e ELSE s END start_s, CASE WHEN s > e THEN s ELSE e END end_s FROM fx_catalog c JOIN (SELECT id,
    CAST(nullif(split_part(spec, ':', 2), '') AS DOUBLE) s, CAST(nullif(split_part(spec, ':', 3), '') AS DOUBLE) e FROM (
    SELECT m.id, min_by(spec, {'k': CASE spec_key WHEN CAST(m.id AS VARCHAR) THEN 1 WHEN m.folder THEN 2 ELSE 3 END, 's': spec}) spec FROM fx_catalog m
    JOIN (SELECT spec, split_part(spec, ':', 1) spec_key FROM specs) p ON spec_key IN (CAST(m.id AS VARCHAR), m.folder, m.name) GROUP BY 1)) w ON w.id = c.id""",
    "fx_catalog", specs=SPEC_SQL))
def _(spark, sf):
    entries = fx.catalog(spark, sf)
    n = F.col("id")
    key = F.when(n % 3 == 0, F.col("folder")).when(n % 3 == 1, F.col("name")).otherwise(n.cast("string"))
    side = lambda skip, mod: F.when(n % skip == 0, "").otherwise((n % mod).cast("string"))
    specs = entries.select(F.concat_ws(":", key, side(4, 90), side(5, 70)).alias("spec"))
    missions = entries.select("id", F.lit(None).cast("string").alias("arg"), "folder", F.col("name").alias("display"))
    return rp.resolve_windows(rp.parse_windows(specs), missions)


FOCUS_SQL = """SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY mission) any_in FROM (SELECT *, t_rel BETWEEN {lo} AND {hi} inside FROM (
    SELECT *, t - min(t) OVER (PARTITION BY mission) t_rel FROM {source}))) WHERE inside OR NOT any_in"""
LO, HI = "864000.0 + mission * 20000.0", "1728000.0 + mission * 20000.0"


@query("J6_cumulative_series", sql(
    f"""SELECT mission, seq, round(t_rel - first_value(t_rel) OVER w, 6) + 0.0 t_rel, round(v_cmd_x - first_value(v_cmd_x IGNORE NULLS) OVER w, 6) + 0.0 v_cmd_x,
    round(tau_a - first_value(tau_a IGNORE NULLS) OVER w, 6) + 0.0 tau_a FROM ({FOCUS_SQL.format(lo=LO, hi=HI, source='fx_motion')})
    WINDOW w AS (PARTITION BY mission ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "fx_motion"))
def _(spark, sf):
    shift = F.col("mission") * 20000.0
    out = rp.cumulative_series(fx.motion(spark, sf), STREAM_AXIS, ["v_cmd_x", "tau_a"], 864000.0 + shift, 1728000.0 + shift)
    return rounded(out, ["mission", "seq"], ["t_rel", "v_cmd_x", "tau_a"])


@query("J7_missing_metrics", sql(
    """SELECT metric, mission FROM (SELECT mission, unnest(['a', 'b', 'vx']) metric, unnest([count(CASE WHEN v > 150 THEN v END), count(CASE WHEN stream = 'error' AND v > 60 THEN v END), count(v)]) n
    FROM fx_stream GROUP BY 1) WHERE n = 0""", "fx_stream"))
def _(spark, sf):
    rows = fx.stream(spark, sf).select("mission", F.when(F.col("v") > 150, F.col("v")).alias("a"),
                                       F.when((F.col("stream") == "error") & (F.col("v") > 60), F.col("v")).alias("b"),
                                       F.col("v").alias("vx"), F.lit(None).cast("double").alias("nowhere"))
    return rp.missing_metrics(rows, ["a", "b", "vx", "nowhere"])


def _slope_sql(c):
    return (f"CASE WHEN lag({c}) OVER w IS NOT NULL AND lead({c}) OVER w IS NOT NULL THEN (lead({c}) OVER w - lag({c}) OVER w) / 2 "
            f"ELSE coalesce(lead({c}) OVER w - {c}, {c} - lag({c}) OVER w) END")


PATH_SQL = f"""SELECT mission, i, dx, dy, (l_orderkey % 63) / 10.0::DOUBLE - 3.1 heading, sqrt(dx**2 + dy**2) path_speed FROM (
    SELECT *, {_slope_sql('enu_x')} dx, {_slope_sql('enu_y')} dy FROM ({ENU_SQL}) WINDOW w AS (PARTITION BY mission ORDER BY i))"""


def _path(spark, sf):
    rows = fx.geo(spark, sf).withColumn("heading", (F.col("l_orderkey") % 63) / 10.0 - 3.1).drop("v", "l_orderkey")
    return rp.path_motion(rows, GEO_AXIS, 20.0)


@query("J8_path_motion", sql(
    f"SELECT mission, i, path_speed >= 20.0 AS moving, round(atan2(dy, dx), 4) + 0.0 path_yaw, round(path_speed, 4) + 0.0 path_speed FROM ({PATH_SQL})", "fx_geo"))
def _(spark, sf):
    return rounded(_path(spark, sf), ["mission", "i", "moving"], ["path_yaw", "path_speed"], 4)


TURNED_SQL = f"""SELECT mission, i, heading, path_speed >= 20.0 AS moving, rot, atan2(CASE rot WHEN 0 THEN dy WHEN 90 THEN dx WHEN 180 THEN -dy ELSE -dx END + 0.0,
    CASE rot WHEN 0 THEN dx WHEN 90 THEN -dy WHEN 180 THEN -dx ELSE dy END + 0.0) yaw FROM ({PATH_SQL}), (VALUES (0), (90), (180), (270)) q(rot)"""
W = "(PARTITION BY mission, rot ORDER BY i)"
BEST_SQL = f"""SELECT mission, rot, sqrt(avg(({WRAP.format(a='(heading - s)')})**2)) rmse, count(*) n FROM (SELECT *, {WRAP.format(a='m')} s FROM (
    SELECT *, avg(flat) OVER (PARTITION BY mission, rot ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM (
    SELECT *, yaw + sum(CASE WHEN d IS NULL OR abs(d) < {PI} THEN 0 ELSE (CASE WHEN k = -{PI} AND d > 0 THEN {PI} ELSE k END) - d END)
      OVER (PARTITION BY mission, rot ORDER BY i ROWS UNBOUNDED PRECEDING) flat
    FROM (SELECT *, {WRAP.format(a='d')} k FROM (SELECT *, yaw - lag(yaw) OVER {W} d FROM ({TURNED_SQL}))))))
    WHERE moving GROUP BY 1, 2"""


@query("J9_best_quarter_turn", sql(
    f"""SELECT mission, CASE WHEN n >= 10 THEN rot END rot, CASE WHEN n >= 10 THEN rmse END rmse, coalesce(n, 0) n_moving
    FROM (SELECT DISTINCT mission FROM fx_geo) LEFT JOIN (
    SELECT mission, min_by(rot, {{'e': rmse, 'r': rot}}) rot, round(min(rmse), 4) + 0.0 rmse, max(n) n FROM ({BEST_SQL}) GROUP BY 1) USING (mission)""", "fx_geo"))
def _(spark, sf):
    best = rp.best_quarter_turn(_path(spark, sf), GEO_AXIS, mean_rows=5)
    return rounded(best, ["mission", "rot", "n_moving"], ["rmse"], 4)


@query("J10_difference_histogram", sql(
    """SELECT mission, "limit", bins, bin, n, round(mean, 6) + 0.0 mean, round(std, 6) + 0.0 std FROM (SELECT mission, lim AS "limit", bins, mean, std,
    CAST(least(floor((d + lim) / (2 * lim) * bins), bins - 1) AS BIGINT) bin, count(*) n FROM (SELECT mission, tau_b * 1.7 AS d FROM fx_motion WHERE tau_b IS NOT NULL)
    JOIN (SELECT mission, avg(d) mean, stddev_pop(d) std, 5.0::DOUBLE * ceil(max(abs(d)) / 5.0) lim, CAST(greatest(20, least(120, floor(2 * 5.0 * ceil(max(abs(d)) / 5.0)))) AS BIGINT) bins
    FROM (SELECT mission, tau_b * 1.7 AS d FROM fx_motion) GROUP BY 1) USING (mission) GROUP BY ALL)""", "fx_motion"))
def _(spark, sf):
    rows = fx.motion(spark, sf).select("mission", (F.col("tau_b") * 1.7).alias("d"))
    return rounded(rp.difference_histogram(rows, ["mission"], "d"), ["mission", "limit", "bins", "bin", "n"], ["mean", "std"])


@query("J11_rmse_and_bias", sql(
    "SELECT mission, round(sqrt(avg((vx - v_cmd_x)**2)), 6) + 0.0 rmse, round(avg(vx - v_cmd_x), 6) + 0.0 bias FROM fx_motion GROUP BY 1", "fx_motion"))
def _(spark, sf):
    return rounded(rp.rmse_and_bias(fx.motion(spark, sf), ["mission"], "vx", "v_cmd_x"), ["mission"], ["rmse", "bias"])


@query("J12_display_smoothing", sql(
    f"SELECT a.mission, a.i, round(a.x, 6) + 0.0 x, round(avg(t_h) OVER (PARTITION BY a.mission ORDER BY t_h ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 u "
    f"FROM ({average_sql('SELECT * FROM fx_grid')}) a", "fx_grid"))
def _(spark, sf):
    rows = fx.grid(spark, sf).withColumn("u", F.col("t_h"))
    return rounded(rp.smooth_columns(rows, GRID_AXIS, ["x", "u"], 5), ["mission", "i"], ["x", "u"])


@query("J13_time_to_distance", sql(
    """SELECT q.mission, q.seq, round(coalesce(b.d + (a.d - b.d) * (q.t - b.t) / nullif(a.t - b.t, 0), b.d, a.d), 6) + 0.0 v FROM ask q
    ASOF LEFT JOIN path b ON b.mission = q.mission AND q.t >= b.t ASOF LEFT JOIN path a ON a.mission = q.mission AND q.t <= a.t""",
    "fx_stream", ask="SELECT mission, seq, t FROM fx_stream WHERE stream <> 'click'",
    path="SELECT mission, t, max(v) OVER (PARTITION BY mission ORDER BY t, seq ROWS UNBOUNDED PRECEDING) d FROM fx_stream WHERE stream = 'click'"))
def _(spark, sf):
    rows = fx.stream(spark, sf)
    asked = rows.where("stream <> 'click'").select("mission", "seq", "t")
    path = rows.where("stream = 'click'").select("mission", "seq", "t", "v")
    return rounded(rp.time_to_distance(asked, path, STREAM_AXIS, "v"), ["mission", "seq"], ["v"])


@query("J14_paired_frames", sql(
    """SELECT p.mission, p.seq, coalesce(s.seq, f.seq) secondary_frame FROM (SELECT * FROM (SELECT *, t - min(t) OVER (PARTITION BY mission) rel FROM fx_stream WHERE stream = 'view')
    WHERE rel BETWEEN 86400 AND 1728000) p ASOF LEFT JOIN (SELECT * FROM fx_stream WHERE stream = 'purchase') s ON s.mission = p.mission AND p.t >= s.t
    LEFT JOIN (SELECT mission, min_by(seq, t) seq FROM fx_stream WHERE stream = 'purchase' GROUP BY 1) f ON f.mission = p.mission""", "fx_stream"))
def _(spark, sf):
    rows = fx.stream(spark, sf)
    secondary = rows.where("stream = 'purchase'").select("mission", "t", F.col("seq").alias("frame"))
    primary = rows.where("stream = 'view'").select("mission", "seq", "t")
    return rp.paired_frames(primary, secondary, fx.Axis(("mission",), "t", fx.CHUNK_SECONDS), 86400.0, 1728000.0).select("mission", "seq", "secondary_frame")


@query("J15_focus_window", sql(
    f"SELECT mission, seq, {r('t_rel')} FROM ({FOCUS_SQL.format(lo='1500000.0 + mission * 30000.0', hi='1600000.0 + mission * 30000.0', source='fx_stream')})", "fx_stream"))
def _(spark, sf):
    shift = F.col("mission") * 30000.0
    out = rp.focus_window(fx.stream(spark, sf), STREAM_AXIS, 1600000.0 + shift, 1500000.0 + shift)  # reversed on purpose
    return rounded(out, ["mission", "seq"], ["t_rel"])


@query("J16_time_normalisation", sql(
    """SELECT user_id mission, event_id seq, (epoch_us(ts) - min(epoch_us(ts)) OVER w) * 1000 ts_ns, epoch_us(ts) * 1000 - min(epoch_us(ts) * 1000) OVER w int_ns,
    CAST(round_even(value * 1e9, 0) AS BIGINT) - min(CAST(round_even(value * 1e9, 0) AS BIGINT)) OVER w float_ns FROM events WINDOW w AS (PARTITION BY user_id)"""))
def _(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("mission"), F.col("event_id").alias("seq"), "ts", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"), "value")
    out = rp.normalise_time(rp.normalise_time(rp.normalise_time(rows, "ts", ["mission"], "ts_ns"), "ns", ["mission"], "int_ns"), "value", ["mission"], "float_ns")
    return out.select("mission", "seq", "ts_ns", "int_ns", "float_ns")


@query("J17_orientation_comparison", sql(
    """SELECT mission, seq, round(degrees(atan2(r21, r22)), 6) + 0.0 roll, round(-degrees(asin(greatest(-1, least(1, -r20)))), 6) + 0.0 pitch,
    round(-degrees(atan2(r10, r00)), 6) + 0.0 yaw, round(-degrees(atan2(2*qw_WB*qz_WB, 1-2*qz_WB*qz_WB)), 6) + 0.0 yaw_map FROM mat JOIN fx_motion USING (mission, seq)""",
    "fx_motion", **VIEWS))
def _(spark, sf):
    rows = tilted(spark, sf)
    own = qf.rpy_degrees(qf.canonical(qf.quat()), flip=True)
    mapped = qf.rpy_degrees(qf.canonical(qf.quat(suffix="_WB")), flip=True)
    out = rows.select(*KEY, *[c.alias(n) for c, n in zip((*own, mapped[2]), ("roll", "pitch", "yaw", "yaw_map"))])
    return rounded(out, KEY, ["roll", "pitch", "yaw", "yaw_map"])


@query("J18_slope_coverage", sql(
    """SELECT mission, count(*) samples, round(avg(CASE WHEN dem_grad_e IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 valid_share
    FROM celled LEFT JOIN plane USING ("row", col) GROUP BY 1""", "fx_cells", **PLANE))
def _(spark, sf):
    out = ra.slope_coverage(ra.plane_slopes(points(spark, sf), fx.cells(spark, sf)), ["mission"])
    return rounded(out, ["mission", "samples"], ["valid_share"])
