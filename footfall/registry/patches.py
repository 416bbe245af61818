"""H: the patch dataset. The event log's motion is cut into 20 m patches every 100 m of path."""

from pyspark.sql import functions as F

from footfall.operators import alignment as al, metrics as me, ordered as o, patches as pa
from footfall.operators.ordered import Axis
from footfall.operators.orientation import WORLD_BASE_BLOCK
from footfall.registry import fixtures as fx
from footfall.registry.alignment import DIST_SQL
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import STREAM_AXIS, sql
from footfall.registry.metrics import CFG
from footfall.session import materialize

SIZE, STRIDE = 20.0, 100.0
SEGMENT_AXIS = Axis(("mission", "segment_id"), "t", fx.CHUNK_SECONDS, ("seq",))
PATCH = ["mission", "patch_id"]

RANGES_SQL = """SELECT mission, range_id, start_s, end_s FROM (SELECT DISTINCT mission FROM fx_stream WHERE mission % 3 = 0),
    (VALUES (0, 86400.0::DOUBLE, 864000.0::DOUBLE), (1, 777600.0::DOUBLE, 1728000.0::DOUBLE)) v(range_id, start_s, end_s)"""
SELECTED_SQL = """SELECT mission, seq, t, t - min(t) OVER (PARTITION BY mission) + coalesce(base, 0) t_rel FROM (
    SELECT s.*, CASE WHEN g.start_s IS NOT NULL THEN 86400.0 END base FROM (SELECT *, t - min(t) OVER (PARTITION BY mission) since
    FROM fx_stream) s LEFT JOIN ranges g ON g.mission = s.mission WHERE g.start_s IS NULL OR since BETWEEN g.start_s AND g.end_s)"""


def _ranges(spark, sf):
    """Two overlapping ranges for every third recording."""
    missions = fx.stream(spark, sf).select("mission").distinct().where("mission % 3 = 0")
    pairs = F.array(*[F.struct(F.lit(k).alias("range_id"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s"))
                      for k, (a, b) in enumerate([(86400.0, 864000.0), (777600.0, 1728000.0)])])
    return missions.select("mission", F.inline(pairs))


@query("H1_time_ranges", sql(f"SELECT mission, seq, {r('t_rel')} FROM ({SELECTED_SQL})", "fx_stream", ranges=RANGES_SQL))
def _(spark, sf):
    return rounded(pa.select_ranges(fx.stream(spark, sf), _ranges(spark, sf)), ["mission", "seq"], ["t_rel"])


@query("H2_segments", sql(
    f"""SELECT s.mission, s.seq, coalesce(g.range_id, 0) segment_id FROM ({SELECTED_SQL}) s LEFT JOIN ranges g ON g.mission = s.mission
        WHERE g.start_s IS NULL OR t_rel BETWEEN g.start_s AND g.end_s""", "fx_stream", ranges=RANGES_SQL))
def _(spark, sf):
    ranges = _ranges(spark, sf)
    return pa.cut_segments(pa.select_ranges(fx.stream(spark, sf), ranges), ranges).select("mission", "seq", "segment_id")


PLACE = ["mission", "segment_id", "t", "seq", "x", "y"]
SUMMARY = ["power", "v_cmd", "v_actual", *WORLD_BASE_BLOCK]
COST = ["power", "v_cmd", "w_cmd_z"]


def _walked(spark, sf, *robot):
    """The walk with those columns of the robot that are asked for: rows travel packed, so nothing else is taken along."""
    rows = al.planar_speeds(fx.motion(spark, sf)).withColumn("segment_id", F.lit(0))
    rows = me.compute(rows, ["power", "power_mech"], CFG, STREAM_AXIS).select(*PLACE, *robot)
    rows = al.add_distance(rows, STREAM_AXIS).drop("dist_m_per_step")
    return materialize(pa.travelled(rows, SEGMENT_AXIS, ["x", "y"]))


RUN_SQL = f"""SELECT *, sqrt(v_cmd_x**2 + v_cmd_y**2) v_cmd, sqrt(vx**2 + vy**2) v_actual,
    coalesce(abs(tau_a * qd_a), 0) + coalesce(abs(tau_b * qd_b), 0) + 0.4::DOUBLE / (0.1::DOUBLE ** 2 * 7.0::DOUBLE ** 2)
      * (coalesce(tau_a * tau_a, 0) + coalesce(tau_b * tau_b, 0)) AS power,
    max(dist_m) OVER (PARTITION BY mission ORDER BY t, seq ROWS UNBOUNDED PRECEDING)
    - first_value(dist_m) OVER (PARTITION BY mission ORDER BY t, seq) dist_run FROM ({DIST_SQL})"""
CENTER_STEPS = """SELECT mission, min(dist_run) d FROM run GROUP BY 1 UNION ALL
    SELECT c.mission, min(run.dist_run) FROM c JOIN run ON run.mission = c.mission WHERE run.dist_run >= c.d + 100.0 GROUP BY c.mission"""
CENTERS_SQL = """SELECT mission, seq, t, x center_e, y center_n, d center_dist, row_number() OVER (PARTITION BY mission ORDER BY d) patch_id
    FROM (SELECT run.*, c.d, row_number() OVER (PARTITION BY c.mission, c.d ORDER BY run.t, run.seq) k FROM c
    JOIN run ON run.mission = c.mission AND run.dist_run = c.d) WHERE k = 1"""
MEMBERS_SQL = """SELECT run.*, patch_id FROM run JOIN centers ON run.mission = centers.mission
    AND abs(run.x - center_e) <= 10.0 AND abs(run.y - center_n) <= 10.0"""
BASE = dict(run=RUN_SQL, c=CENTER_STEPS, centers=CENTERS_SQL)
WITH_MEMBERS = dict(**BASE, members=MEMBERS_SQL)


def psql(body, **more):
    return sql(body, "fx_motion", recursive=True, **WITH_MEMBERS, **more)


def _centers(walked):
    """Centres with an id in path order; the few centres of a path are numbered by their distance rank."""
    found = materialize(pa.patch_centers(walked.select(*PLACE, "dist_run"), SEGMENT_AXIS, STRIDE))
    named = found.withColumns({"center_e": F.col("x"), "center_n": F.col("y")})
    line = Axis(("mission", "segment_id"), "center_dist", STRIDE * pa.CENTRES_PER_CHUNK)
    return materialize(o.positions(named, line, "patch_id").withColumn("patch_id", F.col("patch_id") + 1))


def _members(spark, sf, *robot):
    walked = _walked(spark, sf, *robot)
    centers = _centers(walked)
    return materialize(pa.members_in_square(walked, centers, ["mission", "segment_id"], SIZE, "x", "y").drop("x", "y", "dist_run"))


@query("H3_running_distance", sql(f"SELECT mission, seq, {r('dist_run')} FROM run", "fx_motion", run=RUN_SQL))
def _(spark, sf):
    return rounded(_walked(spark, sf), ["mission", "seq"], ["dist_run"])


@query("H4_patch_centers", psql(f"SELECT mission, seq, patch_id, {r('center_dist', 'center_e', 'center_n')} FROM centers"))
def _(spark, sf):
    return rounded(_centers(_walked(spark, sf)), ["mission", "seq", "patch_id"], ["center_dist", "center_e", "center_n"])


@query("H5_square_members", psql("SELECT mission, patch_id, seq FROM members"))
def _(spark, sf):
    return _members(spark, sf).select(*PATCH, "seq")


@query("H6_distance_members", psql(
    "SELECT run.mission, patch_id, run.seq FROM run JOIN centers ON run.mission = centers.mission AND abs(dist_run - center_dist) <= 10.0 + 1e-6"))
def _(spark, sf):
    walked = _walked(spark, sf)
    return pa.members_in_distance(walked.select("mission", "segment_id", "t", "seq", "dist_run"), _centers(walked), ["mission", "segment_id"], SIZE).select(*PATCH, "seq")


# ---- terrain: one window per supplier and line number ----
WINDOWS_SQL = """SELECT *, CAST(round_even((24.0 - center_n) / 0.5, 0) AS INTEGER) r, CAST(round_even(center_e / 0.5, 0) AS INTEGER) c
    FROM (SELECT l_suppkey mission, l_linenumber patch_id, (sum(l_orderkey) % 480) / 20.0::DOUBLE center_e,
    (sum(l_partkey) % 480) / 20.0::DOUBLE center_n FROM lineitem GROUP BY 1, 2)"""
IN_SQL = "SELECT *, r - 5 >= 0 AND c - 5 >= 0 AND r + 5 < 48 AND c + 5 < 48 AS inside FROM windows"
CELLS_SQL = """SELECT i.mission, i.patch_id, CAST(z.col - i.c AS DOUBLE) x, CAST(z."row" - i.r AS DOUBLE) y, z.z FROM ins i JOIN fx_cells z
    ON abs(z."row" - i.r) <= 5 AND abs(z.col - i.c) <= 5 WHERE inside AND z.z IS NOT NULL"""
TERRAIN = dict(windows=WINDOWS_SQL, ins=IN_SQL, wcells=CELLS_SQL)
TERMS = [(2, 0), (0, 2), (1, 1), (1, 0), (0, 1), (0, 0)]


def _elimination():
    """Normal equations of the quadratic fit solved by elimination, one subquery per pivot."""
    monomial = ["*".join(["1.0::DOUBLE"] + ["x"] * i + ["y"] * j) for i, j in TERMS]
    cells = [f"sum({monomial[a]}*{monomial[b]}) m{a}_{b}" for a in range(6) for b in range(6)]
    cells += [f"sum({monomial[a]}*z) m{a}_6" for a in range(6)]
    q = f"SELECT mission, patch_id, {', '.join(cells)} FROM wcells GROUP BY 1, 2"
    for k in range(6):
        out = [f"m{a}_{b}" + (f" - m{a}_{k} / m{k}_{k} * m{k}_{b}" if a != k else "") + f" AS m{a}_{b}"
               for a in range(6) for b in range(7)]
        q = f"SELECT mission, patch_id, {', '.join(out)} FROM ({q})"
    solved = [f"m{a}_6 / m{a}_{a} AS s{a}" for a in range(6)]
    return f"SELECT mission, patch_id, {', '.join(solved)} FROM ({q})"


QUAD_SQL = f"""SELECT mission, patch_id, s0/0.25 quad_xx, s1/0.25 quad_yy, s2/-0.25 quad_xy, s3/0.5 quad_x, s4/-0.5 quad_y, s5 quad_0
    FROM ({_elimination()})"""
QUAD = ["quad_xx", "quad_yy", "quad_xy", "quad_x", "quad_y", "quad_0"]


def _windows(spark, sf):
    centers = fx.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("mission"), F.col("l_linenumber").alias("patch_id")).agg(
        (F.sum("l_orderkey") % 480 / 20.0).alias("center_e"), (F.sum("l_partkey") % 480 / 20.0).alias("center_n"),
    ).withColumn("raster_id", F.lit("dem"))
    return pa.terrain_windows(centers, fx.cells(spark, sf), fx.georef(spark, sf), ["mission"], 5.0)


def tsql(body, **more):
    return sql(body, "fx_cells", **TERRAIN, **more)


@query("H7_terrain_window", tsql(
    """SELECT mission, patch_id, inside, CASE WHEN inside THEN round((SELECT count(*) FROM wcells w WHERE w.mission = ins.mission
       AND w.patch_id = ins.patch_id) / 121.0, 6) + 0.0 END height_valid_fraction, 5.5::DOUBLE patch_side_m_actual FROM ins"""))
def _(spark, sf):
    return rounded(_windows(spark, sf), [*PATCH, "inside"], ["height_valid_fraction", "patch_side_m_actual"])


PLANE = ["slope_e", "slope_n", "slope_mag", "grad_orientation"]


@query("H8_plane_fit", tsql(
    f"""SELECT mission, patch_id, {r(*PLANE)} FROM (SELECT *, sqrt(slope_e**2 + slope_n**2) slope_mag, atan2(slope_n, slope_e) grad_orientation
    FROM (SELECT mission, patch_id, (covar_pop(x, z)*var_pop(y) - covar_pop(y, z)*covar_pop(x, y)) / (var_pop(x)*var_pop(y) - covar_pop(x, y)**2) / 0.5 slope_e,
    (covar_pop(y, z)*var_pop(x) - covar_pop(x, z)*covar_pop(x, y)) / (var_pop(x)*var_pop(y) - covar_pop(x, y)**2) / -0.5 slope_n
    FROM ins LEFT JOIN wcells USING (mission, patch_id) GROUP BY 1, 2))"""))
def _(spark, sf):
    return rounded(_windows(spark, sf), PATCH, PLANE)


@query("H9_quadratic_fit", tsql(
    f"SELECT mission, patch_id, {r(*QUAD)} FROM ins LEFT JOIN quad USING (mission, patch_id)", quad=QUAD_SQL))
def _(spark, sf):
    return rounded(_windows(spark, sf), PATCH, QUAD)


CURVES = ["curvature_mean", "k1", "k2", "curvature_abs"]
CURVE_SQL = """SELECT *, abs(k1) + abs(k2) curvature_abs FROM (SELECT *, h + sqrt(greatest(h*h - g, 0)) k1, h - sqrt(greatest(h*h - g, 0)) k2, h curvature_mean FROM (
    SELECT *, ((1+ey*ey)*xx - 2*ex*ey*xy + (1+ex*ex)*yy) / (2*(1+ex*ex+ey*ey)**1.5) h, (xx*yy - xy*xy) / (1+ex*ex+ey*ey)**2 g FROM (
    SELECT *, 2*quad_xx xx, 2*quad_yy yy, quad_xy xy, quad_x ex, quad_y ey FROM ins LEFT JOIN quad USING (mission, patch_id))))"""


@query("H10_curvatures", tsql(f"SELECT mission, patch_id, {r(*CURVES)} FROM ({CURVE_SQL})", quad=QUAD_SQL))
def _(spark, sf):
    return rounded(_windows(spark, sf), PATCH, CURVES)


@query("H11_heading_curvatures", tsql(
    f"""SELECT mission, patch_id, round(n / d, 6) + 0.0 curvature_heading, round(n2 / d2, 6) + 0.0 curvature_cross_heading FROM (SELECT *,
    (xx*u*u + 2*xy*u*v + yy*v*v) / sqrt(1+ex*ex+ey*ey) n, (1+ex*ex)*u*u + 2*ex*ey*u*v + (1+ey*ey)*v*v d,
    (xx*v*v - 2*xy*u*v + yy*u*u) / sqrt(1+ex*ex+ey*ey) n2, (1+ex*ex)*v*v - 2*ex*ey*u*v + (1+ey*ey)*u*u d2 FROM (
    SELECT *, cos(patch_id * 0.7::DOUBLE) u, sin(patch_id * 0.7::DOUBLE) v FROM ({CURVE_SQL})))""", quad=QUAD_SQL))
def _(spark, sf):
    headed = _windows(spark, sf).withColumn("heading_yaw_rad", F.col("patch_id") * F.lit(0.7))
    return rounded(pa.add_heading_curvatures(headed), PATCH, ["curvature_heading", "curvature_cross_heading"])


# ---- robot ----
def stats_sql(value, name, digits=6, shown="round({}, {})"):
    mean, low, high = (shown.format(v, digits) for v in (f"avg({value})", f"quantile_cont({value}, 0.05)", f"quantile_cont({value}, 0.95)"))
    return f"{mean} + 0.0 AS {name}_mean, {low} + 0.0 AS {name}_min, {high} + 0.0 AS {name}_max"


def stat_names(*names):
    return [f"{n}_{s}" for n in names for s in ("mean", "min", "max")]


@query("H12_robust_summary", sql(
    f"SELECT mission, {stats_sql('vx', 'vx')}, {stats_sql('tau_a', 'tau_a')} FROM fx_motion GROUP BY 1", "fx_motion"))
def _(spark, sf):
    out = pa.robust_summary(fx.motion(spark, sf), ["mission"], {c: F.col(c) for c in ("vx", "tau_a")})
    return rounded(out, ["mission"], stat_names("vx", "tau_a"))


SPAN = ["t_start", "t_end", "time_span_s", "distance_traveled_m"]
SPAN_SQL = ("count(*) samples, round(min(t), 4) + 0.0 t_start, round(max(t), 4) + 0.0 t_end, round(max(t) - min(t), 4) + 0.0 time_span_s, "
            "round(max(dist_m) - min(dist_m), 4) + 0.0 distance_traveled_m")
SIGN = ("SELECT * REPLACE (uw AS qw_WB, uz AS qz_WB), CASE WHEN uw * first_value(uw) OVER o + uz * first_value(uz) OVER o < -1e-12 THEN -1 ELSE 1 END sg "
        "FROM (SELECT *, qw_WB / n uw, qz_WB / n uz FROM (SELECT *, sqrt(qw_WB * qw_WB + qz_WB * qz_WB) n FROM members)) WINDOW o AS (PARTITION BY mission, patch_id ORDER BY t, seq)")
_LENGTH = "sqrt(avg(sg*qw_WB)**2 + avg(sg*qz_WB)**2)"
# a mean at a right angle to the axis, to rounding, keeps the side of its first row
BEARING = ", ".join(f"round(CASE WHEN avg(sg*qw_WB) / {_LENGTH} < -1e-12 THEN -1 ELSE 1 END * avg(sg*q{n}_WB) / {_LENGTH}, 4) + 0.0 bearing_q{n}" for n in "wz")


STEADY = 9  # digits kept before the last rounding, so that a figure at half a unit does not follow the order of its sum
# DuckDB rounds a double by multiplying it, which leaves half a unit (0.5005) to chance; its digits as a decimal go up, as in the query
DECIMAL_SQL = "CAST(CAST(CAST(CAST({} AS VARCHAR) AS DECIMAL(38, {})) AS VARCHAR) AS DOUBLE)"
STEADY_SQL = DECIMAL_SQL.format(DECIMAL_SQL.format("{}", STEADY), "{}")


@query("H13_robot_summary", psql(
    f"SELECT mission, patch_id, {SPAN_SQL}, {stats_sql('power', 'metric_power', 3, STEADY_SQL)}, {stats_sql('v_actual', 'speed', 4, STEADY_SQL)}, "
    f"{stats_sql('v_cmd', 'v_cmd', 4, STEADY_SQL)}, "
    f"{BEARING} FROM ({SIGN}) GROUP BY 1, 2"))
def _(spark, sf):
    out = pa.robot_summary(_members(spark, sf, *SUMMARY), PATCH, ["power"], "t", ("seq",))
    out = out.withColumns({n: F.round(n, STEADY) for n in stat_names("metric_power", "speed", "v_cmd")})
    power = [(F.round(n, 3) + F.lit(0.0)).alias(n) for n in stat_names("metric_power")]
    return rounded(out, [*PATCH, "samples", *power], [*SPAN, *stat_names("speed", "v_cmd"), "bearing_qw", "bearing_qz"], 4)


def wide(mask, pad):
    return (f"max(CASE WHEN {mask} THEN 1 ELSE 0 END) OVER (PARTITION BY mission, patch_id ORDER BY t "
            f"RANGE BETWEEN {pad}::DOUBLE PRECEDING AND {pad}::DOUBLE FOLLOWING) = 1")


COT_SQL = f"""SELECT mission, patch_id,
    CASE WHEN sum(CASE WHEN ok AND pok THEN step END) > 0 THEN coalesce(sum(CASE WHEN ok AND pok THEN power * dt END), 0)
      / (30.0::DOUBLE * 9.81::DOUBLE * sum(CASE WHEN ok AND pok THEN step END)) END cot_patch,
    CASE WHEN sum(CASE WHEN core AND pcore THEN step END) > 0 THEN coalesce(sum(CASE WHEN core AND pcore THEN power * dt END), 0)
      / (30.0::DOUBLE * 9.81::DOUBLE * sum(CASE WHEN core AND pcore THEN step END)) END cot_patch_p95
  FROM (SELECT *, lag(ok) OVER w pok, lag(core) OVER w pcore, greatest(coalesce(t - lag(t) OVER w, 0), 0) dt,
      greatest(coalesce(dist_m - lag(dist_m) OVER w, 0), 0) step FROM (
    SELECT b.*, coalesce(ok AND power >= lo AND power <= hi, false) core FROM (SELECT *, good AND NOT {wide('coalesce(v_cmd < 0.2, false)', 7200.0)}
        AND NOT {wide('coalesce(good AND abs(w_cmd_z) >= 0.4 AND v_cmd < 0.3, false)', 10800.0)} ok
      FROM (SELECT *, power IS NOT NULL AND dist_m IS NOT NULL AND v_cmd IS NOT NULL good FROM members)) b
    LEFT JOIN (SELECT mission, patch_id, quantile_cont(power, 0.05) lo, quantile_cont(power, 0.95) hi FROM (
      SELECT *, good AND NOT {wide('coalesce(v_cmd < 0.2, false)', 7200.0)} AND NOT {wide('coalesce(good AND abs(w_cmd_z) >= 0.4 AND v_cmd < 0.3, false)', 10800.0)} ok
      FROM (SELECT *, power IS NOT NULL AND dist_m IS NOT NULL AND v_cmd IS NOT NULL good FROM members)) WHERE ok GROUP BY 1, 2) e
    USING (mission, patch_id)) WINDOW w AS (PARTITION BY mission, patch_id ORDER BY t, seq)) GROUP BY 1, 2"""
MEMBER_AXIS = Axis(("mission", "patch_id"), "t", fx.CHUNK_SECONDS, ("seq",))


@query("H14_patch_cost_of_transport", psql(f"SELECT mission, patch_id, {r('cot_patch', digits=4)} FROM ({COT_SQL})"))
def _(spark, sf):
    return rounded(pa.patch_cost_of_transport(_members(spark, sf, *COST), MEMBER_AXIS, CFG), PATCH, ["cot_patch"], 4)


@query("H15_trimmed_cost_of_transport", psql(f"SELECT mission, patch_id, {r('cot_patch_p95', digits=4)} FROM ({COT_SQL})"))
def _(spark, sf):
    return rounded(pa.patch_cost_of_transport(_members(spark, sf, *COST), MEMBER_AXIS, CFG), PATCH, ["cot_patch_p95"], 4)


@query("H16_patch_mask_dilation", psql(
    f"SELECT mission, patch_id, seq, {wide('coalesce(v_cmd < 0.2, false)', 7200.0)} AS idle FROM members"))
def _(spark, sf):
    rows = _members(spark, sf, "v_cmd").withColumn("idle", F.coalesce(F.col("v_cmd") < 0.2, F.lit(False)))
    return me.dilate(rows, MEMBER_AXIS, {"idle": 7200.0}).select(*PATCH, "seq", "idle")


ACCEPT = "samples < 5 OR coalesce(distance_traveled_m < 18.0, false)"
PER_PATCH = "SELECT mission, patch_id, count(*) samples, max(dist_m) - min(dist_m) distance_traveled_m, min(t) t_start, max(t) t_end FROM members GROUP BY 1, 2"


@query("H17_acceptance", psql(f"SELECT mission, patch_id, {ACCEPT} AS rejected FROM per_patch", per_patch=PER_PATCH))
def _(spark, sf):
    spans = _members(spark, sf).groupBy(*PATCH).agg(
        F.count("*").alias("samples"), (F.max("dist_m") - F.min("dist_m")).alias("walked"))
    return spans.select(*PATCH, pa.robot_reason(F.col("samples"), F.col("walked"), 5, SIZE).alias("rejected"))


# ---- reductions: overlapping squares and spans derived from the event log ----
PATCHES_SQL = """SELECT mission, patch_index, center_e, center_n, t_start, t_start + 86400.0 + (seq % 4) * 43200.0 t_end FROM (
    SELECT mission, seq, row_number() OVER (PARTITION BY mission ORDER BY t, seq) - 1 patch_index, (seq % 7) * 2.5::DOUBLE center_e,
    (seq % 5) * 2.5::DOUBLE center_n, floor(t / 86400) * 86400.0::DOUBLE - (seq % 3) * 43200.0::DOUBLE t_start FROM fx_stream)"""


def _squares(spark, sf):
    indexed = o.positions(fx.stream(spark, sf), STREAM_AXIS, "patch_index")
    start = F.floor(F.col("t") / 86400) * 86400.0 - (F.col("seq") % 3) * 43200.0
    return indexed.select(
        "mission", "patch_index", ((F.col("seq") % 7) * 2.5).alias("center_e"), ((F.col("seq") % 5) * 2.5).alias("center_n"),
        start.alias("t_start"), (start + 86400.0 + (F.col("seq") % 4) * 43200.0).alias("t_end"))


DEDUP_SQL = """SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY mission, round_even(center_e, 3), round_even(center_n, 3),
    round_even(t_start, 3), round_even(t_end, 3) ORDER BY patch_index) = 1"""
ORDERED_SQL = "SELECT *, row_number() OVER (PARTITION BY mission ORDER BY patch_index) k, {{'e': center_e, 'n': center_n, 'a': t_start, 'b': t_end}} p FROM {source}"
SPACE_TIME = "abs(o.e - {p}.e) <= {half} AND abs(o.n - {p}.n) <= {half} AND {p}.a >= o.a AND {p}.b <= o.b"
TIME_ONLY = "{p}.a >= o.a - 1e-3 AND {p}.b <= o.b + 1e-3"


def greedy_steps(walk, ordered, rule):
    """Sequential pass over one recording's patches carrying the list of kept ones."""
    return f"""SELECT mission, patch_index, k, true keep, [p] kept FROM {ordered} WHERE k = 1 UNION ALL
      SELECT n.mission, n.patch_index, n.k, len(list_filter(w.kept, lambda o: {rule.format(p='n.p', half=2.5)})) = 0,
        CASE WHEN len(list_filter(w.kept, lambda o: {rule.format(p='n.p', half=2.5)})) = 0 THEN list_append(w.kept, n.p) ELSE w.kept END
      FROM {walk} w JOIN {ordered} n ON n.mission = w.mission AND n.k = w.k + 1"""


@query("H18_exact_duplicates", sql(f"SELECT mission, patch_index FROM ({DEDUP_SQL.format(source='patches')})", "fx_stream", patches=PATCHES_SQL))
def _(spark, sf):
    return pa.drop_exact_duplicates(_squares(spark, sf)).select("mission", "patch_index")


@query("H19_contained_patches", sql(
    "SELECT mission, patch_index FROM walk WHERE keep", "fx_stream", recursive=True, patches=PATCHES_SQL,
    ordered=ORDERED_SQL.format(source="patches").replace("{{", "{").replace("}}", "}"), walk=greedy_steps("walk", "ordered", SPACE_TIME)))
def _(spark, sf):
    return pa.drop_contained(_squares(spark, sf), 5.0).select("mission", "patch_index")


@query("H19_time_subsets", sql(
    "SELECT mission, patch_index FROM walk WHERE keep", "fx_stream", recursive=True, patches=PATCHES_SQL,
    ordered=ORDERED_SQL.format(source="patches").replace("{{", "{").replace("}}", "}"), walk=greedy_steps("walk", "ordered", TIME_ONLY)))
def _(spark, sf):
    return pa.drop_time_subsets(_squares(spark, sf)).select("mission", "patch_index")


# ---- assembly ----
def assembly(raster):
    half = SIZE / 2
    terrain = """SELECT c.mission, c.patch_id, r - 10 >= 0 AND q - 10 >= 0 AND r + 10 < 48 AND q + 10 < 48 inside, (SELECT count(*) FROM fx_cells z WHERE
        z.z IS NOT NULL AND abs(z."row" - r) <= 10 AND abs(z.col - q) <= 10) / 441.0 share FROM (SELECT *,
        CAST(round_even(48.0 - center_n, 0) AS INTEGER) r, CAST(round_even(center_e, 0) AS INTEGER) q FROM centers) c"""
    if not raster:
        terrain = "SELECT mission, patch_id, true inside, NULL::DOUBLE share FROM centers"
    parts = dict(
        per_patch=PER_PATCH, terrain=terrain,
        judged=f"""SELECT c.*, samples, t_start, t_end, CASE WHEN NOT inside THEN 'edges' WHEN share < 0.6 THEN 'height'
          WHEN samples IS NULL OR {ACCEPT} THEN 'robot' END reason FROM centers c JOIN terrain USING (mission, patch_id)
          LEFT JOIN per_patch USING (mission, patch_id)""",
        accepted="SELECT *, row_number() OVER (PARTITION BY mission ORDER BY center_dist) - 1 patch_index FROM judged WHERE reason IS NULL",
        uniq=DEDUP_SQL.format(source="accepted"))
    for name, source, rule in (("a", "uniq", SPACE_TIME), ("b", "apart", TIME_ONLY)):
        parts[f"ordered_{name}"] = ORDERED_SQL.format(source=source).replace("{{", "{").replace("}}", "}")
        parts[f"walk_{name}"] = greedy_steps(f"walk_{name}", f"ordered_{name}", rule).replace("2.5", str(half))
        target = "apart" if name == "a" else "final"
        parts[target] = f"SELECT s.* FROM {source} s JOIN walk_{name} k USING (mission, patch_index) WHERE keep"
    return parts


def asql(body, raster):
    return sql(body, "fx_motion", "fx_cells", recursive=True, **WITH_MEMBERS, **assembly(raster))


def _terrain(spark, sf):
    """Cells and their georeference: one metre cells, as the motion spans about 50 m."""
    return fx.cells(spark, sf), fx.georef(spark, sf).withColumns({"a": F.lit(1.0), "e": F.lit(-1.0), "f": F.lit(48.0)})


def _built(spark, sf, raster):
    walked = _walked(spark, sf, *SUMMARY, "w_cmd_z")
    centers = _centers(walked).withColumn("raster_id", F.lit("dem"))
    return pa.build_patches(walked, centers, SEGMENT_AXIS, CFG, SIZE, STRIDE, "x", "y", ["power"], *(_terrain(spark, sf) if raster else ()))


@query("H20_skip_accounting", asql(
    """SELECT mission, reason, count(*) patches FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2
       UNION ALL SELECT mission, 'dupes', count(*) FROM accepted ANTI JOIN uniq USING (mission, patch_index) GROUP BY 1
       UNION ALL SELECT mission, 'contained', count(*) FROM uniq ANTI JOIN apart USING (mission, patch_index) GROUP BY 1
       UNION ALL SELECT mission, 'time_subset', count(*) FROM apart ANTI JOIN final USING (mission, patch_index) GROUP BY 1""", True))
def _(spark, sf):
    walked = _walked(spark, sf)
    centers = _centers(walked).withColumn("raster_id", F.lit("dem"))
    return pa.cut_patches(walked, centers, SEGMENT_AXIS, SIZE, STRIDE, "x", "y", *_terrain(spark, sf))[1]


def _final(name, raster):
    @query(name, asql(f"SELECT mission, patch_index, samples, {r('center_e', 'center_n', 't_start', 't_end')} FROM final", raster))
    def _(spark, sf):
        return rounded(_built(spark, sf, raster)[0], ["mission", "patch_index", "samples"], ["center_e", "center_n", "t_start", "t_end"])


_final("H21_patch_table", True)
_final("H22_patch_table_without_raster", False)
