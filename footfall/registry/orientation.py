"""F: orientation and angles."""

import math

from pyspark.sql import functions as F

from footfall.functions import angles as an, quaternions as qf
from footfall.operators import frames as fr, orientation as ori
from footfall.registry import fixtures as fx
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import STREAM_AXIS, sql

KEY = ["mission", "seq"]
PI = "3.141592653589793::DOUBLE"
# a second, tilted orientation per row, so that all four components take part
TILT_SQL = """SELECT mission, seq, t, cos(a) * cos(b) qw, cos(a) * sin(b) qx, sin(a) * sin(b) qy, sin(a) * cos(b) qz,
    vx, vy, v_cmd_x FROM (SELECT *, seq % 180 * 0.02::DOUBLE a, seq % 50 * 0.01::DOUBLE b FROM fx_motion)"""


def tilted(spark, sf):
    a, b = F.col("seq") % 180 * F.lit(0.02), F.col("seq") % 50 * F.lit(0.01)
    return fx.motion(spark, sf).select(
        *KEY, "t", (F.cos(a) * F.cos(b)).alias("qw"), (F.cos(a) * F.sin(b)).alias("qx"),
        (F.sin(a) * F.sin(b)).alias("qy"), (F.sin(a) * F.cos(b)).alias("qz"), "vx", "vy", "v_cmd_x",
        "qw_WB", "qx_WB", "qy_WB", "qz_WB")


def product_sql(p, q):
    (pw, px, py, pz), (qw, qx, qy, qz) = p, q
    return (f"({pw}*{qw} - {px}*{qx} - {py}*{qy} - {pz}*{qz})", f"({pw}*{qx} + {px}*{qw} + {py}*{qz} - {pz}*{qy})",
            f"({pw}*{qy} - {px}*{qz} + {py}*{qw} + {pz}*{qx})", f"({pw}*{qz} + {px}*{qy} - {py}*{qx} + {pz}*{qw})")


OWN = ("qw", "qx", "qy", "qz")
OUT = ["ow", "ox", "oy", "oz"]


def named(q, names=OUT):
    return [c.alias(n) for c, n in zip(q, names)]


@query("F1_quaternion_product", sql(
    "SELECT mission, seq, " + ", ".join(
        f"round({e} / n, 6) + 0.0 AS {o}" for e, o in zip(product_sql(("a.qw", "a.qx", "a.qy", "a.qz"),
                                                              ("m.qw_WB", "(-m.qx_WB)", "(-m.qy_WB)", "(-m.qz_WB)")), OUT))
    + " FROM (SELECT *, sqrt(qw**2+qx**2+qy**2+qz**2) n FROM tilt) a JOIN fx_motion m USING (mission, seq)",
    "fx_motion", tilt=TILT_SQL))
def _(spark, sf):
    q = qf.normalize(qf.multiply(qf.quat(), qf.conjugate(qf.quat(suffix="_WB"))))
    return rounded(tilted(spark, sf).select(*KEY, *named(q)), KEY, OUT)


# half angles of roll 180, pitch 0, yaw 0 leave only x; a general mounting exercises all terms
MOUNT = (10.0, 20.0, 30.0)


def _mount_sql():
    (cr, sr), (cp, sp), (cy, sy) = [(math.cos(math.radians(a) / 2), math.sin(math.radians(a) / 2)) for a in MOUNT]
    zyx = ((cy, 0, 0, sy), (cp, 0, sp, 0), (cr, sr, 0, 0))
    lit = [tuple(f"({v!r}::DOUBLE)" for v in q) for q in zyx]
    return product_sql(product_sql(lit[0], lit[1]), lit[2])


@query("F2_rpy_to_quaternion", sql(
    "SELECT mission, seq, " + ", ".join(
        f"round({e}, 6) + 0.0 AS {o}" for e, o in zip(product_sql(OWN, _mount_sql()), OUT)) + " FROM tilt",
    "fx_motion", tilt=TILT_SQL))
def _(spark, sf):
    mount = qf.constant(qf.rotation_constant({"rpy_deg": MOUNT}))
    return rounded(tilted(spark, sf).select(*KEY, *named(qf.multiply(qf.quat(), mount))), KEY, OUT)


@query("F3_rotation_offset", sql(
    "SELECT mission, seq, " + ", ".join(f"round(CASE WHEN pw < 0 THEN -p{n} ELSE p{n} END / n, 6) + 0.0 AS o{n}" for n in "wxyz")
    + " FROM (SELECT *, sqrt(pw**2+px**2+py**2+pz**2) n FROM (SELECT mission, seq, " + ", ".join(
        f"{e} AS p{n}" for e, n in zip(product_sql(OWN, tuple(
            e if k == 0 else f"(-{e})" for k, e in enumerate(_mount_sql()))), "wxyz")) + " FROM tilt))",
    "fx_motion", tilt=TILT_SQL))
def _(spark, sf):
    q = qf.apply_offset(qf.quat(), qf.constant(qf.rotation_constant({"rpy_deg": MOUNT})))
    return rounded(tilted(spark, sf).select(*KEY, *named(q)), KEY, OUT)


# rotation matrix columns of the unit quaternion, used by several SQL counterparts
MATRIX_SQL = """SELECT *, 1-2*(y*y+z*z) r00, 2*(x*y-w*z) r01, 2*(x*y+w*z) r10, 1-2*(x*x+z*z) r11, 2*(x*z-w*y) r20, 2*(y*z+w*x) r21, 1-2*(x*x+y*y) r22
    FROM (SELECT *, qw/n w, qx/n x, qy/n y, qz/n z FROM (SELECT *, sqrt(qw**2+qx**2+qy**2+qz**2) n FROM tilt))"""
VIEWS = dict(tilt=TILT_SQL, mat=MATRIX_SQL)


@query("F4_rotate_vector", sql(
    "SELECT mission, seq, round(r00*vx + r01*vy, 6) + 0.0 east, round(r10*vx + r11*vy, 6) + 0.0 north, "
    "round(r20*vx + r21*vy, 6) + 0.0 up FROM mat", "fx_motion", **VIEWS))
def _(spark, sf):
    v = qf.rotate(qf.normalize(qf.quat()), (F.col("vx"), F.col("vy"), F.lit(0.0)))
    return rounded(tilted(spark, sf).select(*KEY, *named(v, ["east", "north", "up"])), KEY, ["east", "north", "up"])


@query("F5_heading", sql("SELECT mission, seq, round(atan2(r10, r00), 6) + 0.0 heading FROM mat", "fx_motion", **VIEWS))
def _(spark, sf):
    return rounded(tilted(spark, sf).withColumn("heading", qf.heading(qf.quat())), KEY, ["heading"])


@query("F6_euler_zyx", sql(
    "SELECT mission, seq, round(-degrees(atan2(r10, r00)), 6) + 0.0 yaw, round(-degrees(atan2(-r20, "
    "greatest(sqrt(r00*r00 + r10*r10), 1e-12))), 6) + 0.0 pitch, round(degrees(atan2(r21, r22)), 6) + 0.0 roll FROM mat",
    "fx_motion", **VIEWS))
def _(spark, sf):
    angles = qf.euler_zyx_degrees(qf.quat(), yaw_sign=-1.0, pitch_sign=-1.0)
    names = ["yaw", "pitch", "roll"]
    return rounded(tilted(spark, sf).select(*KEY, *named(angles, names)), KEY, names)


@query("F7_roll_pitch_yaw", sql(
    "SELECT mission, seq, round(degrees(atan2(r21, r22)), 6) + 0.0 roll, round(-degrees(asin(greatest(-1, least(1, -r20)))), 6) "
    "+ 0.0 pitch, round(-degrees(atan2(r10, r00)), 6) + 0.0 yaw FROM mat", "fx_motion", **VIEWS))
def _(spark, sf):
    names = ["roll", "pitch", "yaw"]
    angles = qf.rpy_degrees(qf.quat(), flip=True)
    return rounded(tilted(spark, sf).select(*KEY, *named(angles, names)), KEY, names)


@query("F8_tilt", sql(
    "SELECT mission, seq, round(degrees(asin(greatest(-1, least(1, r20)))), 6) + 0.0 pitch, "
    "round(degrees(asin(greatest(-1, least(1, r21)))), 6) + 0.0 roll FROM mat", "fx_motion", **VIEWS))
def _(spark, sf):
    names = ["pitch", "roll"]
    return rounded(tilted(spark, sf).select(*KEY, *named(qf.tilt_degrees(qf.quat()), names)), KEY, names)


AVG_SQL = """SELECT mission, avg(s*w) mw, avg(s*x) mx, avg(s*y) my, avg(s*z) mz FROM (
    SELECT *, CASE WHEN w*first_value(w) OVER o + x*first_value(x) OVER o + y*first_value(y) OVER o + z*first_value(z) OVER o
      < -1e-12 THEN -1.0 ELSE 1.0 END s FROM (SELECT mission, seq, t, qw/n w, qx/n x, qy/n y, qz/n z FROM (
      SELECT *, sqrt(qw**2+qx**2+qy**2+qz**2) n FROM tilt)) WINDOW o AS (PARTITION BY mission ORDER BY t, seq)) GROUP BY 1"""


@query("F9_average_quaternion", sql(
    "SELECT mission, " + ", ".join(
        f"round(CASE WHEN mw < 0 THEN -m{n} ELSE m{n} END / sqrt(mw**2+mx**2+my**2+mz**2), 6) + 0.0 AS o{n}" for n in "wxyz")
    + f" FROM ({AVG_SQL})", "fx_motion", tilt=TILT_SQL))
def _(spark, sf):
    rows = tilted(spark, sf).drop("qw_WB", "qx_WB", "qy_WB", "qz_WB")
    return rounded(ori.average_quaternion(rows, ["mission"], ["t", "seq"], OUT), ["mission"], OUT)


YAW_SQL = "SELECT mission, seq, t, atan2(r10, r00) yaw, vx FROM mat"
WRAP = f"(({{a}} + {PI}) - floor(({{a}} + {PI}) / (2*{PI})) * (2*{PI}) - {PI})"
UNWRAP_SQL = f"""SELECT *, yaw + sum(CASE WHEN d IS NULL OR abs(d) < {PI} THEN 0 ELSE
      (CASE WHEN k = -{PI} AND d > 0 THEN {PI} ELSE k END) - d END) OVER (PARTITION BY mission ORDER BY t, seq
      ROWS UNBOUNDED PRECEDING) flat FROM (SELECT *, {WRAP.format(a='d')} k FROM (
      SELECT *, yaw - lag(yaw) OVER (PARTITION BY mission ORDER BY t, seq) d FROM ({YAW_SQL})))"""


def _yaw(spark, sf):
    return tilted(spark, sf).select(*KEY, "t", qf.heading(qf.quat()).alias("yaw"), "vx")


@query("F14_wrap", sql(f"SELECT mission, seq, round({WRAP.format(a='3 * yaw')}, 6) + 0.0 wrapped FROM ({YAW_SQL})",
                       "fx_motion", **VIEWS))
def _(spark, sf):
    return rounded(_yaw(spark, sf).withColumn("wrapped", an.wrap_pi(3 * F.col("yaw"))), KEY, ["wrapped"])


@query("F15_unwrap", sql(
    "SELECT mission, seq, round(flat, 6) + 0.0 flat, round(flat + (0.5 - first_value(yaw) OVER (PARTITION BY mission "
    f"ORDER BY t, seq)), 6) + 0.0 anchored FROM ({UNWRAP_SQL})", "fx_motion", **VIEWS))
def _(spark, sf):
    flat = ori.unwrap(_yaw(spark, sf), STREAM_AXIS, "yaw", "flat")
    return rounded(ori.unwrap(flat, STREAM_AXIS, "yaw", "anchored", origin=0.5), KEY, ["flat", "anchored"])


SMOOTH_SQL = f"""SELECT mission, seq, yaw, {WRAP.format(a='s')} smooth FROM (SELECT *, avg(m) OVER (PARTITION BY mission
    ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) s FROM (SELECT *, quantile_cont(flat, 0.5) OVER (
    PARTITION BY mission ORDER BY t, seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) m FROM ({UNWRAP_SQL})))"""


@query("F16_angle_smoothing", sql(f"SELECT mission, seq, {r('smooth')} FROM ({SMOOTH_SQL})", "fx_motion", **VIEWS))
def _(spark, sf):
    return rounded(ori.smooth_angle(_yaw(spark, sf), STREAM_AXIS, "yaw", "smooth", 3, 5), KEY, ["smooth"])


@query("F17_circular_rmse", sql(
    f"SELECT mission, round(sqrt(avg(({WRAP.format(a='(yaw - vx)')}) ** 2)), 6) + 0.0 rmse FROM ({YAW_SQL}) GROUP BY 1",
    "fx_motion", **VIEWS))
def _(spark, sf):
    yaw = _yaw(spark, sf)
    return rounded(yaw.groupBy("mission").agg(an.circular_rmse(F.col("yaw"), F.col("vx")).alias("rmse")),
                   ["mission"], ["rmse"])


@query("F18_circular_mean", sql(
    f"SELECT mission, round(atan2(avg(sin(yaw)), avg(cos(yaw))), 6) + 0.0 mean_yaw FROM ({YAW_SQL}) GROUP BY 1",
    "fx_motion", **VIEWS))
def _(spark, sf):
    return rounded(_yaw(spark, sf).groupBy("mission").agg(an.circular_mean(F.col("yaw")).alias("mean_yaw")),
                   ["mission"], ["mean_yaw"])


def _compose_sql(source="fx_tf"):
    """World candidates world, odom; base frame base: hops click and view."""
    world = product_sql(tuple(f"cq.{c}" for c in OWN), tuple(f"vq.{c}" for c in OWN))
    pick = ", ".join(
        f"CASE WHEN cq IS NOT NULL THEN {w} ELSE vq.{c} END {c}" for w, c in zip(world, OWN))
    return f"""SELECT mission, seq, t, is_static, k, CASE WHEN cq IS NOT NULL THEN 0 ELSE 1 END world_rank,
      {", ".join(f"CASE WHEN qw < 0 THEN -{c} ELSE {c} END / sqrt(qw**2+qx**2+qy**2+qz**2) {c}" for c in OWN)}
    FROM (SELECT mission, seq, t, is_static, k, cq, {pick} FROM (
      SELECT *, last_value(CASE WHEN child = 'odom' THEN q END IGNORE NULLS) OVER o cq,
        last_value(CASE WHEN child = 'base' THEN q END IGNORE NULLS) OVER o vq,
        row_number() OVER o k FROM (SELECT *, {{'qw': qw, 'qx': qx, 'qy': qy, 'qz': qz}} q FROM {source})
      WINDOW o AS (PARTITION BY mission ORDER BY NOT is_static, t, seq)) WHERE vq IS NOT NULL)"""


THIN_SQL = """SELECT mission, seq, t, qw, qx, qy, qz, k2, qw lw, qx lx, qy ly, qz lz, true kept FROM numbered WHERE k2 = 1
    UNION ALL SELECT mission, seq, t, qw, qx, qy, qz, k2, CASE WHEN same THEN lw ELSE qw END, CASE WHEN same THEN lx ELSE qx END,
      CASE WHEN same THEN ly ELSE qy END, CASE WHEN same THEN lz ELSE qz END, NOT same FROM (
      SELECT n.*, lw, lx, ly, lz, n.is_static OR (abs(n.qw-lw) <= 1e-6+1e-5*abs(lw) AND abs(n.qx-lx) <= 1e-6+1e-5*abs(lx)
        AND abs(n.qy-ly) <= 1e-6+1e-5*abs(ly) AND abs(n.qz-lz) <= 1e-6+1e-5*abs(lz)) OR (abs(n.qw+lw) <= 1e-6+1e-5*abs(lw)
        AND abs(n.qx+lx) <= 1e-6+1e-5*abs(lx) AND abs(n.qy+ly) <= 1e-6+1e-5*abs(ly)
        AND abs(n.qz+lz) <= 1e-6+1e-5*abs(lz)) same
      FROM thin JOIN numbered n ON n.mission = thin.mission AND n.k2 = thin.k2 + 1)"""
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY mission ORDER BY k) k2 FROM composed"
WORLDS = ["world", "odom"]


@query("F11_frame_composition", sql(
    f"SELECT mission, seq, world_rank, {r(*OWN)} FROM composed", "fx_tf", composed=_compose_sql()))
def _(spark, sf):
    out = fr.compose_orientation(fx.transforms(spark, sf), WORLDS, "base", STREAM_AXIS)
    return rounded(out, [*KEY, "world_rank"], list(OWN))


@query("F12_change_thinning", sql(
    f"SELECT mission, seq, {r(*OWN)} FROM thin WHERE kept", "fx_tf", recursive=True,
    composed=_compose_sql(), numbered=NUMBERED, thin=THIN_SQL))
def _(spark, sf):
    out = fr.compose_orientation(fx.transforms(spark, sf), WORLDS, "base", STREAM_AXIS)
    return rounded(fr.thin_changes(out, STREAM_AXIS), KEY, list(OWN))


# on odd missions the static edge is a moving enu_origin -> imu edge instead: only there the wanted world is reachable
MIXED_SQL = """SELECT * REPLACE (CASE WHEN child = 'imu' AND mission % 2 = 1 THEN 'enu_origin' ELSE parent END AS parent,
    is_static AND mission % 2 = 0 AS is_static) FROM fx_tf"""
TURN_SQL = product_sql(OWN, ("0.0", "(-1.0)", "0.0", "0.0"))  # inverse of a half turn about x


@query("F13_orientation_source", sql(
    f"""SELECT p.mission, p.source_rank, {r('p.t', *[f'p.{c}' for c in OWN])}, """ + ", ".join(
        f"round(CASE WHEN n.t IS NULL OR p.t - p.bt <= n.t - p.t THEN p.b{c} ELSE n.{c} END, 6) + 0.0 AS {c}_map" for c in OWN)
    + " FROM (SELECT s.*, b.t bt, " + ", ".join(f"b.{c} b{c}" for c in OWN)
    + " FROM series s ASOF LEFT JOIN kept b ON s.mission = b.mission AND s.t >= b.t) p "
    "ASOF LEFT JOIN kept n ON p.mission = n.mission AND p.t <= n.t",
    "fx_tf", recursive=True, mixed=MIXED_SQL, composed=_compose_sql("mixed"), numbered=NUMBERED, thin=THIN_SQL,
    kept="SELECT * FROM thin WHERE kept",
    around_all="SELECT mission, t, seq, row_number() OVER (PARTITION BY mission ORDER BY t, seq) k2, " + ", ".join(
        f"CASE WHEN qw < 0 THEN -{c} ELSE {c} END {c}" for c in OWN) + ", false is_static FROM (SELECT * FROM (SELECT mission, t, seq, "
        + ", ".join(f"last_value(CASE WHEN child = 'imu' THEN {c} END IGNORE NULLS) OVER (PARTITION BY mission ORDER BY "
                    f"NOT is_static, t, seq) {c}" for c in OWN)
        + " FROM mixed WHERE mission % 2 = 1) WHERE qw IS NOT NULL)",
    around=THIN_SQL.replace("numbered", "around_all").replace("thin", "around"),
    turned="SELECT mission, t, " + ", ".join(f"{e} {c}" for e, c in zip(TURN_SQL, OWN)) + " FROM around WHERE kept",
    series="SELECT mission, t, " + ", ".join(f"CASE WHEN qw < 0 THEN -{c} ELSE {c} END {c}" for c in OWN)
    + ", 1 source_rank FROM turned UNION ALL SELECT mission, t, qw, qx, qy, qz, 0 FROM kept "
      "WHERE mission NOT IN (SELECT mission FROM turned)",
))
def _(spark, sf):
    moving = (F.col("mission") % 2 == 1) & (F.col("child") == "imu")
    mixed = fx.transforms(spark, sf).withColumns({
        "parent": F.when(moving, F.lit("enu_origin")).otherwise(F.col("parent")),
        "is_static": F.col("is_static") & (F.col("mission") % 2 == 0),
    })
    out = fr.orientation_table(mixed, STREAM_AXIS, "base", "enu_origin", ["world"], "imu",
                               qf.rotation_constant({"rpy_deg": [180, 0, 0]}))
    return rounded(out, ["mission", "source_rank"], ["t", *OWN, *[f"{c}_map" for c in OWN]])
