"""C: time alignment."""

from pyspark.sql import functions as F

from footfall.functions import quaternions as qf
from footfall.operators import alignment as al
from footfall.registry import fixtures as fx
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import GRID_AXIS, STREAM_AXIS, sql
from footfall.sources.signals import signal_scan

HZ = 1 / 21600.0
TOLERANCE = 10_800.0
LAG = 3_600.0
CLOCK_SQL = """SELECT mission, i, round(t0 + i * 21600.0::DOUBLE, 9) t FROM (
    SELECT mission, t0, unnest(range(0, n + 1)) i FROM (
    SELECT mission, min(t) t0, CAST(floor((max(t) - min(t)) / 21600.0::DOUBLE) AS BIGINT) n
    FROM fx_stream GROUP BY 1))"""


# DuckDB rounds a double by multiplying it, which moves long times by an ulp; a tick at the very time of a sample needs all digits
EXACT_CLOCK_SQL = CLOCK_SQL.replace("round(t0 + i * 21600.0::DOUBLE, 9) t", "CAST(CAST(CAST(CAST(t0 + i * 21600.0::DOUBLE AS VARCHAR) "
                                    "AS DECIMAL(38, 9)) AS VARCHAR) AS DOUBLE) t")


def _clock(spark, sf):
    return al.master_clock([fx.stream(spark, sf)], ["mission"], "t", HZ)


def _one(spark, sf, name):
    """One event type as a clean signal table."""
    rows = fx.stream(spark, sf).where(F.col("stream") == name)
    return signal_scan(rows, STREAM_AXIS.keys, "t", ("seq",)).select("mission", "t", "v")


def _asof_sql(stream, direction, tolerance, shift=0.0, last=""):
    """Left rows of ``clock`` with the chosen value of one stream; ``last`` says which row of a time counts."""
    right = f"""SELECT mission, t + {shift!r}::DOUBLE t, v FROM fx_stream WHERE stream = '{stream}'{last}"""
    before = f"""SELECT c.mission, c.i, c.t, b.t bt, b.v bv FROM clock c ASOF LEFT JOIN ({right}) b
        ON c.mission = b.mission AND c.t >= b.t"""
    both = f"""SELECT x.*, a.t nt, a.v nv FROM ({before}) x ASOF LEFT JOIN ({right}) a
        ON x.mission = a.mission AND x.t <= a.t"""
    pick = {
        "backward": ("bt", "bv"), "forward": ("nt", "nv"),
        "nearest": ("CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bt ELSE nt END",
                    "CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bv ELSE nv END"),
    }[direction]
    near = "" if tolerance is None else f"WHEN abs({pick[0]} - t) > {tolerance!r}::DOUBLE THEN NULL "
    return f"SELECT mission, i, t, CASE {near}WHEN true THEN {pick[1]} END v FROM ({both})"


@query("C1_master_clock", sql(f"SELECT mission, i, {r('t')} FROM clock", "fx_stream", clock=CLOCK_SQL))
def _(spark, sf):
    return rounded(_clock(spark, sf), ["mission", "i"], ["t"])


@query("C2_lag_compensation", sql(f"SELECT mission, seq, round(t + {LAG}, 6) + 0.0 t FROM fx_stream", "fx_stream"))
def _(spark, sf):
    return rounded(al.shift_time(fx.stream(spark, sf), "t", LAG), ["mission", "seq"], ["t"])


LARGEST_SEQ = " QUALIFY row_number() OVER (PARTITION BY mission, t ORDER BY seq DESC) = 1"


def _register_asof(direction):
    exact = direction != "nearest"

    @query(f"C3_asof_{direction}", sql(
        f"SELECT mission, i, {r('t', 'v')} FROM ({_asof_sql('click', direction, TOLERANCE, last=LARGEST_SEQ if exact else '')})",
        "fx_stream", clock=EXACT_CLOCK_SQL if exact else CLOCK_SQL))
    def _(spark, sf):
        joined = al.asof_join(_clock(spark, sf), _one(spark, sf, "click"), STREAM_AXIS, direction, TOLERANCE)
        return rounded(joined, ["mission", "i"], ["t", "v"])


for _direction in ("nearest", "backward", "forward"):
    _register_asof(_direction)

CHAIN = ("click", "view", "purchase", "error")


@query("C4_chained_asof", sql(
    "SELECT c.mission, c.i, " + ", ".join(f"round({s}.v, 6) + 0.0 AS v_{s}" for s in CHAIN) + " FROM clock c "
    + " ".join(f"JOIN ({_asof_sql(s, 'nearest', TOLERANCE, LAG if s == 'click' else 0.0)}) {s} "
               f"ON {s}.mission = c.mission AND {s}.i = c.i" for s in CHAIN),
    "fx_stream", clock=CLOCK_SQL))
def _(spark, sf):
    streams = {}
    for s in CHAIN:
        signal = _one(spark, sf, s)
        if s == "click":
            signal = al.shift_time(signal, "t", LAG)
        streams[s] = al.Stream(signal, {"v": f"v_{s}"}, "nearest", TOLERANCE)
    joined = al.asof_join_all(_clock(spark, sf), streams, STREAM_AXIS)
    return rounded(joined, ["mission", "i"], [f"v_{s}" for s in CHAIN])


@query("C5_block_rename", sql(
    "SELECT mission, seq, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}_map" for c in
                                        ("qw_WB", "qx_WB", "qy_WB", "qz_WB")) + " FROM fx_motion", "fx_motion"))
def _(spark, sf):
    block = ["qw_WB", "qx_WB", "qy_WB", "qz_WB"]
    named = al.rename_block(fx.motion(spark, sf), block, "_map")
    return rounded(named, ["mission", "seq"], [f"{c}_map" for c in block])


@query("C6_quaternion_sign", sql(
    "SELECT mission, seq, " + ", ".join(
        f"round(CASE WHEN qw_WB < 0 THEN -{c}_WB ELSE {c}_WB END, 6) + 0.0 AS {c}" for c in ("qw", "qx", "qy", "qz"))
    + " FROM fx_motion", "fx_motion"))
def _(spark, sf):
    q = qf.canonical(qf.quat(suffix="_WB"))
    df = fx.motion(spark, sf).select("mission", "seq", *[c.alias(f"q{n}") for c, n in zip(q, "wxyz")])
    return rounded(df, ["mission", "seq"], ["qw", "qx", "qy", "qz"])


@query("C7_nearest_without_tolerance", sql(
    f"SELECT mission, i, {r('v')} FROM ({_asof_sql('view', 'nearest', None)})", "fx_stream", clock=CLOCK_SQL))
def _(spark, sf):
    joined = al.asof_join(_clock(spark, sf), _one(spark, sf, "view"), STREAM_AXIS, "nearest")
    return rounded(joined, ["mission", "i"], ["v"])


FILL_SQL = """SELECT mission, i, t_h, CASE WHEN x IS NOT NULL THEN x
      WHEN p - bp <= {n} OR ap - p <= {n} THEN
        CASE WHEN bp IS NULL THEN av WHEN ap IS NULL THEN bv ELSE bv + (av - bv) * (p - bp) / (ap - bp) END END x
    FROM (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER b bp,
        last_value(x IGNORE NULLS) OVER b bv,
        first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER a ap, first_value(x IGNORE NULLS) OVER a av
      FROM (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY t_h) p FROM fx_grid)
      WINDOW b AS (PARTITION BY mission ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY mission ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("C8_bounded_interpolation", sql(
    f"SELECT mission, i, {r('x')} FROM ({FILL_SQL.format(n=1)})", "fx_grid"))
def _(spark, sf):
    return rounded(al.interpolate(fx.grid(spark, sf), GRID_AXIS, ["x"], 1), ["mission", "i"], ["x"])


@query("C9_planar_speeds", sql(
    "SELECT mission, seq, round(sqrt(v_cmd_x**2 + v_cmd_y**2), 6) + 0.0 v_cmd, "
    "round(sqrt(vx**2 + vy**2), 6) + 0.0 v_actual FROM fx_motion", "fx_motion"))
def _(spark, sf):
    return rounded(al.planar_speeds(fx.motion(spark, sf)), ["mission", "seq"], ["v_cmd", "v_actual"])


DIST_SQL = """SELECT *, sum(coalesce(dist_m_per_step, 0)) OVER (PARTITION BY mission ORDER BY t, seq
      ROWS UNBOUNDED PRECEDING) dist_m FROM (
    SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
      ELSE sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) END dist_m_per_step
    FROM fx_motion WINDOW w AS (PARTITION BY mission ORDER BY t, seq))"""


@query("C10_distance_traveled", sql(
    f"SELECT mission, seq, {r('dist_m_per_step', 'dist_m')} FROM ({DIST_SQL})", "fx_motion"))
def _(spark, sf):
    return rounded(al.add_distance(fx.motion(spark, sf), STREAM_AXIS), ["mission", "seq"],
                   ["dist_m_per_step", "dist_m"])


@query("C11_rolling_mean_seconds", sql(
    "SELECT mission, i, round(avg(x) OVER (PARTITION BY mission ORDER BY t_h ROWS BETWEEN 2 PRECEDING AND "
    "1 FOLLOWING), 6) + 0.0 x FROM fx_grid", "fx_grid"))
def _(spark, sf):
    return rounded(al.smooth_seconds(fx.grid(spark, sf), GRID_AXIS, ["x"], 24.0, 6.0), ["mission", "i"], ["x"])


@query("C12_coverage", sql(
    "SELECT mission, round(avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 x, "
    "round(avg(CASE WHEN x IS NOT NULL AND t_h IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 x_and_t "
    "FROM fx_grid GROUP BY 1", "fx_grid"))
def _(spark, sf):
    shares = al.coverage(fx.grid(spark, sf), ["mission"], {"x": ["x"], "x_and_t": ["x", "t_h"], "none": ["roll"]})
    return rounded(shares, ["mission"], ["x", "x_and_t"])


@query("C13_median_step", sql(
    "SELECT mission, round(quantile_cont(d, 0.5), 6) + 0.0 median_dt FROM (SELECT mission, "
    "t - lag(t) OVER (PARTITION BY mission ORDER BY t, seq) d FROM fx_stream) WHERE d IS NOT NULL GROUP BY 1",
    "fx_stream"))
def _(spark, sf):
    return rounded(al.median_step(fx.stream(spark, sf), STREAM_AXIS), ["mission"], ["median_dt"])


@query("C14_relative_axes", sql(
    "SELECT mission, seq, round(t - first_value(t) OVER w, 6) + 0.0 t_rel, "
    "round(coalesce(v_cmd_x, 0) - first_value(coalesce(v_cmd_x, 0)) OVER w, 6) + 0.0 dist_rel "
    "FROM fx_motion WINDOW w AS (PARTITION BY mission ORDER BY t, seq)", "fx_motion"))
def _(spark, sf):
    out = al.relative_axes(fx.motion(spark, sf), STREAM_AXIS, "v_cmd_x")
    return rounded(out, ["mission", "seq"], ["t_rel", "dist_rel"])
