"""E: the metric registry."""

from pyspark.sql import functions as F

from footfall.operators import alignment as al, filters as fl, metrics as me
from footfall.registry import fixtures as fx
from footfall.registry.alignment import DIST_SQL
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import STREAM_AXIS, sql
from footfall.sources.signals import signal_scan

FILTERS = {
    "default": {"type": "none"},
    "power_mech": [{"type": "moving_median", "window": 5}, {"type": "moving_average", "window": 3}],
    "cost_of_transport_speed": [{"type": "hampel", "window": 7, "k": 3.0}, {"type": "moving_average", "window": 3}],
    "cost_of_transport": [{"type": "moving_median", "window": 5}, {"type": "moving_average", "window": 3}],
}
CFG = {
    "params": {
        "max_speed_mps": 1.0, "min_speed_for_power_norm": 0.1, "min_cmd_speed_for_power_norm": 0.2,
        "min_cmd_speed_pad_s": 7200.0, "turn_only_min_w_cmd_z": 0.4, "turn_only_max_v_cmd_for_turn": 0.3,
        "turn_only_pad_s": 10800.0,
    },
    "actuation": {"R": 0.4, "k_t": 0.1, "G": 7.0},
    "robot": {"mass_kg": 30.0, "gravity": 9.81},
    "filters": FILTERS,
}

SPEEDS_SQL = """SELECT *, sqrt(v_cmd_x**2 + v_cmd_y**2) v_cmd, sqrt(vx**2 + vy**2) v_actual,
    coalesce(abs(tau_a * qd_a), 0) + coalesce(abs(tau_b * qd_b), 0) power_mech,
    coalesce(tau_a * qd_a, 0) + coalesce(tau_b * qd_b, 0) power_mech_signed,
    coalesce(abs(qd_a), 0) + coalesce(abs(qd_b), 0) joint_travel_rate_L1,
    coalesce(abs(tau_a), 0) + coalesce(abs(tau_b), 0) torque_L1_rate,
    0.4::DOUBLE / (0.1::DOUBLE ** 2 * 7.0::DOUBLE ** 2)
        * (coalesce(tau_a * tau_a, 0) + coalesce(tau_b * tau_b, 0)) power_joule_heating
    FROM fx_motion"""
ROW_METRICS = {
    "E1_speed_error_abs": ("speed_error_abs", "abs(v_cmd - v_actual)"),
    "E2_speed_error_signed": ("speed_error_signed", "v_cmd - v_actual"),
    "E3_speed_tracking_score": (
        "speed_tracking_score",
        "CASE WHEN v_cmd - v_actual IS NOT NULL THEN greatest(0.0, least(1.0, 1.0 - abs(v_cmd - v_actual) / 1.0)) END"),
    "E4_joint_travel_rate_L1": ("joint_travel_rate_L1", "joint_travel_rate_L1"),
    "E6_torque_L1_rate": ("torque_L1_rate", "torque_L1_rate"),
    "E7_power_mech": ("power_mech", "power_mech"),
    "E8_power_mech_signed": ("power_mech_signed", "power_mech_signed"),
    "E9_power_joule_heating": ("power_joule_heating", "power_joule_heating"),
    "E10_power": ("power", "power_mech + power_joule_heating"),
}


def _row_metric(key, name, expression):
    @query(key, sql(f"SELECT mission, seq, round({expression}, 6) + 0.0 AS {name} FROM speeds",
                    "fx_motion", speeds=SPEEDS_SQL))
    def _(spark, sf):
        return rounded(me.compute(fx.motion(spark, sf), [name], CFG, STREAM_AXIS), ["mission", "seq"], [name])


for _key, (_name, _expression) in ROW_METRICS.items():
    _row_metric(_key, _name, _expression)

W = "(PARTITION BY mission ORDER BY t, seq)"
DT_SQL = f"""CASE WHEN count(*) OVER (PARTITION BY mission) = 1 THEN NULL
    ELSE greatest(coalesce(t - lag(t) OVER {W}, 0), 0) END"""


@query("E0_registry_in_order", sql(
    "SELECT mission, seq, round(abs(v_cmd - v_actual), 6) + 0.0 speed_error_abs, "
    "round(power_mech, 6) + 0.0 power_mech, round(abs(v_cmd - v_actual) * power_mech, 6) + 0.0 effort_error FROM speeds",
    "fx_motion", speeds=SPEEDS_SQL))
def _(spark, sf):
    # a user-defined metric that reads two columns computed before it
    @me.metric("effort_error")
    def effort_error(df, cfg):
        return F.col("speed_error_abs") * F.col("power_mech")

    names = ["speed_error_abs", "power_mech", "effort_error"]
    return rounded(me.compute(fx.motion(spark, sf), names, CFG, STREAM_AXIS), ["mission", "seq"], names)


@query("E5_joint_travel_cum_L1", sql(
    f"SELECT mission, seq, round(sum(coalesce(joint_travel_rate_L1 * dt, 0)) OVER (PARTITION BY mission ORDER BY t, seq "
    f"ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS joint_travel_cum_L1 FROM (SELECT *, {DT_SQL} dt FROM speeds)",
    "fx_motion", speeds=SPEEDS_SQL))
def _(spark, sf):
    out = me.compute(fx.motion(spark, sf), ["joint_travel_cum_L1"], CFG, STREAM_AXIS)
    return rounded(out, ["mission", "seq"], ["joint_travel_cum_L1"], 4)


def _frame(a, b):
    return f"(PARTITION BY mission ORDER BY t, seq ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


def med_sql(source, c, a, b):
    return f"SELECT * REPLACE (quantile_cont({c}, 0.5) OVER {_frame(a, b)} AS {c}) FROM ({source})"


def avg_sql(source, c, a, b):
    return f"SELECT * REPLACE (avg({c}) OVER {_frame(a, b)} AS {c}) FROM ({source})"


def hampel_sql(source, c, a, b, k=3.0):
    return f"""SELECT * EXCLUDE (med, mad) REPLACE (CASE WHEN mad <> 0 AND abs({c} - med) > {k}::DOUBLE * 1.4826::DOUBLE * mad
        THEN med ELSE {c} END AS {c}) FROM (SELECT *, quantile_cont(abs({c} - med), 0.5) OVER {_frame(a, b)} mad
        FROM (SELECT *, quantile_cont({c}, 0.5) OVER {_frame(a, b)} med FROM ({source})))"""


def dilate_sql(mask, pad):
    return (f"max(CASE WHEN {mask} THEN 1 ELSE 0 END) OVER (PARTITION BY mission ORDER BY t "
            f"RANGE BETWEEN {pad}::DOUBLE PRECEDING AND {pad}::DOUBLE FOLLOWING) = 1")


def cot_sql(power):
    base = f"SELECT *, {power} p, abs(v_cmd) c, v_actual v FROM speeds"
    base = avg_sql(hampel_sql(base, "v", 3, 3), "v", 1, 1)
    masks = f"""SELECT *, ok AND c < 0.2 idle0, coalesce(ok AND abs(w_cmd_z) >= 0.4 AND c < 0.3, false) turn0 FROM (
        SELECT *, v IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL ok FROM ({base}))"""
    wide = f"""SELECT *, {dilate_sql('idle0', 7200.0)} idle, {dilate_sql('turn0', 10800.0)} turning FROM ({masks})"""
    ratio = f"""SELECT mission, seq, t, CASE WHEN ok AND NOT idle AND NOT turning AND abs(v) >= 0.1
        THEN p / (30.0::DOUBLE * 9.81::DOUBLE * greatest(abs(v), 0.1)) END y FROM ({wide})"""
    return avg_sql(med_sql(ratio, "y", 2, 2), "y", 1, 1)


def _cot(key, name, power):
    @query(key, sql(f"SELECT mission, seq, round(y, 6) + 0.0 AS {name} FROM ({cot_sql(power)})",
                    "fx_motion", speeds=SPEEDS_SQL))
    def _(spark, sf):
        return rounded(me.compute(fx.motion(spark, sf), [name], CFG, STREAM_AXIS), ["mission", "seq"], [name])


_cot("E11_cost_of_transport", "cost_of_transport", "power_mech + power_joule_heating")
_cot("E12_cost_of_transport_mech", "cost_of_transport_mech", "power_mech")


@query("E13_cot_core_unpadded", sql(
    "SELECT mission, seq, round(CASE WHEN v_actual >= 0.1 AND v_cmd >= 0.1 AND power_mech IS NOT NULL "
    "THEN power_mech / (30.0::DOUBLE * 9.81::DOUBLE * v_actual) END, 6) + 0.0 cot FROM speeds",
    "fx_motion", speeds=SPEEDS_SQL))
def _(spark, sf):
    motion = fx.motion(spark, sf)
    out = me.cost_of_transport(motion, STREAM_AXIS, {"robot": {"mass_kg": 30.0}}, me.power_mech(motion, {}), "cot")
    return rounded(out, ["mission", "seq"], ["cot"])


@query("E14_mask_dilation", sql(
    f"SELECT mission, seq, {dilate_sql('v_cmd_x < 0.2', 7200.0)} AS slow FROM fx_motion", "fx_motion"))
def _(spark, sf):
    masked = fx.motion(spark, sf).withColumn("slow", F.coalesce(F.col("v_cmd_x") < 0.2, F.lit(False)))
    return me.dilate(masked, STREAM_AXIS, {"slow": 7200.0}).select("mission", "seq", "slow")


@query("E15_time_step", sql(f"SELECT mission, seq, round({DT_SQL}, 6) + 0.0 dt FROM fx_motion", "fx_motion"))
def _(spark, sf):
    return rounded(me.add_time_step(fx.motion(spark, sf), STREAM_AXIS), ["mission", "seq"], ["dt"])


ENERGY_SQL = f"""SELECT *, sum(coalesce(greatest(power_mech, 0) * dt, 0)) OVER (PARTITION BY mission ORDER BY t, seq
      ROWS UNBOUNDED PRECEDING) energy FROM (SELECT *, {DT_SQL} dt FROM (
      {avg_sql(med_sql('SELECT * FROM speeds', 'power_mech', 2, 2), 'power_mech', 1, 1)}))"""


@query("E16_energy_pos_cum", sql(
    f"SELECT mission, seq, round(energy, 3) + 0.0 energy_pos_cum FROM ({ENERGY_SQL})", "fx_motion", speeds=SPEEDS_SQL))
def _(spark, sf):
    out = me.compute(fx.motion(spark, sf), ["energy_pos_cum"], CFG, STREAM_AXIS)
    return rounded(out, ["mission", "seq"], ["energy_pos_cum"], 3)


@query("E17_cot_running", sql(
    f"SELECT e.mission, e.seq, round(energy / (30.0::DOUBLE * 9.81::DOUBLE * nullif(dist_m, 0)), 4) + 0.0 cot_running "
    f"FROM ({ENERGY_SQL}) e JOIN ({DIST_SQL}) d ON e.mission = d.mission AND e.seq = d.seq",
    "fx_motion", speeds=SPEEDS_SQL))
def _(spark, sf):
    walked = al.add_distance(fx.motion(spark, sf), STREAM_AXIS)
    return rounded(me.compute(walked, ["cot_running"], CFG, STREAM_AXIS), ["mission", "seq"], ["cot_running"], 4)


TRACK_CLOCK = """SELECT mission, t0 + i * 21600.0::DOUBLE t, i FROM (SELECT mission, t0, unnest(range(0, n + 1)) i FROM (
    SELECT mission, min(t) t0, CAST(floor((max(t) - min(t)) / 21600.0::DOUBLE) AS BIGINT) n FROM fx_motion GROUP BY 1))"""
NEAR_SQL = """SELECT x.mission, x.t, x.i, CASE WHEN abs(CASE WHEN n.t IS NULL OR x.t - x.bt <= n.t - x.t THEN x.bt ELSE n.t END
        - x.t) <= 10800.0 THEN CASE WHEN n.t IS NULL OR x.t - x.bt <= n.t - x.t THEN x.bs ELSE n.seq END END seq
    FROM (SELECT c.*, b.t bt, b.seq bs FROM clock c ASOF LEFT JOIN fx_motion b ON c.mission = b.mission AND c.t >= b.t) x
    ASOF LEFT JOIN fx_motion n ON x.mission = n.mission AND x.t <= n.t"""


@query("E1_tracking_error_per_mission", sql(
    "SELECT mission, count(err) AS samples, round(avg(err), 6) + 0.0 AS mean_error FROM (SELECT mission, i, "
    "avg(err) OVER (PARTITION BY mission ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) err FROM ("
    "SELECT mission, i, quantile_cont(err, 0.5) OVER (PARTITION BY mission ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 "
    "FOLLOWING) err FROM (SELECT k.mission, k.i, abs(sqrt(v_cmd_x**2 + v_cmd_y**2) - sqrt(vx**2 + vy**2)) err "
    "FROM near k LEFT JOIN fx_motion m ON k.mission = m.mission AND k.seq = m.seq))) GROUP BY 1",
    "fx_motion", clock=TRACK_CLOCK, near=NEAR_SQL))
def tracking_error(spark, sf):
    """Streams to clock to as-of join to speeds to filtered error to one figure per recording."""
    motion = fx.motion(spark, sf).select("mission", "t", "seq", "v_cmd_x", "v_cmd_y", "vx", "vy")
    clean = signal_scan(motion, STREAM_AXIS.keys, "t", ("seq",)).drop("seq")
    axis = fx.Axis(("mission",), "t", fx.CHUNK_SECONDS)
    synced = al.asof_join(al.master_clock([clean], ["mission"], "t", 1 / 21600.0), clean, axis, "nearest", 10_800.0)
    scored = me.compute(al.planar_speeds(synced), ["speed_error_abs"], CFG, axis)
    smooth = fl.apply_chain(scored, axis, "speed_error_abs", [
        {"type": "moving_median", "window": 5}, {"type": "moving_average", "window": 3}], pos="i")
    report = smooth.groupBy("mission").agg(
        F.count("speed_error_abs").alias("samples"), F.avg("speed_error_abs").alias("mean_error"))
    return rounded(report, ["mission", "samples"], ["mean_error"])
