"""A: sources, sinks and message extraction."""

from pyspark.sql import functions as F

from footfall.registry import fixtures as fx
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import sql
from footfall.session import scratch_path
from footfall.sources import messages as ms, selection as se, signals as sg, storage as st

LAST_SQL = "SELECT mission, t, max_by(v, seq) v, max_by(stream, seq) stream FROM fx_stream WHERE t IS NOT NULL GROUP BY 1, 2"


@query("A1_signal_scan", sql(f"SELECT mission, stream, {r('t', 'v')} FROM ({LAST_SQL})", "fx_stream"))
def _(spark, sf):
    scan = sg.signal_scan(fx.stream(spark, sf).withColumn("stamp_ns", F.col("seq")), ["mission"], "t", ["seq"])
    return rounded(scan, ["mission", "stream"], ["t", "v"])


@query("A2_optional_source", sql(
    "SELECT mission, count(*) samples, CAST(0 AS BIGINT) gps_samples FROM fx_stream GROUP BY 1", "fx_stream"))
def _(spark, sf):
    gps = sg.optional_table(spark, f"{sf}/no_such_gps.parquet", sg.GPS).groupBy("mission").agg(F.count("*").alias("gps_samples"))
    counts = fx.stream(spark, sf).groupBy(F.col("mission").cast("string").alias("mission")).agg(F.count("*").alias("samples"))
    return counts.join(gps, "mission", "left").select(
        F.col("mission").cast("long"), "samples", F.coalesce("gps_samples", F.lit(0)).cast("long").alias("gps_samples"))


KEEP = ("mission", "topic", "seq")
K_SQL = "SELECT *, CAST(json_extract(payload, '$.k') AS DOUBLE) k, CASE WHEN stamp_ns > 0 THEN stamp_ns ELSE log_ns END ns FROM fx_msgs"


def _parsed(spark, sf):
    rows = ms.parse_payload(fx.messages(spark, sf), "k DOUBLE", "payload", "body")
    return rows.withColumn("k", F.col("body.k"))


def _xyz(x, y, z):
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


@query("A3_cmd_vel", sql(
    f"""SELECT mission, topic, seq, {r('t', 'v_cmd_x', 'v_cmd_y', 'w_cmd_z')} FROM (SELECT *, ns / 1e9 t, k / 10 v_cmd_x,
    CASE WHEN seq % 4 = 0 THEN 0.0 ELSE "value" END v_cmd_y, k / 100 w_cmd_z FROM msgs)""", "fx_msgs", msgs=K_SQL))
def _(spark, sf):
    k, v = F.col("k"), F.when(F.col("seq") % 4 != 0, F.col("value"))
    body = F.struct(_xyz(k / 10, v, F.lit(0.0)).alias("linear"), _xyz(F.lit(0.0), F.lit(0.0), k / 100).alias("angular"))
    wrapped = F.col("seq") % 3 == 0  # some senders wrap the velocity
    msg = F.struct(F.when(wrapped, body).alias("twist"), F.when(~wrapped, body["linear"]).alias("linear"),
                   F.when(~wrapped, body["angular"]).alias("angular"))
    out = ms.extract_cmd_vel(_parsed(spark, sf).withColumn("msg", msg), KEEP)
    return rounded(out, list(KEEP), ["t", "v_cmd_x", "v_cmd_y", "w_cmd_z"])


ODOM = ["vx", "vy", "speed", "x", "y", "qw", "qx", "qy", "qz"]


@query("A4_odom", sql(
    f"""SELECT mission, topic, seq, {r('t', *ODOM)} FROM (SELECT *, ns / 1e9 t, k / 10 vx, "value" vy, sqrt((k/10)**2 + "value"**2) speed,
    k x, k * 2 y, cos(k) qw, 0.0::DOUBLE qx, 0.0::DOUBLE qy, sin(k) qz FROM msgs)""", "fx_msgs", msgs=K_SQL))
def _(spark, sf):
    k, zero = F.col("k"), F.lit(0.0)
    turn = F.struct(F.cos(k).alias("w"), zero.alias("x"), zero.alias("y"), F.sin(k).alias("z"))
    msg = F.struct(F.struct(_xyz(k / 10, F.col("value"), zero).alias("linear")).alias("twist"),
                   F.struct(_xyz(k, k * 2, zero).alias("position"), turn.alias("orientation")).alias("pose"))
    return rounded(ms.extract_odom(_parsed(spark, sf).withColumn("msg", msg), KEEP), list(KEEP), ["t", *ODOM])


@query("A5_gps", sql(
    f"""SELECT mission, topic, seq, {r('t', 'lat', 'lon', 'alt', 'status')} FROM (SELECT *, ns / 1e9 t, 47 + k / 1000 lat, 8 + k / 1000 lon,
    "value" alt, CASE WHEN seq % 5 = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END status FROM msgs)""", "fx_msgs", msgs=K_SQL))
def _(spark, sf):
    k = F.col("k")
    msg = F.struct((47 + k / 1000).alias("latitude"), (8 + k / 1000).alias("longitude"), F.col("value").alias("altitude"),
                   F.struct(F.when(F.col("seq") % 5 != 0, F.lit(2)).alias("status")).alias("status"))
    return rounded(ms.extract_gps(_parsed(spark, sf).withColumn("msg", msg), KEEP), list(KEEP), ["t", "lat", "lon", "alt", "status"])


IMU = ["ax", "ay", "az", "wx", "wy", "wz", "qw", "qx", "qy", "qz"]


@query("A6_imu", sql(
    f"""SELECT mission, topic, seq, {r('t', *IMU)} FROM (SELECT *, ns / 1e9 t, k ax, "value" ay, 9.81::DOUBLE az, k / 7 wx, k / 9 wy, k / 11 wz,
    cos(k) qw, sin(k) qx, 0.0::DOUBLE qy, 0.0::DOUBLE qz FROM msgs)""", "fx_msgs", msgs=K_SQL))
def _(spark, sf):
    k, zero = F.col("k"), F.lit(0.0)
    msg = F.struct(_xyz(k, F.col("value"), F.lit(9.81)).alias("linear_acceleration"), _xyz(k / 7, k / 9, k / 11).alias("angular_velocity"),
                   F.struct(F.cos(k).alias("w"), F.sin(k).alias("x"), zero.alias("y"), zero.alias("z")).alias("orientation"))
    return rounded(ms.extract_imu(_parsed(spark, sf).withColumn("msg", msg), KEEP), list(KEEP), ["t", *IMU])


@query("A7_transform_flatten", sql(
    f"""SELECT mission, seq, is_static, parent, child, {r('t', 'qw', 'qz')} FROM (SELECT mission, seq, is_static, t, parent, child, qw, qz FROM fx_tf
    UNION ALL SELECT mission, seq, is_static, t, child, 'leg_' || parent, qw, qz FROM fx_tf WHERE seq % 3 <> 0)""", "fx_tf"))
def _(spark, sf):
    turn = F.struct(F.col("qw").alias("w"), F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z"))
    pair = F.array(
        F.struct(F.concat(F.lit("/"), "parent").alias("parent"), F.col("child").alias("child"), turn.alias("rotation")),
        F.struct(F.col("child").alias("parent"), F.when(F.col("seq") % 3 != 0, F.concat(F.lit("leg_"), "parent")).otherwise("").alias("child"),
                 turn.alias("rotation")))
    raw = fx.transforms(spark, sf).select(
        "mission", "seq", "is_static", F.round(F.col("t") * 1e9).cast("long").alias("stamp_ns"), F.lit(0).alias("log_ns"), pair.alias("transforms"))
    return rounded(ms.flatten_transforms(raw, ("mission", "seq")), ["mission", "seq", "is_static", "parent", "child"], ["t", "qw", "qz"])


JOINTS_SQL = """SELECT mission, seq, t, joint, q, qd, tau FROM (SELECT mission, seq, t, unnest(names) joint, unnest(pos) q, unnest(pos[2:]) qd,
    unnest(list_transform(pos, lambda p: CASE WHEN p > 25 THEN p END)) tau FROM fx_joints) WHERE coalesce(q, qd, tau) IS NOT NULL"""


def _joint_messages(spark, sf, parts):
    return fx.joint_messages(spark, sf, parts).select(
        "mission", "seq", "t", F.col("names").alias("name"), F.col("pos").alias("position"),
        F.slice("pos", F.lit(2), F.greatest(F.size("pos") - 1, F.lit(0))).alias("velocity"),
        F.transform("pos", lambda p: F.when(p > 25, p)).alias("effort"))


@query("A8_joint_flatten", sql(f"SELECT mission, seq, joint, {r('q', 'qd', 'tau')} FROM ({JOINTS_SQL})", "fx_joints"))
def _(spark, sf):
    return rounded(ms.flatten_joints(_joint_messages(spark, sf, fx.joint_parts(spark, sf))), ["mission", "seq", "joint"], ["q", "qd", "tau"])


NAMES = [f"j{k}" for k in range(1, 8)]
WIDE = [f"{kind}_{j}" for kind in ("q", "qd", "tau") for j in NAMES]


@query("A9_joint_pivot", sql(
    "SELECT mission, t, " + ", ".join(f"round(max_by({w.split('_')[0]}, {{'s': seq, 'v': {w.split('_')[0]}}}) FILTER (joint = '{w.split('_')[1]}' AND {w.split('_')[0]} IS NOT NULL), 6) + 0.0 AS {w}"
                                      for w in WIDE) + f" FROM (SELECT * REPLACE (floor(t / 3) AS t, seq * 10 + CAST(joint[2:] AS INTEGER) AS seq) FROM ({JOINTS_SQL})) GROUP BY 1, 2",
    "fx_joints"))
def _(spark, sf):
    # several messages share a time, so the last value counts
    parts = fx.joint_parts(spark, sf)
    timed = _joint_messages(spark, sf, parts).withColumn("t", F.floor(F.col("t") / 3).cast("double"))
    tall = ms.flatten_joints(ms.place_messages(timed, parts))
    tall = tall.withColumn("seq", F.col("seq") * 10 + F.substring("joint", 2, 9).cast("int"))
    return rounded(ms.pivot_joints(tall, NAMES), ["mission", "t"], WIDE)


@query("A10_event_time", sql(
    "SELECT mission, seq, CASE WHEN stamp_ns > 0 THEN stamp_ns ELSE log_ns END ns FROM fx_msgs", "fx_msgs"))
def _(spark, sf):
    return fx.messages(spark, sf).select("mission", "seq", ms.event_time_ns(F.col("stamp_ns"), F.col("log_ns")).alias("ns"))


@query("A10_stamp_fallbacks", sql(
    "SELECT mission, count(*) messages, count(*) - count(CASE WHEN stamp_ns > 0 THEN 1 END) fallbacks FROM fx_msgs GROUP BY 1", "fx_msgs"))
def _(spark, sf):
    return ms.stamp_fallbacks(fx.messages(spark, sf))


TOTALS_SQL = "SELECT mission, count(*) n, round(sum(v), 4) + 0.0 total FROM fx_stream GROUP BY 1"


def _totals(df):
    return rounded(df.groupBy("mission").agg(F.count("*").alias("n"), F.sum("v").alias("total")), ["mission", "n"], ["total"], 4)


@query("A11_write_table", sql(TOTALS_SQL, "fx_stream"))
def _(spark, sf):
    path = scratch_path(spark, "signals")
    rows = fx.stream(spark, sf)
    st.write_table(rows, path)
    st.write_table(rows.where("v > 5"), path)  # an existing table is kept
    return _totals(st.read_table(spark, path))


@query("A13_metrics_sink", sql(
    TOTALS_SQL.replace("mission, count", "'metrics' kind, mission, count").replace("GROUP BY 1", "GROUP BY 1, 2")
    + " UNION ALL " + TOTALS_SQL.replace("mission, count", "'synced' kind, mission, count").replace("sum(v)", "sum(v + 1)").replace("GROUP BY 1", "GROUP BY 1, 2"), "fx_stream"))
def _(spark, sf):
    path = scratch_path(spark, "synced")
    rows = fx.stream(spark, sf)
    st.write_metrics(rows, path, 10)
    st.write_metrics(rows, path, 10, separate=False)
    st.write_metrics(rows.withColumn("v", F.col("v") + 1), path, 10, separate=False)  # in place
    table = st.read_table(spark, path)
    totals = table.groupBy("kind", "mission").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return rounded(totals, ["kind", F.col("mission").cast("long").alias("mission"), "n"], ["total"], 4)


@query("A14_patch_sink", sql(
    "SELECT mission, count(*) n, round(sum(CASE WHEN mission % 2 = 0 THEN v * 2 ELSE v END), 4) + 0.0 total FROM fx_stream GROUP BY 1", "fx_stream"))
def _(spark, sf):
    path = scratch_path(spark, "patches")
    rows = fx.stream(spark, sf)
    st.write_patches(rows, {"patch_size_m": 5.0}, path)
    # replacing some recordings leaves the others
    st.write_patches(rows.where("mission % 2 = 0").withColumn("v", F.col("v") * 2), {"patch_size_m": 5.0}, path)
    return _totals(st.read_table(spark, path).withColumn("mission", F.col("mission").cast("long")))


@query("A15_merge_datasets", sql(
    "SELECT mission, count(*) n, round(sum(v), 4) + 0.0 total FROM (SELECT * FROM fx_stream WHERE mission % 3 <> 0 UNION ALL "
    "SELECT * REPLACE (v * 10 AS v) FROM fx_stream WHERE mission % 3 = 0) GROUP BY 1", "fx_stream"))
def _(spark, sf):
    rows = fx.stream(spark, sf)
    first, second = rows.where("mission % 3 <> 0"), rows.where("mission % 2 = 0 OR mission % 3 = 0").withColumn("v", F.col("v") * 10)
    return _totals(st.merge_datasets(first, second))


@query("A15_merge_counts", sql(
    "SELECT count(*) FILTER (mission % 3 = 0) added, count(*) FILTER (mission % 3 <> 0) skipped FROM (SELECT DISTINCT mission FROM fx_stream "
    "WHERE mission % 2 = 0 OR mission % 3 = 0)", "fx_stream"))
def _(spark, sf):
    rows = fx.stream(spark, sf)
    return st.merge_counts(rows.where("mission % 3 <> 0"), rows.where("mission % 2 = 0 OR mission % 3 = 0"))


@query("A16_raster_cells", sql('SELECT "row", col, round(CASE WHEN label = 3 THEN NULL ELSE z END, 6) + 0.0 z FROM fx_cells', "fx_cells"))
def _(spark, sf):
    coded = fx.cells(spark, sf).withColumn("z", F.when(F.col("label") == 3, F.lit(-9999.0)).otherwise(F.col("z")))
    return rounded(sg.raster_cells(coded, -9999.0), ["row", "col"], ["z"])


@query("A17_run_manifest", sql(
    """SELECT mission, count(*) AS "rows", round(min(t), 6) + 0.0 t_first, round(max(t), 6) + 0.0 t_last, 'mission,seq,stream,t,v' AS "columns", 10.0::DOUBLE hz
    FROM fx_stream GROUP BY 1""", "fx_stream"))
def _(spark, sf):
    return rounded(st.manifest(fx.stream(spark, sf), {"hz": 10.0}), ["mission", "rows", "columns", "hz"], ["t_first", "t_last"])


def _rank_sql(order, where="true"):
    return f"SELECT dir, name, mtime FROM fx_files WHERE {where} QUALIFY row_number() OVER (PARTITION BY dir ORDER BY {order}) = 1"


@query("A12_synced_selection", sql(
    f"""SELECT dir, name, mtime, CAST(regexp_extract(name, 'synced_(\\d+)Hz', 1) AS BIGINT) hz FROM (
    {_rank_sql("CASE WHEN name LIKE '%_metrics.parquet' THEN 0 ELSE 1 END, mtime DESC, name")})""", "fx_files"))
def _(spark, sf):
    out = se.select_synced(fx.files(spark, sf), ["dir"], prefer_metrics=True)
    return out.select("dir", "name", "mtime", F.col("hz").cast("long"))


@query("A18_raster_choice", sql(
    """SELECT dir, name FROM fx_files WHERE name LIKE '%10Hz%' OR name LIKE '%metrics%' OR name = CASE WHEN dir < 'd' THEN 'synced_5Hz.parquet' END
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN dir < 'd' AND name = 'synced_5Hz.parquet' THEN 1 WHEN name LIKE '%10Hz%' THEN 2 ELSE 3 END, name) = 1""", "fx_files"))
def _(spark, sf):
    named = F.when(F.col("dir") < "d", F.lit("synced_5Hz.parquet"))
    return se.choose_rasters(fx.files(spark, sf), ["dir"], ["*10Hz*", "*metrics*"], sidecar=named)


@query("A18_latest_imagery", sql("SELECT dir, max_by(name, {'m': mtime, 'n': name}) AS name FROM fx_files GROUP BY 1", "fx_files"))
def _(spark, sf):
    return se.latest_file(fx.files(spark, sf), ["dir"])
