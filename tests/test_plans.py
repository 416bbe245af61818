"""The stages together, on a small walk, and extraction from a stream."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from footfall.plans import mission as plan
from footfall.sources import messages as ms
from footfall.sources.catalog import requested_missions
from footfall.sources.selection import expand_patterns, glob_regex
from footfall.streaming.messages import extract_stream

CFG = {"robot": {"mass_kg": 30.0}, "params": {"min_cmd_speed_for_power_norm": 0.2}, "filters": {}}


def _signals(spark):
    odom, cmd, joints = [], [], []
    for mission, seconds in (("a", 40.0), ("b", 15.0)):
        t = np.arange(0.0, seconds, 0.05)
        odom.append(pd.DataFrame({"mission": mission, "stamp_ns": (t * 1e9).astype(int), "t": t, "vx": 1.0, "vy": 0.0, "x": t * 1.0, "y": 0.0,
                                  "qw": 1.0, "qx": 0.0, "qy": 0.0, "qz": 0.0}))
        c = np.arange(0.02, seconds, 0.1)
        cmd.append(pd.DataFrame({"mission": mission, "stamp_ns": (c * 1e9).astype(int), "t": c, "v_cmd_x": 1.0, "v_cmd_y": 0.0, "w_cmd_z": 0.0}))
        joints.append(pd.DataFrame({"mission": mission, "t": t, "qd_hip": 2.0, "tau_hip": 10.0}))
    frame = lambda parts: spark.createDataFrame(pd.concat(parts))
    return {"cmd_vel": frame(cmd), "odom": frame(odom), "joint_states": frame(joints)}


def test_whole_chain(spark, tmp_path):
    settings = plan.SyncSettings(chunk_s=10.0)
    out = plan.run(spark, _signals(spark), str(tmp_path), CFG, ["power", "speed_error_abs"], settings)
    synced = spark.read.parquet(f"{tmp_path}/synced").toPandas()
    assert synced.groupby("mission").size().to_dict() == {"a": 400, "b": 150}
    ends = synced.sort_values("t").groupby("mission").dist_m.last()
    np.testing.assert_allclose(ends, [39.9, 14.9], atol=0.06)
    got = out.toPandas()
    assert set(got.mission) == {"a", "b"}
    assert (got.samples >= 5).all() and (got.distance_traveled_m >= 4.5).all()
    # 20 W on 30 kg at 1 m/s
    np.testing.assert_allclose(got.cot_patch.dropna(), 20 / (30 * 9.81), rtol=1e-6)
    np.testing.assert_allclose(got.metric_power_mean, 20.0)


def test_chain_with_raster_text_and_attitude(spark, tmp_path):
    signals = _signals(spark)
    signals["odom"] = signals["odom"].withColumn("gait", F.lit("trot"))
    t = np.arange(0.0, 40.0, 0.05)
    signals["base_orientation"] = spark.createDataFrame(pd.DataFrame(
        {"mission": "a", "stamp_ns": (t * 1e9).astype(int), "t": t, "qw": 1.0, "qx": 0.0, "qy": 0.0, "qz": 0.0}))
    gps = pd.DataFrame({"mission": "a", "stamp_ns": (t * 1e9).astype(int), "t": t, "lat": 46.95108, "lon": 7.43864 + t * 1.3e-5, "alt": 550.0})
    signals["gps"] = spark.createDataFrame(gps)
    side = 300
    cells = spark.range(side * side).select(
        F.lit("r").alias("raster_id"), (F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col")).withColumn(
        "z", 0.1 * F.col("col"))
    georef = spark.createDataFrame([("r", 1.0, 2_599_900.0, -1.0, 1_200_150.0, side, side)], "raster_id string, a double, c double, e double, f double, h int, w int")
    rasters = spark.createDataFrame([("a", "r")], "mission string, raster_id string")
    plan.run(spark, signals, str(tmp_path), CFG, ["power"], plan.SyncSettings(chunk_s=10.0), cells=cells, georef=georef, rasters=rasters)
    table = spark.read.parquet(f"{tmp_path}/slopes").toPandas()
    walked = table[(table.mission == "a") & table.lat.notna()]
    assert len(walked) >= 390 and set(walked.gait.dropna()) == {"trot"}
    np.testing.assert_allclose(walked.dem_grad_e.astype(float), 0.1, atol=1e-9)
    assert table[table.mission == "b"].dem_grad_e.isna().all()
    assert {r["mission"]: r["rows"] for r in spark.read.parquet(f"{tmp_path}/manifest").collect()} == {"a": 400, "b": 150}


def test_no_list_means_all_missions(spark):
    missions = spark.createDataFrame([("1", "f1", "n1"), ("2", "f2", "n2")], "id string, folder string, name string")
    aliases = spark.createDataFrame([("x", "1", 0)], "alias string, id string, pos int")
    lines = spark.createDataFrame([(0, "# none"), (1, " ")], "pos int, line string")
    assert {r["id"] for r in requested_missions(lines, aliases, missions).collect()} == {"1", "2"}


def test_patterns_cover_twins_and_splits():
    assert expand_patterns(["x.bag", "y*.mcap", "z.txt"]) == [
        "x.bag", "x.mcap", "x*.bag", "x*.mcap", "y*.mcap", "y*.bag", "z.txt"]
    assert re.match(glob_regex("a[!0-4]?.b"), "a5x.b") and not re.match(glob_regex("a[!0-4]?.b"), "a4x.b")


def test_stream_extraction_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "user_id AS mission", "event_id AS stamp_ns", "0L AS log_ns",
        "named_struct('linear', named_struct('x', value, 'y', value), 'angular', named_struct('z', value)) AS msg")
    source.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    query = extract_stream(live, ms.extract_cmd_vel, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    query.awaitTermination(60)
    batch = ms.extract_cmd_vel(source)
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.count() == batch.count() and written.exceptAll(batch).isEmpty()
