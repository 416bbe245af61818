"""Nothing is cut, thinned or left out, however long a track, a text or a history is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import filters as fl, metrics as me, raster as ra, reports as rp
from footfall.operators.ordered import Axis
from footfall.sources import texts as tx

AXIS = Axis(("g",), "t", 500.0)


def test_a_long_track_keeps_its_extremes(spark):
    rows = spark.range(20_001).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("t"), F.lit(47.0).alias("lat"),
                                      F.when(F.col("id") == 7_003, 8.02).otherwise(8.0).alias("lon"))
    box = ra.track_chip(rows, AXIS, 100.0).first()
    inner = ra.track_chip(rows.where("t <> 7003"), AXIS, 100.0).first()
    assert box["max_e"] - inner["max_e"] > 700


def test_a_token_far_down_a_text_is_found(spark):
    text = "\n".join(["nothing here"] * 199 + ["walk-17 came last"])
    assert tx.id_and_short_name(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["short_name"] == "WALK-17"


def test_a_recording_with_few_moving_rows_is_listed(spark):
    rows = spark.createDataFrame([(1, float(i), 1.0, 0.0, 0.1, i < 3) for i in range(5)], "g int, t double, dx double, dy double, heading double, moving boolean")
    assert rp.best_quarter_turn(rows, AXIS).collect() == [(1, None, None, 3)]


@pytest.mark.parametrize("adjust", [False, True])
def test_a_slow_average_remembers_everything(spark, monkeypatch, adjust):
    monkeypatch.setattr(fl, "BLOCK_ROWS", 300)
    values = np.random.default_rng(1).normal(size=1500).cumsum()
    df = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate(values)], "g int, t double, x double")
    got = [r["x"] for r in fl.apply_chain(df, AXIS, "x", {"type": "ema", "alpha": 0.0005, "adjust": adjust}).orderBy("t").collect()]
    num, den, want = values[0], 1.0, [values[0]]
    for v in values[1:]:
        num, den = (0.9995 * num + v, 0.9995 * den + 1) if adjust else (0.9995 * num + 0.0005 * v, 1.0)
        want.append(num / den)
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(("cfg", "factor"), [
    ({"actuation": {"R": 2, "kt": -0.5, "G": 4}}, 0.5), ({"motor": {"resistance": "8", "torque_constant": 2, "gear_ratio": 1}}, 2.0),
    ({"actuator": {"R": 2, "k_t": 0, "G": 4}}, None), ({"motor": {"R": -1, "k_t": 1, "G": 4}}, None), ({}, None)])
def test_heat_factor(cfg, factor):
    assert me.heat_factor(cfg) == factor and me.mass_and_gravity({"robot": {"mass_kg": 30}}) == (30.0, me.DEFAULT_GRAVITY)


def test_quarter_turns_travel_in_one_row(spark):
    """The path of a robot whose heading is a quarter turn ahead; rows are not repeated for each turn."""
    rows = spark.range(40).selectExpr("1 AS g", "double(id) AS t", "pmod(atan2(sin(id * 0.3D), cos(id * 0.3D)) + pi() / 2 + pi(), 2 * pi()) - pi() AS heading",
                                      "id > 5 AS moving", "cos(id * 0.3D) AS dx", "sin(id * 0.3D) AS dy")
    found = rp.best_quarter_turn(rows, Axis(("g",), "t", 7.0), median_rows=3)
    assert "inline(" not in found._jdf.queryExecution().optimizedPlan().toString()
    [row] = found.collect()
    assert (row.rot, row.n_moving) == (90, 34) and row.rmse < 0.05
