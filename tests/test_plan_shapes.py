"""What executed plans may hold: scans of the input and exchanges of its rows."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import alignment as al, clusters as cl, metrics as me, ordered as o, orientation as ori
from footfall.operators.ordered import Axis

AXIS = Axis(("g",), "t", 40.0)
CFG = {"robot": {"mass_kg": 30.0}, "params": {}, "filters": {}}


@pytest.fixture(scope="module")
def walk(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    n = 3000
    frame = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.9, 1, 2), "t": np.cumsum(rng.random(n).round(3)) + 1.0, "x": rng.normal(size=n).cumsum(), "y": rng.normal(size=n),
        "a": (rng.random(n) - 0.5) * 6.2, "v": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)), "qd_a": rng.normal(size=n), "tau_a": rng.normal(size=n),
        "label": rng.integers(0, 3, n), "dist_m": np.arange(n) * 0.5})
    path = f"{tmp_path_factory.mktemp('walk')}/walk"
    spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).write.parquet(path)
    return spark.read.parquet(path), frame.sort_values(["g", "t"])


def executed(df):
    """The final plan after a run."""
    text = df.select(F.max(F.xxhash64("*")).alias("h"))
    text.collect()
    return text._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def shape(df):
    plan = executed(df)
    exchanges = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
    return len(re.findall(r"FileScan parquet", plan)), len(exchanges), plan


@pytest.mark.parametrize("name", ["C10", "E5", "E17", "F15", "I11", "I12", "C8", "J8"])
def test_one_scan_and_one_exchange_of_rows(walk, name):
    df, _ = walk
    got = {
        "C10": lambda: al.add_distance(df, AXIS),
        "E5": lambda: me.compute(df, ["joint_travel_cum_L1"], CFG, AXIS),
        "E17": lambda: me.compute(df, ["cot_running"], CFG, AXIS),
        "F15": lambda: ori.unwrap(df, AXIS, "a", origin=0.0),
        "I11": lambda: cl.label_runs(df, AXIS, "label"),
        "I12": lambda: cl.step_edges(df, AXIS, "x"),
        "C8": lambda: al.interpolate(df, AXIS, ["v", "y"], 1),
        "J8": lambda: o.running(df, AXIS, a=o.lag("x"), b=o.lead("x"), c=o.row_index(), d=o.running_max("x"), e=o.group_first("v", valid_only=True)),
    }[name]()
    scans, exchanges, plan = shape(got)
    assert (scans, exchanges) == (1, 1), plan
    assert "ReusedExchange" in plan and "max_by" not in plan


def test_results_of_fused_sums(walk):
    df, frame = walk
    groups = frame.groupby("g")
    step = np.hypot(groups.x.diff(), groups.y.diff()).fillna(0)
    unwrapped = np.concatenate([np.unwrap(g.a) for _, g in groups])
    runs = (groups.label.shift() != frame.label).groupby(frame.g).cumsum()
    for width in (3.0, 40.0, 1e9):
        axis = Axis(("g",), "t", width)
        got = al.add_distance(df, axis).orderBy("g", "t").toPandas()
        np.testing.assert_allclose(got.dist_m_per_step, step)
        np.testing.assert_allclose(got.dist_m, step.groupby(frame.g).cumsum())
        np.testing.assert_allclose(ori.unwrap(df, axis, "a").orderBy("g", "t").toPandas().a, unwrapped, atol=1e-9)
        assert cl.label_runs(df, axis, "label").count() == runs.groupby(frame.g).max().sum()


def test_positions_of_valid_rows(walk):
    df, frame = walk
    k = frame.groupby("g").cumcount()
    back = k.where(frame.v.notna()).groupby(frame.g).ffill()
    ahead = k.where(frame.v.notna()).groupby(frame.g).bfill()
    for width in (2.0, 1e9):
        got = o.running(df, Axis(("g",), "t", width), b=o.last_valid_at("v"), a=o.next_valid_at("v")).orderBy("g", "t").select("b.p", "b.v", F.col("a.p").alias("q")).toPandas()
        np.testing.assert_array_equal(got.p, back)
        np.testing.assert_array_equal(got.q, ahead)
        np.testing.assert_allclose(got.v, frame.groupby("g").v.ffill(), equal_nan=True)


def test_running_result_joined_with_itself(walk):
    """A reused result keeps its columns apart in both places."""
    df, frame = walk
    once = o.running(df, AXIS, k=o.row_index())
    twice = once.alias("a").join(once.select("g", "k", F.col("x").alias("before")).withColumn("k", F.col("k") + 1), ["g", "k"])
    got = twice.agg(F.sum(F.col("x") - F.col("before"))).first()[0]
    assert got == pytest.approx(frame.groupby("g").x.agg(lambda s: s.iloc[-1] - s.iloc[0]).sum())
