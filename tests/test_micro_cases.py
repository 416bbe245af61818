"""Hand-worked tie, null and edge rules."""

import math
import re

import pytest
from pyspark.sql import functions as F

from footfall.functions import geodesy, vectors as vf
from footfall.functions.angles import unwrap_jump_sql
from footfall.operators import alignment as al, filters as fl, metrics as me, orientation as ori, patches as pa, raster as ra
from footfall.operators.ordered import Axis
from footfall.operators.quantiles import quantiles
from footfall.sources import texts as tx

AXIS = Axis(("g",), "t", 2.0)


def series(spark, values, name="x"):
    rows = [(1, float(k), None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"g int, t double, {name} double")


def column(df, name="x"):
    return [r[0] for r in df.orderBy("t").select(name).collect()]


def test_asof_tie_goes_to_the_earlier_row_and_tolerance_is_inclusive(spark):
    left = series(spark, [0, 0, 0, 0]).drop("x")
    right = spark.createDataFrame([(1, t, v) for t, v in [(0.5, 1.0), (1.5, 2.0), (2.5, 3.0), (4.0, 4.0)]], "g int, t double, v double")
    assert column(al.asof_join(left, right, AXIS, "nearest", 0.5), "v") == [1, 1, 2, 3]
    assert column(al.asof_join(left, right, AXIS, "nearest"), "v") == [1, 1, 2, 3]
    assert column(al.asof_join(left, right, AXIS, "backward", 0.4), "v") == [None] * 4
    assert column(al.asof_join(left, right, AXIS, "forward", 1.0), "v") == [1, 2, 3, 4]


def test_interpolation_fills_from_both_sides(spark):
    df = series(spark, [None, None, 1, None, None, None, 5, None, None])
    assert column(al.interpolate(df, AXIS, ["x"], 1)) == [None, 1, 1, 2, None, 4, 5, 5, None]
    assert column(al.interpolate_seconds(df, AXIS, ["x"], 1.2)) == [None, 1, 1, 2, None, 4, 5, 5, None]
    with pytest.raises(ValueError):
        al.interpolate(df, AXIS, ["x"], 0)


def test_even_centred_window_and_median_over_nulls(spark):
    mean = fl.apply_chain(series(spark, [1, 10, 100, 1000, 10000]), AXIS, "x", {"type": "moving_average", "window": 4})
    assert column(mean) == [5.5, 37, 277.75, 2777.5, 3700]
    med = fl.apply_chain(series(spark, [1, None, 3, None, None, None]), AXIS, "x", {"type": "moving_median", "window": 3})
    assert column(med) == [1, 2, 3, 3, None, None]


def test_exponential_average_decays_over_nulls(spark):
    out = column(fl.apply_chain(series(spark, [1, None, 3, 4]), AXIS, "x", {"type": "ema", "alpha": 0.3}))
    assert out == pytest.approx([1, 1, 1.759493670886076, 2.431645569620253])


def test_filter_errors_and_fallback(spark):
    with pytest.raises(KeyError):
        fl.apply_chain(series(spark, [1]), AXIS, "x", "bogus")
    with pytest.raises(ValueError):
        fl.apply_chain(series(spark, [1]), AXIS, "x", {"type": "ema", "alpha": 2})
    table = {"default": "none", "a": {"chain": [{"type": "hampel"}, {"type": "ema", "enabled": False}]}}
    assert [s.kind for s in fl.Catalog(table).chain("a").stages] == [fl.Kind.HAMPEL]
    assert fl.Catalog(table).chain("b").working() == [] and fl.Catalog(None).chain("b") == fl.Chain()


def test_row_sums_and_power_rules(spark):
    df = spark.createDataFrame([(1, 0.0, None, None), (1, 1.0, 2.0, 3.0)], "g int, t double, qd_a double, tau_a double")
    out = me.compute(df, ["joint_travel_rate_L1", "power", "power_joule_heating"], {}, AXIS)
    assert column(out, "joint_travel_rate_L1") == [0.0, 2.0]
    assert column(out, "power") == [0.0, 6.0]
    assert column(out, "power_joule_heating") == [None, None]
    with pytest.raises(KeyError):
        me.compute(df, ["nope"], {}, AXIS)


def test_time_step_of_a_single_row_is_null(spark):
    assert column(me.add_time_step(series(spark, [1]), AXIS), "dt") == [None]
    assert column(me.add_time_step(series(spark, [1, 1]), AXIS), "dt") == [0.0, 1.0]


def test_dilation_is_a_superset(spark):
    df = series(spark, [0, 0, 1, 0, 0, 0, 0]).withColumn("m", F.col("x") == 1)
    assert column(me.dilate(df, AXIS, {"m": 1.5}), "m") == [False, True, True, True, False, False, False]


def test_unwrap(spark):
    assert column(ori.unwrap(series(spark, [3, -3, 3]), AXIS, "x")) == pytest.approx([3, 2 * math.pi - 3, 3])
    assert spark.range(1).selectExpr(unwrap_jump_sql("0.5D")).first()[0] == 0.0


def test_percentiles(spark):
    row = quantiles(series(spark, [1, 2, 3, 10]), ["g"], "x", [0.05, 0.95], ["lo", "hi"]).first()
    assert (row.lo, row.hi) == pytest.approx((1.15, 8.95))


def test_projection_meets_published_points(spark):
    # the worked example of the published formulas, given to 0.01 seconds of arc (0.3 m); null stays null
    points = spark.createDataFrame([(46 + 2 / 60 + 38.87 / 3600, 8 + 43 / 60 + 49.79 / 3600), (None, 8.0)], "lat double, lon double")
    found = ra.project(points).orderBy("lat").collect()
    assert found[0]["easting_m"] is None
    assert found[1]["easting_m"] == pytest.approx(2700000, abs=0.3) and found[1]["northing_m"] == pytest.approx(1100000, abs=0.3)
    # the origin of the grid on its own ellipsoid
    origin = spark.createDataFrame([(math.radians(geodesy.ORIGIN_LAT), math.radians(geodesy.ORIGIN_LON))], "lat double, lon double")
    at = ra.project(origin, steps=geodesy.SWISS_GRID).first()
    assert at["easting_m"] == pytest.approx(2600000, abs=1e-6) and at["northing_m"] == pytest.approx(1200000, abs=1e-6)


def test_thinning_looks_past_long_rests():
    import numpy as np
    import pandas as pd

    from footfall.operators import frames

    rng = np.random.default_rng(1)
    steps = rng.choice([0.0, 4e-6, 1e-3], 3000, p=[0.95, 0.045, 0.005]).cumsum()
    q = pd.DataFrame({"g": 1, "_run": np.repeat([1, 2, 3], 1000), "qw": np.cos(steps), "qx": np.sin(steps), "qy": 0.0, "qz": 0.0})
    q.loc[rng.random(3000) < 0.3, ["qw", "qx"]] *= -1
    want, run, last = [], None, None
    for k, (rid, v) in enumerate(zip(q["_run"], q[list(frames.Q)].to_numpy())):
        if rid != run or frames._differs(v[None], last)[0]:
            run, last = rid, v
            want.append(k)
    got = pd.concat(frames._thin_runs(["g"])(iter([q[:700], q[700:1000], q[1000:]])))
    assert got.index.tolist() == want


LISTING = """\x1b[31mproj │ Größe-Süd │ 0A0B0C0D-1111-2222-3333-444455556666 │ ok\x1b[0m
ETH-12 and Zürich-3, cut off…
ETH-1 é-7 ünïcode-99x Ω-5
p | n2 | 0a0b0c0d-1111-2222-3333-444455556666 | ETH-2
alone 99999999-1111-2222-3333-444455556666"""


def test_handles_with_unicode_letters(spark):
    """As the Unicode-aware patterns of Python see them."""
    df = spark.createDataFrame([(1, LISTING)], "doc_id int, text string")
    want = {"0a0b0c0d-1111-2222-3333-444455556666", "99999999-1111-2222-3333-444455556666"}
    for line in LISTING.split("\n"):
        if "…" not in line and "1111" not in line:
            want |= set(re.findall(r"\b([^\s\|:│]+-[0-9]+)\b", line))
    assert {r.handle for r in tx.handles(df).collect()} == want and {"é-7", "Ω-5", "ETH-1"} <= want


def test_names_from_a_listing(spark):
    df = spark.createDataFrame([(1, LISTING), (2, None), (3, "")], "doc_id int, text string")
    assert [tuple(r) for r in tx.mission_names(df).collect()] == [(1, "0a0b0c0d-1111-2222-3333-444455556666", "Größe-Süd")]


def test_infinite_values_do_not_count_as_energy(spark):
    rows = [(1, float(k), p, float(k), 1.0) for k, p in enumerate([10.0, 10.0, float("inf"), 10.0, 10.0, float("nan")])]
    df = spark.createDataFrame(rows, "patch int, t double, power double, dist_m double, v_cmd double")
    got = pa.patch_cost_of_transport(df, Axis(("patch",), "t", 10.0), {"robot": {"mass_kg": 1.0}, "params": {}}).first()
    assert got.cot_patch == pytest.approx(10.0 / 9.81, rel=1e-3)


def test_projection_head(spark):
    w1, b1, w2 = [[1.0, -1.0], [0.5, 2.0], [-1.0, 0.0]], [0.1, 0.0, 0.2], [[1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None])], "k int, v array<double>")
    got = {r.k: r.u for r in df.select("k", vf.projection_head(F.col("v"), [(w1, b1), (w2, None)]).alias("u")).collect()}
    assert got == {1: [1.0], 2: None, 3: None, 4: None}


def test_mean_orientation_at_a_right_angle_keeps_the_side_of_its_first_row(spark):
    rows = spark.createDataFrame([(1, 0.0, -1e-17, 0.0, 0.0, 1.0), (2, 0.0, -1e-6, 0.0, 0.0, 1.0)], "g int, t double, qw double, qx double, qy double, qz double")
    side = {r.g: r.qz for r in ori.average_quaternion(rows, ["g"], ["t"], slack=ori.RIGHT_ANGLE_SLACK).collect()}
    assert side == {1: 1.0, 2: pytest.approx(-1.0)}
