"""What is stored on the way to a patch table, and what its windows read."""

import re

import pytest
from pyspark.sql import functions as F

from footfall import session
from footfall.operators import patches as pa
from footfall.registry import load_all, patches as registered
from footfall.registry.base import QUERIES

SF = "/root/testdata/sf0.001"
ROBOT = {"power", "v_cmd", "v_actual", "w_cmd_z", "qw_WB", "_p", "_value"}


@pytest.fixture
def stored(monkeypatch):
    """Tables that are written between stages."""
    tables = []

    def record(df):
        tables.append(session.materialize(df))
        return tables[-1]

    for module in (pa, registered):
        monkeypatch.setattr(module, "materialize", record)
    load_all()
    return tables


def test_only_members_of_kept_patches_are_stored(spark, stored):
    kept = QUERIES["H22_patch_table_without_raster"](spark, SF).agg(F.sum("samples")).first()[0]
    members = [t.count() for t in stored if {"patch_id", "power"} <= set(t.columns)]
    assert members == [kept]


def test_counting_skipped_patches_takes_no_robot_along(spark, stored):
    assert QUERIES["H20_skip_accounting"](spark, SF).count() > 0
    assert stored and not any(ROBOT & set(t.columns) for t in stored)


def test_a_window_is_read_once(spark):
    cells = spark.range(400).selectExpr("'r' AS raster_id", "CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", "CAST(id % 20 AS DOUBLE) + id DIV 20 * 3 AS z")
    georef = spark.createDataFrame([("r", 1.0, 0.0, -1.0, 20.0, 20, 20)], "raster_id string, a double, c double, e double, f double, h int, w int")
    at = [(1, 10.2, 9.8), (2, 9.9, 10.1), (3, 7.0, 12.0), (4, 0.0, 0.0)]  # the first two lie around the same cell, the last at an edge
    centers = spark.createDataFrame([(k, k, e, n, "r") for k, e, n in at], "mission int, patch_id int, center_e double, center_n double, raster_id string")
    out = pa.terrain_windows(centers, cells, georef, ["mission"], 6.0)
    got = {r.patch_id: r for r in out.collect()}
    assert [got[k].inside for k in (1, 2, 3, 4)] == [True, True, True, False] and got[4].slope_e is None
    assert [got[k].height_valid_fraction for k in (1, 2, 3)] == [1.0] * 3
    for k in (1, 2, 3):
        assert (got[k].slope_e, got[k].slope_n) == pytest.approx((1.0, -3.0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode.*Aggregate \[raster_id#\d+, row#\d+, col#\d+, _half#\d+\]", plan, re.S), plan
