"""Names served in order, and gradients at points, against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import raster as ra
from footfall.sources import catalog as ca


@pytest.mark.parametrize("seed", range(4))
def test_names_are_served_in_order_of_ids(spark, seed):
    r = random.Random(seed)
    wanted = [(k, r.choice("AB"), r.choice([None, 0, 1, 1, 2, 3, 7, 8, 30])) for k in range(60)]
    taken = {(r.choice("AB"), r.randint(1, 12)) for _ in range(8)}
    used, want = set(taken), {}
    for k, prefix, number in wanted:
        n = 1 if number is None else number
        while (prefix, n) in used:
            n += 1
        used.add((prefix, n))
        want[k] = f"{prefix}-{n}"
    r.shuffle(wanted)
    got = ca.assign_short_names(spark.createDataFrame(wanted, "id int, prefix string, number bigint").repartition(3),
                                spark.createDataFrame(sorted(taken), "prefix string, number bigint"))
    assert {x.id: x.short_name for x in got.collect()} == want


def test_gradient_at_points_equals_the_gradient_grid(spark):
    """With missing cells, points on the border and outside, and a raster of three rows."""
    rng = np.random.default_rng(5)
    cells = [(g, i, j, float(rng.normal())) for g, h, w in (("a", 9, 8), ("b", 3, 5)) for i in range(h) for j in range(w) if rng.random() > 0.03]
    georef = spark.createDataFrame([("a", 0.5, 10.0, -0.5, 20.0, 9, 8), ("b", 2.0, 0.0, -2.0, 6.0, 3, 5)], "raster_id string, a double, c double, e double, f double, h int, w int")
    table = spark.createDataFrame(cells, "raster_id string, row int, col int, z double")
    points = pd.DataFrame({"raster_id": rng.choice(["a", "b"], 300), "k": range(300), "u": rng.random(300) * 10 - 1, "v": rng.random(300) * 10 - 1, "heading": 0.3})
    points["x"] = np.where(points.raster_id == "a", 10 + 0.5 * points.u, 2 * points.u)
    points["y"] = np.where(points.raster_id == "a", 20 - 0.5 * points.v, 6 - 2 * points.v)
    placed = ra.world_to_cell(spark.createDataFrame(points), georef)
    got = ra.sampled_gradient_slopes(placed, table, georef).select("k", "dem_grad_e", "dem_grad_n")
    want = ra.sample_bilinear(placed, ra.grid_gradient(table, georef), {"grad_e": "e0", "grad_n": "n0"}).select("k", "e0", "n0")
    both = got.join(want, "k").toPandas().astype(float)
    assert both.e0.notna().sum() > 60
    np.testing.assert_allclose(both.dem_grad_e, both.e0, atol=1e-12, equal_nan=True)
    np.testing.assert_allclose(both.dem_grad_n, both.n0, atol=1e-12, equal_nan=True)


def test_cells_away_from_points_are_not_read(spark):
    """Twelve cells for each square with a point in it, whatever the raster's size."""
    cells = spark.range(400 * 400).selectExpr("'a' raster_id", "int(id / 400) AS row", "int(id % 400) AS col", "double(id % 7) AS z")
    georef = spark.createDataFrame([("a", 1.0, 0.0, -1.0, 0.0, 400, 400)], "raster_id string, a double, c double, e double, f double, h int, w int")
    points = spark.range(50).selectExpr("'a' raster_id", "id * 0.1 + 100 AS x", "-200.5D AS y", "0.0D AS heading")
    out = ra.sampled_gradient_slopes(ra.world_to_cell(points, georef), cells, georef)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where(F.col("dem_grad_e").isNull()).isEmpty()
