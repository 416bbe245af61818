"""Nearest centroids and resized grids against plain loops."""

import numpy as np
import pandas as pd
import pytest

from footfall.operators import clusters as cl


@pytest.mark.parametrize("block_bytes", [200, 64 << 20])
def test_nearest_centroids(spark, monkeypatch, block_bytes):
    """Ties (equal and parallel centroids) go to the lowest index, whatever the blocks."""
    monkeypatch.setattr(cl, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(3)
    cents = rng.normal(size=(40, 5))
    cents[17], cents[30], cents[39] = cents[4], cents[4] * 2, cents[2]
    x = np.vstack([rng.normal(size=(300, 5)), cents, np.zeros((1, 5))])
    unit = cents / np.maximum(np.linalg.norm(cents, axis=1, keepdims=True), 1e-12)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "vec": [list(map(float, v)) for v in x]}))
    odd = spark.createDataFrame([(1000, None), (1001, [1.0]), (1002, [float("nan")] * 5)], "id long, vec array<double>")
    table = spark.createDataFrame(pd.DataFrame({"k": range(40), "vec": [list(map(float, v)) for v in cents]})).repartition(3)
    got = {r.id: r.cluster for r in cl.assign_clusters(df.unionByName(odd), table).collect()}
    assert [got[k] for k in (1000, 1001, 1002)] == [None] * 3
    scores = np.round(x @ unit.T, 12)
    assert [got[k] for k in range(len(x))] == scores.argmax(axis=1).tolist()


def test_many_centroids(spark):
    rng = np.random.default_rng(5)
    cents, x = rng.normal(size=(10_000, 16)), rng.normal(size=(500, 16))
    table = spark.createDataFrame(pd.DataFrame({"k": range(10_000), "vec": cents.tolist()}))
    got = cl.assign_clusters(spark.createDataFrame(pd.DataFrame({"id": range(500), "vec": x.tolist()})), table).orderBy("id").toPandas()
    want = (x @ (cents / np.linalg.norm(cents, axis=1, keepdims=True)).T).argmax(axis=1)
    assert (got.cluster == want).all()


@pytest.mark.parametrize("missing", [False, True])
def test_resized_grid(spark, missing):
    rng = np.random.default_rng(6)
    hf, wf, h, w = 3, 4, 7, 9
    cells = {(i, j): rng.normal(size=6) for i in range(hf) for j in range(wf) if not (missing and (i, j) in {(0, 0), (0, 1), (1, 0), (2, 3)})}
    want = {}
    for oi in range(h):
        for oj in range(w):
            a, b = max((oi + 0.5) * hf / h - 0.5, 0.0), max((oj + 0.5) * wf / w - 0.5, 0.0)
            i, j, total, any_ = min(int(a), hf - 1), min(int(b), wf - 1), np.zeros(6), False
            for di, x in ((0, 1 - (a - i)), (1, a - i)):
                for dj, y in ((0, 1 - (b - j)), (1, b - j)):
                    cell = cells.get((min(i + di, hf - 1), min(j + dj, wf - 1)))
                    if cell is not None and x * y > 0:
                        total, any_ = total + x * y * cell, True
            if any_:
                want[oi, oj] = total / max(np.linalg.norm(total), 1e-12)
    df = spark.createDataFrame([(1, i, j, v.tolist()) for (i, j), v in cells.items()], "grid_id int, i int, j int, vec array<double>")
    got = {(r.i, r.j): r.vec for r in cl.upsample_grid(df, hf, wf, h, w).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, atol=1e-12)
