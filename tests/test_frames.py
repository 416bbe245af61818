"""Orientation paths over the edges seen so far, against a search from scratch at every update."""

import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import frames as fr
from footfall.operators.ordered import Axis

AXIS = Axis(("mission",), "t", 7.0, ("seq",))


def product(a, b):
    w, x, y, z = a
    return np.array([w * b[0] - x * b[1] - y * b[2] - z * b[3], w * b[1] + x * b[0] + y * b[3] - z * b[2],
                     w * b[2] - x * b[3] + y * b[0] + z * b[1], w * b[3] + x * b[2] - y * b[1] + z * b[0]])


def brute(rows, worlds, base):
    """(seq, rank, q) at every update from which a path exists; rows are (seq, is_static, t, parent, child, q)."""
    latest, near, out = {}, {}, []
    for seq, _, _, parent, child, q in sorted(rows, key=lambda r: (not r[1], r[2], r[0])):
        latest[parent, child] = np.array(q)
        near.setdefault(parent, set()).add(child)
        near.setdefault(child, set()).add(parent)
        for rank, world in enumerate(worlds):
            if world not in near or base not in near:
                continue
            paths, queue = {world: (world,)}, deque([world])
            level = [world]
            while level and base not in paths:  # alphabetically first among the shortest: extend whole levels
                found = {}
                for frame in level:
                    for other in near[frame]:
                        if other not in paths:
                            found[other] = min(found.get(other, (*paths[frame], other)), (*paths[frame], other))
                paths |= found
                level = list(found)
            if base not in paths:
                continue
            total = np.array([1.0, 0, 0, 0])
            for a, b in zip(paths[base][:-1], paths[base][1:]):
                hop = latest.get((a, b))
                total = product(total, hop if hop is not None else latest[b, a] * [1, -1, -1, -1])
            total /= np.linalg.norm(total)
            out.append((seq, rank, total if total[0] >= 0 else -total))
            break
    return out


def compare(spark, missions, worlds, base):
    frame = pd.DataFrame([(m, s, st, t, p, c, *q) for m, rows in missions.items() for s, st, t, p, c, q in rows],
                         columns=["mission", "seq", "is_static", "t", "parent", "child", *fr.Q])
    got = fr.compose_orientation(spark.createDataFrame(frame).repartition(5), worlds, base, AXIS).toPandas()
    for m, rows in missions.items():
        want = brute(rows, worlds, base)
        mine = got[got.mission == m].set_index("seq")
        assert sorted(mine.index) == sorted(s for s, _, _ in want)
        for seq, rank, q in want:
            assert mine.world_rank[seq] == rank
            np.testing.assert_allclose(mine.loc[seq, list(fr.Q)].astype(float), q, atol=1e-9)


def turned(r):
    q = np.array([r.gauss(0, 1) for _ in range(4)])
    return tuple(float(x) for x in q / np.linalg.norm(q))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_meshes(spark, seed):
    """Edges of a mesh appear over time, both ways, some static: paths change, and better worlds come later."""
    r = random.Random(seed)
    missions = {}
    for m in range(4):
        edges = r.sample([(a, b) for a in "abcdefg" for b in "abcdefg" if a != b], 14)
        rows, known = [], []
        for seq in range(120):
            if len(known) < len(edges) and (not known or r.random() < 0.15):
                known.append(edges[len(known)])
            edge = known[-1] if r.random() < 0.3 else r.choice(known)
            rows.append((seq, r.random() < 0.05, round(seq * 0.5 + r.random(), 3), *edge, turned(r)))
        missions[m] = rows
    compare(spark, missions, ["g", "f", "a"], "d")


def test_late_shortcut_and_late_world(spark):
    chain = [("world", "a"), ("a", "b"), ("b", "base")]
    rows, seq = [], 0
    r = random.Random(9)
    for step in range(60):
        edges = chain + ([("base", "world")] if step >= 30 else []) + ([("map", "b")] if step >= 45 else [])
        for edge in edges:
            rows.append((seq, False, float(step) + 0.1 * (seq % 7), *edge, turned(r)))
            seq += 1
    compare(spark, {1: rows, 2: rows[: len(rows) // 2]}, ["map", "world"], "base")


def test_full_mesh_of_twelve_frames(spark):
    names = [f"f{k:02d}" for k in range(12)]
    r = random.Random(4)
    rows = [(k, False, float(k), a, b, turned(r)) for k, (a, b) in enumerate((a, b) for a in names for b in names if a < b)]
    compare(spark, {1: rows}, ["f11"], "f00")


def test_world_is_the_base(spark):
    rows = [(k, False, float(k), "base", "x", turned(random.Random(k))) for k in range(3)]
    compare(spark, {1: rows}, ["base"], "base")


def test_no_path(spark):
    rows = [(0, False, 0.0, "a", "b", (1.0, 0, 0, 0))]
    frame = pd.DataFrame([(1, 0, False, 0.0, "a", "b", 1.0, 0.0, 0.0, 0.0)], columns=["mission", "seq", "is_static", "t", "parent", "child", *fr.Q])
    df = spark.createDataFrame(frame)
    assert brute(rows, ["w"], "b") == [] and fr.compose_orientation(df, ["w"], "b", AXIS).isEmpty()
    assert fr.compose_orientation(df.limit(0), ["a"], "b", AXIS).isEmpty()


def test_imu_is_tried_only_for_the_retried_world(spark):
    """The wanted world is reached through the IMU alone; asked for under another name it is not looked for there."""
    for wanted, rank in (("enu_origin", 1), ("site", 0)):
        rows = [(k, k * 1.0, p, c) for k, (p, c) in enumerate([("map", "base"), (wanted, "imu")] * 5)]
        frame = pd.DataFrame([(1, s, False, t, p, c, *turned(random.Random(s))) for s, t, p, c in rows],
                             columns=["mission", "seq", "is_static", "t", "parent", "child", *fr.Q])
        got = fr.orientation_table(spark.createDataFrame(frame), AXIS, "base", wanted, imu_frame="imu")
        assert {r["source_rank"] for r in got.select("source_rank").distinct().collect()} == {rank}
        assert got.where(F.col("qw_map").isNotNull()).isEmpty() == (rank == 0)
