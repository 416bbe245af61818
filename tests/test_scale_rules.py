"""Results must not depend on how a recording is cut into chunks, nor on how its rows are spread."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall import session
from footfall.operators import alignment as al, filters as fl, frames as fr, ordered as o, patches as pa
from footfall.operators import quantiles as qu
from footfall.operators.ordered import Axis
from footfall.operators.quantiles import quantiles
from footfall.registry import load_all
from footfall.registry.base import QUERIES
from footfall.sources import messages as ms

WIDTHS = (3.0, 1e9)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    frame = pd.DataFrame({
        # one recording holds most rows
        "g": np.where(rng.random(n) < 0.8, 1, 2), "t": np.round(np.cumsum(rng.random(n)), 3),
        "x": np.where(rng.random(n) < 0.3, np.nan, np.round(rng.normal(size=n), 3)), "seq": np.arange(n)})
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df.persist(), frame


def collected(df):
    return df.orderBy("g", "t").toPandas()


def test_running_columns(table):
    df, frame = table
    want = frame.sort_values(["g", "t"]).reset_index(drop=True)
    groups = want.groupby("g")
    for width in WIDTHS:
        got = collected(o.running(df, Axis(("g",), "t", width, ("seq",)), prev=o.lag("x"), nxt=o.lead("seq"), k=o.row_index(),
                                  total=o.running_sum(F.coalesce("x", F.lit(0.0))), top=o.running_max("x"), back=o.last_valid("x"),
                                  ahead=o.next_valid("x"), first=o.group_first("x", valid_only=True)))
        pd.testing.assert_series_equal(got.prev, groups.x.shift(), check_names=False)
        pd.testing.assert_series_equal(got.nxt, groups.seq.shift(-1), check_names=False)
        assert (got.k == groups.cumcount()).all()
        np.testing.assert_allclose(got.total, want.x.fillna(0).groupby(want.g).cumsum(), atol=1e-9)
        pd.testing.assert_series_equal(got.back, groups.x.ffill(), check_names=False)
        pd.testing.assert_series_equal(got.ahead, groups.x.bfill(), check_names=False)
        np.testing.assert_allclose(got.top, groups.x.cummax().groupby(want.g).ffill(), equal_nan=True)
        assert (got["first"] == groups.x.transform("first")).all()


def test_framed_blocks(table):
    df, frame = table
    want = frame.sort_values(["g", "t"]).groupby("g").x.rolling(5, min_periods=1, center=True).median().reset_index(drop=True)
    axis = Axis(("g",), "t", 20.0, ("seq",))
    for rows in (6, 100_000):
        got = collected(o.framed(df, axis, 2, 2, lambda d, w: d.withColumn(
            "m", F.percentile("x", F.lit(0.5)).over(w.rowsBetween(-2, 2))), block_rows=rows))
        np.testing.assert_allclose(got.m, want, equal_nan=True)


def test_asof_against_pandas(spark, table):
    df, frame = table
    left = pd.DataFrame({"g": [1, 2] * 60, "t": np.repeat(np.arange(0.0, 180.0, 3.0), 2)})
    right = frame[frame.x.notna()].sort_values("t")[["g", "t", "x"]]
    for direction in ("nearest", "backward", "forward"):
        want = pd.merge_asof(left.sort_values("t"), right, on="t", by="g", direction=direction, tolerance=0.7)
        want = want.sort_values(["g", "t"]).reset_index(drop=True)
        for width in WIDTHS:
            got = collected(al.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), Axis(("g",), "t", width), direction, 0.7))
            np.testing.assert_allclose(got.x, want.x, equal_nan=True)


def test_ema_against_pandas(table):
    df, frame = table
    ordered = frame.sort_values(["g", "t"])
    for adjust in (False, True):
        want = ordered.groupby("g").x.transform(lambda s: s.ewm(alpha=0.3, adjust=adjust).mean())
        got = collected(fl.apply_chain(df, Axis(("g",), "t", 7.0, ("seq",)), "x", {"type": "ema", "alpha": 0.3, "adjust": adjust}))
        np.testing.assert_allclose(got.x, want, equal_nan=True, atol=1e-12)


@pytest.mark.parametrize("alpha", [1.0, 0.9, 0.3, 0.002, 1e-7])
def test_recurrence_in_blocks(spark, alpha):
    """Blocks of a few rows, several levels of them, slow and fast decay, gaps in which everything is forgotten."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": np.repeat([1, 2, 3], [3000, 40, 1]), "x": rng.normal(size=3041) + 5})
    frame["r"] = frame.groupby("g").cumcount()
    frame["k"] = np.where(frame.r == 0, 0.0, np.where(rng.random(3041) < 0.01, 1e-200, 1 - alpha))
    want, state = [], 0.0
    for k, x in zip(frame.k, frame.x, strict=True):
        state = k * state + x
        want.append(state)
    for rows in (7, 500, 10_000):
        got = fl.recurrence(spark.createDataFrame(frame.rename(columns={"x": "y"})), ["g"], "r", "k", ["y"], rows).orderBy("g", "r").toPandas()
        np.testing.assert_allclose(got.y, want, rtol=1e-11)


def test_ema_of_a_long_recording(spark):
    """A million rows, nulls and gaps, equal to pandas and without Python on the executors."""
    rng = np.random.default_rng(12)
    x = np.where(rng.random(1_000_000) < 0.1, np.nan, rng.normal(size=1_000_000))
    x[400_000:405_000] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(1e6), "x": x})).selectExpr("1 AS g", "t", "nullif(x, double('nan')) AS x")
    for alpha in (0.3, 0.0005):
        out = fl.ema(df, Axis(("g",), "t", 50_000.0), "x", fl.Stage(fl.Kind.EMA, alpha=alpha))
        assert "Pandas" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = out.orderBy("t").toPandas()
        np.testing.assert_allclose(got.x, pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), equal_nan=True, atol=1e-10)


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"g": (rng.random(60_000) < 0.05).astype(int), "v": np.round(rng.exponential(size=60_000), 4)})
    got = quantiles(spark.createDataFrame(frame), ["g"], "v", [0.05, 0.5, 0.95], list("abc")).toPandas().set_index("g").sort_index()
    want = frame.groupby("g").v.quantile([0.05, 0.5, 0.95]).unstack()
    np.testing.assert_allclose(got[list("abc")], want, atol=1e-12)


@pytest.mark.parametrize(("margin", "inside"), [(0.001, 2_000_000), (-0.05, 2_000_000), (0.001, 50), (-0.2, 20), (0.5, 200)])
def test_quantiles_are_narrowed_until_they_are_right(spark, monkeypatch, margin, inside):
    """First brackets that miss their rank (a negative margin), and brackets that hold too many values, still end at the exact value."""
    monkeypatch.setattr(qu, "MARGIN", margin)
    monkeypatch.setattr(qu, "INSIDE", inside)
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"g": np.repeat(["a", "b", "c", "d", "e"], [20_000, 3000, 1, 2, 500]), "v": np.concatenate([
        rng.lognormal(0, 8, 20_000), np.where(rng.random(3000) < 0.7, 4.0, rng.normal(size=3000)), [5.0], [1.0, 2.0], np.full(500, 3.0)])})
    probs = [0.0, 0.05, 0.5, 0.777, 0.95, 1.0]
    df = spark.createDataFrame(frame.sort_values("v")).repartitionByRange(4, "v")
    names = [f"q{k}" for k in range(len(probs))]
    got = qu.quantiles(df, ["g"], "v", probs, names).toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(got[names], frame.groupby("g").v.quantile(probs).unstack(), rtol=1e-12)
    whole = qu.quantiles(df, [], "v", [0.5], ["m"]).first()[0]
    assert whole == pytest.approx(frame.v.median(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "g int, v double")
    assert qu.quantiles(empty, ["g"], "v", [0.5], ["m"]).collect() == []
    assert qu.quantiles(empty, [], "v", [0.5], ["m"]).collect() in ([], [(None,)])


def greedy_centers(d, stride):
    out, target = [], d[0]
    while True:
        k = int(np.searchsorted(d, target))
        if k >= len(d):
            return out
        out.append(d[k])
        target = d[k] + stride


@pytest.mark.parametrize(("block_rows", "fanout"), [(1, 2), (7, 3), (20, 64), (100_000, 64)])
def test_patch_centers_do_not_depend_on_blocks(spark, block_rows, fanout):
    rng = np.random.default_rng(11)
    frames, want = [], {}
    for g, jump in ((1, 0.4), (2, 9.0), (3, 0.01), (4, 0.0)):
        d = np.round(np.cumsum(rng.random(300) * jump * (rng.random(300) < 0.8)), 4)
        frames.append(pd.DataFrame({"g": g, "t": np.arange(300.0), "dist_run": d}))
        want[g] = greedy_centers(d, 2.5)
    df = spark.createDataFrame(pd.concat(frames))
    got = pa.patch_centers(df, Axis(("g",), "t", 50.0), 2.5, block_rows=block_rows, fanout=fanout).toPandas()
    for g, expected in want.items():
        assert sorted(got[got.g == g].center_dist) == pytest.approx(expected)


def test_short_recordings_share_a_task(spark):
    """Many recordings of one block: a task streams through them, and Python is not called once for each."""
    rng = np.random.default_rng(12)
    frame = pd.DataFrame({"g": np.repeat(np.arange(700), 20), "t": np.tile(np.arange(20.0), 700), "dist_run": np.round(rng.random(14_000) * 3, 2)})
    frame["dist_run"] = frame.groupby("g").dist_run.cumsum().round(2)
    found = pa.patch_centers(spark.createDataFrame(frame), Axis(("g",), "t", 50.0), 2.5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = found.toPandas().groupby("g").center_dist.apply(sorted)
    for g, rows in frame.groupby("g"):
        assert got[g] == greedy_centers(rows.dist_run.to_numpy(), 2.5)


def test_a_row_at_half_a_patch_is_a_member(spark):
    """Ten metres from the centre in sums that were added up in different orders."""
    rows = spark.createDataFrame([(1, 0.0, 1103.1 - 1e-12), (1, 1.0, 1113.1 + 1e-12), (1, 2.0, 1113.1 + 1e-5)], "m int, t double, dist_run double")
    centers = spark.createDataFrame([(1, 7, 1103.1)], "m int, patch_id int, center_dist double")
    assert sorted(r.t for r in pa.members_in_distance(rows, centers, ["m"], 20.0).collect()) == [0.0, 1.0]


def test_one_recording_is_many_blocks(spark):
    """A million distances of one recording: no task gets more rows than a block has."""
    n = 1_000_000
    df = spark.range(n).selectExpr("1 AS g", "double(id) AS t", "id * 0.01D AS dist_run")
    numbered = df.withColumn("_blk", F.floor(F.col("t") / pa.BLOCK_ROWS))
    assert numbered.groupBy("_blk").count().agg(F.max("count")).first()[0] <= pa.BLOCK_ROWS
    got = pa.patch_centers(df, Axis(("g",), "t", 10_000.0), 2.5).select("center_dist").toPandas().center_dist.sort_values()
    np.testing.assert_allclose(got, greedy_centers(np.arange(n) * 0.01, 2.5))


def test_members_of_a_robot_at_rest(spark):
    """Nine of ten rows in one bucket: they are dealt out by their number, and the result is the same."""
    rng = np.random.default_rng(4)
    n = 4000
    rest = rng.random(n) < 0.9
    frame = pd.DataFrame({"m": 1, "t": np.arange(n, dtype=float), "x": np.where(rest, 3.1, rng.random(n) * 200), "y": np.where(rest, 4.2, rng.random(n) * 40)})
    frame["dist_run"] = np.where(rest, 77.0, frame.x)
    centers = pd.DataFrame({"m": 1, "patch_id": np.arange(80), "center_e": np.arange(80) * 2.5, "center_n": 5.0, "center_dist": np.arange(80) * 2.5})
    rows, cs = spark.createDataFrame(frame), spark.createDataFrame(centers)
    square = {(t, k) for t, x, y in zip(frame.t, frame.x, frame.y) for k in range(80) if abs(x - k * 2.5) <= 5 and abs(y - 5) <= 5}
    along = {(t, k) for t, d in zip(frame.t, frame.dist_run) for k in range(80) if abs(d - k * 2.5) <= 5}
    for limit in (100, 10**9):
        got = pa.members_in_square(rows, cs, ["m"], 10.0, "x", "y", rows_per_task=limit)
        assert {(r.t, r.patch_id) for r in got.collect()} == square and got.count() == len(square)
        assert {(r.t, r.patch_id) for r in pa.members_in_distance(rows, cs, ["m"], 10.0, rows_per_task=limit).collect()} == along
    placed = rows.withColumn("_b", F.floor(F.col("dist_run") / 10.0))
    spread = cs.select("m", "patch_id", "center_dist").withColumn("_b", F.floor(F.col("center_dist") / 10.0))
    parts = pa._bucket_join(placed, spread, ["m", "_b"], "t", 100).where("_b = 7").groupBy("_part").agg(F.countDistinct("t").alias("n")).collect()
    assert len(parts) >= 36 and max(r.n for r in parts) < 200  # about 100 rows each
    quiet = pa._bucket_join(placed, spread, ["m", "_b"], "t", 100).where("_b = 3").agg(F.max("_part")).first()[0]
    assert quiet == 0  # centres elsewhere are not repeated


def test_thinning_against_a_loop(spark):
    rng = np.random.default_rng(3)
    # long stretches of tiny drift between real moves
    angle = np.cumsum(np.where(rng.random(500) < 0.1, 0.01, 2e-6))
    q = np.column_stack([np.cos(angle), np.zeros(500), np.zeros(500), np.sin(angle)])
    frame = pd.DataFrame(q, columns=["qw", "qx", "qy", "qz"]).assign(g=1, t=np.arange(500.0), _when=np.arange(500.0), is_static=False)
    kept, last = [], None
    for k, row in enumerate(q):
        if last is None or not (np.allclose(row, last, atol=1e-6) or np.allclose(row, -last, atol=1e-6)):
            kept.append(float(k))
            last = row
    got = fr.thin_changes(spark.createDataFrame(frame), Axis(("g",), "t", 60.0)).toPandas()
    assert sorted(got.t) == kept


def kept_patches(frame, inside):
    kept = []
    for p in frame.sort_values("patch_index").itertuples():
        if not any(inside(p, k) for k in kept):
            kept.append(p)
    return [k.patch_index for k in kept]


def in_space(p, k):
    return abs(p.center_e - k.center_e) <= 2.5 and abs(p.center_n - k.center_n) <= 2.5 and p.t_start >= k.t_start and p.t_end <= k.t_end


def in_time(p, k):
    return p.t_start >= k.t_start - 1e-3 and p.t_end <= k.t_end + 1e-3


@pytest.mark.parametrize("length", [3.0, 20.0, 200.0])
def test_kept_patches_do_not_contain_one_another(spark, length):
    rng = np.random.default_rng(2)
    n = 150
    start = np.round(rng.random(n) * 50, 1)
    frame = pd.DataFrame({"mission": 1, "patch_index": rng.permutation(n), "center_e": rng.integers(0, 6, n) * 2.0, "center_n": rng.integers(0, 3, n) * 2.0,
                          "t_start": start, "t_end": start + np.round(rng.random(n) * length, 1) + rng.integers(0, 3, n) * 5e-4})
    df = spark.createDataFrame(frame)
    for chunk in (4.0, 1e6):
        assert sorted(r.patch_index for r in pa.drop_contained(df, 5.0, chunk).collect()) == sorted(kept_patches(frame, in_space))
        assert sorted(r.patch_index for r in pa.drop_time_subsets(df, chunk).collect()) == sorted(kept_patches(frame, in_time))


def test_patches_without_spans_stay(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 10.0), (1, 1, None, 0.0, 1.0, 2.0), (1, 2, 0.0, 0.0, None, 2.0), (1, 3, 0.0, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "mission int, patch_index int, center_e double, center_n double, t_start double, t_end double")
    assert sorted(r.patch_index for r in pa.drop_contained(df, 5.0).collect()) == [0, 1, 2]
    assert sorted(r.patch_index for r in pa.drop_time_subsets(df).collect()) == [0, 2]


def test_a_chain_of_nested_patches_takes_few_jobs(spark):
    """Each patch lies in the one before it in time and near it in space: kept and dropped ones alternate along the chain."""
    n = 1000
    frame = pd.DataFrame({"mission": 1, "patch_index": np.arange(n), "center_e": np.arange(n) * 2.0, "center_n": 0.0,
                          "t_start": np.arange(n) * 1.0, "t_end": 5000.0 - np.arange(n)})
    spark.sparkContext.setJobGroup("nested", "nested")
    got = sorted(r.patch_index for r in pa.drop_contained(spark.createDataFrame(frame), 5.0).collect())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("nested")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted(kept_patches(frame, in_space)) and len(got) == n // 2
    assert len(jobs) < 40


@pytest.mark.parametrize("name, most", [("A9_joint_pivot", 2_000), ("A8_joint_flatten", 8_000)])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_tasks_on_joint_messages_do_not_follow_the_input(spark, monkeypatch, name, most, threshold):
    load_all()
    monkeypatch.setattr(session, "TASK_ROWS", 10**9, raising=False)
    whole = QUERIES[name](spark, "/root/testdata/sf0.01").persist()
    monkeypatch.setattr(session, "TASK_ROWS", 5_000, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        dealt = QUERIES[name](spark, "/root/testdata/sf0.01")
        tasks = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) == 15 and max(tasks) < most  # 75,000 rows
        assert dealt.exceptAll(whole).isEmpty() and sum(tasks) == whole.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        whole.unpersist()


def test_placed_messages_are_not_shuffled_again(spark):
    rows = [(g, None if i % 40 == 0 else float(i % 7), i, ["a", "b"][:1 + i % 2], [i * 1.0, None if i % 3 else i * 2.0], [i * 3.0], [None, i * 1.0])
            for g in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "mission long, t double, seq long, name array<string>, position array<double>, "
                                     "velocity array<double>, effort array<double>").repartition(3)
    placed = ms.pivot_joints(ms.flatten_joints(ms.place_messages(df, 5)), ["a", "b"])
    free = ms.pivot_joints(ms.flatten_joints(df), ["a", "b"])
    assert placed.count() == free.count() == 16 and placed.exceptAll(free).isEmpty()
    for out in (placed, free):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
