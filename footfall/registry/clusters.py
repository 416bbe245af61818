"""I: vectors and terrain clusters."""

from pyspark.sql import functions as F

from footfall.functions import vectors as vf
from footfall.operators import clusters as cl, ordered as o, raster as ra
from footfall.registry import fixtures as fx
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import GRID_AXIS, sql
from footfall.registry.raster import PV, points

NORM_SQL = "SELECT id, label, vec, list_transform(vec, lambda x: x / greatest(sqrt(list_sum(list_transform(vec, lambda y: y*y))), 1e-12)) u FROM fx_vec"
LONG = "SELECT id, CAST(generate_subscripts({v}, 1) - 1 AS INTEGER) AS d, unnest({v}) AS x FROM ({s})"


def _long(df, keys, vec):
    return df.select(*keys, F.posexplode(vec).alias("d", "x"))


@query("I1_l2_normalize", sql(f"SELECT id, d, {r('x')} FROM ({LONG.format(v='u', s=NORM_SQL)})", "fx_vec"))
def _(spark, sf):
    unit = fx.vectors(spark, sf).withColumn("u", vf.l2_normalize(F.col("vec")))
    return rounded(_long(unit, ["id"], "u"), ["id", "d"], ["x"])


CENTROIDS_SQL = """SELECT label k, list(x ORDER BY d) c FROM (SELECT label, d, avg(x) x FROM (
    SELECT label, generate_subscripts(vec, 1) d, unnest(vec) x FROM fx_vec) GROUP BY 1, 2) GROUP BY 1"""


def _centroids(spark, sf):
    means = _long(fx.vectors(spark, sf), ["label"], "vec").groupBy("label", "d").agg(F.avg("x").alias("x"))
    return means.groupBy(F.col("label").alias("k")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))


@query("I2_nearest_centroid", sql(
    "SELECT id, CAST(k AS BIGINT) AS cluster FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY "
    "list_dot_product(vec, c) / sqrt(list_dot_product(c, c)) DESC, k) n FROM fx_vec, centroids) WHERE n = 1",
    "fx_vec", centroids=CENTROIDS_SQL))
def _(spark, sf):
    return cl.assign_clusters(fx.vectors(spark, sf), _centroids(spark, sf)).select("id", "cluster")


W1 = [[((i * 7 + j * 3) % 11 - 5) / 10.0 for j in range(64)] for i in range(4)]
W2 = [[((i * 5 + j * 3) % 7 - 3) / 10.0 for j in range(4)] for i in range(3)]
B1, B2 = [0.1, -0.2, 0.3, 0.05], [0.5, 0.25, -0.1]


def _linear_sql(v, weight, bias):
    return "[" + ", ".join(f"list_dot_product({v}, {w}::DOUBLE[]) + ({b})" for w, b in zip(weight, bias)) + "]"


@query("I3_projection_head", sql(
    f"SELECT id, d, {r('x')} FROM (" + LONG.format(v="u", s="SELECT id, list_transform(y, lambda x: x / greatest(sqrt(list_dot_product(y, y)), 1e-12)) u "
    f"FROM (SELECT id, {_linear_sql('list_transform(h, lambda x: greatest(x, 0))', W2, B2)} y FROM (SELECT id, {_linear_sql('vec', W1, B1)} h FROM fx_vec))")
    + ")", "fx_vec"))
def _(spark, sf):
    out = fx.vectors(spark, sf).withColumn("u", vf.projection_head(F.col("vec"), [(W1, B1), (W2, B2)]))
    return rounded(_long(out, ["id"], "u"), ["id", "d"], ["x"])


TAPS_SQL = """SELECT k, CAST(floor(pos) AS INTEGER) lo, least(CAST(floor(pos) AS INTEGER) + 1, 4) hi, pos - floor(pos) f FROM (
    SELECT k, greatest((k + 0.5::DOUBLE) * 5 / 8 - 0.5, 0) pos FROM range(8) g(k)) s"""
UP_SQL = """SELECT t.g grid_id, a.k i, b.k j, v.d, sum((CASE WHEN v.i = a.lo THEN 1 - a.f ELSE 0 END + CASE WHEN v.i = a.hi THEN a.f ELSE 0 END)
      * (CASE WHEN v.j = b.lo THEN 1 - b.f ELSE 0 END + CASE WHEN v.j = b.hi THEN b.f ELSE 0 END) * v.x) x
    FROM (SELECT DISTINCT id // 25 g FROM fx_vec) t, taps a, taps b
    JOIN (SELECT id // 25 g, id % 25 // 5 i, id % 5 j, generate_subscripts(vec, 1) - 1 d, unnest(vec) x FROM fx_vec) v
      ON v.g = t.g AND (v.i = a.lo OR v.i = a.hi) AND (v.j = b.lo OR v.j = b.hi) GROUP BY 1, 2, 3, 4"""


@query("I4_upsample_grid", sql(
    "SELECT grid_id, CAST(i AS INTEGER) i, CAST(j AS INTEGER) j, CAST(d AS INTEGER) d, round(x / greatest(sqrt(sum(x*x) OVER (PARTITION BY grid_id, i, j)), 1e-12), 6) + 0.0 x FROM up",
    "fx_vec", taps=TAPS_SQL, up=UP_SQL))
def _(spark, sf):
    grid = fx.vectors(spark, sf).selectExpr("id DIV 25 AS grid_id", "CAST(id % 25 DIV 5 AS INT) AS i", "CAST(id % 5 AS INT) AS j", "vec")
    return rounded(_long(cl.upsample_grid(grid, 5, 5, 8, 8), ["grid_id", "i", "j"], "vec"), ["grid_id", "i", "j", "d"], ["x"])


SAMPLES_SQL = 'SELECT mission, l_orderkey, l_linenumber, v, CASE WHEN v > 10 THEN label END label FROM celled LEFT JOIN fx_cells USING (raster_id, "row", col)'
IV = dict(**PV, samples=SAMPLES_SQL)


def _samples(spark, sf):
    hit = ra.sample_nearest(points(spark, sf), fx.cells(spark, sf))
    return hit.select("mission", "l_orderkey", "l_linenumber", "v", F.when(F.col("v") > 10, F.col("label")).alias("label"))


@query("I5_cluster_label_per_sample", sql(
    "SELECT mission, l_orderkey, l_linenumber, CAST(label AS BIGINT) label FROM samples", "fx_cells", **IV))
def _(spark, sf):
    return _samples(spark, sf).select("mission", "l_orderkey", "l_linenumber", F.col("label").cast("long"))


@query("I6_cluster_count", sql(
    """SELECT mission, CAST(CASE WHEN mission % 4 = 0 THEN 9 WHEN mission % 4 = 1 THEN 50 WHEN mission % 4 = 2 THEN (SELECT max(label) FROM fx_cells) + 1
       ELSE max(label) + 1 END AS BIGINT) k FROM samples GROUP BY 1""", "fx_cells", **IV))
def _(spark, sf):
    seen = _samples(spark, sf).groupBy("mission").agg(F.max("label").alias("seen")).withColumn("raster_id", F.lit("dem"))
    tops = seen.join(ra.label_maximum(fx.cells(spark, sf)), "raster_id")
    case = F.col("mission") % 4
    k = cl.cluster_count(F.when(case == 0, F.lit(9)), F.when(case == 1, F.lit("dem_cluster_kmeans50.tif")).otherwise(F.lit("dem.tif")),
                         F.when(case == 2, F.col("max_label")), F.col("seen"))
    return tops.select("mission", k.cast("long").alias("k"))


STATS_SQL = """SELECT label, count(*) samples, avg(v) mean, coalesce(stddev_samp(v), 0) std, quantile_cont(v, 0.5) median
    FROM samples WHERE label IS NOT NULL AND v IS NOT NULL GROUP BY 1"""
STATS = ["mean", "std", "median"]


@query("I7_cluster_statistics", sql(f"SELECT label, samples, {r(*STATS)} FROM ({STATS_SQL})", "fx_cells", **IV))
def _(spark, sf):
    return rounded(cl.cluster_statistics(_samples(spark, sf), "v"), ["label", "samples"], STATS)


@query("I8_empty_clusters", sql(
    """SELECT count(DISTINCT label) observed, count(*) samples, count(DISTINCT mission) missions, CAST(9 AS BIGINT) clusters,
       greatest(0, 9 - count(DISTINCT label)) AS "empty" FROM samples WHERE label IS NOT NULL""", "fx_cells", **IV))
def _(spark, sf):
    samples = _samples(spark, sf)
    counts = samples.groupBy("mission").agg((F.lit(8) + F.max(F.col("mission") % 2)).alias("k"))
    return cl.empty_clusters(samples, "v", counts)


@query("I9_top_clusters", sql(
    f"SELECT label, samples, {r('mean')} FROM ({STATS_SQL}) ORDER BY samples DESC, label LIMIT 3", "fx_cells", **IV))
def _(spark, sf):
    return rounded(cl.top_clusters(cl.cluster_statistics(_samples(spark, sf), "v"), 3), ["label", "samples"], ["mean"])


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query("I10_box_statistics", sql(
    f"""SELECT label, {r(*BOX)} FROM (SELECT label, q1, median, q3, min(CASE WHEN v >= q1 - 1.5*(q3-q1) THEN v END) whisker_low,
    max(CASE WHEN v <= q3 + 1.5*(q3-q1) THEN v END) whisker_high FROM samples JOIN (SELECT label, quantile_cont(v, 0.25) q1,
    quantile_cont(v, 0.5) median, quantile_cont(v, 0.75) q3 FROM samples WHERE label IS NOT NULL GROUP BY 1) USING (label)
    GROUP BY 1, 2, 3, 4)""", "fx_cells", **IV))
def _(spark, sf):
    return rounded(cl.box_statistics(_samples(spark, sf), "v"), ["label"], BOX)


RUNS_SQL = """SELECT mission, min(k) start_row, max(k) + 1 end_row, any_value(label) label FROM (SELECT *, sum(n) OVER (PARTITION BY mission ORDER BY k
    ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, CASE WHEN k > 0 AND label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY mission ORDER BY k)
    THEN 0 ELSE 1 END n FROM labelled)) WHERE label IS NOT NULL GROUP BY mission, island"""
LABELLED_SQL = "SELECT *, CAST(floor(x / 20) AS BIGINT) label, row_number() OVER (PARTITION BY mission ORDER BY t_h) - 1 k FROM fx_grid"


def _labelled(spark, sf):
    return fx.grid(spark, sf).withColumn("label", F.floor(F.col("x") / 20).cast("long"))


@query("I11_label_runs", sql(RUNS_SQL, "fx_grid", labelled=LABELLED_SQL))
def _(spark, sf):
    return cl.label_runs(_labelled(spark, sf), GRID_AXIS, "label")


EDGE_SQL = """SELECT mission, k, t_h - coalesce(t_h - lag(t_h) OVER w, lead(t_h) OVER w - t_h, 1.0) / 2 left_edge,
    t_h + coalesce(lead(t_h) OVER w - t_h, t_h - lag(t_h) OVER w, 1.0) / 2 right_edge FROM labelled WINDOW w AS (PARTITION BY mission ORDER BY k)"""


@query("I12_run_bounds", sql(
    f"""SELECT q.mission, start_row, label, round(a.left_edge, 6) + 0.0 x0, round(b.right_edge, 6) + 0.0 x1 FROM ({RUNS_SQL}) q
    JOIN edges a ON a.mission = q.mission AND a.k = start_row JOIN edges b ON b.mission = q.mission AND b.k = end_row - 1""",
    "fx_grid", labelled=LABELLED_SQL, edges=EDGE_SQL))
def _(spark, sf):
    rows = _labelled(spark, sf)
    runs = cl.label_runs(rows, GRID_AXIS, "label")
    edges = o.positions(cl.step_edges(rows, GRID_AXIS, "t_h"), GRID_AXIS, "k").select("mission", "k", "left_edge", "right_edge")
    first = edges.select("mission", F.col("k").alias("start_row"), F.col("left_edge").alias("x0"))
    last = edges.select("mission", (F.col("k") + 1).alias("end_row"), F.col("right_edge").alias("x1"))
    return rounded(runs.join(first, ["mission", "start_row"]).join(last, ["mission", "end_row"]),
                   ["mission", "start_row", "label"], ["x0", "x1"])
