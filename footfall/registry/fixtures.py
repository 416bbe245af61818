"""Views that give the driver tables the shape of telemetry, as Spark DataFrames and as DuckDB CTEs.

A "mission" is a user of the event log, so the scale is hours, not milliseconds. Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.operators.ordered import Axis
from footfall.session import parts_for

# five days: a recording of the event log spans several chunks
CHUNK_SECONDS = 432_000.0
EPOCH = 1704067200

STREAM_AXIS = Axis(("mission",), "t", CHUNK_SECONDS, ("seq",))
GRID_AXIS = Axis(("mission",), "t_h", CHUNK_SECONDS / 3600.0)
GEO_AXIS = Axis(("mission",), "t", 256.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stream(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id AS mission",
        "event_type AS stream",
        "event_id AS seq",
        f"unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 - {EPOCH} AS t",
        "value AS v",
    )


_H = "(seq % 360) * 0.5 * 0.017453292519943295"
MOTION_COLUMNS = {
    "v_cmd_x": "CASE WHEN seq % 23 = 0 THEN NULL ELSE (seq % 17) / 10.0 END",
    "v_cmd_y": "(seq % 5) / 20.0",
    "w_cmd_z": "(seq % 13 - 6) / 10.0",
    "vx": "CASE WHEN seq % 29 = 0 THEN NULL ELSE (seq * 3 % 19) / 10.0 END",
    "vy": "(seq % 7) / 20.0",
    "x": "(seq * 7 % 101) / 2.0",
    "y": "(seq * 11 % 97) / 2.0",
    "qd_a": "(seq % 11 - 5) / 4.0",
    "qd_b": "CASE WHEN seq % 31 = 0 THEN NULL ELSE (seq % 9 - 4) / 2.0 END",
    "tau_a": "v / 10.0",
    "tau_b": "(seq % 15 - 7) * 1.5",
    "qw_WB": f"cos({_H})",
    "qx_WB": "0",
    "qy_WB": "0",
    "qz_WB": f"sin({_H})",
}


def motion(spark: SparkSession, sf: str) -> DataFrame:
    return stream(spark, sf).selectExpr(
        "mission", "seq", "t", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in MOTION_COLUMNS.items()]
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = stream(spark, sf).groupBy("mission", F.floor(F.col("t") / 21600).cast("long").alias("i"))
    return cells.agg(F.when(F.count("*") % 4 != 3, F.avg("v")).alias("x")).select(
        "mission", "i", (F.col("i") * 6).cast("double").alias("t_h"), "x"
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    z = table(spark, sf, "lineitem").groupBy(
        (F.col("l_orderkey") % 48).cast("int").alias("row"), (F.col("l_partkey") % 48).cast("int").alias("col")
    ).agg((F.avg("l_extendedprice") / 1000).alias("z"))
    return z.select(
        F.lit("dem").alias("raster_id"), "row", "col",
        F.expr("CASE WHEN (row * 5 + col) % 97 <> 0 THEN z END").alias("z"),
        F.expr("(row * 7 + col * 3) % 6").cast("int").alias("label"),
    )


def georef(spark: SparkSession, sf: str) -> DataFrame:
    """Placement of the elevation raster, sized from its own cells."""
    return cells(spark, sf).groupBy("raster_id").agg(
        F.lit(0.5).alias("a"), F.lit(0.0).alias("c"), F.lit(-0.5).alias("e"), F.lit(24.0).alias("f"),
        F.lit(48).alias("h"), F.lit(48).alias("w"),
    )


def geo(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.select(
        F.col("l_suppkey").alias("mission"),
        F.row_number().over(order).cast("long").alias("i"),
        (47.0 + (F.col("l_orderkey") % 1000) * 1e-6).alias("lat"),
        (8.0 + (F.col("l_partkey") % 1000) * 1e-6).alias("lon"),
        F.col("l_quantity").cast("double").alias("v"),
        "l_orderkey",
    ).withColumn("t", F.col("i").cast("double"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def transforms(spark: SparkSession, sf: str) -> DataFrame:
    edges = {"click": ("world", "odom"), "view": ("odom", "base"), "purchase": ("base", "imu")}
    turn = F.col("seq") % 180 * F.lit(0.008726646259971648)

    def pick(k):
        return F.coalesce(*[F.when(F.col("stream") == s, F.lit(e[k])) for s, e in edges.items()],
                          F.lit(("base", "lidar")[k]))

    return stream(spark, sf).select(
        "mission", "seq", (F.col("stream") == "purchase").alias("is_static"), "t",
        pick(0).alias("parent"), pick(1).alias("child"),
        F.cos(turn).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(turn).alias("qz"),
    )


def joint_parts(spark: SparkSession, sf: str) -> int:
    """Parts for the joint messages, by the rows they are made of (known from the footers of the files)."""
    return parts_for(spark, table(spark, sf, "orders").count() + table(spark, sf, "lineitem").count())


def joint_messages(spark: SparkSession, sf: str, parts: int) -> DataFrame:
    # joined, collected and sorted in one stage: parts by rows keep its tasks small (a sort-merge join takes the
    # session's number of parts where that is larger)
    lines = table(spark, sf, "lineitem").repartition(parts, "l_orderkey").join(
        table(spark, sf, "orders").repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("mission"), F.col("o_orderkey").alias("seq")).agg(
        F.sort_array(F.collect_list(F.concat(F.lit("j"), F.col("l_linenumber").cast("string")))).alias("names"),
        F.sort_array(F.collect_list(F.col("l_quantity").cast("double"))).alias("pos"),
    ).withColumn("t", F.col("seq").cast("double"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id AS mission", "concat('/', event_type) AS topic", "event_id AS seq",
        "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS log_ns",
        "CASE WHEN event_id % 7 = 0 THEN 0 ELSE unix_micros(CAST(ts AS TIMESTAMP)) * 1000 - 5000000 END AS stamp_ns",
        "props AS payload", "value",
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).selectExpr("c_custkey AS id", "c_name AS name", "split_part(c_name, '#', 2) AS folder",
                 "c_mktsegment AS kind", "n_name AS alias")


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id AS mission", "concat('/', event_type, '/', CAST(event_id % 3 AS STRING)) AS topic").distinct()


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id",
        "concat('synced_', CAST(5 + doc_id % 3 * 5 AS STRING), 'Hz', "
        "CASE WHEN doc_id % 2 = 0 THEN '_metrics' ELSE '' END, '.parquet') AS name",
        "n_chars AS mtime", "source AS dir",
    )


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey % 20 AS e_km", "l_suppkey % 5 AS n_km", "2019 + l_linenumber % 4 AS year",
        "CAST(CASE WHEN l_quantity < 25 THEN 0.5 ELSE 2.0 END AS DOUBLE) AS res_m").distinct()


VIEWS = {
    "fx_stream": f"""SELECT user_id mission, event_type stream, event_id seq,
        epoch_us(ts) / 1e6 - {EPOCH} t, value v FROM events""",
    "fx_motion": "SELECT mission, seq, t, "
    + ", ".join(f"CAST({e} AS DOUBLE) {c}" for c, e in MOTION_COLUMNS.items())
    + " FROM fx_stream",
    "fx_grid": """SELECT mission, i, CAST(i * 6 AS DOUBLE) t_h, x FROM (
        SELECT mission, CAST(floor(t / 21600) AS BIGINT) i,
               CASE WHEN count(*) % 4 = 3 THEN NULL ELSE avg(v) END x
        FROM fx_stream GROUP BY 1, 2)""",
    "fx_cells": """SELECT 'dem' raster_id, "row", col,
        CASE WHEN ("row" * 5 + col) % 97 = 0 THEN NULL ELSE z END z, ("row" * 7 + col * 3) % 6 AS label FROM (
        SELECT CAST(l_orderkey % 48 AS INTEGER) "row", CAST(l_partkey % 48 AS INTEGER) col,
               avg(l_extendedprice) / 1000 z FROM lineitem GROUP BY 1, 2)""",
    "fx_geo": """SELECT l_suppkey mission, row_number() OVER (PARTITION BY l_suppkey
          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) i,
        47.0::DOUBLE + (l_orderkey % 1000) * 1e-6 lat, 8.0::DOUBLE + (l_partkey % 1000) * 1e-6 lon,
        CAST(l_quantity AS DOUBLE) v, l_orderkey FROM lineitem""",
    "fx_vec": "SELECT vec_id id, CAST(embedding AS DOUBLE[]) vec, label FROM embeddings",
    "fx_tf": """SELECT mission, seq, stream = 'purchase' is_static, t,
        CASE stream WHEN 'click' THEN 'world' WHEN 'view' THEN 'odom' ELSE 'base' END parent,
        CASE stream WHEN 'click' THEN 'odom' WHEN 'view' THEN 'base' WHEN 'purchase' THEN 'imu'
        ELSE 'lidar' END child,
        cos(seq % 180 * 0.008726646259971648::DOUBLE) qw, 0.0::DOUBLE qx, 0.0::DOUBLE qy,
        sin(seq % 180 * 0.008726646259971648::DOUBLE) qz
        FROM fx_stream""",
    "fx_joints": """SELECT o_custkey mission, o_orderkey seq, CAST(o_orderkey AS DOUBLE) t,
        list_sort(list('j' || CAST(l_linenumber AS VARCHAR))) AS names,
        list_sort(list(CAST(l_quantity AS DOUBLE))) AS pos
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "fx_msgs": """SELECT user_id mission, '/' || event_type topic, event_id seq, epoch_us(ts) * 1000 log_ns,
        CASE WHEN event_id % 7 = 0 THEN 0 ELSE epoch_us(ts) * 1000 - 5000000 END stamp_ns,
        props payload, value FROM events""",
    "fx_catalog": """SELECT c_custkey id, c_name AS name, split_part(c_name, '#', 2) folder, c_mktsegment kind,
        n_name AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_topics": """SELECT DISTINCT user_id mission,
        '/' || event_type || '/' || CAST(event_id % 3 AS VARCHAR) topic FROM events""",
    "fx_files": """SELECT doc_id, 'synced_' || CAST(5 + doc_id % 3 * 5 AS VARCHAR) || 'Hz' ||
        CASE WHEN doc_id % 2 = 0 THEN '_metrics' ELSE '' END || '.parquet' AS name, n_chars mtime, source dir
        FROM documents""",
    "fx_tiles": """SELECT DISTINCT l_partkey % 20 e_km, l_suppkey % 5 n_km, 2019 + l_linenumber % 4 AS "year",
        CAST(CASE WHEN l_quantity < 25 THEN 0.5 ELSE 2.0 END AS DOUBLE) res_m
        FROM lineitem""",
}
NEEDS = {"fx_motion": ["fx_stream"], "fx_grid": ["fx_stream"], "fx_tf": ["fx_stream"]}


def sql(body: str, *views: str, recursive: bool = False, **ctes: str) -> str:
    """Prefix a DuckDB query with the views it uses and its own named subqueries."""
    names: list[str] = []
    for v in views:
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in ctes.items()]
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
