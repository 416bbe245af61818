"""Message streams to signal tables. Every function is a row-wise projection, so it also runs on streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.sources.signals import missing_as_null


def event_time_ns(stamp: Column, log: Column, by_log: bool = False) -> Column:
    """Header stamp when set, else the time of recording; ``by_log`` always takes the latter."""
    return log if by_log else F.coalesce(F.when(stamp > 0, stamp), log)


def stamp_fallbacks(df: DataFrame, keys: Sequence[str] = ("mission",)) -> DataFrame:
    """Messages per recording, and how many of them lack a header stamp."""
    unset = ~F.coalesce(F.col("stamp_ns") > 0, F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("messages"), F.count_if(unset).alias("fallbacks"))


def parse_payload(df: DataFrame, schema: T.StructType | str, payload: str = "payload", out: str = "msg") -> DataFrame:
    """JSON payload to a struct; an unreadable message becomes null fields instead of an error."""
    return df.withColumn(out, F.from_json(payload, schema, {"mode": "PERMISSIVE"}))


def _signal(df: DataFrame, values: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    ns = event_time_ns(F.col("stamp_ns"), F.col("log_ns"))
    return df.select(*keep, ns.alias("stamp_ns"), (ns / 1e9).alias("t"),
                     *[missing_as_null(c.cast("double")).alias(n) for n, c in values.items()])


def _field(df: DataFrame, path: str) -> Column | None:
    """Column of a nested field, or None when the schema lacks it."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return F.col(path)


def extract_cmd_vel(df: DataFrame, keep: Sequence[str] = ("mission",)) -> DataFrame:
    """Commanded velocity; the velocity may be wrapped in ``twist``. A missing sideways part is 0."""

    def part(path: str) -> Column:
        options = [c for c in (_field(df, f"msg.twist.{path}"), _field(df, f"msg.{path}")) if c is not None]
        return F.coalesce(*options) if options else F.lit(None)

    return _signal(df, {"v_cmd_x": part("linear.x"), "v_cmd_y": F.coalesce(part("linear.y"), F.lit(0.0)),
                        "w_cmd_z": part("angular.z")}, keep)


def extract_odom(df: DataFrame, keep: Sequence[str] = ("mission",)) -> DataFrame:
    vx, vy = F.col("msg.twist.linear.x"), F.col("msg.twist.linear.y")
    pose = {"x": "position.x", "y": "position.y", "qw": "orientation.w", "qx": "orientation.x",
            "qy": "orientation.y", "qz": "orientation.z"}
    return _signal(df, {"vx": vx, "vy": vy, "speed": F.hypot(vx, vy),
                        **{n: F.col(f"msg.pose.{p}") for n, p in pose.items()}}, keep)


def extract_gps(df: DataFrame, keep: Sequence[str] = ("mission",)) -> DataFrame:
    status = _field(df, "msg.status.status")
    return _signal(df, {"lat": F.col("msg.latitude"), "lon": F.col("msg.longitude"), "alt": F.col("msg.altitude"),
                        "status": F.lit(0) if status is None else F.coalesce(status, F.lit(0))}, keep)


def extract_imu(df: DataFrame, keep: Sequence[str] = ("mission",)) -> DataFrame:
    parts = {f"a{c}": f"linear_acceleration.{c}" for c in "xyz"} | {f"w{c}": f"angular_velocity.{c}" for c in "xyz"} | {
        f"q{c}": f"orientation.{c}" for c in "wxyz"}
    return _signal(df, {n: F.col(f"msg.{p}") for n, p in parts.items()}, keep)


def flatten_transforms(df: DataFrame, keep: Sequence[str] = ("mission",)) -> DataFrame:
    """One row per transform of each message; frames without their leading slash, incomplete ones dropped.

    Expects is_static, stamp_ns, log_ns and ``transforms`` (parent, child, rotation struct w,x,y,z).
    """
    rows = df.select(*keep, "is_static", event_time_ns(F.col("stamp_ns"), F.col("log_ns")).alias("_ns"), F.explode("transforms").alias("_t"))
    clean = lambda c: F.regexp_replace(c, "^/+", "")
    named = rows.select(*keep, "is_static", (F.col("_ns") / 1e9).alias("t"), clean(F.col("_t.parent")).alias("parent"),
                        clean(F.col("_t.child")).alias("child"), *[F.col(f"_t.rotation.{c}").alias(f"q{c}") for c in "wxyz"])
    return named.where("parent <> '' AND child <> '' AND qw IS NOT NULL")


def place_messages(df: DataFrame, parts: int, keys: Sequence[str] = ("mission",)) -> DataFrame:
    """Joint messages of one time in one of ``parts`` parts; flattened from there, ``pivot_joints`` needs no shuffle.

    A message travels whole, which is less than its wide row, and with parts by the number of messages a task of the pivot holds few.
    """
    return df.repartition(parts, *keys, "t")


def flatten_joints(df: DataFrame, keep: Sequence[str] = ("mission",)) -> DataFrame:
    """One row per joint and message from parallel arrays; a shorter array gives nulls, rows without any value are dropped."""
    zipped = df.select(*keep, "t", "seq", F.explode(F.arrays_zip("name", "position", "velocity", "effort")).alias("_j"))
    flat = zipped.select(*keep, "t", "seq", F.col("_j.name").alias("joint"), F.col("_j.position").alias("q"),
                         F.col("_j.velocity").alias("qd"), F.col("_j.effort").alias("tau"))
    return flat.where("joint IS NOT NULL AND coalesce(q, qd, tau) IS NOT NULL")


def pivot_joints(tall: DataFrame, joints: Sequence[str], keys: Sequence[str] = ("mission",)) -> DataFrame:
    """Tall joint rows to one row per time with ``q_<joint>``, ``qd_<joint>``, ``tau_<joint>``: the last known value each.

    The joint list is a parameter (a robot has a fixed set), so no pass is needed to discover it. ``seq`` numbers messages; a
    message names a joint once.
    """
    def last(kind: str, joint: str) -> Column:
        return F.max_by(kind, F.when((F.col("joint") == joint) & F.col(kind).isNotNull(), F.col("seq"))).alias(f"{kind}_{joint}")

    # values and numbers of fixed width: aggregated before the shuffle, which moves one row per time and input part;
    # rows of placed messages are not shuffled again
    return tall.groupBy(*keys, "t").agg(*[last(k, j) for k in ("q", "qd", "tau") for j in joints])
