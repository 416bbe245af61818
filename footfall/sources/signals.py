"""Signal tables: flat typed time series, one row per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_as_null(c: Column) -> Column:
    """NaN becomes null, so that aggregates and comparisons skip it."""
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null, for operators that ask for finite values."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    """Apply ``missing_as_null`` to every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: missing_as_null(F.col(c)) for c in floating})


def signal_scan(df: DataFrame, keys: Sequence[str], order: str = "t", ties: Sequence[str] = ()) -> DataFrame:
    """Rows with a time, one per (keys, time) keeping the last by the tie breakers, without stamp columns.

    The duplicate rule is an aggregate, so duplicates shrink before the shuffle and a long recording is spread by time.
    """
    stamps = [c for c in df.columns if c.startswith("stamp_ns")]
    timed = df.withColumn(order, missing_as_null(F.col(order).cast("double"))).where(F.col(order).isNotNull())
    rank = [c for c in (*stamps, *ties) if c in df.columns]
    payload = [c for c in df.columns if c not in (*keys, order)]
    last = timed.groupBy(*keys, order).agg(
        F.max_by(F.struct(*payload), F.struct(*(rank or payload))).alias("_row"))
    kept = [c for c in payload if c not in stamps]
    return last.select(*keys, order, *[F.col(f"_row.{c}").alias(c) for c in kept])


def optional_table(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """A table that may not exist: missing or empty sources contribute no rows but keep their declared columns."""
    if path is not None and _exists(spark, path):
        found = spark.read.schema(schema).parquet(path)
        return clean_doubles(found)
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def raster_cells(df: DataFrame, nodata: float | None) -> DataFrame:
    """Band values of a cell table as doubles, the raster's nodata value and NaN as null."""
    z = missing_as_null(F.col("z").cast("double"))
    return df.withColumn("z", z if nodata is None else F.nullif(z, F.lit(float(nodata))))


def signal_schema(*values: str, stamped: bool = True) -> T.StructType:
    fields = [T.StructField("mission", T.StringType(), False)]
    if stamped:
        fields.append(T.StructField("stamp_ns", T.LongType()))
    fields.append(T.StructField("t", T.DoubleType(), False))
    return T.StructType(fields + [T.StructField(v, T.DoubleType()) for v in values])


# fixed values: columns of the signal tables
CMD_VEL = signal_schema("v_cmd_x", "v_cmd_y", "w_cmd_z")
ODOM = signal_schema("vx", "vy", "speed", "x", "y", "qw", "qx", "qy", "qz")
GPS = signal_schema("lat", "lon", "alt", "status")
IMU = signal_schema("ax", "ay", "az", "wx", "wy", "wz", "qw", "qx", "qy", "qz")
BASE_ORIENTATION = signal_schema("qw", "qx", "qy", "qz", "qw_map", "qx_map", "qy_map", "qz_map")
