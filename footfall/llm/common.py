"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import scratch_path

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep the batches of Python workers small: texts may be long, and a worker holds a whole batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read on from it; ``compression`` other than the session's for large ones.

    Later stages neither recompute it nor lose it with an executor, and the optimizer sees its real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from; rows without an id are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampling_hash(*columns: Column) -> Column:
    """A value from 0 to 1 fixed by the columns, for samples that are the same on every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def running_sums(numbers: Column) -> Column:
    """For each number of an array the sum of those before it.

    Sums are appended inside blocks of about the root of the length, then to the ends of blocks, as each append copies what it extends.
    """
    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def blocks(x: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(x))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(x), block), lambda at: sums(F.slice(x, at, block)))
        return F.transform(F.array(cut), lambda inner: F.flatten(F.zip_with(
            inner, F.slice(sums(F.transform(inner, lambda s: F.element_at(s, -1))), F.lit(1), F.size(inner)),
            lambda s, start: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v + start))))[0]

    # the array is bound to a name, so that it is made once
    return F.transform(F.array(numbers), lambda x: F.when(F.size(x) == 0, x).otherwise(blocks(x)))[0]
