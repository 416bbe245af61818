"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets are split further. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import stored

#: Bits of the hash, and bits of the directory settled in one round.
BITS, ROUND = 60, 12


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(value: Column, bits: int, of: int = BITS) -> Column:
    return F.shiftright(value, of - bits) if bits else F.lit(0).cast("long")


def _directory(rows: DataFrame, done: int, limit: int) -> DataFrame:
    """(cell, depth, total): for each prefix of ``done + ROUND`` bits the least depth at which its bucket fits, null where none does.

    Rows are summed to cells once; the buckets of all depths of this round are sums of cells. A bucket with one hash value
    cannot be split, so it counts as fitting.
    """
    end = done + ROUND
    cells = stored(rows.groupBy(_prefix(F.col("hash"), end).alias("cell")).agg(
        F.sum("n_bytes").alias("total"), F.min("hash").alias("low"), F.max("hash").alias("high")), "cells")
    depths = F.sequence(F.lit(done + 1 if done else 0), F.lit(end))
    spread = cells.select("*", F.explode(depths).alias("depth")).withColumn("bucket", F.expr(f"shiftright(cell, {end} - depth)"))
    buckets = spread.groupBy("depth", "bucket").agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    fitting = stored(buckets.filter((F.col("total") <= limit) | (F.col("low") == F.col("high"))).select("depth", "bucket", "total"), "buckets")
    least = spread.select("cell", "depth", "bucket").join(fitting, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "total")).alias("leaf"))
    return stored(cells.select("cell").join(least, "cell", "left").select("cell", "leaf.depth", "leaf.total"), "directory")


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash value that together exceed the limit, dealt to pages that fit it (a row larger than that has its own).

    Rows of equal key and size are the same to a shard, so they are counted and laid out again from their count.
    """
    alike = rows.groupBy("key", "hash", "n_bytes", "depth").agg(F.count("*").alias("n"))
    alike = alike.withColumn("each", F.greatest(F.lit(1), F.expr(f"{limit} div greatest(n_bytes, 1)")))
    before = Window.partitionBy("hash").orderBy("n_bytes", "key").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("first", F.coalesce(F.sum(F.expr("(n + each - 1) div each")).over(before), F.lit(0)))
    laid = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).withColumn("page", F.expr("first + k div each"))
    pages = alike.select("hash", "n_bytes", F.expr("explode(sequence(0L, (n + each - 1) div each - 1))").alias("p"), "first", "each", "n")
    sizes = pages.select("hash", F.expr("first + p").alias("page"), F.expr("least(each, n - p * each) * n_bytes").alias("total"))
    return laid.join(sizes, ["hash", "page"]).select("key", "hash", "n_bytes", "depth", "total", "page")


def shards(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """key, n_bytes, shard (the bits of its prefix), depth, page and shard_bytes of every row; shards hold at most ``limit`` bytes.

    The directory doubles only where a bucket is too large. Rows of one key share a hash and cannot be split by it: if they
    exceed the limit they overflow to pages; a single row larger than the limit is alone. A null size counts as 0; an empty
    table gives an empty result.
    """
    open_rows = stored(rows.select(F.col(key).alias("key"), key_hash(F.col(key)).alias("hash"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes")), "sizes")
    parts = []
    for done in range(0, BITS, ROUND):
        directory = _directory(open_rows, done, limit)
        found = open_rows.join(directory, _prefix(F.col("hash"), done + ROUND) == F.col("cell"))
        parts.append(found.filter("depth is not null").select("key", "hash", "n_bytes", "depth", "total"))
        if directory.filter("depth is null").isEmpty():
            break
        open_rows = stored(found.filter("depth is null").select("key", "hash", "n_bytes"), "open")
    settled = parts[0]
    for part in parts[1:]:
        settled = settled.union(part)
    fits = settled.filter(F.col("total") <= limit).withColumn("page", F.lit(0).cast("long"))
    over = _paged(settled.filter(F.col("total") > limit), limit)
    bits = F.expr(f"lpad(bin(shiftright(hash, {BITS} - depth)), depth, '0')")
    return fits.union(over).select(F.col("key").alias(key), "n_bytes", F.when(F.col("depth") == 0, "").otherwise(bits).alias("shard"),
                                   "depth", "page", F.col("total").alias("shard_bytes"))
