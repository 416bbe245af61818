"""Cluster labels of vectors and terrain cells, and what a metric looks like per cluster."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions import vectors as vf
from footfall.operators import ordered as o
from footfall.operators.ordered import Axis
from footfall.operators.quantiles import quantiles

BLOCK_BYTES = 64 * 1024 * 1024
BATCH = 256  # vectors whose scores against one block of centroids are held at once


def assign_clusters(df: DataFrame, centroids: DataFrame, vec: str = "vec", out: str = "cluster") -> DataFrame:
    """Index of the centroid with the highest cosine; the lowest index wins ties. Null vectors, and vectors of another length than
    the centroids', have none.

    One pass: each batch of vectors is multiplied with one block of centroids after the other and carries its best along.
    A block is broadcast and has at most 64 MB; a task holds one at a time.
    """
    spark = df.sparkSession
    shape = centroids.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if not shape.n:
        raise ValueError("no centroids")
    if shape.least != shape.most:
        raise ValueError("centroids differ in length")
    per_block = max(1, BLOCK_BYTES // (8 * shape.most))
    blocks, held = [], []
    for r in centroids.select("k", vf.l2_normalize(F.col("vec")).alias("vec")).orderBy("k").toLocalIterator():
        held.append((r["k"], r["vec"]))
        if len(held) == per_block:
            blocks.append(spark.sparkContext.broadcast((np.array([k for k, _ in held]), np.array([v for _, v in held]))))
            held = []
    if held:
        blocks.append(spark.sparkContext.broadcast((np.array([k for k, _ in held]), np.array([v for _, v in held]))))
    length = shape.most

    def nearest(vectors: pd.Series) -> pd.Series:
        fits = np.array([v is not None and len(v) == length for v in vectors], dtype=bool)
        found = np.full(len(vectors), None, dtype=object)
        x = np.array([np.asarray(v, dtype=float) for v, fit in zip(vectors, fits, strict=True) if fit]).reshape(-1, length)
        whole = ~np.isnan(x).any(axis=1)
        best, label = np.full(len(x), -np.inf), np.full(len(x), -1)
        for block in blocks:
            for start in range(0, len(x), BATCH):
                part = slice(start, start + BATCH)
                _improve(x[part], *block.value, best[part], label[part])
        found[np.flatnonzero(fits)[whole]] = label[whole]
        return pd.Series(found, dtype="Int64")

    return df.withColumn(out, F.pandas_udf(nearest, T.LongType())(F.col(vec)))


def _improve(x: np.ndarray, names: np.ndarray, centroids: np.ndarray, best: np.ndarray, label: np.ndarray) -> None:
    """Update the best score and centroid of each vector by a block of centroids in rising order.

    A matrix product may round equal scores differently: what comes within rounding of the best is added up again in one order.
    """
    scores = x @ centroids.T
    top = scores.max(axis=1)
    slack = 1e-12 * np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    close = scores >= (top - slack)[:, None]
    for row in np.flatnonzero(top + slack >= best):
        for k in np.flatnonzero(close[row]):
            score = _dot(x[row], centroids[k])
            if score > best[row]:
                best[row], label[row] = score, names[k]


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.add.accumulate(a * b)[-1]) if len(a) else 0.0


def upsample_grid(features: DataFrame, hf: int, wf: int, h: int, w: int) -> DataFrame:
    """Bilinear resize of feature grids (half-pixel centres, edges clamped), vectors brought to unit length.

    Each feature hands its vector to the four source squares that it is a corner of; an output cell then joins the one square
    it lies in and combines its corners element by element. A corner without a feature counts as zero.
    """

    def taps(size: int, source: int, name: str) -> Column:
        entries = []
        for k in range(size):
            at = max((k + 0.5) * source / size - 0.5, 0.0)
            low = min(int(at), source - 1)
            beyond = at - low if low + 1 < source else 0.0
            entries.append(F.struct(F.lit(k).alias(f"out_{name}"), F.lit(low).alias(name), F.lit(beyond).alias(f"w_{name}")))
        return F.array(*entries)

    sides = F.array(F.lit(0), F.lit(1))
    corners = features.select("grid_id", "i", "j", "vec", F.explode(sides).alias("_di")).select("*", F.explode(sides).alias("_dj"))
    corners = corners.select("grid_id", (F.col("i") - F.col("_di")).alias("i"), (F.col("j") - F.col("_dj")).alias("j"), "_di", "_dj", "vec").where("i >= 0 AND j >= 0")
    squares = corners.groupBy("grid_id", "i", "j").agg(*[
        F.first(F.when((F.col("_di") == a) & (F.col("_dj") == b), F.col("vec")), ignorenulls=True).alias(f"_v{a}{b}") for a in (0, 1) for b in (0, 1)])
    spread = squares.select("grid_id").distinct().select("grid_id", F.inline(taps(h, hf, "i"))).select("*", F.inline(taps(w, wf, "j")))
    near = spread.join(squares, ["grid_id", "i", "j"])
    nothing = F.array().cast("array<double>")

    def blend(a: Column, b: Column, share: Column) -> Column:
        return F.zip_with(F.coalesce(a, nothing), F.coalesce(b, nothing), lambda x, y: F.coalesce(x, F.lit(0.0)) * (1 - share) + F.coalesce(y, F.lit(0.0)) * share)

    upper, lower = (blend(F.col(f"_v{a}0"), F.col(f"_v{a}1"), F.col("w_j")) for a in (0, 1))
    near = near.withColumns({"_upper": upper, "_lower": lower})
    # a cell none of whose weighted corners has a feature is left out
    weighed = [F.col(f"_v{a}{b}").isNotNull() & ((F.col("w_i") > 0) if a else F.lit(True)) & ((F.col("w_j") > 0) if b else F.lit(True)) for a in (0, 1) for b in (0, 1)]
    near = near.where(weighed[0] | weighed[1] | weighed[2] | weighed[3])
    return near.select("grid_id", F.col("out_i").alias("i"), F.col("out_j").alias("j"), vf.l2_normalize(blend(F.col("_upper"), F.col("_lower"), F.col("w_i"))).alias("vec"))


def cluster_count(requested: Column, name: Column, max_label: Column, max_seen: Column) -> Column:
    """Requested count, else the one in the raster's name, else one above the largest label."""
    # fixed value: name pattern
    named = F.regexp_extract(name, r"cluster_kmeans(\d+)", 1)
    return F.coalesce(requested, F.when(named != "", named.cast("int")), max_label + 1, max_seen + 1)


def cluster_statistics(samples: DataFrame, value: str, label: str = "label") -> DataFrame:
    """Count, mean, sample deviation (0 for one sample) and median of a metric per cluster."""
    known = samples.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    basics = known.groupBy(label).agg(F.count("*").alias("samples"), F.avg(value).alias("mean"),
                                      F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    return basics.join(quantiles(known, [label], value, [0.5], ["median"]), label)


def empty_clusters(samples: DataFrame, value: str, counts: DataFrame, label: str = "label") -> DataFrame:
    """Totals of a comparison: K (the largest on mismatch), clusters seen, clusters without samples, missions used.

    ``counts``: one row per mission with its cluster count ``k``.
    """
    known = samples.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    per_label = known.groupBy(label, "mission").agg(F.count("*").alias("_n"))
    seen = per_label.agg(F.count_distinct(label).alias("observed"), F.sum("_n").alias("samples"),
                         F.count_distinct("mission").alias("missions")).withColumn("_one", F.lit(1))
    k = counts.agg(F.max("k").alias("clusters")).withColumn("_one", F.lit(1))
    return seen.join(k, "_one").drop("_one").withColumn(
        "empty", F.greatest(F.lit(0), F.col("clusters") - F.col("observed")))


def top_clusters(stats: DataFrame, k: int, label: str = "label") -> DataFrame:
    """The k largest clusters, shown by falling mean; 0 means all."""
    chosen = stats.orderBy(F.desc("samples"), label).limit(k) if k else stats
    return chosen.orderBy(F.desc("mean"), label)


def box_statistics(samples: DataFrame, value: str, label: str = "label") -> DataFrame:
    """Quartiles, median and whiskers (extreme values within 1.5 interquartile ranges) per cluster."""
    known = samples.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    box = quantiles(known, [label], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = known.join(box, label).withColumns({
        "_low": F.when(F.col(value) >= F.col("q1") - reach, F.col(value)),
        "_high": F.when(F.col(value) <= F.col("q3") + reach, F.col(value))})
    return near.groupBy(label, "q1", "median", "q3").agg(
        F.least(F.min("_low"), F.col("q1")).alias("whisker_low"), F.greatest(F.max("_high"), F.col("q3")).alias("whisker_high"))


def label_runs(df: DataFrame, axis: Axis, label: str) -> DataFrame:
    """Runs of equal labels as (start row, end row exclusive, label); a null breaks a run."""
    changed = lambda here, prev: f"CAST(NOT ({here('label')} <=> {prev('label')}) AS BIGINT)"
    islands = o.running(df, axis, _k=o.row_index(), _island=o.pairwise(changed, "1L", {"label": label}, total=True))
    return islands.where(F.col(label).isNotNull()).groupBy(*axis.keys, "_island").agg(
        F.min("_k").alias("start_row"), (F.max("_k") + 1).alias("end_row"), F.first(label).alias(label)).drop("_island")


def step_edges(df: DataFrame, axis: Axis, x: str) -> DataFrame:
    """Left and right edge of each sample: midpoints to the neighbours, half a step beyond the ends, 0.5 when alone."""
    near = o.running(df, axis, _before=o.lag(x), _after=o.lead(x))
    back, ahead = F.col(x) - F.col("_before"), F.col("_after") - F.col(x)
    return near.withColumns({
        "left_edge": F.col(x) - F.coalesce(back, ahead, F.lit(1.0)) / 2,
        "right_edge": F.col(x) + F.coalesce(ahead, back, F.lit(1.0)) / 2,
    }).drop("_before", "_after")
