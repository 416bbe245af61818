"""Exact top-k search by a Voronoi join: queries and data are grouped by pivots, and data go only where bounds say they may count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from footfall.llm.common import bound_batches, sampling_hash, stored

SCALE = 1024
#: Pivots (a bounded sample of the data), most queries of a group and most data rows solved in one task.
PIVOTS, GROUP_QUERIES, BLOCK_ROWS = 128, 2000, 20_000
NO_ID = np.iinfo(np.int64).max


def quantized(vector: Column) -> Column:
    """Components floor(1024 x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Vectors that are null or hold a null or non-finite component take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros."""
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.int64) if len(vectors) else np.zeros((0, width), dtype=np.int64)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _augmented(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Inner products as distances: data get a coordinate that makes all of one length, queries a zero there.

    The squared distance is then |q|^2 + longest^2 - 2 q.x, so the nearest rows are those of the largest inner products.
    """
    x = x.astype(np.float64)
    last = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(1), 0))
    return np.column_stack([x, last])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2^53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2 ** 53 else a @ b.T


def _in_cells(rows: DataFrame, pivots: np.ndarray, longest: float | None, width: int) -> DataFrame:
    """``rows`` with the nearest pivot and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    out = StructType([StructField("cell", IntegerType()), StructField("distance", DoubleType())])

    @F.pandas_udf(out)
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        d = _distances(_augmented(_matrix(vectors, width), longest), shared.value)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "distance": d[np.arange(len(d)), cell]})

    return rows.withColumn("_near", nearest("v")).select(*rows.columns, "_near.cell", "_near.distance")


def _bounds(pivots: np.ndarray, queries: dict[int, float], nearest: dict[int, list[float]], k: int, slack: float) -> np.ndarray:
    """For each cell of queries and cell of data, the least distance to its pivot that a row must have to count for a query there.

    ``queries``: largest distance to the pivot in each query cell; ``nearest``: smallest distances in each data cell. The k-th
    smallest of |p_i p_j| + |p_j s| + U_i bounds the distance of k rows from any query of cell i. A row s of cell j can be that
    near to such a query only if |p_j s| >= |p_i p_j| - U_i - bound.
    """
    between = _distances(pivots, pivots)
    least = np.full((len(pivots), len(pivots)), np.inf)
    cells = sorted(nearest)
    reach = np.concatenate([np.full(len(nearest[j]), j) for j in cells]).astype(int)
    own = np.concatenate([np.array(nearest[j]) for j in cells])
    for i, radius in queries.items():
        upper = np.sort(between[i, reach] + own + radius)
        bound = upper[k - 1] if len(upper) >= k else np.inf
        least[i, cells] = between[i, cells] - radius - bound - slack
    return least


def _solve(width: int, k: int):
    out_rows = ["query_row", "query_id", "row", "vec_id", "score"]

    def solve(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in out_rows})
        data = data.sort_values("vec_id", kind="stable", ignore_index=True)
        scores = _products(_matrix(queries["v"], width), _matrix(data["v"], width))
        ids, rows = data["vec_id"].to_numpy(), data["row"].to_numpy()
        found = []
        for q, (row, query_id) in enumerate(zip(queries["row"], queries["vec_id"], strict=True)):
            s = scores[q]
            # k + 1, as the query itself may be among them; all ties of the last are looked at
            n = min(k + 1, len(s))
            cut = np.partition(s, len(s) - n)[len(s) - n]
            at = np.flatnonzero(s >= cut)
            at = at[rows[at] != row]
            at = at[np.lexsort((rows[at], ids[at], -s[at]))][:k]
            found.append(pd.DataFrame({"query_row": row, "query_id": query_id, "row": rows[at], "vec_id": ids[at], "score": s[at]}))
        return pd.concat(found, ignore_index=True)[out_rows].astype("int64")

    return solve


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
          pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k largest integer inner products among all other rows.

    Ties go to the smaller id (rows without an id last); a repeated row is a candidate for its twin but not for itself. Fewer
    than k other rows give fewer results; vectors that cannot be used take no part; shorter vectors count as filled with zeros.
    Pivots are a bounded sample; every row is used. A query group of many rows is split, and so is the data it needs.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    plain = vectors.filter(usable(F.col(vector_column))).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("vec_id"),
        quantized(F.col(vector_column)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = stored(plain.withColumn("norm2", norm2), "vectors")
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max("norm2").alias("longest"),
                     F.count_if("is_query").alias("queries")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total["queries"]:
        return empty
    width, longest = max(total["width"], 1), float(np.sqrt(total["longest"]))
    # the sample is drawn from different vectors: copies of one would be one pivot
    drawn = rows.filter(sampling_hash(F.col("v")) <= min(1.0, 8.0 * pivots / total["n"])).select("v").distinct()
    chosen = [r["v"] for r in drawn.orderBy(F.xxhash64("v"), "v").limit(pivots).collect()] or [[0] * width]
    at = _augmented(_matrix(pd.Series(chosen), width), longest)
    data = stored(_in_cells(rows.select("row", "vec_id", "v"), at, longest, width), "cells")
    asked = stored(_in_cells(rows.filter("is_query").select("row", "vec_id", "v"), at, None, width), "query_cells")

    # the k + 1 rows nearest to each pivot: first in salted parts of a cell, then of the parts
    salt = F.pmod(F.col("row"), F.lit(64))
    part = Window.partitionBy("cell", salt).orderBy("distance")
    cell = Window.partitionBy("cell").orderBy("distance")
    close = data.select("cell", "row", "distance").withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
    close = close.select("cell", "distance").withColumn("n", F.row_number().over(cell)).filter(F.col("n") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for r in close.select("cell", "distance").collect():
        nearest.setdefault(r["cell"], []).append(r["distance"])
    sizes = {r["cell"]: (r["n"], r["far"]) for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
    least = _bounds(at, {c: far for c, (_, far) in sizes.items()}, nearest, k + 1, 1e-6 * max(longest, 1.0))

    # cells of queries go together into groups of bounded size, each next to the pivot that is closest to the last; a full cell is split
    between, left, order = _distances(at, at), set(sizes), []
    while left:
        order.append(min(left, key=lambda c: (between[order[-1], c] if order else 0.0, c)))
        left.remove(order[-1])
    groups, chunks, filled = [], {}, group_queries
    for c in order:
        n = sizes[c][0]
        if n > group_queries:
            chunks[c] = (len(groups), -(-n // group_queries))
            groups.extend([least[c]] * chunks[c][1])
            filled = group_queries
        else:
            if filled + n > group_queries:
                groups.append(np.full(len(at), np.inf))
                filled = 0
            groups[-1] = np.minimum(groups[-1], least[c])
            chunks[c] = (len(groups) - 1, 1)
            filled += n
    blocks = max(1, -(-total["n"] // block_rows))
    needs = spark.createDataFrame([(j, g, float(bound[j])) for g, bound in enumerate(groups) for j in nearest if bound[j] < np.inf],
                                  "cell int, g int, least double")
    where = spark.createDataFrame([(int(c), g, n) for c, (g, n) in chunks.items()], "cell int, first int, n int")
    # both tables are bounded by the numbers of pivots and of query groups
    sent = data.join(F.broadcast(needs), "cell").filter("distance >= least").select(
        "g", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "vec_id", "v")
    posed = asked.join(F.broadcast(where), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("row"), F.col("n"))).cast("int").alias("g"), "row", "vec_id", "v")
    posed = posed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = StructType([StructField(c, LongType()) for c in ("query_row", "query_id", "row", "vec_id", "score")])
    found = sent.groupBy("g", "block").cogroup(posed.select("g", "block", "row", "vec_id", "v").groupBy("g", "block")).applyInPandas(_solve(width, k), schema)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("query_id", "vec_id")]
    return ranked.select(named[0], "rank", named[1], "score")
