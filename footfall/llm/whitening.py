"""Embedding whitening: leading components of the covariance by spectrum slicing, vectors projected and scaled by them.

The covariance comes from two passes of partial sums; only a dims x dims matrix reaches the driver. There its leading eigenvalues
are isolated by inertia counts: the signs of the pivots of an LDL' factorisation of ``V - s I`` tell how many eigenvalues exceed
``s``. Inside its interval an eigenvalue is refined by Rayleigh quotient iteration, and two more counts, just above and below
what it found, certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from footfall.llm.common import bound_batches

SCALE, SHIFT = 64, 1_000_000
MOST = 32
#: Components with a share of the trace below this are rounding noise of a covariance of lower rank; nothing is scaled by them.
LEAST_SHARE = 1e-11
#: Entries beyond this have no exact long form here.
LARGEST = float(1 << 52)
_BUNCH = (1 + 17 ** 0.5) / 8  # fixed value: pivot threshold of Bunch and Kaufman


# --- spectrum slicing, on the driver, on one matrix of dims x dims


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` are larger than ``shift``: positive pivots of an LDL' factorisation.

    Pivots are 1 x 1 or 2 x 2 blocks chosen by Bunch and Kaufman's rule, so that growth stays bounded whatever the shift; a 2 x 2
    block always holds one positive and one negative eigenvalue. A pivot of zero is an eigenvalue equal to the shift: not larger.
    """
    m = a - shift * np.eye(len(a))
    positive, k, n = 0, 0, len(m)
    while k < n:
        s = m[k:, k:]
        diagonal = abs(s[0, 0])
        if len(s) == 1:
            return positive + int(s[0, 0] > 0)
        r = 1 + int(np.argmax(np.abs(s[1:, 0])))
        off = abs(s[r, 0])
        if max(diagonal, off) == 0.0:
            k += 1
            continue
        two = False
        if diagonal < _BUNCH * off:
            row = np.abs(s[r])
            row[r] = 0.0
            largest = row.max()
            if diagonal * largest < _BUNCH * off * off:
                two = abs(s[r, r]) < _BUNCH * largest
                target = 1 if two else 0
                s[[target, r]] = s[[r, target]]
                s[:, [target, r]] = s[:, [r, target]]
        if two:
            positive += 1
            c = s[2:, :2]
            s[2:, 2:] -= c @ np.linalg.solve(s[:2, :2], c.T)
            k += 2
        else:
            positive += int(s[0, 0] > 0)
            c = s[1:, 0]
            s[1:, 1:] -= np.outer(c, c / s[0, 0])
            k += 1
    return positive


def _orthogonal(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    norm = np.linalg.norm(v)
    return v / norm if norm > 0 else v


def _solve(a: np.ndarray, shift: float, v: np.ndarray, size: float) -> np.ndarray:
    """One step of inverse iteration; a shift that is an eigenvalue to the last bit is moved by a rounding error."""
    eye = np.eye(len(a))
    for nudge in (0.0, 4.0, 64.0):
        try:
            w = np.linalg.solve(a - (shift + nudge * np.finfo(float).eps * size) * eye, v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all():
            return w / np.linalg.norm(w)
    return v


def leading(v: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the ``most`` leading components of a symmetric positive matrix.

    Each eigenvalue is bisected by counts until its interval holds it alone or is as narrow as rounding; equal eigenvalues share
    such an interval, and their vectors are made orthogonal to each other. The largest entry of a vector is positive. Components
    below ``LEAST_SHARE`` of the trace are left out.
    """
    v = (v + v.T) / 2
    d, trace = len(v), float(np.trace(v))
    if d == 0 or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    top = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is larger
    noise = 8 * np.finfo(float).eps * top * d ** 0.5
    counts: dict[float, int] = {0.0: d, top + noise: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v, shift)
        return counts[shift]

    random = np.random.default_rng(7)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    least = count(LEAST_SHARE * trace)
    for k in range(1, min(most, least) + 1):
        # the known counts already bracket number k: at least k eigenvalues above low, fewer than k above high
        low = max(s for s, c in counts.items() if c >= k)
        high = min(s for s, c in counts.items() if c < k)
        while True:
            alone = count(low) == k and count(high) == k - 1
            if alone or high - low <= noise:
                value, vector = _refine(v, low, high, vectors, random, top)
                if vector is not None:
                    below, above = max(value - noise, 0.0), value + noise
                    if count(above) < k <= count(below):
                        break
                if high - low <= noise:
                    raise ArithmeticError(f"component {k} has no certified eigenvalue between {low} and {high}")
            middle = low + (high - low) / 2
            if count(middle) >= k:
                low = middle
            else:
                high = middle
        values.append(value)
        vectors.append(vector * np.sign(vector[np.argmax(np.abs(vector))]))
    return np.array(values), np.stack(vectors, axis=1) if vectors else np.zeros((d, 0))


def _refine(v, low, high, found, random, top) -> tuple[float, np.ndarray | None]:
    """Rayleigh quotient iteration from the middle of an interval; no vector if it leaves the interval or does not settle."""
    eps, slack = np.finfo(float).eps, 64 * np.finfo(float).eps * top
    shift = low + (high - low) / 2
    x = _orthogonal(random.standard_normal(len(v)), found)
    for _ in range(3):  # inverse iteration towards the interval's own vector
        x = _orthogonal(_solve(v, shift, x, top), found)
    best = None
    for _ in range(12):
        value = float(x @ v @ x)
        if not low - slack <= value <= high + slack:
            return value, None
        residual = float(np.linalg.norm(v @ x - value * x))
        if best is not None and residual >= best[0] / 2:
            break
        best = (residual, value, x)
        x = _orthogonal(_solve(v, value, x, top), found)
    residual, value, x = best
    return value, x if residual <= 256 * eps * top * len(v) ** 0.5 else None


# --- passes over the vectors


def _matrix(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, long x) of the vectors of ``dims`` entries (of any one length if None) that are not null, hold no null and are finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(rows)).flatten()
    c = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    fine = (np.abs(c) * SCALE < LARGEST).all(axis=1)  # false for nan and infinities
    return rows[fine], np.floor(c[fine] * SCALE).astype(np.int64) + SHIFT


def _rows(schema: str, function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)

    return lambda df: df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` vectors of ``len(sums)`` entries, their exact sums, eigenvalues and vectors of their covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double, from the exact n*x - S wherever that is a long."""
        sums = np.array(self.sums, dtype=np.int64)
        if self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
            return (self.n * x - sums) / self.n
        return np.array((self.n * x.astype(object) - sums.astype(object)) / self.n, dtype=float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; None if it is no long."""
        sums = np.array(self.sums, dtype=np.int64)
        if self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
            off = self.n * x - sums
            if len(sums) * float(np.abs(off).max(initial=0)) ** 2 < float(1 << 62):
                return (off * off).sum(axis=1).tolist()
            off = off.astype(object)
        else:
            off = self.n * x.astype(object) - sums.astype(object)
        totals = (off * off).sum(axis=1)
        return [int(t) if t < 1 << 63 else None for t in totals]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def _dimension(vectors: DataFrame) -> int | None:
    """Entries of most vectors without null or non-finite ones; among equally frequent lengths the largest."""
    x = F.col("vector")
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    first = vectors.filter(whole).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return first["dims"] if first else None


def _summed(partials: DataFrame) -> DataFrame:
    return partials.groupBy("i", "j").agg(F.sum("value").alias("value"))


def fit(df: DataFrame, vector_column: str = "embedding", most: int = MOST) -> Whitening | None:
    """The whitening of all whole vectors of a table; None if it holds none.

    Two passes: exact sums of x, then products of the centred vectors. Each task adds up its own, so a pass shuffles at most
    dims x dims numbers a task and the driver receives one matrix.
    """
    bound_batches(df.sparkSession)
    vectors = df.select(F.col(vector_column).alias("vector"))
    dims = _dimension(vectors)
    if not dims:
        return None

    def sums(batches):
        total, n = [0] * dims, 0
        for batch in batches:
            _, x = _matrix(batch.column(0), dims)
            # per batch: longs; across batches: any size
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, dims), pa.int32()), "value": pa.array(list(map(str, [n, *total])), pa.string())})

    parts = _rows("i int, value string", sums)(vectors).groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    totals = {r["i"]: int(r["value"]) for r in parts.collect()}
    n = totals.pop(-1)
    centre = Whitening(n, tuple(totals[i] for i in range(dims)), np.zeros(0), np.zeros((dims, 0)), 0.0)

    def products(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            y = centre.centred(_matrix(batch.column(0), dims)[1])
            total += y.T @ y
        yield from _entries(total)

    v = _gathered(_summed(_rows("i int, j int, value double", products)(vectors)).collect(), dims) / n
    values, found = leading(v, most)
    return Whitening(n, centre.sums, values, found, float(np.trace(v)))


def _entries(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The upper triangle as rows."""
    i, j = np.triu_indices(len(total))
    yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "value": total[i, j]})


def _gathered(rows: list[Row], size: int) -> np.ndarray:
    total = np.zeros((size, size))
    for r in rows:
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["value"]
    return total


def identity_error(df: DataFrame, model: Whitening, vector_column: str = "embedding") -> float | None:
    """The largest absolute entry of (covariance of all whitened vectors - identity), from one more pass; None without components."""
    k, dims = len(model.values), len(model.sums)
    if k == 0:
        return None

    def products(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = model.project(_matrix(batch.column(0), dims)[1])
            w = np.hstack([w, np.ones((len(w), 1))])  # the last row gathers the sums
            total += w.T @ w
        yield from _entries(total)

    vectors = df.select(F.col(vector_column).alias("vector"))
    total = _gathered(_summed(_rows("i int, j int, value double", products)(vectors)).collect(), k + 1)
    mean = total[:k, k] / model.n  # whitened vectors are centred but for rounding, so taking the mean off here loses nothing
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding", error: float | None = None) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error (a value of the caller).

    Vectors that are null or hold null or non-finite entries have no rows; nor have vectors of another length than the fitted
    one (that of most vectors), those with entries of 2^46 or more, and components without variance. ``deviation`` is null where
    it exceeds a long. Repeated rows and null ids each give rows of their own; other columns are not looked at. An empty table,
    or one without a whole vector, gives an empty result.
    """
    schema = f"{id_column} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    if model is None or len(model.values) == 0:
        return spark.createDataFrame([], schema)
    bound_batches(spark)
    k, dims, share = len(model.values), len(model.sums), model.values / model.trace

    def project(batches):
        for batch in batches:
            rows, x = _matrix(batch.column(1), dims)
            if len(rows) == 0:
                continue
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
            size = len(rows) * k
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(size, model.n)), deviation,
                pa.array(model.project(x).ravel()), pa.array(np.tile(share, len(rows))), pa.array([error] * size, pa.float64())],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _rows(schema, project)(df.select(F.col(id_column).cast("long"), F.col(vector_column).alias("vector")))
