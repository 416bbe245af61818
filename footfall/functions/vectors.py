"""Vector column functions on ARRAY<DOUBLE>."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALLEST_NORM = 1e-12  # fixed value


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(SMALLEST_NORM))
    return F.zip_with(v, F.array_repeat(size, F.size(v)), lambda x, n: x / n)


def projection_head(v: Column, layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float] | None]]) -> Column:
    """Linear layers with ReLU between them, then unit length. Vectors that are null, hold nulls or do not fit give null.

    The weights travel with the function, which Spark broadcasts once when it is large; a batch is one product a layer.
    """
    dense = [(np.asarray(w, dtype=float), np.zeros(len(w)) if b is None else np.asarray(b, dtype=float)) for w, b in layers]
    width = dense[0][0].shape[1]

    def head(vectors: pd.Series) -> pd.Series:
        fits = np.array([x is not None and len(x) == width and not any(e is None or e != e for e in x) for x in vectors], dtype=bool)
        out = np.full(len(vectors), None, dtype=object)
        y = np.array([np.asarray(x, dtype=float) for x, fit in zip(vectors, fits, strict=True) if fit]).reshape(-1, width)
        for k, (weight, bias) in enumerate(dense):
            y = (y if k == 0 else np.maximum(y, 0.0)) @ weight.T + bias
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), SMALLEST_NORM)
        for row, x in zip(np.flatnonzero(fits), y, strict=True):
            out[row] = x
        return pd.Series(out)

    return F.pandas_udf(head, T.ArrayType(T.DoubleType()))(v)
