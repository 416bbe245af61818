"""Least-squares window designs. They depend on the window only, so they are small driver-side constants."""

from __future__ import annotations

import numpy as np


def window_offsets(half: int) -> list[tuple[int, int]]:
    return [(dr, dc) for dr in range(-half, half + 1) for dc in range(-half, half + 1)]


def weights(method: str, half: int, sigma: float) -> np.ndarray:
    """Weight per window cell: all ones, or a bell with value 1 at the centre."""
    d = np.array(window_offsets(half), dtype=float)
    if method == "uniform":
        return np.ones(len(d))
    if method == "gaussian":
        if not np.isfinite(sigma) or sigma <= 0:
            raise ValueError("the gaussian weighting needs a positive sigma")
        return np.exp(-(d**2).sum(axis=1) / (2 * sigma**2))
    raise ValueError(f"unknown weighting method {method!r}")


def plane_kernel(half: int, method: str = "uniform", sigma: float = 1.0) -> list[tuple[int, int, float, float]]:
    """(dr, dc, per-column slope, per-row slope) coefficients of the weighted plane fit, in cells.

    Both sides of the system are weighted, so a weight acts squared.
    """
    offsets = np.array(window_offsets(half), dtype=float)
    w = weights(method, half, sigma)
    design = np.column_stack([offsets[:, 1], offsets[:, 0], np.ones(len(offsets))])
    solve = np.linalg.pinv(design * w[:, None]) * w
    return [(int(r), int(c), float(p), float(q)) for (r, c), p, q in zip(offsets, solve[0], solve[1])]
