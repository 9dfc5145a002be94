"""Euclidean distance in float32, summed dimension by dimension: as a Column and as a numpy block kernel.

Each square is added with one rounding (fused multiply-add), as DuckDB's ``list_distance`` and optimised C do; two
roundings give another last bit in some pairs, and so another edge set where a distance is that close to the radius.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances that are summed at a time.
BLOCK = 1 << 18


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two array<float> columns; every partial sum is rounded to float32. Squares are exact in double; a sum that
    double rounds to the middle of two float32 numbers (one in 5e8) may come out as the other one."""
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0).cast("float"), lambda acc, x: (acc + x).cast("float"))).cast("float")


def vector(values) -> Column:
    """Literal array<float>."""
    return F.array(*[F.lit(float(x)).cast("float") for x in values])


def _add_square(acc: np.ndarray, d: np.ndarray) -> np.ndarray:
    """acc + d * d of float32 numbers, rounded once to float32."""
    square = d.astype(np.float64)
    square *= square  # exact
    total = square + acc
    out = total.astype(np.float32)
    middle = (total.view(np.int64) & 0x1FFFFFFF) == 0x10000000  # between two float32 numbers, maybe by rounding only
    if middle.any():
        t, x, y, near = total[middle], square[middle], acc[middle].astype(np.float64), out[middle]
        z = t - x
        lost = (x - (t - z)) + (y - z)
        away = t - near
        out[middle] = np.where(away * lost > 0, (t + away).astype(np.float32), near)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances (rows of ``a`` by rows of ``b``), as :func:`paired` gives them."""
    out = np.zeros((len(a), len(b)), np.float32)
    step = max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), step):
        acc = out[at : at + step]
        for k in range(a.shape[1]):
            acc = _add_square(acc, a[at : at + step, k, None] - b[None, :, k])
        np.sqrt(acc, out=out[at : at + step])
    return out


def rough_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same with squares rounded before they are added, which is faster; for bounds that have :func:`slack` only."""
    acc = np.zeros((len(a), len(b)), np.float32)
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        d *= d
        acc += d
    return np.sqrt(acc, out=acc)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row."""
    acc = np.zeros(len(a), np.float32)
    for k in range(a.shape[1]):
        acc = _add_square(acc, a[:, k] - b[:, k])
    return np.sqrt(acc)


def slack(dim: int, scale):
    """First-order bound on the float32 error of sums of distances of this size; added to pruning bounds only."""
    return np.float32(1.2e-7) * (dim + 8) * scale


def within(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at distance <= radius: matrix products find candidates, the exact test decides."""
    r = np.float32(radius)
    x, y = a.astype(np.float64), b.astype(np.float64)
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    square = nx[:, None] + ny[None, :] - 2 * (x @ y.T)
    # error of the product form, and of the float32 distance itself
    room = 1e-12 * (nx[:, None] + ny[None, :]) + 4e-7 * (a.shape[1] + 8) * (float(r) ** 2 + 1e-30)
    i, j = np.nonzero(square <= float(r) ** 2 + room)
    ok = paired(a[i], b[j]) <= r
    return i[ok], j[ok]
