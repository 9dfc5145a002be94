"""Seeded synthetic points: blobs in a subspace, padded with zeros and rotated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from ..operators.points import PointSet
from ..runtime import ship


def rotation(d: int, rng: np.random.Generator) -> np.ndarray:
    """A random rotation (orthogonal, determinant 1): a product of reflections in random hyperplanes of growing subspaces."""
    turn = np.eye(d)
    for k in range(2, d + 1):
        u = rng.normal(size=k)
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        turn[-k:] -= 2 * np.outer(u, u @ turn[-k:])
    if d % 2 == 0:  # an odd number of reflections
        turn[0] *= -1
    return turn


def blobs(spark: SparkSession, n: int, dim: int, ambient: int | None = None, centers: int = 80, seed: int = 0) -> PointSet:
    """``n`` points around ``centers`` means in [-10, 10]^dim with unit variance, in ``ambient`` dimensions.
    A point depends on the seed and its id alone, not on the partitions."""
    ambient = ambient or dim
    if ambient < dim:
        raise ValueError("the ambient dimension is less than the points'")
    ship(spark)
    rng = np.random.default_rng(seed)
    means = rng.uniform(-10, 10, (centers, dim))
    turn = rotation(ambient, rng)[:dim] if ambient > dim else np.eye(dim)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_numpy()
            x = np.empty((len(ids), dim))
            for k, i in enumerate(ids.tolist()):
                own = np.random.default_rng((seed, i))
                x[k] = means[i % centers] + own.normal(size=dim)
            v = (x @ turn).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * ambient), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "v"])

    return PointSet(spark.range(n).mapInArrow(run, "id long, v array<float>"))
