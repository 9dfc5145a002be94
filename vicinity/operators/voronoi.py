"""Farthest-point centers, nearest-center cells, and boundary (ghost) points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import distances, slack
from ..runtime import materialize, ship
from .points import PointSet

#: Bytes of centers that may be sent to every task.
MAX_CENTER_BYTES = 64 << 20
#: Bytes of points up to which the rounds run on the driver.
MAX_LOCAL_BYTES = 16 << 20
#: Rounds after which the distances so far are written down, so that no round looks at more centers than this.
ROUNDS = 16


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(n, -1)


@dataclass
class Centers:
    ids: list[int]
    vectors: np.ndarray  # (m, d)
    separation: float  # distance of the farthest point from the centers

    def df(self, spark: SparkSession) -> DataFrame:
        """(cell, center_id, v)"""
        rows = [(k, i, [float(x) for x in v]) for k, (i, v) in enumerate(zip(self.ids, self.vectors, strict=True))]
        return spark.createDataFrame(rows, "cell int, center_id long, v array<float>")


def farthest_centers(points: PointSet, m: int, first: int | None = None, local: bool = True) -> Centers:
    """Up to ``m`` centers: the point ``first`` (default: least id), then again and again the point farthest
    from all so far, the least id of equals. Stops early when every point is a center's duplicate.

    A round is one aggregate of (distance, id, vector), a row per task; nothing else leaves the executors.
    """
    if m < 1:
        raise ValueError("at least one center is needed")
    spark = points.df.sparkSession
    ship(spark)
    start = points.df if first is None else points.df.where(F.col("id") == first)
    row = start.agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")).first()
    if row["id"] is None:
        return Centers([], np.zeros((0, 0), np.float32), 0.0)
    (size,) = points.df.agg(F.sum(F.size("v"))).first()
    if local and 4 * size <= MAX_LOCAL_BYTES:
        return _farthest_here(points, m, row["id"])
    ids, vectors = [row["id"]], [np.array(row["v"], np.float32)]
    state = points.df.select("id", "v", F.lit(float("inf")).cast("float").alias("dist"))
    fresh = 0  # centers before this one are already in dist
    while True:
        seen = np.stack(vectors[fresh:])

        def nearest(batches: Iterator, seen=seen) -> Iterator:
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    d = np.minimum(distances(_matrix(b.column(1)), seen).min(1), b.column(2).to_numpy())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["id", "v", "dist"])

        now = state.mapInArrow(nearest, "id long, v array<float>, dist float")
        if len(ids) - fresh >= ROUNDS:
            now = state = materialize(now, "fps")
            fresh = len(ids)
        top = now.agg(F.max_by(F.struct("id", "v", "dist"), F.struct("dist", -F.col("id"))).alias("t")).first()["t"]
        if len(ids) == m or top["dist"] == 0:
            return Centers(ids, np.stack(vectors), float(top["dist"]))
        ids.append(top["id"])
        vectors.append(np.array(top["v"], np.float32))


def _farthest_here(points: PointSet, m: int, first: int) -> Centers:
    """The same on the driver, for points of checked size."""
    table = points.df.select("id", "v").toArrow()
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    ids, v = table["id"].to_numpy()[order], _matrix(table["v"].combine_chunks())[order]
    at = [int(np.searchsorted(ids, first))]
    nearest = distances(v, v[at[0]][None])[:, 0]
    while len(at) < m and nearest.max() > 0:
        at.append(int(nearest.argmax()))
        np.minimum(nearest, distances(v, v[at[-1]][None])[:, 0], out=nearest)
    return Centers(ids[at].tolist(), v[at], float(nearest.max()))


def _shared(spark: SparkSession, centers: Centers):
    if centers.vectors.nbytes > MAX_CENTER_BYTES:
        raise ValueError("too many centers to send to every task")
    return spark.sparkContext.broadcast(centers.vectors)


def cells(points: PointSet, centers: Centers) -> DataFrame:
    """(id, v, cell, dist): the nearest center of each point, the first of equals."""
    spark = points.df.sparkSession
    ship(spark)
    shared = _shared(spark, centers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            d = distances(_matrix(b.column(1)), shared.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "dist"]
            )

    return points.df.select("id", "v").mapInArrow(run, "id long, v array<float>, cell int, dist float")


def ghosts(assigned: DataFrame, centers: Centers, radius: float, exact_bound: bool = True) -> DataFrame:
    """(id, v, cell): each point again in every other cell whose center is within dist + 2 * radius.

    Two points within ``radius`` in different cells: each is a ghost of the other's cell. With
    ``exact_bound`` False the bound gets room for float32 errors, for use by the joins.
    """
    spark = assigned.sparkSession
    ship(spark)
    shared = _shared(spark, centers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            own, dist = b.column(2).to_numpy(), b.column(3).to_numpy()
            bound = dist + np.float32(2) * np.float32(radius)
            if not exact_bound:
                bound = bound + slack(v.shape[1], bound)
            near = distances(v, shared.value) <= bound[:, None]
            near[np.arange(len(own)), own] = False
            i, cell = np.nonzero(near)
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    return assigned.select("id", "v", "cell", "dist").mapInArrow(run, "id long, v array<float>, cell int")


def cell_sizes(assigned: DataFrame, centers: Centers) -> DataFrame:
    """(cell, size) with a row for each center, empty cells too."""
    return (
        centers.df(assigned.sparkSession).select("cell").join(assigned.groupBy("cell").agg(F.count("*").alias("size")), "cell", "left")
        .select("cell", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    )
