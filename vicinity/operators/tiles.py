"""Blocked metric join: the two sides of each cell are cut into chunks of bounded size, and each pair of
chunks is one group. Memory per task is fixed whatever the cell sizes; a crowded cell becomes many tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Points in a chunk.
CHUNK = 2048
#: Index pairs within the radius, and the distances computed for them (all of the tile, if it isn't told).
Kernel = Callable[[np.ndarray, np.ndarray, float], tuple]
#: What the joins find: edges, and a row for each tile with its work and nulls for src and dst.
FOUND = "src long, dst long, task int, comps long, seconds double, read long"


def matrix(table, column: str = "v") -> np.ndarray:
    v = table[column].combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(v), -1)


def _with_work(src, dst, comps: int, seconds: float, read: int):
    """Columns of FOUND: the edges, then one row of work."""
    import pyarrow as pa
    from pyspark import TaskContext

    n = len(src)
    last = lambda x, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array([x], kind)])
    ends = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(1, pa.int64())]) for x in (src, dst)]
    work = (TaskContext.get().partitionId(), pa.int32()), (comps, pa.int64()), (seconds, pa.float64()), (read, pa.int64())
    return [*ends, *(last(*x) for x in work)]


_FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def edges_of(found: DataFrame) -> DataFrame:
    """(src, dst)"""
    return found.where("src IS NOT NULL").select("src", "dst")


def _run(radius: float, kernel: Kernel):
    def run(probe, build):
        import pyarrow as pa

        src = dst = np.zeros(0, np.int64)
        comps, began = 0, time.perf_counter()
        if probe.num_rows and build.num_rows:
            p, b = matrix(probe), matrix(build, "b_v")
            if p.shape[1] != b.shape[1]:
                raise ValueError("points of different dimensions")
            i, j, *told = kernel(p, b, radius)
            comps = told[0] if told else len(p) * len(b)
            pid, bid = probe["id"].to_numpy(), build["b_id"].to_numpy()
            src, dst = pid[i], bid[j]
            keep = src != dst
            src, dst = src[keep], dst[keep]
            if probe["both"][0].as_py() and probe["pi"][0].as_py() != probe["bj"][0].as_py():
                src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
        return pa.table(_with_work(src, dst, comps, time.perf_counter() - began, probe.num_rows + build.num_rows), names=_FOUND_NAMES)

    return run


def _edges(probe: DataFrame, build: DataFrame, radius: float, kernel: Kernel) -> DataFrame:
    ship(probe.sparkSession)
    # aliases give the build side attributes of its own; shared ones would be pruned away from one side
    build = build.select(*[F.col(c).alias(f"b_{c}") for c in build.columns])
    return probe.groupBy("cell", "pi", "bj").cogroup(build.groupBy("b_cell", "b_pi", "b_bj")).applyInArrow(_run(radius, kernel), FOUND)


def _deal(chunks) -> F.Column:
    return F.pmod(F.xxhash64("id"), chunks).cast("int")


def all_pairs(points: DataFrame, radius: float, kernel: Kernel, n: int, chunk: int = CHUNK, least_tasks: int = 1, counted: bool = False) -> DataFrame:
    """Edges (src, dst), both directions, of (id, v); ``counted``: FOUND. Each unordered pair of chunks is compared once."""
    c = max(-(-n // chunk), 1)
    while c * (c + 1) // 2 < least_tasks and n // (c + 1) >= 64:
        c += 1
    dealt = points.select("id", "v", F.lit(0).alias("cell"), F.lit(True).alias("both"), _deal(F.lit(c)).alias("k"))
    probe = dealt.select("id", "v", "cell", "both", F.col("k").alias("pi"), F.explode(F.sequence(F.col("k"), F.lit(c - 1))).alias("bj"))
    build = dealt.select("id", "v", "cell", F.col("k").alias("bj"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("pi"))
    found = _edges(probe, build, radius, kernel)
    return found if counted else edges_of(found)


#: Bytes of points that may be sent to every task whole.
MAX_SHARED_BYTES = 32 << 20


def against_shared(points: DataFrame, radius: float, kernel: Kernel, tasks: int, counted: bool = False) -> DataFrame:
    """Edges as :func:`all_pairs` gives them, for points whose checked size allows every task a copy: no tile is shuffled."""
    spark = points.sparkSession
    ship(spark)
    table = points.select("id", "v").toArrow()
    ids = table["id"].to_numpy()
    everything = spark.sparkContext.broadcast((ids, matrix(table)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, v = everything.value
            own = b.column(0).to_numpy()
            for at in range(0, len(own), CHUNK):
                probe = b.column(1).slice(at, CHUNK)
                probe = probe.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(probe), -1)
                for low in range(0, len(ids), 4 * CHUNK):
                    began, build = time.perf_counter(), v[low : low + 4 * CHUNK]
                    i, j, *told = kernel(probe, build, radius)
                    src, dst = own[at : at + CHUNK][i], ids[low : low + 4 * CHUNK][j]
                    keep = src != dst
                    comps = told[0] if told else len(probe) * len(build)
                    yield pa.RecordBatch.from_arrays(_with_work(src[keep], dst[keep], comps, time.perf_counter() - began, len(probe) + len(build)), _FOUND_NAMES)

    found = points.select("id", "v").repartition(tasks).mapInArrow(run, FOUND)
    return found if counted else edges_of(found)


def by_cell(probe: DataFrame, build: DataFrame, sizes: DataFrame, radius: float, kernel: Kernel, chunk: int = CHUNK) -> DataFrame:
    """FOUND from ``probe`` (id, v, cell) to ``build`` (id, v, cell) within cells. ``sizes`` (cell, probes, builds) has a row per cell."""
    chunks = F.broadcast(
        sizes.select(
            "cell", F.greatest(F.ceil(F.col("probes") / chunk), F.lit(1)).cast("int").alias("pc"), F.greatest(F.ceil(F.col("builds") / chunk), F.lit(1)).cast("int").alias("bc")
        )
    )
    probe = probe.join(chunks, "cell").select(
        "id", "v", "cell", F.lit(False).alias("both"), _deal(F.col("pc")).alias("pi"), F.explode(F.sequence(F.lit(0), F.col("bc") - 1)).alias("bj")
    )
    build = build.join(chunks, "cell").select("id", "v", "cell", _deal(F.col("bc")).alias("bj"), F.explode(F.sequence(F.lit(0), F.col("pc") - 1)).alias("pi"))
    return _edges(probe, build, radius, kernel)
