"""Exact top-k inner-product search with no-random-access aggregation.

Each dimension is a list of vectors sorted by value, read from the top for a positive query weight and
from the bottom for a negative one. What has been read of a vector bounds its score from below
(unread values are at their least) and above (unread values are at most the last value read). A
query stops when no other vector's upper bound reaches its k-th lower bound; ties go on, since they
are broken by vec_id. What is left is resolved to final scores.

Vectors are dealt into blocks of bounded size, queries into blocks too, and each pair of blocks is one
group: lists are sorted once per block, all queries of the block that haven't stopped read them in step, so that the
bounds are matrix products. A query stops by itself, once at most 2k vectors can still qualify; those are resolved to
final scores. Read to the end, the bounds are the scores. ``read`` is the share of its lists that a query has read. In many
dimensions bounds tighten late: README has figures. A block's k best per query go on to one ranked window per query. The
work is (queries x vectors), as the task is exact; memory per task is fixed.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, as
queries neither; components are floored as given by ``quantise``; vectors of different length have
no score; a query never meets a vector of its own id; fewer than k candidates are returned whole;
rows that repeat a vec_id are candidates each. Scores beyond 2^53 are not exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship


def quantise(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double arithmetic gives it; null if any is null or not finite."""
    inf = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    return F.when(fine & (F.size(v) > 0), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


#: Depths, as shares of the lists, at which bounds are compared.
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1)
#: Queries of a block whose bounds are held at once.
TOGETHER = 512


def block_top_k(x: np.ndarray, ids: np.ndarray, w: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of ``x`` (rows) for each of ``w`` (rows): query number, id, score, and the share of the lists that the query read."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    n, d = x.shape
    big = float(np.abs(x).max(initial=0)) * float(np.abs(w).max(initial=0)) * d
    kind = np.float32 if big < 2**24 else np.float64
    at_rank = np.sort(x, axis=0)[::-1]
    rank = np.empty((n, d), np.int32)
    np.put_along_axis(rank, np.argsort(-x, axis=0, kind="stable"), np.arange(n, dtype=np.int32)[:, None], 0)
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    for lo in range(0, len(own), TOGETHER):
        active = np.arange(lo, min(len(own), lo + TOGETHER))  # queries still reading
        rows = np.arange(n)  # vectors that one of them still needs
        for share in DEPTHS:
            depth = max(1, int(n * share))
            part, r, q = x[rows].astype(kind), rank[rows], w[active].astype(kind)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            unread_up, unread_down = r >= depth, r < n - depth
            known = np.where(unread_up, 0, part) @ up.T + np.where(unread_down, 0, part) @ down.T
            lower, upper = known, known
            if depth < n:
                unread_up, unread_down = unread_up.astype(kind), unread_down.astype(kind)
                lower = known + unread_up @ (up * at_rank[-1].astype(kind)).T + unread_down @ (down * at_rank[0].astype(kind)).T
                upper = known + unread_up @ (up * at_rank[depth - 1].astype(kind)).T + unread_down @ (down * at_rank[n - depth].astype(kind)).T
            mine = ids[rows][:, None] == own[active][None, :]
            lower = np.where(mine, -np.inf, lower)
            bar = np.partition(lower, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else np.full(len(active), -np.inf)
            room = kind(1e-9) * big if kind is np.float64 and big >= 2**53 else 0  # sums are exact below
            alive = (upper >= bar - room) & ~mine
            stops = (alive.sum(axis=0) <= 2 * k) | (depth == n)  # outsiders cannot qualify
            for j in np.flatnonzero(stops):
                left = rows[alive[:, j]]
                score = x[left] @ w[active[j]]
                best = np.lexsort((ids[left], -score))[:k]
                out.append((np.full(len(best), active[j]), ids[left[best]], score[best], np.full(len(best), depth / n)))
            active, rows = active[~stops], rows[alive[:, ~stops].any(axis=1)]
            if not len(active):
                break
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, query_block: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, read. Inputs: (vec_id long, v array<long>), (query_id long, v array<long>).

    Each vector is shuffled once for every ``query_block`` queries, each query once for every ``block`` vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = materialize(vectors.where("v IS NOT NULL").select("vec_id", "v", F.size("v").alias("dim")), "vectors")
    queries = materialize(queries.where("v IS NOT NULL").select("query_id", "v", F.size("v").alias("dim")), "queries")
    n, q = vectors.count(), queries.count()
    blocks = max(-(-n // block), min(2 * spark.sparkContext.defaultParallelism, -(-n // 256)), 1)
    query_blocks = max(-(-q // query_block), 1)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = vectors.withColumns({"b": deal("vec_id", blocks), "qb": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    right = queries.withColumns({"qb": deal("query_id", query_blocks), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def run(vs, qs):
        import pyarrow as pa

        names = ["query_id", "vec_id", "score", "read"]
        if not vs.num_rows or not qs.num_rows:
            return pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.float64())], names=names)
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        own = qs["query_id"].to_numpy()
        at, ids, score, read = block_top_k(matrix(vs), vs["vec_id"].to_numpy(), matrix(qs), own, k)
        return pa.table([pa.array(own[at]), pa.array(ids), pa.array(score), pa.array(read)], names=names)

    found = left.groupBy("dim", "b", "qb").cogroup(right.groupBy("dim", "b", "qb")).applyInArrow(run, "query_id long, vec_id long, score long, read double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "read")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
