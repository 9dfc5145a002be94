"""Point sets: (id BIGINT, v ARRAY<FLOAT>), with row-range, id and block operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import euclidean, vector


def validated(df: DataFrame) -> DataFrame:
    """(id, v) as long and array<float>; a null or non-finite component, or a null id or vector, fails the job."""
    v = F.col("v").cast("array<float>")
    bad = F.col("id").isNull() | v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float")))
    return df.select(F.col("id").cast("long").alias("id"), F.when(bad, F.raise_error("a point with a null or non-finite coordinate or id")).otherwise(v).alias("v"))


@dataclass
class PointSet:
    """Dense vectors of one dimension with unique ids. The plan is lazy; nothing is validated before it runs."""

    df: DataFrame

    @classmethod
    def of(cls, df: DataFrame, id: str, v: str | Column) -> PointSet:
        return cls(validated(df.select(F.col(id).alias("id"), (F.col(v) if isinstance(v, str) else v).alias("v"))))

    def neighbors(self, radius: float, method: str = "auto", **options):
        """The graph of all pairs within ``radius``; see :func:`vicinity.plans.neighbors.neighbors`."""
        from ..plans.neighbors import neighbors

        return neighbors(self, radius, method, **options)

    def radius_query(self, q, radius: float) -> DataFrame:
        """(id) of points within ``radius`` of the vector ``q``."""
        return self.df.where(euclidean(F.col("v"), vector(q)) <= F.lit(float(radius)).cast("float")).select("id")

    def radius_query_by_id(self, query_id: int, radius: float) -> DataFrame:
        """(id) of points within ``radius`` of the point ``query_id``, itself included. One row is broadcast."""
        q = self.df.where(F.col("id") == query_id).select(F.col("v").alias("q")).limit(1)
        return self.df.join(F.broadcast(q), euclidean(F.col("v"), F.col("q")) <= F.lit(float(radius)).cast("float")).select("id")

    def slice(self, start: int = 0, count: int | None = None) -> PointSet:
        """Points with ids from ``start``, at most ``count``, clipped to what there is."""
        cond = F.col("id") >= start
        return PointSet(self.df.where(cond if count is None else cond & (F.col("id") < start + count)))

    def rebase(self, start: int) -> PointSet:
        return PointSet(self.df.withColumn("id", F.col("id") - start))

    def gather(self, ids: DataFrame) -> PointSet:
        """Points whose id is in ``ids`` (id)."""
        return PointSet(self.df.join(ids.select("id"), "id", "left_semi"))

    def sample_ids(self, k: int, seed: int = 0) -> DataFrame:
        """``k`` ids chosen by the order of md5("id:seed"): repeatable, whatever the partitions or the engine."""
        return self.df.select("id").orderBy(F.md5(F.concat_ws(":", "id", F.lit(seed))), "id").limit(k)

    def block_offsets(self, blocks: int) -> DataFrame:
        """(block, size, start): consecutive ids in ``blocks`` even blocks, earlier ones one larger where it doesn't divide."""
        n = self.df.agg(F.count("*").alias("n"))
        sizes = self.df.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).crossJoin(F.broadcast(n)).select(
            "block", (F.floor(F.col("n") / blocks) + (F.col("block") < F.col("n") % blocks).cast("int")).cast("long").alias("size")
        )
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
        return sizes.select("block", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))

    def owners(self, blocks: int) -> DataFrame:
        """(id, block) by those ranges; ids are dense from 0."""
        offsets = self.block_offsets(blocks).agg(F.sort_array(F.collect_list("start")).alias("starts"))
        last = F.size(F.filter("starts", lambda s: s <= F.col("id"))) - 1
        return self.df.select("id").join(F.broadcast(offsets)).select("id", last.alias("block"))
