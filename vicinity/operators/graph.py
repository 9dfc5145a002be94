"""The neighbour graph: directed edges without self-loops, which are implied."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import delete_path, materialize, open_output, part_files, scratch_path
from .points import PointSet
from .tiles import edges_of


@dataclass
class NeighborGraph:
    """``found`` is what a join gives: edges and rows of work. The first call that needs more than the edges' plan
    writes it to the shared folder, so that no other call runs the join again; ``runtime`` is the time up to then."""

    points: PointSet
    found: DataFrame
    parameters: dict[str, Any] = field(default_factory=dict)
    runtime: float | None = None
    is_written: bool = False

    @property
    def edges_df(self) -> DataFrame:
        return edges_of(self.found)

    def edges(self) -> DataFrame:
        """(src, dst), both directions."""
        return self.edges_df

    def written(self) -> NeighborGraph:
        """The same with the edges computed and written to the shared folder."""
        if not self.is_written:
            began = time.time()
            self.found, self.is_written = materialize(self.found, "edges"), True
            self.runtime = (self.runtime or 0.0) + time.time() - began
        return self

    def metrics(self) -> DataFrame:
        """(process, dist_comps, comp_time, points_read, tiles): the work of each task slot, tasks dealt to slots in turn."""
        work = self.written().found.where("src IS NULL").withColumn("process", F.pmod("task", F.lit(self._processes())))
        return work.groupBy("process").agg(
            F.sum("comps").alias("dist_comps"), F.sum("seconds").alias("comp_time"), F.sum("read").alias("points_read"), F.count("*").alias("tiles")
        )

    def _processes(self) -> int:
        return self.found.sparkSession.sparkContext.defaultParallelism

    def with_loops(self) -> DataFrame:
        return self.edges_df.unionByName(self.points.df.select(F.col("id").alias("src"), F.col("id").alias("dst")))

    def adjacency(self) -> DataFrame:
        """(src, neighbors ascending) of points that have any."""
        return self.edges_df.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))

    def degrees(self) -> DataFrame:
        """(id, degree), each point its own neighbour."""
        found = self.edges_df.groupBy("src").agg(F.count("*").alias("n"))
        return self.points.df.select("id").join(found, F.col("id") == F.col("src"), "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("degree"))

    def num_edges(self) -> int:
        """Directed edges and self-loops."""
        return self.written().edges_df.count() + self.points.df.count()

    def summary(self) -> DataFrame:
        """(num_points, num_edges, density)"""
        self.written()
        n = self.points.df.agg(F.count("*").alias("num_points"))
        m = self.edges_df.agg(F.count("*").alias("m"))
        return n.crossJoin(m).select("num_points", (F.col("m") + F.col("num_points")).alias("num_edges")).withColumn("density", F.col("num_edges") / F.col("num_points"))

    def density(self) -> float:
        return self.summary().first()["density"]

    def edge_lines(self) -> DataFrame:
        """(line): the header ``% n n m``, then ``src dst`` from 1, self-loops included. Order is free but for the header."""
        self.written()
        body = self.with_loops().select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("line"))
        head = self.summary().select(F.concat_ws(" ", F.lit("%"), "num_points", "num_points", "num_edges").alias("line"))
        return head.unionByName(body)

    def write_edge_file(self, path: str) -> None:
        """One text file: executors write parts in the shared folder, the driver streams them together behind the header."""
        spark = self.found.sparkSession
        s = self.summary().first()
        parts = scratch_path(spark, "edge-parts")
        self.with_loops().select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1)).write.text(parts)
        with open_output(spark, path) as out:
            out.write(f"% {s['num_points']} {s['num_points']} {s['num_edges']}\n".encode())
            for part in part_files(spark, parts):
                out.copy(part)
        delete_path(spark, parts)

    def run_record(self) -> dict[str, Any]:
        """What was run and what came out, as the reports read it. Arrays have an entry for each task slot; times that Spark
        spends on shuffles and waiting are in its own event log, not here."""
        s = self.summary().first()
        work = {r["process"]: r for r in self.metrics().collect()}  # a row for each task slot
        each = lambda c, none: [work[k][c] if k in work else none for k in range(self._processes())]
        return {
            "parameters": self.parameters, "dist_comps": each("dist_comps", 0), "comp_times": each("comp_time", 0.0), "points_read": each("points_read", 0),
            "runtime": self.runtime, "num_points": s["num_points"], "num_edges": s["num_edges"], "num_procs": self._processes(),
        }

    def write_run_record(self, path: str) -> None:
        with open_output(self.found.sparkSession, path) as out:
            out.write(json.dumps(self.run_record(), indent=4).encode())
