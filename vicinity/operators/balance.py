"""Assignment of cells to bins, and placement of their rows."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def static(sizes: DataFrame, bins: int) -> DataFrame:
    """(cell, bin): cell modulo ``bins``."""
    return sizes.select("cell", F.pmod("cell", F.lit(bins)).cast("int").alias("bin"))


def multiway(sizes: DataFrame, bins: int) -> DataFrame:
    """(cell, bin): cells by falling size (of equals the higher cell first), each to the least loaded bin
    (of equals the first). One row per center is collected."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    rows = sorted(((r["size"], r["cell"]) for r in sizes.select("cell", "size").collect()), reverse=True)
    loads = [(0, b) for b in range(bins)]
    out = []
    for size, cell in rows:
        load, b = loads[0]
        out.append((cell, b))
        heapq.heapreplace(loads, (load + size, b))
    return sizes.sparkSession.createDataFrame(out, "cell int, bin int")


def place(rows: DataFrame, assignment: DataFrame, bins: int) -> DataFrame:
    """Rows with a cell, each bin's in a partition of its own. For layout on disk; the joins deal crowded cells by themselves."""
    return rows.join(F.broadcast(assignment), "cell").repartitionById(bins, F.col("bin"))
