"""Run records (JSON) and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fmt import basename, format_large_number, method_label

RECORD = (
    "parameters struct<infile:string,method:string,radius:double,cover:double,leaf_size:bigint,num_centers:bigint,tree_assignment:string,"
    "query_balancing:string,queries_per_tree:bigint>, dist_comps array<bigint>, comm_times array<double>, comp_times array<double>, "
    "idle_times array<double>, points_read array<bigint>, runtime double, num_points bigint, num_edges bigint, num_procs bigint, steal_attempts array<bigint>, "
    "steal_successes array<bigint>, steal_services array<bigint>, my_steal_comp_time array<double>, my_steal_time array<double>, "
    "my_poll_time array<double>, my_response_time array<double>, my_allreduce_time array<double>"
)
#: Column of the per-process table, and the record's array that it comes from.
STEAL = {
    "comp_time": "my_steal_comp_time", "steal_time": "my_steal_time", "poll_time": "my_poll_time", "response_time": "my_response_time",
    "allreduce_time": "my_allreduce_time", "dist_comps": "dist_comps", "steal_successes": "steal_successes",
    "steal_attempts": "steal_attempts", "steal_services": "steal_services",
}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records of all JSON files that ``path`` (a glob) matches; one record may span lines."""
    return spark.read.schema(RECORD).json(path, multiLine=True)


def run_summary(records: DataFrame) -> DataFrame:
    """A row per run, numbers rounded to three places, by processes, method and balancing."""
    p = lambda c: F.col(f"parameters.{c}").alias(c)
    total = F.aggregate("dist_comps", F.lit(0).cast("long"), lambda a, x: a + x)
    return records.select(
        basename(F.col("parameters.infile")).alias("infile"), p("method"), F.round("parameters.cover", 3).alias("cover"), p("leaf_size"), p("num_centers"),
        p("tree_assignment"), p("query_balancing"), F.round("runtime", 3).alias("runtime"), "num_points", "num_edges", "num_procs",
        format_large_number(total).alias("dist_comps"),
    ).orderBy("num_procs", "method", "query_balancing")


def steal_table(records: DataFrame) -> DataFrame:
    """A row per process of stealing runs (gvor with steal); other records fail the job."""
    ok = (F.col("parameters.method") == "gvor") & (F.col("parameters.query_balancing") == "steal")
    checked = records.withColumn("num_procs", F.when(F.coalesce(ok, F.lit(False)), F.col("num_procs")).otherwise(F.raise_error("not a stealing run")))
    arrays = F.arrays_zip(*[F.col(a).alias(c) for c, a in STEAL.items()])
    rows = checked.select("num_procs", F.posexplode(arrays).alias("rank", "x")).where(F.col("rank") < F.col("num_procs"))
    field = lambda c: F.col("x").getField(c)
    return rows.select("rank", *[(format_large_number(field(c)) if c == "dist_comps" else field(c)).alias(c) for c in STEAL])


def scaling(summary: DataFrame) -> DataFrame:
    """(label, num_procs, runtime): what a strong-scaling chart shows."""
    return summary.select(method_label(F.col("method"), F.col("query_balancing")).alias("label"), "num_procs", "runtime").orderBy("label", "num_procs")


def process_counts(summary: DataFrame) -> DataFrame:
    """(num_procs): the different numbers of processes, in order."""
    return summary.select("num_procs").distinct().orderBy("num_procs")


def write_summary(summary: DataFrame, path: str) -> None:
    """CSV with a header."""
    summary.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)
