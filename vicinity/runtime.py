"""Session helpers: shared scratch tables and code for the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a plain local session may fall back to a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="vicinity-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/vicinity/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; cuts lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_vicinity_core_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="vicinity-code-"), "vicinity_core.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(target)
    sc._vicinity_core_shipped = True


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system knows it, if it is in a file system that is mounted here; else null."""
    p, fs = _fs(spark, path)
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def part_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the data files in a written folder, in order."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))


class open_output:  # noqa: N801
    """A file in any store that Spark knows, written by the driver; an existing one is replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, (p, fs) = spark, _fs(spark, path)
        self.stream = fs.create(p, True)

    def __enter__(self) -> open_output:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def write(self, data: bytes) -> None:
        self.stream.write(bytearray(data))

    def copy(self, path: str) -> None:
        """Append another file, streamed in the JVM."""
        p, fs = _fs(self.spark, path)
        source = fs.open(p)
        try:
            self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, self.stream, 1 << 20, False)
        finally:
            source.close()
