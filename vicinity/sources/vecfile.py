"""Binary vector files, little-endian: .fvecs (int32 d, then d float32, per row), .fbin and .u8bin
(uint32 n, uint32 d, then rows of float32 or uint8). A point's id is its row number from 0.

Files under a POSIX path are read by byte range through a Python data source (``vicinity_vectors``). In
other stores .fvecs is read as fixed-length records, also by range; .fbin and .u8bin are read whole, one
file a task, and may have 2 GB at most there.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.fmt import format_bytes
from ..operators.points import PointSet
from ..runtime import _fs, open_output, ship

FORMATS = {".fvecs": "<f4", ".fbin": "<f4", ".u8bin": "u1"}
SCHEMA = "id bigint, v array<float>"
#: Rows in an Arrow batch, and bytes that a partition has by default.
BATCH, PARTITION_BYTES = 8192, 128 << 20


@dataclass(frozen=True)
class Layout:
    """Where a file's rows are."""

    rows: int
    dim: int
    bytes: int
    kind: str

    @property
    def item(self) -> int:
        return np.dtype(FORMATS[self.kind]).itemsize

    @property
    def head(self) -> int:
        return 0 if self.kind == ".fvecs" else 8

    @property
    def stride(self) -> int:
        return self.dim * self.item + (4 if self.kind == ".fvecs" else 0)

    def decode(self, data: bytes) -> np.ndarray:
        """Rows of a whole number of records as float32."""
        if self.kind == ".fvecs":
            raw = np.frombuffer(data, "<i4").reshape(-1, self.dim + 1)
            if len(raw) and (raw[:, 0] != self.dim).any():
                raise ValueError("rows of different dimensions")
            return raw[:, 1:].copy().view("<f4")
        return np.frombuffer(data, FORMATS[self.kind]).reshape(-1, self.dim).astype(np.float32)


def kind_of(path: str) -> str:
    ext = os.path.splitext(path)[1]
    if ext not in FORMATS:
        raise ValueError(f"unknown vector file extension {ext!r}; known: {', '.join(FORMATS)}")
    return ext


def layout(kind: str, size: int, head: bytes) -> Layout:
    """From a file's size and first eight bytes."""
    if kind == ".fvecs":
        if not size:
            return Layout(0, 0, 0, kind)
        (dim,) = struct.unpack("<i", head[:4])
        if dim < 1 or size % (4 * (dim + 1)):
            raise ValueError("the file is no whole number of rows")
        return Layout(size // (4 * (dim + 1)), dim, size, kind)
    n, dim = struct.unpack("<II", head)
    out = Layout(n, dim, size, kind)
    if size < 8 + n * out.stride:
        raise ValueError("the file is shorter than its header says")
    return out


def file_layout(spark: SparkSession, path: str) -> Layout:
    """Of a file in any store, read through Spark's file systems."""
    p, fs = _fs(spark, path)
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        head = b"".join(struct.pack("B", max(0, stream.read())) for _ in range(min(8, size)))
    finally:
        stream.close()
    return layout(kind_of(path), size, head)


def _arrow(ids_from: int, rows: np.ndarray):
    import pyarrow as pa

    n, d = rows.shape
    v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(ids_from, ids_from + n)), v], ["id", "v"])


@dataclass
class RowRange(InputPartition):
    start: int
    end: int


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        with open(self.path, "rb") as f:
            self.layout = layout(kind_of(self.path), os.path.getsize(self.path), f.read(8))
        n = self.layout.rows
        self.start = min(max(int(options.get("start", 0)), 0), n)
        count = options.get("count")
        self.end = n if count is None else min(n, self.start + max(int(count), 0))
        default = -(-(self.end - self.start) * max(1, self.layout.stride) // PARTITION_BYTES)
        self.parts = max(1, int(options.get("numpartitions", options.get("numPartitions", default))))

    def partitions(self) -> list[RowRange]:
        edges = [self.start + (self.end - self.start) * k // self.parts for k in range(self.parts + 1)]
        return [RowRange(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator:
        with open(self.path, "rb") as f:
            f.seek(self.layout.head + partition.start * self.layout.stride)
            for at in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                yield _arrow(at, self.layout.decode(f.read(n * self.layout.stride)))


class VectorSource(DataSource):
    """``spark.read.format("vicinity_vectors").option("start", ...).option("count", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "vicinity_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options))


def read_points(spark: SparkSession, path: str, start: int = 0, count: int | None = None, partitions: int | None = None) -> PointSet:
    """Points ``start`` to ``start + count`` (clipped to the file) with their row numbers as ids."""
    ship(spark)
    if "://" not in path or path.startswith("file://"):
        spark.dataSource.register(VectorSource)
        reader = spark.read.format("vicinity_vectors").option("start", start)
        reader = reader if count is None else reader.option("count", count)
        reader = reader if partitions is None else reader.option("numPartitions", partitions)
        return PointSet(reader.load(path))
    shape = file_layout(spark, path)
    if shape.kind == ".fvecs":
        raw = spark.sparkContext.binaryRecords(path, shape.stride).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
        df = spark.createDataFrame(raw, "id bigint, data binary")

        def unpack(batches: Iterator) -> Iterator:
            for b in batches:
                rows = shape.decode(b"".join(x.as_py() for x in b.column(1)))
                out = _arrow(0, rows)
                yield out.set_column(0, "id", b.column(0))

        return PointSet(df.mapInArrow(unpack, SCHEMA)).slice(start, count)

    def whole(batches: Iterator) -> Iterator:
        for b in batches:
            for x in b.column(0):
                data = x.as_py()
                for at in range(0, shape.rows, BATCH):
                    n = min(BATCH, shape.rows - at)
                    begin = shape.head + at * shape.stride
                    yield _arrow(at, shape.decode(data[begin : begin + n * shape.stride]))

    return PointSet(spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, SCHEMA)).slice(start, count)


def write_points(points: PointSet, path: str) -> int:
    """One file in id order, streamed through the driver a block at a time; returns the number of rows.
    For .u8bin every component must lie in 0..255; fractions are cut."""
    kind = kind_of(path)
    df = points.df
    spark = df.sparkSession
    ship(spark)
    n, low, high = df.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError("points of different dimensions")

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1)
            if kind == ".u8bin":
                if not ((rows >= 0) & (rows < 256)).all():
                    raise ValueError("a component does not fit a byte")
                data = rows.astype("u1").tobytes()
            elif kind == ".fbin":
                data = rows.tobytes()
            else:
                head = np.full((len(rows), 1), rows.shape[1], "<i4").view("<f4")
                data = np.hstack([head, rows]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    blocks = df.orderBy("id").select("v").mapInArrow(pack, "data binary")
    with open_output(spark, path) as out:
        if kind != ".fvecs":
            out.write(struct.pack("<II", n, high or 0))
        for row in blocks.toLocalIterator(prefetchPartitions=True):
            out.write(bytes(row["data"]))
    return n


def convert(spark: SparkSession, source: str, target: str, start: int = 0, count: int | None = None) -> int:
    """Copy a slice of a vector file, from any format to any."""
    return write_points(read_points(spark, source, start, count), target)


def catalog(spark: SparkSession, paths: list[str], unit: str | None = None) -> DataFrame:
    """(path, num, dim, type, size_bytes, size); files of unknown kind are left out. ``size`` is in the unit that suits each file, or in ``unit``."""
    rows = []
    for p in paths:
        if os.path.splitext(p)[1] in FORMATS:
            s = file_layout(spark, p)
            rows.append((p, s.rows, s.dim, "uint8" if s.kind == ".u8bin" else "float32", s.bytes))
    df = spark.createDataFrame(rows, "path string, num long, dim int, type string, size_bytes long")
    return df.withColumn("size", format_bytes(F.col("size_bytes"), unit=unit))
