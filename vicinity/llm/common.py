"""Shared helpers: scratch tables that are deleted again, row keys, and block-wise views of Arrow text."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import scratch_root, ship  # noqa: F401  (used by the operators)

#: Bytes of text that one vectorised step looks at; bounds a Python worker's memory.
BLOCK_BYTES = 1_000_000


#: Scratch folders made by this process and not deleted yet.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(path := f"{scratch_root(spark)}/vicinity/{name}-{uuid.uuid4().hex}")
    return path


def finish(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch folders made after the first ``since`` of ``_made``, but for ``keep``."""
    for path in list(_made[since:]):
        if path not in keep:
            delete_path(spark, path)


def scratch_mark() -> int:
    return len(_made)


def finished(result: DataFrame, since: int, name: str) -> DataFrame:
    """``result``, written down, and nothing else of what was made on the way to it."""
    out = materialize(result, name)
    finish(result.sparkSession, since, (out._vicinity_path,))
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vicinity_path = path
    return out


#: Bytes of a row group that a Python worker writes; bounds what it holds.
GROUP_BYTES = 32_000_000


def _write(batches: Iterator, folder: str, step: Callable[[Iterator], Iterator] | None) -> Iterator:
    """Write the batches (what ``step`` makes of them) to one file, hidden so far; yield its partition and name, if it has rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark import TaskContext

    name, writer, held, size = f"_{uuid.uuid4().hex}", None, [], 0
    for b in step(batches) if step else batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= GROUP_BYTES:
            writer = writer or pq.ParquetWriter(f"{folder}/{name}", b.schema, compression="zstd")
            writer.write_table(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        writer = writer or pq.ParquetWriter(f"{folder}/{name}", held[0].schema, compression="zstd")
        writer.write_table(pa.Table.from_batches(held))
    if writer:
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name])], ["part", "name"])


def _by_workers(df: DataFrame, folder: str, step: Callable[[Iterator], Iterator] | None) -> int:
    """Let the Python workers write ``df`` to a folder of a file system that all mount. Only files of tasks that ended well are named as data.
    Returns how many partitions there are up to the last one with rows."""
    os.makedirs(folder)
    ship(df.sparkSession)
    last, files = -1, df.mapInArrow(partial(_write, folder=folder, step=step), "part int, name string")
    found = [(row.getInt(0), row.getString(1)) for row in files._jdf.collectAsList()]
    # py4j tells the JVM of Python's garbage up to a second late, and this plan keeps its shuffle files until then
    df.sparkSession.sparkContext._gateway._gateway_client.garbage_collect_object(files._jdf._target_id, False)
    for part, name in found:
        os.rename(f"{folder}/{name}", f"{folder}/part-{part:05d}-{name[1:]}_{part:05d}.c000.zstd.parquet")  # as Spark names a bucket's file
        last = max(last, part)
    return last + 1


def materialize_arrow(df: DataFrame, name: str, step: Callable[[Iterator], Iterator] | None = None, schema: str | None = None) -> DataFrame:
    """:func:`materialize` of ``df``, or of ``df.mapInArrow(step, schema)``, written by the Python workers.

    On a local or mounted path Hadoop's writer starts a program (``chmod``) three times for each file. Until it runs it shares the executor's
    memory, so an executor seems to be twice its size. In other stores nothing of the kind happens, and Spark writes. What ``df`` itself
    has made in Python belongs into ``step``: a second Python node doubles the workers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    folder = runtime.local_folder(spark, path)
    made = df.mapInArrow(step, schema) if step else df
    if folder is None:
        made.write.parquet(path)
    else:
        _by_workers(df, folder, step)
    out = spark.read.schema(made.schema).parquet(path)
    out._vicinity_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    They go when the driver's garbage is collected, which an idle driver puts off for as long as half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing will read again."""
    path = getattr(df, "_vicinity_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    runtime.delete_path(spark, path)
    if path in _made:
        _made.remove(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` bucketed by ``key``, so that later joins on it move only the other side."""
    spark = df.sparkSession
    n = partitions(spark)
    table = f"vicinity_{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    folder = runtime.local_folder(spark, path)
    if folder is None:
        df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(table)
    else:
        # a bucket is a partition of that number: both are the key's hash modulo n
        if _by_workers(df.repartition(n, key), folder, None) > n:
            raise RuntimeError(f"more than {n} partitions were written")
        columns, at = df._jdf.schema().asNullable().toDDL(), path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {n} BUCKETS LOCATION '{at}'")
    release(spark)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and what has been resolved goes on reading them
    out._vicinity_path = path
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two 64-bit hashes, ``_k1`` and ``_k2``, that tell rows of different doc_id or text apart, nulls too."""
    parts = [F.col(doc_id).isNull(), F.col(doc_id).cast("long"), F.col(text).isNull(), F.col(text).cast("string")]
    return [F.xxhash64(F.lit(k), *parts).alias(f"_k{k}") for k in (1, 2)]


def carry(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct ``rest``, so that no name can clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*out, *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))


#: A key is hot if it has at least HOT_LEAST of the rows in a sample of one in HOT_SAMPLE, and one in HOT_KEYS of the sample.
HOT_SAMPLE, HOT_LEAST, HOT_KEYS = 64, 16, 20_000


def live_groups(rows: DataFrame, name: str) -> DataFrame:
    """The rows (a, c, multi, twice, doc_id, pos, ...), which are read several times, with ``some`` (the rows of the same
    key ``a`` have several c, or one of them has ``multi``) and, of the rows of the same (a, c): ``twice``, ``low`` and ``high``
    (doc_id, pos). Rows whose key nothing else has may be left out.

    One shuffle by key, but for hot keys, of which there are HOT_KEYS at most: those are aggregated before the shuffle and joined
    back to their rows, which adaptive execution splits. A sample tells which are hot; results don't depend on it.
    """
    here = F.struct("doc_id", "pos")
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(HOT_SAMPLE)) == 0)
    hot = sample.groupBy("a").count().where(F.col("count") >= max(HOT_LEAST, -(-sample.count() // HOT_KEYS))).select("a")
    hot = materialize_arrow(hot, "hot-keys")
    key, whole = Window.partitionBy("a"), Window.partitionBy("a", "c")
    none = hot.isEmpty()
    cold = rows if none else rows.join(F.broadcast(hot), "a", "left_anti")
    cold = cold.repartition("a").sortWithinPartitions("a", "c")
    cold = cold.withColumn("some", (F.min("c").over(key) != F.max("c").over(key)) | F.max("multi").over(key)).drop("multi").withColumns(
        {"twice": F.max("twice").over(whole), "low": F.min(here).over(whole), "high": F.max(here).over(whole)}
    )
    if none:
        discard(hot)
        return cold
    rows = materialize_arrow(rows.join(F.broadcast(hot), "a", "left_semi"), name)
    some = rows.groupBy("a").agg(((F.min("c") != F.max("c")) | F.max("multi")).alias("some"))
    same = rows.groupBy("a", "c").agg(F.max("twice").alias("twice"), F.min(here).alias("low"), F.max(here).alias("high"))
    warm = rows.drop("multi", "twice").join(some, "a").join(same, ["a", "c"])
    return cold.unionByName(warm)


def place() -> Column:
    """What tells rows that share a doc_id apart: 31 bits of a hash of doc_id and text, as the upper half of a position."""
    return F.shiftleft(row_key()[0].bitwiseAND(F.lit((1 << 31) - 1)), 32).alias("place")


# --- block-wise text -------------------------------------------------------------------------


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow string column into blocks of whole values.

    Yields (first row, end row, bytes, offsets) where ``bytes[offsets[i]:offsets[i+1]]`` is the
    UTF-8 of row ``first + i``. Nulls are empty. A value longer than ``limit`` is a block alone.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.cast(pc.fill_null(column, ""), pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


_MASK = (1 << 64) - 1
_BASES = (6364136223846793005, 2862933555777941757)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Roller:
    """Hashes of arbitrary ranges of a sequence from prefix sums, modulo 2^64."""

    def __init__(self, seed: int = 0):
        base = _BASES[seed % 2]
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.power = np.ones(1, np.uint64)
        self.unpower = np.ones(1, np.uint64)
        self.table = mix(np.arange(1 + 256 * (seed + 1), 257 + 256 * (seed + 1), dtype=np.uint64)) | np.uint64(1)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 1 << 16)
            for name, x in (("power", self.base), ("unpower", self.inverse)):
                a = np.full(size, x, np.uint64)
                a[0] = 1
                np.multiply.accumulate(a, out=a)
                setattr(self, name, a)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self.grow(n)
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * self.power[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.unpower[start])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without space, tab, LF, VT, FF, CR) of each value: starts, ends, first word of each value (one more entry)."""
    n = len(buf)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~_SPACE[buf]
    inner = off[(off > 0) & (off < n)]
    starts = word[1:-1] & ~word[:-2]
    starts[inner] = word[1:-1][inner]
    ends = word[1:-1] & ~word[2:]
    ends[inner - 1] = word[1:-1][inner - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value among each ``width`` consecutive ones, the last of equals.

    Compares the leading bits only; what it picks depends on the window's content alone. Works in
    pieces, so that positions fit the bits left for them.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = 24
    piece = (1 << bits) - width
    out = np.empty(n, np.int64)
    for at in range(0, n, piece):
        end = min(n, at + piece)
        h = hashes[at : end + width - 1]
        low = np.uint64((1 << bits) - 1)
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        rest = width - span
        if rest:
            key = np.minimum(key[:-rest], key[rest:])
        out[at:end] = at + (low - (key & low)).astype(np.int64)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
