"""Packing into optimal length buckets and token-budget batches.

The global histogram of sequence lengths goes to the driver; it has ``max_length`` + 1 entries at most,
whatever the corpus. Dynamic programming over it chooses the bucket boundaries that minimise padding
(every sequence is padded to its bucket's boundary). Inside a bucket each batch has as many sequences
as fit the token budget at the bucket's length.

Texts of more than ``max_length`` words become several sequences; no word is lost. A bucket is dealt
into shards of about sixteen batches (by the known counts), so that no task numbers a whole bucket; each
shard has one unfilled batch at most.

Defined results: a null or empty text is one sequence of length 0; repeated rows are sequences each, which may
change places; a null doc_id is kept as it is; equal lengths share a bucket; an empty table gives no rows. Extra columns
are ignored. Batches depend on the rows alone (shards by a hash of doc_id, text and piece), not on their partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key

BATCHES_PER_SHARD = 16


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding; lengths are ascending and distinct."""
    m = len(lengths)
    if not m:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    s = np.concatenate([[0], np.cumsum(counts * lengths)])
    ends = np.arange(1, m + 1)
    best = lengths * n[ends] - s[ends]  # one bucket over the first j lengths
    cut = [np.zeros(m + 1, np.int64)]
    best = np.concatenate([[0], best])
    for _ in range(1, min(buckets, m)):
        new, at = best.copy(), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            at[j] = np.argmin(cost)
            new[j] = cost[at[j]]
        best = new
        cut.append(at)
    out, j = [], m
    for at in reversed(cut):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(at[j])
    return out[::-1]


def pack(docs: DataFrame, max_length: int = 4096, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """doc_id, piece, start, length (words), bucket, padded (bucket's length), batch_id, slot."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n"), row_key()[0].alias("row")
    )
    pieces = materialize(
        rows.select(
            "doc_id", "n", "row",
            F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / max_length) - 1, F.lit(0)).cast("long"))).alias("piece"),
        ).select(
            "doc_id", "row", F.col("piece").cast("int").alias("piece"), (F.col("piece") * max_length).alias("start"),
            F.least(F.col("n") - F.col("piece") * max_length, F.lit(max_length)).alias("length"),
        ),
        "sequences",
    )
    histogram = sorted(map(tuple, pieces.groupBy("length").count().collect()))
    lengths, counts = (np.array([h[i] for h in histogram], np.int64) for i in (0, 1))
    ends = optimal_boundaries(lengths, counts, buckets)
    plan = F
    for i, end in enumerate(ends):
        rows_in = int(counts[(lengths > (ends[i - 1] if i else -1)) & (lengths <= end)].sum())
        fit = max(1, budget // max(1, end))
        of_bucket = F.struct(
            F.lit(i).alias("bucket"), F.lit(end).cast("long").alias("padded"),
            F.lit(-(-rows_in // (BATCHES_PER_SHARD * fit))).cast("long").alias("shards"), F.lit(fit).cast("long").alias("capacity"),
        )
        plan = plan.when(F.col("length") <= end, of_bucket)
    if not ends:
        plan = F.struct(F.lit(0).alias("bucket"), *[F.lit(1).cast("long").alias(x) for x in ("padded", "shards", "capacity")])
    dealt = pieces.withColumn("plan", plan).select("*", "plan.*").withColumn(
        "shard", F.pmod(F.xxhash64("row", "piece"), F.col("shards")).cast("long")
    )
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("length", "doc_id", "piece", "row")) - 1
    return dealt.withColumn("number", number).select(
        "doc_id", "piece", "start", "length", "bucket", "padded",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("number") / F.col("capacity"))).alias("batch_id"),
        (F.col("number") % F.col("capacity")).cast("int").alias("slot"),
    )
