"""Exact deduplication against a persistent digest index (DataFrame and SQL functions only).

The index is a table bucketed and sorted by digest. A batch of documents is digested once, its
digests are aggregated, those already in the index are taken out by a sort-merge anti-join (the
index side is read in place, bucket by bucket), and the rest are appended.

A batch has a key, of the caller or a new one. A batch that is appended again under its key, in part or whole,
gets the verdicts that it got before: its own digests are known by the key, and only those missing are appended.

Defined results: a null text counts as empty; empty texts equal one another; of equal texts in one
batch the one with the most code points stays, then the smallest doc_id (null ones last), then, of one doc_id, the
text with the least hash; a text that an earlier batch brought stays with that batch's row, and every later copy is
dropped. ``kept`` is never null; where the row that stays has no doc_id, keep_id is null. Rows that share doc_id and
text get the same verdict. An empty batch adds nothing. Other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, row_key, scratch_path

#: A digest with more than 1/HOT of a batch's rows is joined by broadcast: at most HOT such digests exist.
HOT = 2048

_SCHEMA = "digest string, keep_id long, keep_chars long, keep_row long, group_size long, batch string"


def normalised(text: Column) -> Column:
    """The text without space, tab, LF, VT, FF and CR; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """Persistent table of digests, bucketed and sorted by digest.

    ``path`` is a folder that all executors share; opened again (also by another session), it
    continues with what it holds. ``buckets`` is fixed when the index is made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.buckets = buckets or partitions(spark)
        self.table = f"vicinity_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE {self.table}")

    def append(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` against the index and itself, append what is new, and return one row
        per document: doc_id, keep_id, group_size (within the batch that brought the digest), kept,
        text_sha256, and the row's key (_k1, _k2)."""
        batch = batch or uuid.uuid4().hex
        seen = materialize(
            docs.select(
                F.col(doc_id).cast("long").alias("doc_id"),
                F.sha2(normalised(F.col(text)), 256).alias("digest"),
                F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"),
                *row_key(doc_id, text),
            ),
            "digests",
        )
        # written down, or the anti-join would be pushed below the aggregate and each copy shuffled
        groups = materialize(
            seen.groupBy("digest").agg(F.max(F.struct("chars", (-F.col("doc_id")).alias("low"), (-F.col("_k1")).alias("row"))).alias("best"), F.count("*").alias("group_size")),
            "digest-groups",
        )
        fresh = groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti").select(
            "digest",
            (-F.col("best.low")).alias("keep_id"),
            F.col("best.chars").alias("keep_chars"),
            (-F.col("best.row")).alias("keep_row"),
            "group_size",
            F.lit(batch).alias("batch"),
        )
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet").mode("append").option(
            "path", self.path
        ).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        discard(groups)

        total = seen.count()
        index = self.read()
        hot = F.broadcast(index.where((F.col("batch") == batch) & (F.col("group_size") > max(1, total // HOT))))
        rows = seen.join(hot, "digest").unionByName(
            seen.join(hot.select("digest"), "digest", "left_anti").join(index.hint("merge"), "digest")
        )
        return rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (F.col("_k1") == F.col("keep_row"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
            "_k1",
            "_k2",
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """Verdict for each row of ``docs`` against ``index`` (a new one, if none is given)."""
    if index:
        return index.append(docs, batch=batch)
    index = DigestIndex(docs.sparkSession)
    out = index.append(docs)
    index.close()
    return out


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
       digest AS text_sha256
FROM t
WINDOW w AS (PARTITION BY digest ORDER BY chars DESC, doc_id NULLS LAST)
"""
