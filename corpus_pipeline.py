"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it
kept. All but the last return the columns of the input.

Defined results: a row is known by its doc_id and text, never by its doc_id alone, so rows that share a doc_id are
judged each by its own text, those of a null doc_id too. Of rows that share doc_id and text both, one stays in exact
dedup (any: other columns may differ). Ties between copies go to the most code points (exact dedup), then to the least
doc_id, null ones last. Null texts count as empty. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.common import finish, materialize, row_key, scratch_mark, scratch_path
from vicinity.llm.exact_dedup import exact_dedup
from vicinity.llm.packing import pack
from vicinity.llm.quality import fit, score
from vicinity.llm.simhash import similar_classes
from vicinity.llm.substring_dedup import substring_dedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labels of this run's documents."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("predicted = 1").select("row.*")


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict (_k1, _k2, kept) is to stay, one of each key."""
    verdicts = materialize(verdicts.select("_k1", "_k2", "kept"), "verdicts")
    keyed, key = docs.select(*docs.columns, *row_key()), ["_k1", "_k2"]
    left = keyed.join(verdicts.where("NOT kept").select(*key), key, "left_anti")
    again = verdicts.where("kept").groupBy(*key).count().where("count > 1").select(*key)
    if not again.isEmpty():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates(key))
    return left.select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text."""
    return keep_rows(docs, exact_dedup(docs))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more on five-word shingles, the row of least doc_id."""
    ref = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), *row_key())
    groups = similar_classes(docs.select(ref.alias("ref"), F.col("text").cast("string").alias("text")))
    return keep_rows(docs, groups.select("ref._k1", "ref._k2", (F.col("ref") == F.col("leader")).alias("kept")))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without words covered by twenty-word windows that occurred earlier; texts that lose none stay as they are."""
    out = substring_dedup(docs, verbatim=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text")}
    return out.select(*[(new[c] if c in new else F.col("rest").getField(c)).cast(kind).alias(c) for c, kind in docs.dtypes])


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches: which words of which document go into which batch."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("substring dedup", drop_repeats),
    ("packing", pack_batches),
]

#: Classifier, connected groups and boundaries by dynamic programming have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again. Only the last one's table is left there."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        finish(spark, since, (path,))
        docs = spark.read.parquet(path)
    return docs
