"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, scratch_mark


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantise, top_k

    since = scratch_mark()
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("v"))
    return finished(top_k(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")).drop("read"), since, "op1")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_verdicts

    since = scratch_mark()
    return finished(url_verdicts(_table(spark, sf_dir, "pages")), since, "op2")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    since = scratch_mark()
    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return finished(out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")), since, "op3")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_fst import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    since = scratch_mark()
    return finished(exact_dedup(_table(spark, sf_dir, "documents")).drop("_k1", "_k2"), since, "op5")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    since = scratch_mark()
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return finished(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), since, "op8")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    since = scratch_mark()
    return finished(pack(_table(spark, sf_dir, "documents")), since, "op9")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    since = scratch_mark()
    out = suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return finished(out, since, "op10")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_topk, op2_url_filter, op3_substring_dedup, op4_sentencepiece, op5_exact_dedup, op6_quality, op7_language_id, op8_simhash, op9_packing, op10_suffix_dedup, pipeline)}


def sql() -> dict[str, str]:
    from . import exact_dedup, substring_dedup, suffix_dedup, topk, url_filter

    return {
        "op1_topk": topk.SQL, "op2_url_filter": url_filter.sql(), "op3_substring_dedup": substring_dedup.SQL,
        "op5_exact_dedup": exact_dedup.SQL, "op10_suffix_dedup": suffix_dedup.SQL,
    }
