"""Quality classifier on supervised subword embeddings.

Words and character trigrams (UTF-8 bytes, white space as one sign) are hashed to learned vectors, a
document is the average of the vectors of all that occur in it, and a softmax layer on top gives the
class. Training is stochastic gradient descent in numpy over a sample of labelled documents, bounded in rows and
bytes and chosen by a hash of the doc_id; scoring covers whole texts of all documents. A word that repeats the one before
it falls into a bucket of its own: junk says words twice, whatever words it is made of, and a hashed word alone can't tell.
The output layer is linear, so for scoring each hashed vector is folded into one number beforehand.

Defined results: null, empty and blank texts score by the bias alone; labels that are null or not 0 or 1
are ignored; of repeated labels the greatest counts; with no label of one class to learn from, every
document scores as the other class (0.5 if there are no labels). Only the text is ever scored. Rows repeat as given; a
null doc_id is returned with a score, is not held out and teaches nothing; columns of any other name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, ship, text_blocks, words_of

BITS = 17
#: Word bucket of a word that repeats the one before it.
REPEAT = 0
#: Features of no weight that each average counts in; a few words alone cannot swing it.
PRIOR = 10
#: Bound on the documents to learn from.
SAMPLE = 4000
_SIGN = np.arange(256, dtype=np.uint32)
_SIGN[[9, 10, 11, 12, 13, 32]] = 32


def features(buf: np.ndarray, off: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all words and of all trigrams of a block, each with the offsets of its documents."""
    starts, ends, first = words_of(buf, off)
    full = roller.of(roller.prefix(roller.table[buf]), starts, ends)
    words = (full >> np.uint64(64 - BITS)).astype(np.int32)
    again = np.flatnonzero(full[1:] == full[:-1]) + 1
    words[again[~np.isin(again, first)]] = REPEAT
    v = _SIGN[buf]
    if len(v) >= 3:
        h = (v[:-2] * np.uint32(0x9E3779B1)) ^ (v[1:-1] * np.uint32(0x85EBCA6B)) ^ (v[2:] * np.uint32(0xC2B2AE35))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    else:
        h = np.zeros(0, np.uint32)
    # trigrams that cross a document's end are cut off
    tail = np.minimum(np.maximum(off[1:] - 2, off[:-1]), len(h))
    head = np.minimum(off[:-1], tail)
    return words, first, h.astype(np.int32), np.stack([head, tail])


@dataclass
class QualityModel:
    words: np.ndarray  # folded: score of a word bucket
    grams: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        roller, out = Roller(0), []
        for lo, hi, buf, off in text_blocks(column):
            words, first, grams, (head, tail) = features(buf, off, roller)
            ws = np.concatenate([[0], np.cumsum(self.words[words], dtype=np.float64)])
            gs = np.concatenate([[0], np.cumsum(self.grams[grams], dtype=np.float64)])
            n = np.diff(first) + tail - head
            total = ws[first[1:]] - ws[first[:-1]] + gs[tail] - gs[head]
            blank = np.diff(first) == 0
            out.append(np.where(blank, 0.0, total / (n + PRIOR)) + self.bias)
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts, labels: list[int], dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Embeddings and a two-way softmax by stochastic gradient descent, one document a step. ``texts``: a list or an Arrow column."""
    import pyarrow as pa

    size = 1 << BITS
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0 if not labels else (4.0 if labels[0] else -4.0))
    # all bags in two arrays: the driver's memory is given back when they go
    roller, edge, indices, weights = Roller(0), [0], [], []
    for _, _, buf, off in text_blocks(texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.string())):
        words, first, grams, (head, tail) = features(buf, off, roller)
        own_index, own_weight = [], []
        for i in range(len(off) - 1):
            own = np.concatenate([words[first[i] : first[i + 1]], grams[head[i] : tail[i]] + size])
            index, count = np.unique(own, return_counts=True)
            own_index.append(index.astype(np.int32))
            own_weight.append((count / (len(own) + PRIOR)).astype(np.float32))
            edge.append(edge[-1] + len(index))
        indices.append(np.concatenate(own_index))
        weights.append(np.concatenate(own_weight))
    indices, weights = np.concatenate(indices), np.concatenate(weights)
    bags = len(edge) - 1
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (2 * size, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * bags, 0
    for _ in range(epochs):
        for i in rng.permutation(bags):
            index, weight = indices[edge[i] : edge[i + 1]], weights[edge[i] : edge[i + 1]]
            lr = rate * (1 - done / steps)
            done += 1
            mean = weight @ vectors[index]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = out @ g
            out -= lr * np.outer(mean, g)
            bias -= lr * g
            # each vector's own share is small, so the step is per feature, not per document
            vectors[index] -= (lr * np.minimum(1.0, weight * 20))[:, None] * back
    fold = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return QualityModel(fold[:size], fold[size:], float(bias[1] - bias[0]))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = 64_000_000) -> QualityModel:
    """Learn ``quality`` from labelled documents that are not held out: at most ``sample`` and ``sample_bytes`` of text (in expectation)."""
    known = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    )
    share = min(1.0, sample / max(1, known.count()))
    below = lambda x: F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * x)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known.where(below(share))), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.where(below(share * min(1.0, sample_bytes / max(1, size)))).toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "text")])
    return train(rows["text"], rows["quality"].to_pylist())


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` in ``row`` (a struct), with quality_score and predicted."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # two tables of 2^BITS numbers, whatever the corpus

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = shared.value.scores(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["row", "quality_score", "predicted"])

    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, quality_score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, sample), ["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), "predicted"
    )
