"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed 3- to 5-byte grams of its lower-cased letters that occur in
it. On the training rows every gram gets its log-count ratio between toxic and other texts;
the grams that tell the classes apart best are kept, scaled by that ratio, and a ridge
logistic model is fitted on them. All documents are scored where they are read.

Training uses about ``sample`` labelled ids whose ``crc32(id) mod 5`` is not 0 (all, or those
whose hash lies in a share of all hashes; of different labels of an id the largest counts), and the ``features`` grams that tell their classes apart best
(at most 65,536; equal ones by bucket number); so what reaches the driver has a bound
of ``sample`` rows of two bytes a gram. Scoring covers all rows and reads the text only.

Defined results: null and empty texts have no grams and score as the intercept; null labels
are not used; without both classes in the labels every score is the share of toxic ones (0.5 without labels); repeated
rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sampled, table
from .linear import fit_sparse, sigmoid

BITS = 18
SIZES = (3, 4, 5)
#: Lower-case letters and bytes of other scripts stay; all else counts as a space.
FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def gram_buckets(text: str | None) -> np.ndarray:
    """The bucket of every gram of the text, repeats included."""
    data = FOLD[np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    out, h = [], data
    with np.errstate(over="ignore"):
        for n in range(2, max(SIZES) + 1):
            h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :]
            if n in SIZES and len(h):
                out.append((h ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def held_out(id_col):
    return F.crc32(id_col.cast("string")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """doc_id, text, label of about ``sample`` training ids, a row each (the least text of a repeated id); so few that the ids are broadcast."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.filter(sampled(F.col("doc_id"), known.count(), sample))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))


def gram_counts(training: DataFrame) -> DataFrame:
    """bucket, toxic and other texts that have it; each task sums its texts first."""

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                counts[label, np.unique(gram_buckets(text.as_py()))] += 1
        bucket = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(counts[1, bucket]), pa.array(counts[0, bucket])], ["bucket", "toxic", "other"])

    return training.select("text", "label").mapInArrow(run, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = 20_000, features: int = 4096) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept."""
    training = training_texts(docs, labels, id_col, text_col, label_col, sample)
    weights = np.zeros(1 << BITS, np.float32)
    n = training.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not n.toxic or n.toxic == n.n:
        share = (n.toxic + 0.5) / (n.n + 1)
        return weights, float(np.log(share / (1 - share)))
    # how far a gram's share of toxic texts lies from its share of the others, in standard errors
    a, b, p = F.col("toxic") / n.toxic, F.col("other") / (n.n - n.toxic), (F.col("toxic") + F.col("other")) / n.n
    z = F.abs(a - b) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n.toxic + 1 / (n.n - n.toxic)))
    best = gram_counts(training).filter("toxic + other >= 3").withColumn("z", z).filter("z >= 3").orderBy(F.desc("z"), "bucket").limit(features).collect()
    bucket = np.array(sorted(r.bucket for r in best), np.int64)
    if not len(bucket):
        return weights, float(np.log(n.toxic / (n.n - n.toxic)))
    by = {r.bucket: r for r in best}
    toxic, other = (np.array([by[k][c] for k in bucket], float) + 1 for c in ("toxic", "other"))
    ratio = np.log(toxic / toxic.sum() / (other / other.sum()))
    column = np.full(1 << BITS, -1, np.int64)
    column[bucket] = np.arange(len(bucket))

    def run(batches):
        for b in batches:
            rows = [np.unique(c[c >= 0]).astype("<u2").tobytes() for c in (column[gram_buckets(t.as_py())] for t in b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.binary())], ["label", "grams"])

    fitted = training.select("text", "label").mapInArrow(run, "label int, grams binary").toPandas()
    fitted = sorted(zip(fitted["label"], map(bytes, fitted["grams"])))  # sums don't depend on the order in which tasks end
    w, intercept = fit_sparse([np.frombuffer(g, "<u2").astype(np.int64) for _, g in fitted], np.array([y for y, _ in fitted], float), ratio)
    weights[bucket] = w
    return weights, intercept


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    weights, intercept = model
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    used = weights != 0

    def run(batches):
        for b in batches:
            scores = np.empty(b.num_rows)
            for i, text in enumerate(b.column(2)):
                bucket = gram_buckets(text.as_py())
                scores[i] = intercept + float(weights[np.unique(bucket[used[bucket]])].sum())
            scores = sigmoid(scores)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
