"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``; each result is written to the shared folder and
read again as the next stage's input, so a lost executor costs one stage at most.

Rows reach Python in batches of at most ``BATCHES``, which the stages set in the session unless
it has values of its own: by default one batch holds up to 10,000 rows, tens of MB of text, in the
JVM's direct memory and again, with what is made of it, in each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill.llm import mixing, near_dup, packing, pii, quality_model
from orthomill.llm.common import materialize, table


#: Rows and bytes; the rows are a multiple of packing's look-ahead.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, whose result may be computed later in the same session, with ``BATCHES``."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_model.keep_good(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id, null ids last. Links start at similarity 0.8.

    Rows are numbered and written first, so equal rows under one id, or none, are duplicates like
    any others; they travel as one struct, so columns of any name are safe.
    """
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("given"), F.monotonically_increasing_id().alias("row")))
    given = lambda c: F.col("given").getField(c)
    groups = near_dup.near_duplicates(numbered.select("row", given("text").alias("text")), "row", percent=80)
    placed = numbered.select("row", given("doc_id").alias("doc_id")).join(groups.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = placed.groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select("given.*")


@in_small_batches
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes the name of its kind."""
    return pii.mask_documents(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their shares of words; a document may appear once per epoch, and one per source in part."""
    return mixing.mixed_rows(docs)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", to_weights),
    ("packing", packed),
]

#: Fitted models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
