"""Substring dedup on words: seeds by winnowing, extension both ways, maximal repeats removed.

Defined results: null texts are empty; texts shorter than a window lose nothing; a passage
that repeats inside one document counts, overlapping copies included; equal rows remove each
other's text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import covered_documents, without_repeats


def remove_repeated_words(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 35, seed: int = 6, texts: bool = False) -> DataFrame:
    """doc_id, n, n_removed, n_spans, longest, kept_sha256 and optionally the kept words joined by spaces."""
    return without_repeats(covered_documents(docs, "word", window, seed, id_col, text_col), "word", window, texts)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents")).selectExpr("doc_id", "n AS n_words", "n_removed", "kept_sha256", "n_spans")
