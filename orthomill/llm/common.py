"""Shared helpers: written intermediate tables, words, and 64-bit hashing in numpy."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import forget as discard  # noqa: F401
from ..sources.tables import written as materialize  # noqa: F401

U64 = np.uint64

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col) -> F.Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def sampled(ident, n: int, sample: int):
    """Whether a row's id is among about ``sample`` of ``n`` ids: all of them, or those with a small hash."""
    share = 1_000_000 if n <= sample else 1_000_000 * sample // n
    return F.pmod(F.xxhash64(F.lit("sample"), ident), F.lit(1_000_000)) < share


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered; forgets everything once ``limit`` words are held."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after another, and each text's number of words."""
    counts, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        words = text.split()  # bytes.split() cuts at exactly the six ASCII white-space characters
        counts[i] = len(words)
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive units."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = units[:n].copy()
        for i in range(1, k):
            h = (h ^ (h >> U64(29))) * U64(0x9E3779B97F4A7C15) + units[i : n + i]
        return mix(h)


def chunks_by_bytes(texts: list[bytes], limit: int = 4_000_000):
    """Cut a batch into slices of about ``limit`` bytes, so that arrays stay small; yields (start, stop)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
