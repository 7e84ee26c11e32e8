"""Compression of arriving images: transforms are expressions within the row, so streams need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.basis import Basis


def compress_stream(images: DataFrame, basis: Basis, ratio: float = 0.9) -> DataFrame:
    if not images.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return basis.compress(images, ratio=ratio)
