"""Vectors as integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of at most this size after scaling, so that sums of products fit 64 bits.
LARGEST = 1 << 26


def integer_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label and ``x``, each component x as floor(scale * x); rows whose vector is null or holds null or non-finite components go.

    A component beyond 2^26 after scaling is an error.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).filter(F.coalesce(usable.isNotNull() & usable, F.lit(False)))
    scaled = lambda c: F.when(F.abs(c) * scale <= LARGEST, F.floor(c * float(scale)).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return rows.select("vec_id", "label", F.transform("v", scaled).alias("x"))


def matrix(column, dims: int | None = None) -> np.ndarray:
    """A row per list of equally long lists."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy().reshape(len(values), -1 if dims is None and len(values) else dims or 0)
