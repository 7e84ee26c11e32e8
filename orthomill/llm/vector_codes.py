"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

A vector is cut into equal parts and every part position has its own codebook, fitted by rounds
of assigning all parts and averaging. Nearest entries are found by LAESA: the distances from a
part to a few fixed pivots are computed once and written beside the vector; in every round the
pivots' distances to the moved entries are computed anew, and |d(part, pivot) - d(pivot, entry)|
bounds the distance to an entry from below. Entries are tried in the order of their bounds and a
part is done when the next bound exceeds its best distance, so only few exact integer distances
are evaluated.

The driver holds codebooks and sums by entry, whose size is that of the codebooks; all rows are
read in every round and none is sampled.

Defined results: rows whose vector is null or holds null or non-finite components drop; so do
those of another length than the first row's by id. The first rows by id start the codebooks, null
ids last, equal ids by their components; with fewer rows than entries the codebooks are smaller.
Repeated rows count as often as they occur. Null labels add up together. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
SLICE = 4096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows of a and rows of b."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2).astype(float))


def far_apart(entries: np.ndarray, pivots: int) -> np.ndarray:
    """The first entry, then each time the one farthest from those chosen."""
    chosen = [0]
    least = distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(pivots, len(entries)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest entry of each part, the lowest number on ties, and how many distances it took."""
    bound = np.zeros((len(x), len(entries)))
    for j in range(to_pivots.shape[1]):
        a, b = to_pivots[:, j : j + 1], entry_pivots[None, :, j]
        np.maximum(bound, np.abs(a - b) - 1e-9 * (a + b), out=bound)  # room for rounding
    order = np.argsort(bound, axis=1, kind="stable")
    best, at, alive, taken = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), np.arange(len(x)), 0
    for j in range(len(entries)):
        e = order[alive, j]
        going = bound[alive, e] ** 2 <= best[alive]
        alive, e = alive[going], e[going]
        if not len(alive):
            break
        d = ((x[alive] - entries[e]) ** 2).sum(axis=1)
        better = (d < best[alive]) | (d == best[alive]) & (e < at[alive])
        best[alive[better]], at[alive[better]] = d[better], e[better]
        taken += len(alive)
    return at, best, taken


def assigned(column, pivot_column, books: np.ndarray, pivots: np.ndarray):
    """Slices of a batch: from, to, parts, entry numbers and squared distances (rows x parts)."""
    parts, _, width = books.shape
    x, near = matrix(column, parts * width), matrix(pivot_column, parts * pivots.shape[1])
    between = [distances(b, p) for b, p in zip(books, pivots)]
    for lo in range(0, len(x), SLICE):
        part = x[lo : lo + SLICE].reshape(-1, parts, width)
        dist = near[lo : lo + SLICE].reshape(-1, parts, pivots.shape[1])
        found = [nearest(part[:, j], dist[:, j], books[j], between[j])[:2] for j in range(parts)]
        yield lo, lo + len(part), part, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``near``: the distances of every part to its position's pivots."""
    parts, count, width = pivots.shape
    names = ["vec_id", "label", "x", "near"]

    def run(batches):
        for b in batches:
            x = matrix(b.column(2), parts * width).reshape(-1, parts, width)
            near = np.stack([distances(x[:, j], pivots[j]) for j in range(parts)], 1).reshape(len(x), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts * count, pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names)

    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, x array<long>, near array<double>")


def moved(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Codebooks after all parts are assigned and each entry becomes the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            for _, _, part, at, _ in assigned(b.column(0), b.column(1), books, pivots):
                for j in range(parts):
                    np.add.at(sums[j], at[:, j], np.column_stack([part[:, j], np.ones(len(part), np.int64)]))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.ravel()[used])], ["at", "v"])

    got = rows.select("x", "near").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()  # at most a number per codebook component and count
    sums = np.zeros(books.size // width * (width + 1), np.int64)
    for r in got:
        sums[r["at"]] = r["v"]
    sums = sums.reshape(parts, entries, width + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of integer vectors (vec_id, label, x)."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    kept = materialize(vectors.select("vec_id", "label", "x"))
    first = kept.orderBy(*order).limit(1).collect()
    dims = len(first[0]["x"]) if first else parts
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    kept_rows = kept.filter(F.size("x") == dims)
    head = kept_rows.orderBy(*order).limit(entries).collect()  # a codebook's worth of rows
    coded = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if not head:
        return kept.sparkSession.createDataFrame([], coded).select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = np.array([r["x"] for r in head], np.int64).reshape(len(head), parts, -1).transpose(1, 0, 2)
    fixed = np.stack([far_apart(b, pivots) for b in books])
    rows = materialize(with_pivots(kept_rows, fixed))
    for _ in range(rounds):
        books = moved(rows, books, fixed)
    names = ["vec_id", "label", "code", "error"]

    def run(batches):
        for b in batches:
            for lo, hi, _, at, best in assigned(b.column(2), b.column(3), books, fixed):
                codes = [bytes(row).hex() for row in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(codes), pa.array(best.sum(axis=1))], names)

    done = materialize(rows.select("vec_id", "label", "x", "near").mapInArrow(run, coded))
    discard(kept, rows)
    totals = done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return done.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(integer_vectors(table(spark, sf_dir, "embeddings")))


def _assign(name: str, books: str) -> str:
    distance = " + ".join(f"(p.x[{i}] - b.c[{i}]) * (p.x[{i}] - b.c[{i}])" for i in range(1, 5))
    return f"{name} AS (SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min(({distance}) * 64 + b.e) AS m FROM p JOIN {books} b USING (part) GROUP BY p.vec_id, p.label, p.part)"


def _move(name: str, books: str, of: str) -> str:
    means = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
    return f"{name} AS (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM {books} b LEFT JOIN (SELECT part, m % 64 AS e, [{means}] AS c FROM {of} GROUP BY 1, 2) n USING (part, e))"


OP13_SQL = (
    "WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "p AS (SELECT vec_id, label, j AS part, v[4 * j + 1 : 4 * j + 4] AS x FROM k, range(0, 16) t(j)), "
    "b0 AS (SELECT part, e, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 64), "
    + ", ".join([_assign("a0", "b0"), _move("b1", "b0", "a0"), _assign("a1", "b1"), _move("b2", "b1", "a1"), _assign("a2", "b2")])
    + ", r AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY 1, 2), "
    "h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS v, unnest(range(0, 4)) AS i FROM b2)) "
    "SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, h"
)
