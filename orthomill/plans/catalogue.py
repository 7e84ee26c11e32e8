"""Registered queries and their SQL, by name."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import series
from ..operators import basis as B
from ..operators import circuits, coordinates, losses, manifolds, training
from ..sources import files
from ..sources.arrays import ArrayFiles
from ..sources.tables import shared_folder, written
from ..streaming.compress import compress_stream
from . import oracle as O
from .images import coefficients, cropped, kept_rows, mosaics, padded, pixels, rounded, table, unit_vectors, vectors

P3 = (0.1, 0.2, 0.3)
P6 = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
P8 = (*P6, 0.7, 0.8)
RING3 = ((1, 2), (2, 3), (3, 1))
RATIOS = (0.5, 0.8, 0.9, 0.95)
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


QFT = B.Basis.make("qft", 3, 3)
FORWARD = {
    "qft_forward": (QFT, O.transform(3, 3, "qft"), 8),
    "wht_forward": (B.Basis.make("tebd", 3, 3), O.transform(3, 3, "wht"), 8),
    "eqft_back": (B.Basis.make("eqft", 3, 3, P3, "back"), O.transform(3, 3, "qft", back=O.joint(P3, 3, 3, "u", "w")), 8),
    "eqft_front": (B.Basis.make("eqft", 3, 3, P3, "front"), O.transform(3, 3, "qft", front=O.joint(P3, 3, 3, "r0", "c0")), 8),
    "eqft_middle": (B.Basis.make("eqft", 3, 3, P3, "middle"), O.transform(3, 3, "qft", middle=O.joint(P3, 3, 3, "u", "c0")), 8),
    "eqft_middle_4x2": (B.Basis.make("eqft", 4, 2, P3[:2], "middle"), O.transform(4, 2, "qft", back=O.joint(P3[:2], 4, 2, "u", "w")), 16),
    "tebd_ring": (B.Basis.make("tebd", 3, 3, P6), O.transform(3, 3, "wht", back=O.pairs(P6[:3], RING3, "u") + " + " + O.pairs(P6[3:], RING3, "w")), 8),
    "mera_2x4": (B.Basis.make("mera", 2, 4, P8), O.transform(2, 4, "wht", back=O.pairs(P8[:2], ((2, 1), (1, 2)), "u") + " + " + O.pairs(P8[2:], ((2, 3), (4, 1), (1, 2), (3, 4), (2, 4), (1, 3)), "w")), 4),
}


def _forward(basis):
    return lambda spark, sf_dir: coefficients(basis.forward(vectors(spark, sf_dir), real=True), "vec_id")


for _name, (_basis, _sql, _h) in FORWARD.items():
    QUERIES[_name] = _forward(_basis)
    SQL[_name] = O.with_pixels(_sql) + O.all_coefficients(_h)


@query(O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8)) + " SELECT vec_id, u + 1 + w * 8 AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM rk WHERE rn <= 6")
def qft_topk(spark, sf_dir):
    return kept_rows(B.largest_after(vectors(spark, sf_dir), QFT.steps(), 3, 3, 6), "vec_id")


@query(O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8)) + " SELECT vec_id, u + 1 + w * 8 AS idx, CASE WHEN rn <= 6 THEN round(re, 6) + 0.0 ELSE 0 END AS re, CASE WHEN rn <= 6 THEN round(im, 6) + 0.0 ELSE 0 END AS im FROM rk")
def topk_dense(spark, sf_dir):
    return coefficients(B.truncated(QFT.forward(vectors(spark, sf_dir), real=True), 6, 64), "vec_id")


@query(O.with_pixels(O.transform(3, 3, "qft") + ", sc AS (SELECT *, round(sqrt(re * re + im * im) * (2.0::DOUBLE - 0.5::DOUBLE * sqrt(pow(u + 1 - 4.5, 2) + pow(w + 1 - 4.5, 2)) / sqrt(24.5::DOUBLE)), 9) AS score FROM f), rk AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY score DESC) AS rn FROM sc)")
       + " SELECT vec_id, u + 1 + w * 8 AS idx, round(score, 6) AS score FROM rk WHERE rn <= 6")
def topk_freq_weighted(spark, sf_dir):
    kept = B.weighted_largest(QFT.forward(vectors(spark, sf_dir), real=True), 3, 3, 6)
    return kept.select("vec_id", F.inline("kept")).select("vec_id", (F.col("lin") + 1).alias("idx"), F.round("score", 6).alias("score"))


@query(O.with_pixels(O.transform(3, 3, "qft") + ", " + O.transform(3, 3, "inverse_qft", "b", "ff") .replace("bg AS (SELECT vec_id, lin % 8 AS r0, lin // 8 AS c0, re, im FROM ff)", "bg AS (SELECT vec_id, u AS r0, w AS c0, re, im FROM f)"))
       + " SELECT px.vec_id, round(sqrt(sum(px.re * px.re)), 6) AS norm_in, round(sqrt(sum(f.re * f.re + f.im * f.im)), 6) AS norm_out, round(max(abs(px.re - b.re)), 6) + 0.0 AS worst"
       " FROM px JOIN f ON px.vec_id = f.vec_id AND px.lin = f.u + 8 * f.w JOIN b ON px.vec_id = b.vec_id AND px.lin = b.u + 8 * b.w GROUP BY px.vec_id")  # fmt: skip
def roundtrip_error(spark, sf_dir):
    norm = "sqrt(aggregate({0}, 0D, (s, v) -> s + v * v))"
    there = QFT.forward(vectors(spark, sf_dir).withColumn("x", F.col("re")), real=True)
    there = there.withColumn("norm_out", F.expr("sqrt(aggregate(arrays_zip(re, im), 0D, (s, z) -> s + z.re * z.re + z.im * z.im))"))
    back = QFT.inverse(there)
    return back.select("vec_id", F.round(F.expr(norm.format("x")), 6).alias("norm_in"), F.round("norm_out", 6).alias("norm_out"), rounded(F.expr("array_max(zip_with(x, re, (a, b) -> abs(a - b)))")).alias("worst"))


def _compressed(spark, sf_dir, images=vectors):
    return QFT.compress_ratios(images(spark, sf_dir), RATIOS)


RATIO_SQL = "ks AS (SELECT ratio, greatest(1, round_even(64 * (1.0::DOUBLE - ratio), 0)::INT) AS k FROM (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) t(ratio))"


@query(O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8) + ", " + RATIO_SQL) + " SELECT vec_id, ratio, rn::INT AS place, u + 1 + w * 8 AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM rk JOIN ks ON rn <= k")
def compress_ratio(spark, sf_dir):
    rows = _compressed(spark, sf_dir).select("vec_id", "ratio", F.posexplode(F.arrays_zip("indices", "values_real", "values_imag")).alias("at", "z"))
    return rows.select("vec_id", "ratio", (F.col("at") + 1).alias("place"), F.col("z.indices").alias("idx"), rounded(F.col("z.values_real")).alias("re"), rounded(F.col("z.values_imag")).alias("im"))


@query(O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8)) + " SELECT vec_id, count(*)::INT AS kept_count, round(sum(abs(re) + abs(im)), 6) AS weight FROM rk WHERE rn <= 10 GROUP BY vec_id")
def compress_k(spark, sf_dir):
    low = QFT.compress(vectors(spark, sf_dir), k=10)
    return low.select("vec_id", F.size("indices").alias("kept_count"), F.round(F.expr("aggregate(arrays_zip(values_real, values_imag), 0D, (s, z) -> s + abs(z.values_real) + abs(z.values_imag))"), 6).alias("weight"))


@query(f"WITH {RATIO_SQL} SELECT vec_id, ratio, 64 AS total, k AS kept_count, 1 - k / 64.0::DOUBLE AS kept_ratio, round(8 * 64 / (20 * k + 100)::DOUBLE, 9) AS storage_ratio FROM embeddings, ks")
def compression_stats(spark, sf_dir):
    stats = B.compression_stats(_compressed(spark, sf_dir).withColumnRenamed("ratio", "asked"))
    return stats.select("vec_id", F.col("asked").alias("ratio"), "total", "kept_count", F.col("ratio").alias("kept_ratio"), F.round("storage_ratio", 9).alias("storage_ratio"))


def _recovered(spark, sf_dir):
    images = unit_vectors(spark, sf_dir).withColumn("x", F.col("re"))
    return losses.picture_metrics(QFT.recover(QFT.compress_ratios(images, RATIOS)), "x", "re")


RECOVERED_SQL = (
    O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8) + ", " + RATIO_SQL
                  + ", low AS (SELECT vec_id * 4 + CASE ratio WHEN 0.5 THEN 0 WHEN 0.8 THEN 1 WHEN 0.9 THEN 2 ELSE 3 END AS vec_id, (u + 8 * w)::BIGINT AS lin, CASE WHEN rn <= k THEN re ELSE 0 END AS re, CASE WHEN rn <= k THEN im ELSE 0 END AS im FROM rk, ks), "
                  + O.transform(3, 3, "inverse_qft", "b", "low")
                  + ", err AS (SELECT b.vec_id // 4 AS vec_id, CASE b.vec_id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS ratio, v.label, avg(pow(v.v - greatest(0, least(1, b.re)), 2)) AS mse"
                  " FROM b JOIN v ON v.vec_id = b.vec_id // 4 AND v.lin = b.u + 8 * b.w GROUP BY ALL), q AS (SELECT *, 10 * log10(1 / mse) AS psnr FROM err)", O.UNIT)
)


@query(RECOVERED_SQL + " SELECT label, ratio, round(avg(mse), 6) AS avg_mse, round(stddev_samp(mse), 6) AS std_mse, round(avg(psnr), 5) AS avg_psnr, round(stddev_samp(psnr), 5) AS std_psnr FROM q GROUP BY label, ratio")
def recover_metrics_by_label(spark, sf_dir):
    out = losses.metric_summary(_recovered(spark, sf_dir), "label", "ratio")
    return out.select("label", "ratio", *[F.round(c, 6 if "mse" in c else 5).alias(c) for c in ("avg_mse", "std_mse", "avg_psnr", "std_psnr")])


@query(RECOVERED_SQL + ", m AS (SELECT ratio, label, avg(psnr) AS p FROM q GROUP BY 1, 2) SELECT ratio, arg_max(label, round(p, 6)) AS best_label, round(max(p), 5) AS best_psnr, round(max(p) - min(p), 5) AS gain FROM m GROUP BY ratio")
def best_label_by_ratio(spark, sf_dir):
    means = _recovered(spark, sf_dir).groupBy("ratio", "label").agg(F.avg("psnr").alias("p"))
    return means.groupBy("ratio").agg(F.max_by("label", F.round("p", 6)).alias("best_label"), F.round(F.max("p"), 5).alias("best_psnr"), F.round(F.max("p") - F.min("p"), 5).alias("gain"))


@query(O.with_pixels(O.transform(3, 3, "fft") + ", " + O.ranked(8)) + " SELECT vec_id, u + 1 + w * 8 AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM rk WHERE rn <= 6")
def fft_baseline(spark, sf_dir):
    return kept_rows(B.largest_after(vectors(spark, sf_dir), B.classical_steps(3, 3), 3, 3, 6), "vec_id")


@query(O.with_pixels(O.transform(3, 3, "qft")) + " SELECT vec_id, round(sum(sqrt(re * re + im * im)), 6) AS loss FROM f GROUP BY vec_id")
def l1_loss(spark, sf_dir):
    return losses.l1_loss(vectors(spark, sf_dir), QFT).select("vec_id", F.round("loss", 6).alias("loss"))


MSE_SQL = O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8) + ", l AS (SELECT vec_id, greatest(0, sum(CASE WHEN rn > 6 THEN re * re + im * im ELSE 0 END)) AS loss FROM rk GROUP BY vec_id)")


@query(MSE_SQL + " SELECT vec_id, round(loss, 6) AS loss FROM l")
def mse_loss(spark, sf_dir):
    return losses.mse_loss(vectors(spark, sf_dir), QFT, 6).select("vec_id", F.round("loss", 6).alias("loss"))


@query(MSE_SQL + " SELECT label, round(avg(loss), 6) AS loss, count(*) AS n FROM l JOIN (SELECT DISTINCT vec_id, label FROM v) USING (vec_id) GROUP BY label")
def batch_loss(spark, sf_dir):
    return losses.batch_loss(losses.mse_loss(vectors(spark, sf_dir), QFT, 6), "label").select("label", F.round("loss", 6).alias("loss"), "n")


SPLIT_SQL = "WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings), s AS (SELECT *, least(greatest(round_even(n * 0.2::DOUBLE, 0), 0), n - 1)::BIGINT AS n_val FROM o)"


def _split(spark, sf_dir):
    at = W.partitionBy("label").orderBy("vec_id")
    o = vectors(spark, sf_dir).select("vec_id", "label", F.row_number().over(at).alias("rn"), F.count(F.lit(1)).over(W.partitionBy("label")).alias("n"))
    return o.withColumn("n_val", F.least(F.greatest(F.rint(F.col("n") * 0.2), F.lit(0.0)), F.col("n") - 1.0).cast("long"))


@query(SPLIT_SQL + " SELECT vec_id, label, rn <= n_val AS validation FROM s")
def validation_split(spark, sf_dir):
    return _split(spark, sf_dir).select("vec_id", "label", (F.col("rn") <= F.col("n_val")).alias("validation"))


@query(SPLIT_SQL + " SELECT label, (rn - n_val - 1) // 16 AS batch, count(*) AS n, min(vec_id) AS first_id FROM s WHERE rn > n_val GROUP BY 1, 2")
def minibatches(spark, sf_dir):
    rows = _split(spark, sf_dir).filter("rn > n_val").withColumn("batch", F.expr("(rn - n_val - 1) div 16"))
    return rows.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@query("WITH s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS step FROM embeddings) SELECT vec_id, round(CASE WHEN step <= 5 THEN 0.01::DOUBLE * (step / 5.0) ELSE 0.001::DOUBLE + 0.5 * (0.01::DOUBLE - 0.001::DOUBLE) * (1 + cos(pi() * ((step - 5) / 95.0))) END, 9) AS rate FROM s")
def lr_schedule(spark, sf_dir):
    steps = vectors(spark, sf_dir).select("vec_id", F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("step"))
    return steps.select("vec_id", F.round(series.learning_rate(F.col("step"), 100), 9).alias("rate"))


@query("WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, len(v) AS n, round(list_reduce(v, lambda a, x: 0.6::DOUBLE * a + 0.4::DOUBLE * x), 6) AS last FROM s")
def ema_smooth(spark, sf_dir):
    last = series.ema_last(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 0.6)
    return last.select("user_id", "n", F.round("last", 6).alias("last"))


@query("WITH p AS (SELECT vec_id, [embedding[i]::DOUBLE for i in range(1, 9)] AS g FROM embeddings) SELECT vec_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM (SELECT vec_id, (0.6::DOUBLE * g[2] - 0.8::DOUBLE * g[1]) * -0.8::DOUBLE AS x, (0.6::DOUBLE * g[2] - 0.8::DOUBLE * g[1]) * 0.6::DOUBLE AS y FROM p)")
def project_phase(spark, sf_dir):
    """Gradients from the vectors' first two numbers, projected at the unit phase 0.6 + 0.8i."""
    g = vectors(spark, sf_dir).selectExpr("vec_id", "re[0] AS gr", "re[1] AS gi")
    x, y = training.project_phase_columns(F.lit(0.6), F.lit(0.8), F.col("gr"), F.col("gi"))
    return g.select("vec_id", rounded(x).alias("x"), rounded(y).alias("y"))


@query("WITH g AS (SELECT vec_id, (0.6::DOUBLE * embedding[2]::DOUBLE - 0.8::DOUBLE * embedding[1]::DOUBLE) AS s FROM embeddings), t AS (SELECT vec_id, 0.6::DOUBLE - 0.1::DOUBLE * (s * -0.8::DOUBLE) AS a, 0.8::DOUBLE - 0.1::DOUBLE * (s * 0.6::DOUBLE) AS b FROM g) SELECT vec_id, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM t")
def retract_phase(spark, sf_dir):
    """A step of 0.1 against the projected gradient, taken back onto the unit circle."""
    g = vectors(spark, sf_dir).selectExpr("vec_id", "re[0] AS gr", "re[1] AS gi")
    x, y = training.project_phase_columns(F.lit(0.6), F.lit(0.8), F.col("gr"), F.col("gi"))
    a, b = training.retract_phase_columns(F.lit(0.6), F.lit(0.8), -x, -y, 0.1)
    return g.select("vec_id", F.round(a, 6).alias("x"), F.round(b, 6).alias("y"))


@query(O.VECTORS.replace("SELECT vec_id, label,", "SELECT vec_id,", 1).join(["WITH v AS (", ") SELECT vec_id, lin % 8 + 4 + 1 + 16 * (lin // 8 + 4) AS idx16, lin + 1 AS idx, round(v, 6) + 0.0 AS v FROM v"]))
def pad_crop(spark, sf_dir):
    """Centre in a frame of twice the size, then cut the centre out again: where each value stood and what it is."""
    big = padded(vectors(spark, sf_dir), 8, 8, 16, 16).withColumn("big", F.col("re"))
    small = cropped(big, 16, 16, 8, 8).select("vec_id", "big", F.posexplode("re").alias("lin", "v"))
    at = F.expr("cast(lin % 8 + 4 + 16 * (lin div 8 + 4) as int)")
    return small.select("vec_id", (at + 1).alias("idx16"), (F.col("lin") + 1).alias("idx"), rounded(F.get("big", at)).alias("v"))


HEAT = "SELECT 0 AS vec_id, (day(ts) - 1 + {top} + 32 * (hour(ts) + {left})) AS lin, count(*)::DOUBLE AS v FROM events GROUP BY 2"


@query("WITH px AS (SELECT 0 AS vec_id, (day(ts) - 1 + 1 + 32 * (hour(ts) + 4))::BIGINT AS lin, count(*)::DOUBLE AS re, 0.0::DOUBLE AS im FROM events GROUP BY 2), " + O.transform(5, 5, "wht") + " SELECT u + 1 + w * 32 AS idx, round(re, 6) + 0.0 AS re FROM f")
def event_heatmap_wht(spark, sf_dir):
    """Events by day of the month and hour, centred in 32 x 32, in the Walsh-Hadamard basis."""
    cells = table(spark, sf_dir, "events").groupBy(F.expr("day(ts) - 1 + 1 + 32 * (hour(ts) + 4)").alias("lin")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    # at most 1,024 cells, so one row holds the picture
    image = cells.agg(F.map_from_entries(F.collect_list(F.struct("lin", "v"))).alias("cells")).select(F.expr(B.let("q", {"cells": "cells"}, "transform(sequence(0, 1023), i -> coalesce(try_element_at(q.cells, i), 0D))")).alias("re"))
    out = B.Basis.make("tebd", 5, 5).forward(image, real=True)
    return out.select(F.posexplode("re").alias("lin", "v")).select((F.col("lin") + 1).alias("idx"), rounded(F.col("v")).alias("re"))


def _by_coordinates(basis):
    def run(spark, sf_dir):
        out = coordinates.transform(pixels(vectors(spark, sf_dir), "vec_id"), basis)
        return out.select(F.col("id").alias("vec_id"), (F.col("lin") + 1).alias("idx"), rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))

    return run


# the same transforms on coordinate rows, for images too large for one row
for _name, _like in (("qft_kernel_join", "qft_forward"), ("eqft_coordinates", "eqft_middle"), ("mera_coordinates", "mera_2x4")):
    QUERIES[_name] = _by_coordinates(FORWARD[_like][0])
    SQL[_name] = SQL[_like]


HALF_SQL = O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8) + ", low AS (SELECT vec_id, (u + 8 * w)::BIGINT AS lin, CASE WHEN rn <= 32 THEN re ELSE 0 END AS re, CASE WHEN rn <= 32 THEN im ELSE 0 END AS im FROM rk), " + O.transform(3, 3, "inverse_qft", "b", "low"))


@query(HALF_SQL + " SELECT vec_id, u + 1 + w * 8 AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM b")
def json_roundtrip(spark, sf_dir):
    """Compressed images written as JSON, read back with the declared schema, and recovered."""
    return coefficients(QFT.recover(files.roundtrip(QFT.compress(vectors(spark, sf_dir), ratio=0.5))), "vec_id")


@query("WITH p AS (SELECT l_returnflag AS flag, (l_partkey % 64 + 64 * (l_suppkey % 64))::BIGINT AS lin, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), g AS (SELECT flag, dense_rank() OVER (ORDER BY flag) AS vec_id, lin, v FROM p), names AS (SELECT DISTINCT vec_id, flag FROM g), px AS (SELECT vec_id, lin, v AS re, 0.0::DOUBLE AS im FROM g), "
       + O.transform(6, 6, "wht") + ", " + O.ranked(64) + " SELECT flag, rn::INT AS place, u + 1 + w * 64 AS idx, round(re, 6) + 0.0 AS re FROM rk JOIN names USING (vec_id) WHERE rn <= 41")
def lineitem_map_wht(spark, sf_dir):
    """Quantities by part and supplier, a 64 x 64 picture for each return flag: a hundredth of the Walsh-Hadamard coefficients."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.expr("cast(l_partkey % 64 + 64 * (l_suppkey % 64) as int)").alias("lin")).agg(F.sum("l_quantity").alias("v"))
    # at most 4,096 cells a flag
    images = cells.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("lin", "v"))).alias("cells"))
    images = images.select(F.col("l_returnflag").alias("flag"), F.expr(B.let("q", {"cells": "cells"}, "transform(sequence(0, 4095), i -> coalesce(try_element_at(q.cells, i), 0D))")).alias("re"))
    kept = B.largest_after(images, B.Basis.make("tebd", 6, 6).steps(), 6, 6, 41)
    return kept.select("flag", F.posexplode("kept").alias("at", "z")).select("flag", (F.col("at") + 1).alias("place"), (F.col("z.lin") + 1).alias("idx"), rounded(F.col("z.re")).alias("re"))


@query("WITH p AS (SELECT l_returnflag AS flag, l_orderkey % 512 AS r, l_partkey % 512 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT flag, round(sum(v * v), 3) AS energy, round(sum(v) / 512, 6) AS mean FROM p GROUP BY flag")
def lineitem_map_512(spark, sf_dir):
    """512 x 512 pictures as coordinate rows: the Fourier coefficients' energy, which is the pictures', and the constant one."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("id"), F.expr("l_orderkey % 512 + 512 * (l_partkey % 512)").alias("lin")).agg(F.sum("l_quantity").alias("re"))
    out = coordinates.transform(cells.select("id", "lin", "re", F.lit(0.0).alias("im")), B.Basis.make("qft", 9, 9))
    energy = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return out.groupBy(F.col("id").alias("flag")).agg(F.round(energy, 3).alias("energy"), F.round(F.sum(F.when(F.col("lin") == 0, F.col("re"))), 6).alias("mean"))


def _recovered_sql(kind: str) -> str:
    """Error of pictures recovered from a fifth of the coefficients of a fixed transform, by picture."""
    return (O.with_pixels(O.transform(3, 3, kind, f"{kind}f") + ", " + O.ranked(8, f"{kind}f", f"{kind}rk") + f", {kind}low AS (SELECT vec_id, (u + 8 * w)::BIGINT AS lin, CASE WHEN rn <= 13 THEN re ELSE 0 END AS re, CASE WHEN rn <= 13 THEN im ELSE 0 END AS im FROM {kind}rk), "
                          + O.transform(3, 3, f"inverse_{kind}", f"{kind}b", f"{kind}low"), O.UNIT)
            + f" SELECT '{kind}' AS basis, b.vec_id, avg(pow(v.v - greatest(0, least(1, b.re)), 2)) AS mse FROM {kind}b b JOIN v ON v.vec_id = b.vec_id AND v.lin = b.u + 8 * b.w GROUP BY b.vec_id")


def _baselines(spark, sf_dir):
    images = unit_vectors(spark, sf_dir).withColumn("x", F.col("re"))
    each = [losses.picture_metrics(B.baseline_recovered(images, 3, 3, 0.8, kind), "x", "re").select(F.lit(kind).alias("basis"), "vec_id", "mse", "psnr") for kind in ("fft", "dct")]
    return losses.metric_summary(each[0].unionByName(each[1]).withColumn("ratio", F.lit(0.8)), "basis", "ratio")


_BASELINE_SQL = f"WITH e AS (({_recovered_sql('fft')}) UNION ALL ({_recovered_sql('dct')})), m AS (SELECT basis, avg(mse) AS avg_mse, stddev_samp(mse) AS std_mse, avg(10 * log10(1 / mse)) AS avg_psnr, stddev_samp(10 * log10(1 / mse)) AS std_psnr FROM e GROUP BY basis)"


@query(_BASELINE_SQL + " SELECT basis, 0.8::DOUBLE AS ratio, round(avg_mse, 6) AS avg_mse, round(std_mse, 6) AS std_mse, round(avg_psnr, 5) AS avg_psnr, round(std_psnr, 5) AS std_psnr FROM m")
def fixed_baselines(spark, sf_dir):
    """Pictures recovered from a fifth of their Fourier or cosine coefficients."""
    out = _baselines(spark, sf_dir)
    return out.select("basis", "ratio", *[F.round(c, 6 if "mse" in c else 5).alias(c) for c in ("avg_mse", "std_mse", "avg_psnr", "std_psnr")])


@query(_BASELINE_SQL + " SELECT 0.8::DOUBLE AS ratio, 'dct' AS basis, round(100 * (1 - d.avg_mse / f.avg_mse), 4) AS mse_percent, round(d.avg_psnr - f.avg_psnr, 5) AS psnr_gain FROM m d, m f WHERE d.basis = 'dct' AND f.basis = 'fft'")
def gain_over_fft(spark, sf_dir):
    """The cosine baseline against the Fourier one: fall of the error in percent, gain in decibels."""
    out = losses.improvements(_baselines(spark, sf_dir), "fft", ["ratio"])
    return out.select("ratio", "basis", F.round("mse_percent", 4).alias("mse_percent"), F.round("psnr_gain", 5).alias("psnr_gain"))


@query(RECOVERED_SQL + " SELECT label, " + ", ".join(f"round(avg(psnr) FILTER (ratio = {r}), 5) AS p{int(100 * r)}" for r in RATIOS) + " FROM q GROUP BY label")
def psnr_report(spark, sf_dir):
    """A table of mean signal-to-noise ratios: a row per label, a column per ratio."""
    summary = losses.metric_summary(_recovered(spark, sf_dir), "label", "ratio").withColumn("at", F.concat(F.lit("p"), F.rint(F.col("ratio") * 100).cast("int")))
    return losses.report(summary.withColumn("p", F.round("avg_psnr", 5)), "p", "label", "at")


_SSIM_SQL = (RECOVERED_SQL + ", z AS (SELECT b.vec_id // 4 AS vec_id, b.vec_id % 4 AS part, v.label, b.u, b.w, greatest(0, least(1, v.v)) AS x, greatest(0, least(1, b.re)) AS y FROM b JOIN v ON v.vec_id = b.vec_id // 4 AND v.lin = b.u + 8 * b.w),"
             " s AS (SELECT vec_id, part, label, i, j, avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS vx, avg(y * y) - avg(y) * avg(y) AS vy, avg(x * y) - avg(x) * avg(y) AS vxy FROM z, range(0, 2) a(i), range(0, 2) c(j) WHERE u BETWEEN i AND i + 6 AND w BETWEEN j AND j + 6 GROUP BY ALL),"
             " t AS (SELECT label, part, (2 * mx * my + 0.0001::DOUBLE) * (2 * vxy + 0.0009::DOUBLE) / ((mx * mx + my * my + 0.0001::DOUBLE) * (vx + vy + 0.0009::DOUBLE)) AS one FROM s)"
             " SELECT label, CASE part WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS ratio, round(avg(one), 6) AS ssim FROM t GROUP BY label, part")  # fmt: skip


@query(_SSIM_SQL)
def ssim_by_label(spark, sf_dir):
    """Mean structural similarity of recovered pictures."""
    both = losses.similarity(_recovered(spark, sf_dir), "x", "re", 8, 8)
    return both.groupBy("label", "ratio").agg(F.round(F.avg("ssim"), 6).alias("ssim"))


FIRST_LOSS = "SELECT 0 AS step, round(avg(l), 6) AS loss FROM (SELECT vec_id, {what} AS l FROM {source} GROUP BY vec_id)"


def _before_training(spark, images, basis, loss, k):
    _, trace = training.optimize(images, basis, training.Optimizer(), loss=loss, k=k, max_iter=0)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(trace)], "step int, loss double")


@query(O.with_pixels(O.transform(3, 3, "qft")) + " " + FIRST_LOSS.format(what="sum(sqrt(re * re + im * im))", source="f"))
def loss_before_training_l1(spark, sf_dir):
    """What the trainer measures before its first step: the mean L1 loss of all vectors."""
    return _before_training(spark, vectors(spark, sf_dir), QFT, "l1", 6)


@query("WITH px AS (SELECT vec_id // 64 AS vec_id, (p - 1 + 64 * (vec_id % 64))::BIGINT AS lin, embedding[p]::DOUBLE AS re, 0.0::DOUBLE AS im FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)), "
       + O.transform(6, 6, "qft") + ", " + O.ranked(64) + " " + FIRST_LOSS.format(what="sum(CASE WHEN rn > 409 THEN re * re + im * im ELSE 0 END)", source="rk"))
def loss_before_training_64x64(spark, sf_dir):
    """The same for pictures of 64 x 64: the squared error with 409 coefficients, where adam_64x64 and gd_64x64 start."""
    return _before_training(spark, mosaics(vectors(spark, sf_dir)), B.Basis.make("qft", 6, 6), "mse", 409)


@query()
def train_qft(spark, sf_dir):
    """Training history of gates fitted to the vectors: epoch, training and validation loss."""
    result = training.train(vectors(spark, sf_dir), "qft", 3, 3, epochs=3, id_col="vec_id")
    return result.history_frame(spark)


@query("SELECT vec_id // 64 AS img_id, count(*) AS columns, round(sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 6) AS energy, round(sum(list_sum(embedding[1:2]::DOUBLE[])), 6) + 0.0 AS top FROM embeddings GROUP BY 1")
def mosaic_energy(spark, sf_dir):
    """Pictures of 64 vectors: how many columns they have, their energy, and the sum of their two top rows."""
    images = mosaics(vectors(spark, sf_dir))
    energy, top = F.expr("aggregate(re, 0D, (s, v) -> s + v * v)"), F.expr("aggregate(filter(re, (v, i) -> i % 64 < 2), 0D, (s, v) -> s + v)")
    columns = F.expr("cast(size(filter(sequence(0, 63), c -> exists(slice(re, 64 * c + 1, 64), v -> v <> 0))) as long)")
    return images.select("img_id", columns.alias("columns"), F.round(energy, 6).alias("energy"), rounded(top).alias("top"))


def _fitted(spark, sf_dir, kind: str, rate: float):
    optimizer = training.Optimizer(kind=kind, rate=rate)
    _, trace = training.optimize(mosaics(vectors(spark, sf_dir)), B.Basis.make("qft", 6, 6), optimizer, k=409, max_iter=10, tol=0.0)
    return spark.createDataFrame([(i, loss) for i, loss in enumerate(trace)], "step int, loss double")


@query()
def adam_64x64(spark, sf_dir):
    """Losses of ten full-batch Adam steps on pictures of 64 x 64, 409 coefficients kept."""
    return _fitted(spark, sf_dir, "adam", 0.001)


@query()
def gd_64x64(spark, sf_dir):
    """Losses of ten full-batch gradient steps with Armijo search on the same pictures."""
    return _fitted(spark, sf_dir, "gd", 0.01)


UNITARY = np.array([[0.6, 0.8j], [0.8j, 0.6]])
_ENTRY = ", ".join(f"m{i}{j}{p} double" for i, j in O.ENTRIES for p in "ri")
_U, _G = O.fixed(UNITARY.tolist()), O.matrix("g")
_TANGENT = "WITH " + O.GRADIENTS + ", " + O.step("a", "g", "h", O.times(O.adjoint(_U), _G)) + ", " + O.step("b", "a", "s", O.skew(O.matrix("h"))) + ", " + O.step("c", "b", "p", O.times(_U, O.matrix("s")))


def _matrices(spark, sf_dir, work):
    """A row per vector with the entries of ``work`` of its first eight numbers as a complex 2x2 matrix."""

    def run(re):
        m = np.ascontiguousarray(B.matrix_of(re, 64)[:, :8]).view(complex).reshape(-1, 2, 2)
        out = work(m)
        return [pa.array(np.round(v, 6) + 0.0) for i, j in O.ENTRIES for v in (out[:, i, j].real, out[:, i, j].imag)]

    return B.map_images(vectors(spark, sf_dir), ["re"], _ENTRY, 64, run, ("re", "label"))


@query(_TANGENT + O.rounded_matrix("p", "c"))
def project_unitary(spark, sf_dir):
    """Gradients projected onto the tangent space at a unitary matrix."""
    return _matrices(spark, sf_dir, lambda g: manifolds.Unitary.project(UNITARY, g))


@query(_TANGENT + ", " + O.step("d", "c", "w", O.times(O.matrix("p"), O.adjoint(_U))) + ", " + O.step("e", "d", "v", O.skew(O.matrix("w")))
       + ", " + O.step("f", "e", "l", [[tuple(f"{int(i == j and p == 0)} - 0.05::DOUBLE * {O.matrix('v')[i][j][p]}" for p in (0, 1)) for j in (0, 1)] for i in (0, 1)])
       + ", " + O.step("k", "f", "r", [[tuple(f"{int(i == j and p == 0)} + 0.05::DOUBLE * {O.matrix('v')[i][j][p]}" for p in (0, 1)) for j in (0, 1)] for i in (0, 1)])
       + ", " + O.inverted("n", "k", "q", O.matrix("l")) + ", " + O.step("o", "n", "y", O.times(O.matrix("r"), _U)) + ", " + O.step("z", "o", "x", O.times(O.matrix("q"), O.matrix("y"))) + O.rounded_matrix("x", "z"))
def retract_unitary(spark, sf_dir):
    """A step of 0.1 along the projected gradient, taken back by the Cayley transform."""
    return _matrices(spark, sf_dir, lambda g: manifolds.Unitary.retract(UNITARY, manifolds.Unitary.project(UNITARY, g), 0.1))


_MOVED = [[tuple(f"{_U[i][j][k]} + 0.1::DOUBLE * {O.matrix('p')[i][j][k]}" for k in (0, 1)) for j in (0, 1)] for i in (0, 1)]


@query(_TANGENT + ", " + O.step("d", "c", "w", _MOVED) + ", " + O.polar("e", "d", "x", O.matrix("w")) + O.rounded_matrix("x", "e"))
def retract_polar(spark, sf_dir):
    """The same step, taken back to the nearest frame."""
    return _matrices(spark, sf_dir, lambda g: manifolds.StiefelPolar.retract(UNITARY, manifolds.StiefelPolar.project(UNITARY, g), 0.1))


@query(_TANGENT + ", " + O.step("d", "c", "w", _MOVED)
       + ", e AS (SELECT *, sqrt(" + " + ".join(f"w{i}0{k} * w{i}0{k}" for i in (0, 1) for k in "ri") + ") AS s FROM d)"
       + ", f AS (SELECT *, " + ", ".join(f"w{i}0{k} / s AS x{i}0{k}" for i in (0, 1) for k in "ri") + " FROM e)"
       + ", h2 AS (SELECT *, " + " + ".join(f"x{i}0r * w{i}1r + x{i}0i * w{i}1i" for i in (0, 1)) + " AS ar, " + " + ".join(f"x{i}0r * w{i}1i - x{i}0i * w{i}1r" for i in (0, 1)) + " AS ai FROM f)"
       + ", k AS (SELECT *, " + ", ".join(f"w{i}1r - (x{i}0r * ar - x{i}0i * ai) AS y{i}r, w{i}1i - (x{i}0r * ai + x{i}0i * ar) AS y{i}i" for i in (0, 1)) + " FROM h2)"
       + ", l AS (SELECT *, " + ", ".join(f"y{i}{k} / sqrt(y0r * y0r + y0i * y0i + y1r * y1r + y1i * y1i) AS x{i}1{k}" for i in (0, 1) for k in "ri") + " FROM k)" + O.rounded_matrix("x", "l"))
def retract_qr(spark, sf_dir):
    """The same step, taken back to the frame of the columns in order."""
    return _matrices(spark, sf_dir, lambda g: manifolds.StiefelQR.retract(UNITARY, manifolds.StiefelQR.project(UNITARY, g), 0.1))


@query("WITH " + O.GRADIENTS + ", " + O.inverted("a", "g", "q", _G) + " SELECT vec_id, " + ", ".join(f"round({x}, 4) + 0.0 AS m{i}{j}{p}" for i, j in O.ENTRIES for p, x in zip("ri", O.matrix("q")[i][j])) + " FROM a")
def inverse_matrix(spark, sf_dir):
    """Each matrix's closed-form inverse."""
    return _matrices(spark, sf_dir, lambda g: np.round(manifolds.inverse2(g), 4))


@query("WITH " + O.GRADIENTS + ", " + O.inverted("a", "g", "q", _G) + " SELECT vec_id, " + ", ".join(f"round({x}, 3) + 0.0 AS m{i}{j}{p}" for i, j in O.ENTRIES for p, x in zip("ri", O.times(_G, O.matrix("q"))[i][j])) + " FROM a")
def inverse_times_matrix(spark, sf_dir):
    """Each matrix times its closed-form inverse."""
    return _matrices(spark, sf_dir, lambda g: np.round(g @ manifolds.inverse2(g), 3))


@query("SELECT vec_id, label % 2 = 0 AS rotated, label % 3 = 0 AS turned FROM embeddings")
def unitary_check(spark, sf_dir):
    """Whether rotations built from each vector's first numbers are unitary: some are stretched (odd labels) or sheared (labels that 3 doesn't divide) a little."""

    def run(re, label):
        m = np.ascontiguousarray(B.matrix_of(re, 64)[:, :8]).view(complex).reshape(-1, 2, 2)
        a, b = (m[:, 0] / np.linalg.norm(m[:, 0], axis=1, keepdims=True)).T
        turned = np.stack([np.stack([a, b], -1), np.stack([-b.conj(), a.conj()], -1)], -2)
        label = label.to_numpy()[:, None, None]
        stretched, sheared = turned * np.where(label % 2, 1 + 1e-5, 1), turned + np.where(label % 3, 1e-3, 0) * np.array([[0, 1], [0, 0]])
        return [pa.array(manifolds.is_unitary(x)) for x in (stretched, sheared)]

    return B.map_images(vectors(spark, sf_dir), ["re", "label"], "rotated boolean, turned boolean", 64, run, ("re", "label"))


def _phase_step(kind, rate):
    z = 0.6 + 0.8j
    gate = [circuits.Gate("phase", (1, 2), np.full((2, 2), z))]

    def one(g):
        off = lambda m: float((np.abs(m - g) ** 2).sum())
        new, _ = training.Optimizer(kind, rate).step(gate, [2 * (gate[0].matrix - g)], rate, off(gate[0].matrix), lambda c: [off(x[0].matrix) for x in c])
        return new[0].matrix

    return lambda m: np.array([one(g) for g in m]).reshape(-1, 2, 2)


_PHASES = ("WITH e AS (SELECT vec_id, k, embedding[2 * k + 1]::DOUBLE AS gr, embedding[2 * k + 2]::DOUBLE AS gi FROM embeddings, range(0, 4) t(k)),"
           " s AS (SELECT *, 0.6::DOUBLE * 2 * (0.8::DOUBLE - gi) - 0.8::DOUBLE * 2 * (0.6::DOUBLE - gr) AS s FROM e)")  # fmt: skip
_BY_ENTRY = ", ".join(f"round(max(CASE WHEN k = {2 * i + j} THEN {'xy'[p]} END), 6) + 0.0 AS m{i}{j}{'ri'[p]}" for i, j in O.ENTRIES for p in (0, 1))


@query(_PHASES + ", m AS (SELECT vec_id, k, 0.6::DOUBLE + 0.1::DOUBLE * 0.8::DOUBLE * s / (abs(s) + 1e-8::DOUBLE) AS a, 0.8::DOUBLE - 0.1::DOUBLE * 0.6::DOUBLE * s / (abs(s) + 1e-8::DOUBLE) AS b FROM s), "
       "n AS (SELECT vec_id, k, a / sqrt(a * a + b * b) AS x, b / sqrt(a * a + b * b) AS y FROM m) SELECT vec_id, " + _BY_ENTRY + " FROM n GROUP BY vec_id")  # fmt: skip
def adam_phase_step(spark, sf_dir):
    """The first Adam step of unit phases towards each vector's numbers."""
    return _matrices(spark, sf_dir, _phase_step("adam", 0.1))


@query(_PHASES + ", m AS (SELECT *, pow(0.5::DOUBLE, j) AS step, 0.6::DOUBLE + pow(0.5::DOUBLE, j) * 0.8::DOUBLE * s AS a, 0.8::DOUBLE - pow(0.5::DOUBLE, j) * 0.6::DOUBLE * s AS b FROM s, range(0, 10) t(j)), "
       "n AS (SELECT *, a / sqrt(a * a + b * b) AS x, b / sqrt(a * a + b * b) AS y FROM m), "
       "f AS (SELECT vec_id, j, step, sum(pow(x - gr, 2) + pow(y - gi, 2)) AS f, sum(pow(0.6::DOUBLE - gr, 2) + pow(0.8::DOUBLE - gi, 2)) AS f0, sum(s * s) AS norm2 FROM n GROUP BY vec_id, j, step), "
       "c AS (SELECT vec_id, coalesce(min(j) FILTER (f <= f0 - 1e-4::DOUBLE * step * norm2), 9) AS j FROM f GROUP BY vec_id) SELECT vec_id, " + _BY_ENTRY + " FROM n JOIN c USING (vec_id, j) GROUP BY vec_id")  # fmt: skip
def armijo_phase_step(spark, sf_dir):
    """A gradient step of unit phases towards each vector's numbers, halved until the loss falls enough."""
    return _matrices(spark, sf_dir, _phase_step("gd", 1.0))


@query(O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8)) + " SELECT vec_id, u + 1 + w * 8 AS idx, round(CASE WHEN rn <= 6 THEN -2 * re ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN rn <= 6 THEN -2 * im ELSE 0 END, 6) + 0.0 AS im FROM rk")
def mse_gradient(spark, sf_dir):
    """The squared error's gradient by coefficient: minus twice the kept ones, as the selection counts as fixed."""
    kept = B.truncated(QFT.forward(vectors(spark, sf_dir), real=True), 6, 64)
    return coefficients(kept.withColumns({"re": F.transform("re", lambda v: -2 * v), "im": F.transform("im", lambda v: -2 * v)}), "vec_id")


@query(O.with_pixels(O.transform(3, 3, "qft") + ", l AS (SELECT vec_id, sum(sqrt(re * re + im * im)) AS loss FROM f GROUP BY vec_id), o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
       + " SELECT label, round(avg(loss) FILTER (rn <= least(greatest(round_even(n * 0.2::DOUBLE, 0), 0), n - 1)), 6) AS validation, round(avg(loss) FILTER (rn > least(greatest(round_even(n * 0.2::DOUBLE, 0), 0), n - 1)), 6) AS training FROM l JOIN o USING (vec_id) GROUP BY label")
def validation_loss(spark, sf_dir):
    """Mean L1 loss of the held-out and of the other rows of each label."""
    held = _split(spark, sf_dir).select("vec_id", (F.col("rn") <= F.col("n_val")).alias("held"))
    rows = losses.l1_loss(vectors(spark, sf_dir), QFT).join(held, "vec_id")
    means = losses.batch_loss(rows, "label", "held").groupBy("label")
    return means.agg(*[F.round(F.max(F.when(F.col("held") == held, F.col("loss"))), 6).alias(name) for held, name in ((True, "validation"), (False, "training"))])


def _by_gates(basis):
    """The circuit gate by gate, in the order of its list, instead of by its two matrices."""

    def run(re):
        y = circuits.run_gates(list(basis.gates), B.matrix_of(re, basis.size).T, basis.m + basis.n).T
        return [B.lists_of(y.real), B.lists_of(y.imag)]

    return lambda spark, sf_dir: coefficients(B.map_images(vectors(spark, sf_dir), ["re"], "re array<double>, im array<double>", basis.size, run), "vec_id")


def _from_json(basis):
    """The forward transform of a basis that was written as a JSON document and read back."""
    return lambda spark, sf_dir: _forward(files.dict_to_basis(json.loads(json.dumps(files.basis_to_dict(basis)))))(spark, sf_dir)


for _family, _like in (("qft", "qft_forward"), ("eqft", "eqft_middle"), ("tebd", "tebd_ring"), ("mera", "mera_2x4")):
    QUERIES[f"{_family}_by_gates"], QUERIES[f"{_family}_from_json"] = _by_gates(FORWARD[_like][0]), _from_json(FORWARD[_like][0])
    SQL[f"{_family}_by_gates"] = SQL[f"{_family}_from_json"] = SQL[_like]


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS re0, round(embedding[2]::DOUBLE * cos(0.1::DOUBLE * label), 6) + 0.0 AS re1, round(embedding[2]::DOUBLE * sin(0.1::DOUBLE * label), 6) + 0.0 AS im1 FROM embeddings")
def entanglement_gate(spark, sf_dir):
    """The diagonal gate diag(1, e^(i phi)) on each vector's first two numbers, phi a tenth of its label."""
    gates = np.array([circuits.entanglement_gate(0.1 * label) for label in range(10)])

    def run(re, label):
        out = np.einsum("nij,nj->ni", gates[label.to_numpy()], B.matrix_of(re, 64)[:, :2])
        return [pa.array(np.round(v, 6) + 0.0) for v in (out[:, 0].real, out[:, 1].real, out[:, 1].imag)]

    return B.map_images(vectors(spark, sf_dir), ["re", "label"], "re0 double, re1 double, im1 double", 64, run, ("re", "label"))


@query(O.with_pixels(O.transform(3, 3, "qft") + ", " + O.ranked(8)) + " SELECT vec_id, rn::INT AS place, u + 1 + w * 8 AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM rk WHERE rn <= 6")
def stream_compress(spark, sf_dir):
    """The vectors read as a stream, compressed at ratio 0.9 and written as they arrive; the written rows."""
    shared = shared_folder(spark)
    given = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parquet*")  # a pattern, as a stream does not read a single file
    low = compress_stream(given.select("vec_id", F.col("embedding").cast("array<double>").alias("re")), QFT)
    out, log = (f"{shared}/stream-{uuid.uuid4().hex}" for _ in range(2))
    low.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(low.schema).parquet(out).select("vec_id", F.posexplode(F.arrays_zip("indices", "values_real", "values_imag")).alias("place", "z"))
    return rows.select("vec_id", (F.col("place") + 1).alias("place"), F.col("z.indices").alias("idx"), rounded(F.col("z.values_real")).alias("re"), rounded(F.col("z.values_imag")).alias("im"))


P12 = tuple(round(0.1 * i, 1) for i in range(1, 13))
RING6 = ((1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1))
RING_64 = B.Basis.make("tebd", 6, 6, P12)
_CELLS_64 = ("p AS (SELECT l_returnflag AS flag, (l_partkey % 64 + 64 * (l_suppkey % 64))::BIGINT AS lin, sum(l_quantity) / 1000 AS v FROM lineitem GROUP BY ALL), g AS (SELECT flag, dense_rank() OVER (ORDER BY flag) AS vec_id, lin, v FROM p),"
             " names AS (SELECT DISTINCT vec_id, flag FROM g), px AS (SELECT vec_id, lin, v::DOUBLE AS re, 0.0::DOUBLE AS im FROM g)")  # fmt: skip


def _cells(spark, sf_dir, id_expr, lin, scale=1):
    """Quantities by place, a picture for each return flag, as coordinate rows."""
    cells = table(spark, sf_dir, "lineitem").groupBy(id_expr.alias("id"), F.expr(lin).cast("long").alias("lin")).agg((F.sum("l_quantity").cast("double") / scale).alias("re"))
    return cells.select("id", "lin", "re", F.lit(0.0).alias("im"))


def _ring(sign: int, u: str, w: str) -> str:
    return O.pairs([sign * p for p in P12[:6]], RING6, u) + " + " + O.pairs([sign * p for p in P12[6:]], RING6, w)


@query("SELECT flag, r + 512 * c + 1 AS idx, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY v DESC, r + 512 * c) AS rn FROM (SELECT l_returnflag AS flag, l_orderkey % 512 AS r, l_partkey % 512 AS c, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)) WHERE rn <= 2621")
def lineitem_map_512_largest(spark, sf_dir):
    """The hundredth of the places of each 512 x 512 picture that hold the most, found by histograms; many are equal, the lowest places stay."""
    cells = written(_cells(spark, sf_dir, F.col("l_returnflag"), "l_orderkey % 512 + 512 * (l_partkey % 512)"))
    kept = coordinates.largest(cells, 2621)
    return kept.select(F.col("id").alias("flag"), (F.col("lin") + 1).alias("idx"), F.round("re", 6).alias("v"))


@query("WITH " + _CELLS_64 + ", " + O.transform(6, 6, "wht", back=_ring(1, "u", "w")) + ", " + O.ranked(64) + ", low AS (SELECT vec_id, (u + 64 * w)::BIGINT AS lin, re, im FROM rk WHERE rn <= 409), "
       + O.transform(6, 6, "wht", "b", "low", front=_ring(-1, "r0", "c0")) + " SELECT flag, u + 1 + w * 64 AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM b JOIN names USING (vec_id)")
def ring_map_recovered(spark, sf_dir):
    """64 x 64 pictures as coordinate rows, compressed to a tenth in the ring basis and recovered from those rows."""
    cells = _cells(spark, sf_dir, F.col("l_returnflag"), "l_partkey % 64 + 64 * (l_suppkey % 64)", 1000)
    back = coordinates.recover(coordinates.compress(cells, RING_64, k=409), RING_64)
    return back.select(F.col("id").alias("flag"), (F.col("lin") + 1).alias("idx"), rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


_RECOVERED_64 = ("WITH " + _CELLS_64 + ", " + O.transform(6, 6, "wht", back=_ring(1, "u", "w")) + ", " + O.ranked(64) + ", low AS (SELECT vec_id, (u + 64 * w)::BIGINT AS lin, re, im FROM rk WHERE rn <= 409), " + O.transform(6, 6, "wht", "b", "low", front=_ring(-1, "r0", "c0")))


@query(_RECOVERED_64 + ", z AS (SELECT b.vec_id, b.u, b.w, greatest(0, least(1, coalesce(px.re, 0))) AS x, greatest(0, least(1, b.re)) AS y FROM b LEFT JOIN px ON px.vec_id = b.vec_id AND px.lin = b.u + 64 * b.w),"
       " s AS (SELECT vec_id, i, j, avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS vx, avg(y * y) - avg(y) * avg(y) AS vy, avg(x * y) - avg(x) * avg(y) AS vxy FROM (SELECT vec_id, x, y, u - k AS i, w - l AS j FROM z, range(0, 7) a(k), range(0, 7) c(l)) WHERE i BETWEEN 0 AND 57 AND j BETWEEN 0 AND 57 GROUP BY vec_id, i, j),"
       " t AS (SELECT vec_id, (2 * mx * my + 0.0001::DOUBLE) * (2 * vxy + 0.0009::DOUBLE) / ((mx * mx + my * my + 0.0001::DOUBLE) * (vx + vy + 0.0009::DOUBLE)) AS one FROM s) SELECT flag, round(avg(one), 6) AS ssim FROM t JOIN names USING (vec_id) GROUP BY flag")  # fmt: skip
def ring_map_ssim(spark, sf_dir):
    """Structural similarity of 64 x 64 pictures and their recovered forms, from coordinate rows by tiles."""
    cells = written(_cells(spark, sf_dir, F.col("l_returnflag"), "l_partkey % 64 + 64 * (l_suppkey % 64)", 1000))
    back = coordinates.recover(coordinates.compress(cells, RING_64, k=409), RING_64)
    return coordinates.similarity(coordinates.paired(cells, back), 6, 6).select(F.col("id").alias("flag"), F.round("ssim", 6).alias("ssim"))


RING_8 = FORWARD["tebd_ring"][0]
_PAIRS_8 = ", ".join(f"({6 + g}, {a - 1 + 3 * (g > 2)}, {b - 1 + 3 * (g > 2)}, {p}::DOUBLE)" for g, ((a, b), p) in enumerate(zip((*RING3, *RING3), P6)))
RING_GRADIENT_SQL = (
    O.with_pixels(O.transform(3, 3, "wht") + ", " + O.ranked(8))
    + ", x AS (SELECT vec_id, (u + 8 * w)::BIGINT AS lin, re AS f, rn <= 6 AS kept FROM rk), n AS (SELECT count(DISTINCT vec_id) AS n FROM x),"
    # a unitary gate's states before it are sums and differences of those after it
    " h AS (SELECT q AS gate, (x.lin >> q) & 1 AS i, j, -2 * x.f * (CASE WHEN (x.lin >> q) & 1 = 0 THEN x.f ELSE y.f END + (1 - 2 * j) * CASE WHEN (x.lin >> q) & 1 = 0 THEN y.f ELSE x.f END) / sqrt(2.0::DOUBLE) AS re, 0.0::DOUBLE AS im"
    " FROM x CROSS JOIN range(0, 6) t(q) CROSS JOIN range(0, 2) s(j) JOIN x y ON y.vec_id = x.vec_id AND y.lin = xor(x.lin, (1 << q)::BIGINT) WHERE x.kept),"
    f" g AS (SELECT gate, (lin >> a) & 1 AS i, (lin >> b) & 1 AS j, -2 * f * f * CASE WHEN (lin >> a) & (lin >> b) & 1 = 1 THEN cos(p) ELSE 1 END AS re, -2 * f * f * CASE WHEN (lin >> a) & (lin >> b) & 1 = 1 THEN sin(p) ELSE 0 END AS im FROM x, (VALUES {_PAIRS_8}) t(gate, a, b, p) WHERE kept)"
    " SELECT gate::INT AS gate, i::INT AS i, j::INT AS j, round(sum(re) / any_value(n), 6) + 0.0 AS re, round(sum(im) / any_value(n), 6) + 0.0 AS im FROM (SELECT * FROM h UNION ALL SELECT * FROM g), n GROUP BY ALL"
)


def _gradient_rows(spark, grads):
    rows = [(g, i, j, round(float(m[i, j].real), 6) + 0.0, round(float(m[i, j].imag), 6) + 0.0) for g, m in enumerate(grads) for i in (0, 1) for j in (0, 1)]
    return spark.createDataFrame(rows, "gate int, i int, j int, re double, im double")


@query(RING_GRADIENT_SQL)
def ring_gradient(spark, sf_dir):
    """The mean squared error's gradient by entry of every gate of a ring, unitary and phase gates, over all vectors."""
    _, grads = training.evaluate(vectors(spark, sf_dir), [list(RING_8.gates)], 6, "mse", 6, gradient=True)
    return _gradient_rows(spark, grads)


@query(RING_GRADIENT_SQL)
def ring_gradient_coordinates(spark, sf_dir):
    """The same from coordinate rows, by two shuffles forwards and two backwards."""
    _, y, kept = coordinates.loss_and_kept(pixels(vectors(spark, sf_dir), "vec_id"), RING_8, 6)
    return _gradient_rows(spark, coordinates.gradient(y, kept, RING_8))


@query("WITH " + _CELLS_64 + ", " + O.transform(6, 6, "wht", back=_ring(1, "u", "w")) + ", " + O.ranked(64) + " SELECT 0 AS step, round(sum(CASE WHEN rn > 409 THEN re * re + im * im ELSE 0 END) / count(DISTINCT vec_id), 6) AS loss FROM rk")
def coordinates_before_training(spark, sf_dir):
    """What training on coordinate rows measures before its first step, on 64 x 64 pictures."""
    cells = _cells(spark, sf_dir, F.col("l_returnflag"), "l_partkey % 64 + 64 * (l_suppkey % 64)", 1000)
    _, trace = coordinates.optimize(cells, RING_64, training.Optimizer(), k=409, max_iter=0)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(trace)], "step int, loss double")


@query()
def train_512(spark, sf_dir):
    """Losses before and after a gradient step on 512 x 512 pictures as coordinate rows, a tenth of the coefficients kept; a picture is spread over many tasks."""
    cells = _cells(spark, sf_dir, F.col("l_returnflag"), "l_orderkey % 512 + 512 * (l_partkey % 512)", 1000)
    _, trace = coordinates.optimize(cells, B.Basis.make("tebd", 9, 9, tuple(0.1 * i for i in range(18))), training.Optimizer("gd", 0.01), max_iter=1, tol=0.0)
    return spark.createDataFrame(list(enumerate(trace)), "step int, loss double")


@query("SELECT vec_id, (p - 1)::INT AS lin, embedding[p]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)")
def array_files(spark, sf_dir):
    """The vectors, each with its id before its numbers, written as array files and read back by ranges of records."""
    spark.dataSource.register(ArrayFiles)
    folder = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    numbers = vectors(spark, sf_dir).select(F.concat(F.array(F.col("vec_id").cast("double")), "re").alias("re"))
    numbers.repartition(3).write.format("arrays").mode("append").save(folder)
    back = spark.read.format("arrays").schema("re array<double>").option("bytesPerPartition", 50_000).load(folder)
    return back.select(F.col("re")[0].cast("long").alias("vec_id"), F.posexplode(F.slice("re", 2, 64)).alias("lin", "v"))


@query(O.with_pixels(O.transform(3, 3, "qft") + ", sc AS (SELECT *, round(sqrt(re * re + im * im) * (2.0::DOUBLE - 0.5::DOUBLE * sqrt(pow(u + 1 - 4.5, 2) + pow(w + 1 - 4.5, 2)) / sqrt(24.5::DOUBLE)), 9) AS score FROM f), rk AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY score DESC) AS rn FROM sc)")
       + " " + FIRST_LOSS.format(what="sum(CASE WHEN rn > 6 THEN re * re + im * im ELSE 0 END)", source="rk"))
def loss_before_training_weighted(spark, sf_dir):
    """The mean squared error with the selection that weighs places and keeps ties."""
    return _before_training(spark, vectors(spark, sf_dir), QFT, "weighted", 6)


@query("WITH p AS (SELECT l_returnflag AS flag, (l_orderkey % 512)::BIGINT AS r, sum(l_quantity)::DOUBLE / 1000 AS v FROM lineitem GROUP BY ALL), k AS (" + O.kernel("qft", 9) + ")"
       " SELECT flag, y + 1 AS idx, round(sum(v * kr) / sqrt(512.0::DOUBLE), 6) + 0.0 AS re, round(sum(v * ki) / sqrt(512.0::DOUBLE), 6) + 0.0 AS im FROM p JOIN k ON r = x GROUP BY flag, y")  # fmt: skip
def lineitem_map_512_edge(spark, sf_dir):
    """The 512 Fourier coefficients of each 512 x 512 picture that are constant along its rows: transforms of the rows' sums."""
    cells = _cells(spark, sf_dir, F.col("l_returnflag"), "l_orderkey % 512 + 512 * (l_partkey % 512)", 1000)
    out = coordinates.transform(cells, B.Basis.make("qft", 9, 9)).filter("lin < 512")
    return out.select(F.col("id").alias("flag"), (F.col("lin") + 1).alias("idx"), rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


def _first_adam_step_sql(rate: float) -> str:
    """New unitary gates of the ring after one Adam step, from the gradients' rows: project, divide by size, project, and go back by the Cayley transform."""
    h = O.fixed(circuits.HADAMARD.tolist())
    tangent = lambda a, b, source, given, skewed, out: ", ".join([O.step(a, source, given[0], O.times(O.adjoint(h), given[1])), O.step(b, a, skewed, O.skew(O.matrix(given[0]))), O.step(out[0], b, out[1], O.times(h, O.matrix(skewed)))])
    size = lambda x: f"(sqrt({x[0]} * {x[0]} + {x[1]} * {x[1]}) + 1e-8::DOUBLE)"
    away = [[tuple(f"-({part}) / {size(x)}" for part in x) for x in row] for row in O.matrix("p")]
    half = lambda sign, v: [[tuple(f"{int(i == j and k == 0)} {sign} {rate / 2!r}::DOUBLE * {v[i][j][k]}" for k in (0, 1)) for j in (0, 1)] for i in (0, 1)]
    pivot = ", ".join(f"sum(CASE WHEN i = {i} AND j = {j} THEN {c} ELSE 0 END) / any_value(n) AS g{i}{j}{c[0]}" for i, j in O.ENTRIES for c in ("re", "im"))
    rows = RING_GRADIENT_SQL.split(" SELECT gate::INT")[0]
    return (rows + f", pv AS (SELECT gate, {pivot} FROM h, n GROUP BY gate), "
            + tangent("a1", "a2", "pv", ("h", O.matrix("g")), "s", ("a3", "p")) + ", " + O.step("a4", "a3", "y", away) + ", " + tangent("b1", "b2", "a4", ("k", O.matrix("y")), "t", ("b3", "d"))
            + ", " + O.step("c1", "b3", "w", O.times(O.matrix("d"), O.adjoint(h))) + ", " + O.step("c2", "c1", "v", O.skew(O.matrix("w"))) + ", " + O.step("c3", "c2", "l", half("-", O.matrix("v"))) + ", " + O.step("c4", "c3", "r", half("+", O.matrix("v")))
            + ", " + O.inverted("c5", "c4", "q", O.matrix("l")) + ", " + O.step("c6", "c5", "m", O.times(O.matrix("r"), h)) + ", " + O.step("c7", "c6", "x", O.times(O.matrix("q"), O.matrix("m")))
            + O.rounded_matrix("x", "c7").replace("SELECT vec_id", "SELECT gate::INT AS gate"))


@query(_first_adam_step_sql(0.01))
def ring_adam_step(spark, sf_dir):
    """The ring's unitary gates after the first Adam step of the whole circuit on all vectors."""
    moved, _ = training.optimize(vectors(spark, sf_dir), RING_8, training.Optimizer("adam", 0.01), k=6, max_iter=1, tol=0.0)
    rows = [(g, *[round(float(v), 6) + 0.0 for i, j in O.ENTRIES for v in (m[i, j].real, m[i, j].imag)]) for g, m in enumerate(moved.tensors[:6])]
    return spark.createDataFrame(rows, "gate int, " + _ENTRY)


def _first_stiefel_step_sql(rate: float) -> str:
    """All gates of the ring after one gradient step on frames: unitary gates move against what kept and left-out coefficients have in common, phase gates only go to their nearest frame."""
    h, bit = O.fixed(circuits.HADAMARD.tolist()), "(x.lin >> q) & 1"
    rows = RING_GRADIENT_SQL.split(" h AS (")[0].rstrip(",") + ","
    rest = "CASE WHEN y.kept THEN 0 ELSE y.f END"
    rows += (f" h AS (SELECT q AS gate, {bit} AS i, j, -2 * x.f * CASE WHEN {bit} = 1 THEN 1 ELSE 1 - 2 * j END * {rest} / sqrt(2.0::DOUBLE) AS re, 0.0::DOUBLE AS im"
             " FROM x CROSS JOIN range(0, 6) t(q) CROSS JOIN range(0, 2) s(j) JOIN x y ON y.vec_id = x.vec_id AND y.lin = xor(x.lin, (1 << q)::BIGINT) WHERE x.kept)")  # fmt: skip
    pivot = ", ".join(f"sum(CASE WHEN i = {i} AND j = {j} THEN {c} ELSE 0 END) / any_value(n) AS g{i}{j}{c[0]}" for i, j in O.ENTRIES for c in ("re", "im"))
    moved = [[tuple(f"{h[i][j][k]} - {rate!r}::DOUBLE * {O.matrix('p')[i][j][k]}" for k in (0, 1)) for j in (0, 1)] for i in (0, 1)]
    names = ", ".join(f"w{i}{j}{p}" for i, j in O.ENTRIES for p in "ri")
    return (rows + f", pv AS (SELECT gate, {pivot} FROM h, n GROUP BY gate), " + O.step("a1", "pv", "h", O.times(O.adjoint(h), O.matrix("g"))) + ", " + O.step("a2", "a1", "s", O.skew(O.matrix("h"))) + ", " + O.step("a3", "a2", "p", O.times(h, O.matrix("s")))
            + ", " + O.step("a4", "a3", "w", moved) + f", st AS (SELECT gate, {names} FROM a4 UNION ALL SELECT gate, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, cos(p), sin(p) FROM (VALUES {_PAIRS_8}) t(gate, a, b, p)), "
            + O.polar("z", "st", "x", O.matrix("w")) + O.rounded_matrix("x", "z").replace("SELECT vec_id", "SELECT gate::INT AS gate"))


@query(_first_stiefel_step_sql(0.01))
def ring_stiefel_step(spark, sf_dir):
    """The ring's gates after the first gradient step of the comparator that has all gates on frames."""
    optimizer = training.Optimizer("gd", 0.01, tries=1, manifold="stiefel_polar")
    moved, _ = training.optimize(vectors(spark, sf_dir), RING_8, optimizer, loss="roundtrip", k=6, max_iter=1, tol=0.0)
    rows = [(g, *[round(float(v), 6) + 0.0 for i, j in O.ENTRIES for v in (m[i, j].real, m[i, j].imag)]) for g, m in enumerate(moved.tensors)]
    return spark.createDataFrame(rows, "gate int, " + _ENTRY)
