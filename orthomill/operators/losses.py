"""Losses and picture quality: one pass over batches of images, and plain aggregates over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .basis import Basis, flat, images_of, map_images, ranking, run_steps, sizes_of


def l1_loss(images: DataFrame, basis: Basis, real: bool = True) -> DataFrame:
    steps, m, n = basis.steps(), basis.m, basis.n
    work = lambda *x: [pa.array(np.abs(flat(run_steps(images_of(x[0], x[1] if len(x) > 1 else None, m, n), steps))).sum(axis=1))]
    return map_images(images, ["re"] if real else ["re", "im"], "loss double", basis.size, work)


def mse_loss(images: DataFrame, basis: Basis, k: int, real: bool = True) -> DataFrame:
    """Squared error after truncation to k coefficients; the transform keeps norms, so no inverse is needed."""
    steps, m, n = basis.steps(), basis.m, basis.n

    def work(re, im=None):
        y = flat(run_steps(images_of(re, im, m, n), steps))
        power = y.real**2 + y.imag**2
        kept = np.take_along_axis(power, ranking(sizes_of(y), k), axis=1)
        return [pa.array(np.maximum(0.0, power.sum(axis=1) - kept.sum(axis=1)))]

    return map_images(images, ["re"] if real else ["re", "im"], "loss double", basis.size, work)


LOSSES = ("l1", "mse")


def image_loss(images: DataFrame, basis: Basis, loss: str, k: int | None = None, real: bool = True) -> DataFrame:
    """The loss by name; any other name is an error."""
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}; there are {', '.join(LOSSES)}")
    return l1_loss(images, basis, real) if loss == "l1" else mse_loss(images, basis, k or max(1, round(0.1 * basis.size)), real)


def batch_loss(losses: DataFrame, *keys: str) -> DataFrame:
    return losses.groupBy(*keys).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"))


def validation_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.coalesce(F.avg("loss"), F.lit(float("inf"))).alias("loss"))


def picture_metrics(pairs: DataFrame, original: str, recovered: str) -> DataFrame:
    """Mean squared error after clamping to [0, 1] and signal-to-noise ratio in decibels, per row."""
    mse = F.expr(f"aggregate(zip_with({original}, {recovered}, (a, b) -> pow(a - greatest(0D, least(1D, b)), 2)), 0D, (s, v) -> s + v) / size({original})")
    with_mse = pairs.withColumn("mse", mse)
    return with_mse.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(1 / F.col("mse"))).otherwise(F.lit(float("inf"))))


def similarity(pairs: DataFrame, original: str, recovered: str, h: int, w: int, window: int = 7) -> DataFrame:
    """Adds ``ssim``: the mean structural similarity over all places of a square window, for pictures in [0, 1] after clamping."""
    c1, c2 = 0.01**2, 0.03**2
    side = min(window, h, w)

    def means(x):
        return np.lib.stride_tricks.sliding_window_view(x, (side, side), axis=(1, 2)).mean(axis=(3, 4))

    def work(a, b):
        x, y = (np.clip(images_of(v, None, int(np.log2(h)), int(np.log2(w))), 0, 1) for v in (a, b))
        mx, my = means(x), means(y)
        vx, vy, vxy = means(x * x) - mx * mx, means(y * y) - my * my, means(x * y) - mx * my
        each = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
        return [pa.array(each.mean(axis=(1, 2)))]

    return map_images(pairs, [original, recovered], "ssim double", h * w * side, work, drop=())


def improvements(summary: DataFrame, baseline: str, keys: list[str], name: str = "basis") -> DataFrame:
    """Each basis against the baseline row of the same keys: the error's fall in percent and the gain in decibels."""
    other = summary.filter(F.col(name) == baseline).select(*keys, F.col("avg_mse").alias("base_mse"), F.col("avg_psnr").alias("base_psnr"))
    joined = summary.filter(F.col(name) != baseline).join(other, list(keys))
    return joined.select(*keys, name, (100 * (1 - F.col("avg_mse") / F.col("base_mse"))).alias("mse_percent"), (F.col("avg_psnr") - F.col("base_psnr")).alias("psnr_gain"))


def report(summary: DataFrame, value: str, row: str = "basis", column: str = "ratio") -> DataFrame:
    """A table with a row per basis and a column per ratio."""
    return summary.groupBy(row).pivot(column).agg(F.first(value))


def metric_summary(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[f(c).alias(f"{name}_{c}") for c in ("mse", "psnr") for name, f in (("avg", F.avg), ("std", F.stddev_samp))])
