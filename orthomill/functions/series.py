"""Schedules, splits, batches and smoothing as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def learning_rate(step: Column, total: int, warmup: float = 0.05, peak: float = 0.01, final: float = 0.001) -> Column:
    """Linear warm-up, then a cosine to the final rate; halves round to even."""
    first = max(1, round(warmup * total))
    progress = (step - first) / float(max(1, total - first))
    return F.when(step <= first, peak * (step / float(first))).otherwise(final + 0.5 * (peak - final) * (1 + F.cos(math.pi * progress)))


def learning_rate_at(step: int, total: int, warmup: float = 0.05, peak: float = 0.01, final: float = 0.001) -> float:
    first = max(1, round(warmup * total))
    if step <= first:
        return peak * step / first
    return final + 0.5 * (peak - final) * (1 + math.cos(math.pi * (step - first) / max(1, total - first)))


def validation_count(n: int, split: float) -> int:
    return min(max(round(n * split), 0), n - 1)


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average of an array, first value unchanged."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")

    def add(acc, v):
        return F.when(F.size(acc) == 0, F.array(v)).otherwise(F.concat(acc, F.array(alpha * F.element_at(acc, -1) + (1 - alpha) * v)))

    return F.aggregate(values, F.array().cast("array<double>"), add)


def ema_last(rows: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """key, n and last: the moving average after the last of each key's rows in order; null if a value is.

    Rows are cut into ranges of (key, order), so a large key lies in many; each range is reduced to
    its number of rows and its weighted sum, and only those are chained per key.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    # never 0, so that an infinite value stays infinite however many rows follow
    weight = lambda n: F.greatest(F.pow(F.lit(alpha), n), F.lit(5e-324))
    v = F.col(value).cast("double")
    dealt = rows.select(F.col(key), *order, v.alias("_v")).repartitionByRange(F.col(key), *[F.col(c).asc_nulls_last() for c in order])
    dealt = dealt.withColumn("_range", F.spark_partition_id())
    after = F.row_number().over(W.partitionBy(key, "_range").orderBy(*[F.col(c).desc_nulls_first() for c in order])) - 1
    ranges = dealt.withColumn("_after", after).groupBy(key, "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_known"), F.sum(weight(F.col("_after")) * (1 - alpha) * F.col("_v")).alias("_sum"), F.max_by("_v", "_after").alias("_first"))
    later = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chained = ranges.withColumn("_later", later).groupBy(key).agg(
        F.sum("_n").alias("n"), F.sum("_known").alias("_known"), F.sum(weight(F.col("_later")) * F.col("_sum")).alias("_sum"), F.min_by("_first", "_range").alias("_first"))
    # the average starts at the first value, so that value counts as what came before all rows
    return chained.select(key, "n", F.when(F.col("_known") == F.col("n"), F.col("_sum") + weight(F.col("n")) * F.col("_first")).alias("last"))
