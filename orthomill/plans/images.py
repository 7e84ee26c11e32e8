"""Images out of the tables, and rows out of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.basis import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a column-major image: vec_id, label, re."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("re"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to [0, 1] each by its own range; a constant one becomes zeros."""
    scaled = let("q", {"re": "re", "lo": "array_min(re)", "hi": "array_max(re)"}, "transform(q.re, v -> if(q.hi > q.lo, (v - q.lo) / (q.hi - q.lo), 0D))")
    return vectors(spark, sf_dir).select("vec_id", "label", F.expr(scaled).alias("re"))


def rounded(col, digits: int = 6):
    return F.round(col, digits) + F.lit(0.0)


def coefficients(df: DataFrame, *keys: str) -> DataFrame:
    """One row per coefficient: the keys, idx (1-based, column-major), re, im."""
    at = df.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("lin", "z"))
    return at.select(*keys, (F.col("lin") + 1).alias("idx"), rounded(F.col("z.re")).alias("re"), rounded(F.col("z.im")).alias("im"))


def pixels(df: DataFrame, key: str) -> DataFrame:
    """Images as rows of (id, lin, re, im)."""
    return df.select(F.col(key).alias("id"), F.posexplode("re").alias("lin", "re"), F.lit(0.0).alias("im")).select("id", F.col("lin").cast("long").alias("lin"), "re", "im")


def kept_rows(df: DataFrame, *keys: str) -> DataFrame:
    at = df.select(*keys, F.inline("kept"))
    return at.select(*keys, (F.col("lin") + 1).alias("idx"), rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


def padded(df: DataFrame, h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """Column-major images centred in a larger frame of zeros."""
    top, left = (to_h - h) // 2, (to_w - w) // 2
    r, c = f"(p % {to_h} - {top})", f"(p div {to_h} - {left})"
    inside = f"{r} >= 0 and {r} < {h} and {c} >= 0 and {c} < {w}"
    cell = f"transform(sequence(0, {to_h * to_w - 1}), p -> if({inside}, q.re[cast(greatest(0, least({h * w - 1}, {r} + {h} * {c})) as int)], 0D))"
    return df.withColumn("re", F.expr(let("q", {"re": "re"}, cell)))


def cropped(df: DataFrame, h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """The centre of larger column-major images."""
    top, left = (h - to_h) // 2, (w - to_w) // 2
    return df.withColumn("re", F.expr(let("q", {"re": "re"}, f"transform(sequence(0, {to_h * to_w - 1}), p -> q.re[cast(p % {to_h} + {top} + {h} * (p div {to_h} + {left}) as int)])")))


def mosaics(df: DataFrame, side: int = 64) -> DataFrame:
    """Images of ``side`` vectors each, one vector a column in order of id; missing columns at the end are zeros.

    Images are dealt evenly over the cluster, as what follows is bound by computation.
    """
    spread = df.select(F.expr(f"vec_id div {side}").alias("img_id"), "vec_id", "re").repartition(df.sparkSession.sparkContext.defaultParallelism, "img_id")
    # a group has at most ``side`` vectors
    stacked = spread.groupBy("img_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "re"))), lambda x: x["re"])).alias("re"))
    return stacked.select("img_id", F.concat("re", F.array_repeat(F.lit(0.0), F.lit(side * side) - F.size("re"))).alias("re"))


def grey(r, g, b):
    """Luma of red, green and blue columns."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def chosen(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the first in the order of a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def synthetic(spark: SparkSession, n: int, m: int, n_bits: int, seed: int = 42) -> DataFrame:
    """Made-up pictures in [0, 1]: a gradient, a disc whose place depends on the number, and noise."""
    h, w = 2**m, 2**n_bits
    r, c = f"(p % {h} / {h}D)", f"(p div {h} / {w}D)"
    noise = f"(pmod(xxhash64({seed}, img_id, p), 2001) / 1000D - 1)"
    disc = f"if(pow({r} - (0.25 + 0.5 * pmod(img_id * 37, 100) / 100D), 2) + pow({c} - (0.25 + 0.5 * pmod(img_id * 61, 100) / 100D), 2) < 0.02, 0.4D, 0D)"
    value = f"greatest(0D, least(1D, 0.5 * {r} + 0.3 * {c} + {disc} + 0.05 * {noise}))"
    return spark.range(n).withColumnRenamed("id", "img_id").withColumn("re", F.expr(f"transform(sequence(0, {h * w - 1}), p -> {value})"))


def gaussian(spark: SparkSession, n: int, m: int, n_bits: int, seed: int = 42) -> DataFrame:
    """Random complex pictures; a row's numbers depend on its number and the seed only."""
    size = 2 ** (m + n_bits)
    uniform = lambda salt: f"((pmod(xxhash64({seed}, {salt}, img_id, p), 9007199254740992) + 0.5D) / 9007199254740992D)"
    part = lambda turn: F.expr(f"transform(sequence(0, {size - 1}), p -> sqrt(-ln({uniform(1)})) * {turn}(2 * pi() * {uniform(2)}))")
    return spark.range(n).withColumnRenamed("id", "img_id").select("img_id", part("cos").alias("re"), part("sin").alias("im"))
