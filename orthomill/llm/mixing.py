"""Mix sources to target weights with DataFrame functions only.

Each document gets a hash-random key of its id and text. Keys cut every source into ranges of about
``range_rows`` documents; token counts are summed per range, ranges are prefix-summed,
and inside a range a window adds the documents before it, so no task holds a source.
The cut falls exactly on each source's budget: whole epochs first, then documents in key
order, the last one in part.

Defined results: null or blank texts have size 0 and nothing is taken from them; a null
source is a source of its own and comes last; sources without words get target 0; an
empty table gives an empty result; repeated rows are separate documents, and so are rows of
one or no id; between equal rows any order will do, as they are the same; other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, materialize, table

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source: size, rows and target.

    The excess of capped sources goes to the others by weight until none is above its cap.
    Capped sources are a prefix of the order by cap / weight, so two running sums find them.
    The windows run over one row per source, never over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", weight)
    by_fill = W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    before = per.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(by_fill), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)).alias("weight_before"),
    )
    level = (share * F.col("all_size") - max_epochs * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    cap = max_epochs * F.col("source_size")
    leveled = before.withColumn("level", level).withColumn("capped", cap <= F.col("level") * F.col("weight"))
    # sources from the first that is not capped on share its level, the largest of theirs
    final = leveled.withColumn("final_level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    target = F.when(F.col("capped"), cap).otherwise(F.col("weight") * F.col("final_level"))
    return final.select("source", "rank", "rows", "source_size", target.cast("double").alias("target"))


def sized_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed="mix", row_col=None) -> DataFrame:
    """doc_id, source, size in words, a 60-bit hash-random key of id and text, and the row's number where ``row_col`` has one."""
    ident, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), ident.cast("string"), F.md5(text))), 1, 15), 16, 10).cast("long")
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    number = [F.col(row_col).alias("row")] if row_col else []
    return docs.select(ident.alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *number)


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share: float = 1.5,
                max_epochs: float = 2.0, seed: str = "mix", range_rows: int = 4096, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, before (words of the source ahead in key order), epochs, part, taken.

    With ``row_col``, unique row numbers, also row; it decides between rows of the same id and text.
    Rows without words have nothing to order: they pass by the windows, with before 0.
    """
    sized = materialize(sized_documents(docs, id_col, text_col, source_col, seed, row_col))
    number = ["row"] if row_col else []
    targets = source_targets(sized, weights, share, max_epochs)
    # one row per source: hashed joins with AQE; small source tables are broadcast by size
    ranges = F.ceil(F.col("rows") / F.lit(range_rows))
    known = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    keyed = known.filter("size > 0").withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * ranges).cast("long"))
    sums = keyed.groupBy("rank", "range").agg(F.sum("size").alias("range_size"))
    ahead = W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("rank").alias("r_rank"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("range_start"))
    inside = W.partitionBy("rank", "range").orderBy("key", "doc_id", "size", *number).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.join(starts, (F.col("rank") == F.col("r_rank")) & (F.col("range") == F.col("r_range")))
    placed = placed.withColumn("before", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    names = ["doc_id", "source", "size", "source_size", "target", "before", *number]
    placed = placed.select(*names).unionByName(known.filter("size = 0").withColumn("before", F.lit(0).cast("long")).select(*names))
    budget = F.rint("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "before", epochs.alias("epochs"), part.cast("long").alias("part"),
                         (epochs * F.col("size") + part).cast("long").alias("taken"), *number)


def mixed_rows(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix as rows of ``docs``: one copy per epoch, and the part that the budget's cut leaves of one document.

    Rows are numbered and written first, so that each meets its own row of the mix, whatever its
    id; they travel as one struct, so columns of any name are safe.
    """
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("given"), F.monotonically_increasing_id().alias("row")))
    plain = numbered.select(*[F.col("given").getField(kwargs.get(f"{c}_col", d)).alias(c) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))], "row")
    mixed = mix_sources(plain, "id", "text", "source", row_col="row", **{k: v for k, v in kwargs.items() if not k.endswith("_col")}).filter("taken > 0")
    joined = numbered.join(mixed.select("row", "size", "epochs", "part"), "row")
    copies = joined.select("given", "size", "epochs", "part", F.explode(F.sequence(F.lit(1), (F.col("epochs") + (F.col("part") > 0).cast("long")).cast("int"))).alias("copy"))
    text_col = kwargs.get("text_col", "text")
    given = lambda c: F.col("given").getField(c)
    words = F.regexp_extract_all(given(text_col), F.lit("(" + WORD + ")"), F.lit(1))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")).otherwise(given(text_col))
    return copies.select(*[(text if c == text_col else F.length(text).cast("long") if c == "n_chars" else given(c)).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per),
b AS (SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
        coalesce(sum(source_size) OVER f, 0) AS size_before, coalesce(sum(weight) OVER f, 0) AS weight_before
      FROM w WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * size_before) / (all_weight - weight_before) AS level FROM b),
c AS (SELECT *, 2.0::DOUBLE * source_size <= level * weight AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size
        ELSE weight * max(CASE WHEN NOT capped THEN level END) OVER () END AS target FROM c),
d AS (SELECT s.*, t.source_size, t.target, round_even(t.target, 0)::BIGINT AS budget,
        (coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM d)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""
