"""Connected components of an edge table, by alternating hooking and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Every round lets each node's root hook onto the smallest root next to it and then shortens
    the pointers, so chains need a logarithmic number of rounds. All steps are partial
    aggregates and equi-joins of written tables, one side of which has a row per node, so adaptive
    execution can split a root or node that very many rows have; each round's tables go after it.
    Null ends and loops are ignored; repeated edges change nothing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    for _ in range(max_rounds):
        # pointer jumping: node -> root -> root's root
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        jumped = materialize(roots.join(up, "root").select("node", F.col("upper").alias("root")))
        left = jumped.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = jumped.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        # edges whose ends still differ; each makes the larger root hook onto the smaller one
        open_edges = pairs.join(left, "u").join(right, "v").filter("ru <> rv").select(F.greatest("ru", "rv").alias("node"), F.least("ru", "rv").alias("hook"))
        hooks = materialize(open_edges.groupBy("node").agg(F.min("hook").alias("hook")))
        flat = jumped.join(up.filter("root <> upper").select(F.col("root").alias("r2")), F.col("root") == F.col("r2"), "left_semi").isEmpty()
        if hooks.isEmpty() and flat:
            discard(pairs, roots, hooks)
            return jumped
        before, roots = roots, materialize(jumped.join(hooks, "node", "left").select("node", F.least("root", F.coalesce("hook", "root")).alias("root")))
        discard(before, jumped, hooks)
    raise RuntimeError("components did not settle")
