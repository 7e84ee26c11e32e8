"""Hard-negative mining: threshold joins of anchors against all rows, in the manner of L2AP.

Anchors (a stated share of the rows) meet all rows block by block; a block pair is one group of
bounded size, blocks are dealt by hash, so a label or vector that very many rows have is spread.

Inside a block pair, dimensions come in the order of their energy, in groups. A row's inverted
index omits the last groups as soon as the norm of what is left can't reach any threshold
alone. Partial scores add up group by group over the index; a pair goes when its partial score
plus the product of both remaining norms stays below the anchor's threshold; what is left is
completed exactly, the omitted dimensions too. Every block returns its best rows per window, and
the best of all blocks are kept.

Positives: thresholds start at what a first share of the rows already fills, which is a bound on
the result. Negatives: a positive's window reaches from its score down to a share of it; the
threshold starts just below the score and is lowered for windows that aren't full, until they are or
their end is reached. A window that is full at a threshold has its exact result, as all rows from
the threshold up were found.

Defined results: rows with a null label, a null vector or a null or non-finite component take no
part, nor rows of another length than the first row's by id; a null id is no anchor and comes last
among ties. Repeated rows and ids are rows of their own: each is an anchor or neighbour by itself.
A positive of negative score has an empty window. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialize, table
from .vectors import integer_vectors, matrix

#: Rows and anchors of a block at most, dimensions of a group, and partial scores held at once.
BLOCK, GROUP, HELD = 8192, 8, 2_000_000
LOW, HIGH = -(1 << 62), 1 << 62
HIT = "row long, slot int, score long, vec_id long"


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of what stands from each group of dimensions on, the last one zero."""
    square = np.add.reduceat(x.astype(float) ** 2, np.arange(0, x.shape[1], GROUP), axis=1)
    return np.sqrt(np.concatenate([np.cumsum(square[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))


def joined(q: np.ndarray, x: np.ndarray, least: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs that ``allowed(anchors, rows)`` lets pass and whose score is at least the anchor's ``least``."""
    if not x.shape[1]:
        q, x = np.zeros((len(q), 1), np.int64), np.zeros((len(x), 1), np.int64)
    dims = np.argsort(-(x.astype(float) ** 2).sum(axis=0), kind="stable")
    q, x = q[:, dims], x[:, dims]
    exact = float if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52 else np.int64
    q, x = q.astype(exact), x.astype(exact)
    q_tail, x_tail = tails(q), tails(x)
    groups = x_tail.shape[1] - 1
    # what an anchor asks for by unit of its norm; equal ones share an index
    asks = np.where(least > 0, least / np.maximum(q_tail[:, 0], 1e-300), 0.0) * (1 - 1e-9)
    order = np.argsort(asks, kind="stable")
    step, out = max(1, HELD // len(x)), []
    for lo in range(0, len(order), step):
        own = order[lo : lo + step]
        depth = (x_tail[:, :-1] >= asks[own[0]]).sum(axis=1) if asks[own[0]] > 0 else np.full(len(x), groups)  # groups that are indexed
        by_depth = np.argsort(-depth, kind="stable")
        depth = depth[by_depth]
        score, done = np.zeros((len(own), int((depth > 0).sum())), exact), 0
        rows = by_depth[: score.shape[1]]
        pairs = None
        for g in range(groups):
            m = int((depth > g).sum())
            if not m:
                break
            at = slice(g * GROUP, (g + 1) * GROUP)
            score[:, :m] += q[own, at] @ x[rows[:m], at].T
            done = g + 1
            if 2 * done >= groups or done == int(depth[0]):
                seen = np.minimum(done, depth[: len(rows)])
                reach = score + q_tail[own][:, seen] * x_tail[rows, seen] * (1 + 1e-9) + 1e-6
                alive = reach >= least[own][:, None]
                if done == int(depth[0]) or alive.mean() < 0.05:
                    pairs = np.nonzero(alive)
                    break
        a, b = pairs if pairs is not None else np.nonzero(np.ones(score.shape, bool))
        free = allowed(own[a], rows[b])
        a, b = a[free], b[free]
        value, seen = score[a, b], np.minimum(done, depth[b])
        for g in range(groups):
            open_ = seen <= g
            if not open_.any():
                continue
            i, j, at = own[a[open_]], rows[b[open_]], slice(g * GROUP, (g + 1) * GROUP)
            value[open_] += (q[i, at] * x[j, at]).sum(axis=1)
            after = np.where(open_, g + 1, seen)
            going = value + q_tail[own[a], after] * x_tail[rows[b], after] * (1 + 1e-9) + 1e-6 >= least[own[a]]
            a, b, value, seen = a[going], b[going], value[going], after[going]
        going = value >= least[own[a]]
        out.append((own[a[going]], rows[b[going]], value[going].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def best_of_windows(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best hits of each window (anchor, slot) as (anchor, slot, hit number); ``lows`` and ``highs`` have a row per anchor."""
    parts = []
    for slot in range(lows.shape[1]):
        inside = np.flatnonzero((score >= lows[anchor, slot]) & (score <= highs[anchor, slot]))
        inside = inside[np.lexsort((ids[inside], -score[inside], anchor[inside]))]
        own = anchor[inside]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        inside = inside[rank < k]
        parts.append((anchor[inside], np.full(len(inside), slot), inside))
    return tuple(np.concatenate(c) for c in zip(*parts))


def searched(rows: DataFrame, probes: DataFrame, n_rows: int, n_probes: int, same: bool, k: int) -> DataFrame:
    """row, slot, score, vec_id: of each probe (row, label, x, lows, highs) the k best rows of the same or of other labels in each window."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    i_blocks = max(1, math.ceil(n_probes / BLOCK))
    j_blocks = max(1, math.ceil(n_rows / BLOCK), min(4 * parallel, n_rows // 1024))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = probes.select(of(i_blocks).alias("i"), deal(j_blocks).alias("j"), "row", "label", "x", "lows", "highs")
    right = rows.select(deal(i_blocks).alias("i"), of(j_blocks).alias("j"), "row", "vec_id", "label", "x")

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())]).empty_table()
        labels = pa.concat_arrays([*a["label"].chunks, *b["label"].chunks]).dictionary_encode().indices.to_numpy()
        q_label, x_label = labels[: len(a)], labels[len(a) :]
        q_row, x_row, vec_id = a["row"].to_numpy(), b["row"].to_numpy(), pa.concat_arrays(b["vec_id"].chunks)
        lows, highs = matrix(a["lows"]), matrix(a["highs"])
        allowed = lambda s, t: ((q_label[s] == x_label[t]) == same) & (q_row[s] != x_row[t])
        anchor, at, score = joined(matrix(a["x"]), matrix(b["x"]), lows.min(axis=1), allowed)
        ids = vec_id.fill_null(np.iinfo(np.int64).max).to_numpy()
        own, slot, hit = best_of_windows(anchor, score, ids[at], lows, highs, k)
        return pa.table([pa.array(q_row[own]), pa.array(slot, pa.int32()), pa.array(score[hit]), vec_id.take(pa.array(at[hit]))], ["row", "slot", "score", "vec_id"])

    hits = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(work, HIT)
    place = F.row_number().over(W.partitionBy("row", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 5, percent: int = 80, first_share: int = 16, levels=(95, 88)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of integer vectors (vec_id, label, x).

    ``anchors`` is the condition on ``vec_id`` of the rows to mine for; ``percent`` of a positive's
    score is the least score of its negatives; one in ``first_share`` rows starts the positives'
    thresholds; ``levels`` are the percentages at which the negatives' thresholds start.
    """
    kept = materialize(vectors.filter("label is not null").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    dims = len(first[0]["x"]) if first else 0
    rows = kept.filter(F.size("x") == dims)
    probes = materialize(rows.filter(F.coalesce(anchors, F.lit(False))))
    n_rows, n_probes = rows.count(), probes.count()
    window = lambda low, high: (F.array(low).alias("lows"), F.array(high).alias("highs"))
    everything = probes.select("row", "label", "x", *window(F.lit(LOW), F.lit(HIGH)))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("first"), "row"), F.lit(first_share)) == 0)
    started = searched(sample, everything, n_rows // first_share, n_probes, True, positives).groupBy("row").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("low"))
    begun = probes.join(started, "row", "left").select("row", "label", "x", *window(F.coalesce("low", F.lit(LOW)), F.lit(HIGH)))
    near = searched(rows, begun, n_rows, n_probes, True, positives).select("row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = materialize(near.join(probes.select("row", F.col("vec_id").alias("anchor_id")), "row"))
    open_, found = near.filter("positive_score >= 0").select("row", "slot", "positive_score"), []
    for level in (*[x for x in levels if x > percent], percent):
        window_of = F.struct(F.expr(f"({level} * positive_score + 99) div 100").alias("low"), F.col("positive_score").alias("high"))
        by_anchor = open_.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", window_of))).alias("w"))  # a window per positive
        edges = lambda name, none: F.array(*[F.coalesce(F.try_element_at("w", F.lit(s))[name], F.lit(none)) for s in range(positives)])
        asked = probes.join(by_anchor, "row").select("row", "label", "x", edges("low", HIGH).alias("lows"), edges("high", LOW).alias("highs"))
        hits = materialize(searched(rows, asked, n_rows, n_probes, False, negatives))
        if level == percent:
            found.append(hits)
            break
        full = hits.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == negatives).select("row", "slot")
        found.append(hits.join(full, ["row", "slot"], "left_semi"))
        open_ = materialize(open_.join(full, ["row", "slot"], "left_anti"))
        if open_.isEmpty():
            break
    all_hits = found[0]
    for more in found[1:]:
        all_hits = all_hits.unionByName(more)
    out = near.join(all_hits, ["row", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_vectors(table(spark, sf_dir, "embeddings")).withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = (
    "WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings"
    " WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), "
    "p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS rn FROM s WHERE same) WHERE rn <= 5), "
    "n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank"
    " FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) "
    "SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"
)
