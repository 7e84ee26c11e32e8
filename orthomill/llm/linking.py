"""Links between sets that meet in buckets: each pair is decided on full sets once, pairs within a component never.

Members (key, c, n and, with positions, pos) say which class of equal sets ``c`` of size ``n`` stands
in which bucket. All pairs of a bucket are candidates, but they are not written out:

1. Hub rounds. Every bucket's most central class is compared with the others; members that link form a
   component at once. In the next round a hub of those outside the bucket's largest component
   meets all members of other components. A bucket of near copies thus costs a pair per member.
2. What is left: members outside the largest component of their bucket meet all members of other
   components, so each pair of a bucket is either compared, ruled out by a bound, or in one component.

Pairs are made only if they pass bounds on their overlap: by size, by the positions of a shared
first element in a common order (with ``pos``), and by suffix: shingles dealt to ranges of their
hash, where the smaller count of each range bounds what can be shared in it (``COARSE`` ranges in the join, then ``RANGES``).
Where each class's keys are given, a pair that shares several buckets of one hub is made in the first of them only.
All steps are joins with equality and aggregates, a hot bucket is never gathered in a task, and
adaptive execution can split it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, chunks_by_bytes, discard, materialize
from .components import connected_components
from .shingles import shingle_sets

RANGES, COARSE, HUB_ROUNDS, HUB_PART = 64, 16, 2, 256
#: Class numbers are broadcast to the texts up to this many (about 24 MB), else texts are shuffled to them.
BROADCAST_CLASSES = 1_000_000


def class_sets(docs: DataFrame, text_col: str, wanted: DataFrame, k: int) -> DataFrame:
    """c, the sorted shingle hashes as bytes and their numbers by range, once per class; ``wanted`` has c and the text hash ``k`` of one of its texts."""
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("k"), F.col(text_col).cast("string").alias("text"))
    wanted = wanted.select("k", "c")
    joined = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted, "k").select("c", "text")

    def run(batches):
        cache, seen = WordHashes(), set()
        for b in batches:
            fresh = []
            for i, c in enumerate(b.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            if len(seen) > 200_000:
                seen.clear()
            b = b.take(pa.array(fresh, pa.int32()))
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
            for lo, hi in chunks_by_bytes(texts, 2_000_000):
                values, counts = shingle_sets(texts[lo:hi], k, cache)
                owner = np.repeat(np.arange(hi - lo), counts)
                ranges = np.bincount(owner * RANGES + (values >> U64(58)).astype(np.int64), minlength=(hi - lo) * RANGES)
                end = np.cumsum(counts)
                sets = [values[e - n : e].tobytes() for e, n in zip(end, counts)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * RANGES, pa.int32()), pa.array(ranges, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary()), lists], ["c", "shingles", "ranges"])

    return joined.mapInArrow(run, "c long, shingles binary, ranges array<int>").dropDuplicates(["c"])


def least_overlap(a, b, percent: int):
    """The overlap from which 100 * overlap >= percent * union, for sizes a and b."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked: pairs (a, b) decided on full sets. A task reads the set of b, then those of its partners one by one."""
    open_ = materialize(pairs)
    parts = open_.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_PART).cast("int").alias("parts"))
    own = sets.select("c", "shingles")
    hubs = parts.join(own.withColumnRenamed("c", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "shingles")
    members = open_.join(parts, "b").join(own.withColumnRenamed("c", "a"), "a").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a", "shingles")

    def run(batches):
        key, hub = None, None
        for b in batches:
            out = []
            for own_b, part, a, shingles in zip(*[c.to_pylist() for c in b.columns]):
                values = np.frombuffer(shingles, np.uint64)
                if a is None:
                    key, hub = (own_b, part), values
                    continue
                if key != (own_b, part):
                    raise RuntimeError("a pair came without its first set")
                at = np.minimum(np.searchsorted(hub, values), len(hub) - 1)
                common = int((hub[at] == values).sum())
                out.append((a, own_b, 100 * common >= percent * (len(hub) + len(values) - common)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    dealt = hubs.unionByName(members).repartition("b", "part").sortWithinPartitions(F.col("b"), F.col("part"), F.col("a").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long, linked boolean")


def candidates(left: DataFrame, right: DataFrame, percent: int, positions: bool) -> DataFrame:
    """Distinct pairs a > b of classes that share a key, pass the bounds and are in different components (``comp``)."""
    x, y = left.alias("x"), right.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.comp") != F.col("y.comp")) & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
    in_ranges = reduce(lambda s, i: s + F.least(f"x.r{i}", f"y.r{i}"), range(1, COARSE), F.least("x.r0", "y.r0"))
    near = near & (in_ranges >= least_overlap(nx, ny, percent))
    shared = F.aggregate(F.zip_with("x.ranges", "y.ranges", lambda a, b: F.least(a, b)), F.lit(0), lambda s, a: s + a)
    near = near & (shared >= least_overlap(nx, ny, percent))
    if "hub_keys" in right.columns:  # the other buckets that the two share would make the same pair again
        near = near & (F.array_min(F.array_intersect("y.hub_keys", "x.keys")) == F.col("x.key"))
    if positions:
        near = near & (1 + F.least(nx - F.col("x.pos"), ny - F.col("y.pos")) - 1 >= least_overlap(nx, ny, percent))
    return x.join(y, near).select(F.greatest("x.c", "y.c").alias("a"), F.least("x.c", "y.c").alias("b")).distinct()


def shared_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that have two or more, written, with ``central``: how many others a class meets in all its buckets."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = materialize(members.join(sizes, "key"))
    central = met.groupBy("c").agg(F.sum("size").alias("central"))
    placed = materialize(met.drop("size").join(central, "c"))
    discard(met)
    return placed


def linked_components(members: DataFrame, sets: DataFrame, percent: int, positions: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """(node, root) of all classes that have a link; ``members`` and ``sets`` are written tables.

    ``keys`` (c, keys) lists each class's buckets, for lists short enough to travel with every member; not with ``positions``.
    """
    width = RANGES // COARSE
    coarse = [reduce(lambda s, j: s + F.get("ranges", F.lit(j)), range(i * width + 1, (i + 1) * width), F.get("ranges", F.lit(i * width))).alias(f"r{i}") for i in range(COARSE)]
    members = members.join(sets.select("c", "ranges", *coarse), "c")
    members = materialize(members if keys is None else members.join(keys, "c"))
    hub_of = lambda rows: rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), F.struct("central", "c")).alias("h")).select("h.*")
    with_comp = lambda roots: members.withColumn("comp", F.col("c")) if roots is None else members.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root")
    known, roots = None, None
    for round_ in range(HUB_ROUNDS + 1):
        placed = materialize(with_comp(roots))
        if roots is None:
            hubs = hub_of(placed)
        else:
            largest = placed.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
            hubs = placed.join(largest.select("key", F.col("most.comp").alias("main")), "key").filter("comp <> main").drop("main")
            if round_ < HUB_ROUNDS:
                hubs = hub_of(hubs)
        if keys is not None:
            hubs = hubs.drop("keys").join(hubs.groupBy("c").agg(F.collect_set("key").alias("hub_keys")), "c")
        pairs = candidates(placed, hubs, percent, positions)
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        found = materialize(verified(pairs, sets, percent))
        discard(placed)
        known = found if known is None else known.unionByName(found)
        roots = materialize(connected_components(known.filter("linked")))
    discard(members)
    return roots


def components_of_documents(signed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the smallest id of all classes that links lead to; rows without shingles or id stand alone."""
    linked = roots.join(classes.select(F.col("c").alias("node"), "rep"), "node")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("group"))
    groups = linked.join(smallest, "root").select(F.col("node").alias("c"), "group")
    named = classes.join(groups, "c", "left").select("d1", "d2", F.coalesce("group", "rep").alias("group"))
    columns = ["doc_id", "n_shingles", "d1", "d2"]
    placed = signed.filter("n_shingles > 0").select(*columns).join(named, ["d1", "d2"], "left").select("doc_id", "n_shingles", "group")
    # texts without shingles are in no class, so they don't meet in the join
    placed = placed.unionByName(signed.filter("n_shingles = 0").select("doc_id", "n_shingles").withColumn("group", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
