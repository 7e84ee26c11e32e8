"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Texts become sets of 5-word shingles; equal sets fold into one class at once.
2. Which sets can have a partner at all? A set of n shingles linked at ``percent`` has at most
   ``missing`` = n - ceil(percent * n / 100) shingles that its partner lacks. Shingles of a fixed share of the
   hash space meet by shingle; a set of whose meeting shingles more than ``missing`` are in no
   other set goes. Sets that stay meet with all their shingles.
3. All shingles of the sets that stay are ordered by the number of those sets they are in, rare
   ones first. Two linked sets share a shingle among the first missing + 1 of each (the prefix),
   so the join runs on prefix shingles alone; those in one set join nothing, but take a place.
4. Pairs that share a prefix shingle pass the length, positional and suffix filters and are then
   decided on full sets, once each (``linking``); near copies of one text meet a hub, never each other.
5. Components of the links are folded back to all documents.

Nothing is lost: step 2 drops only sets without a link, whatever the share, and so does the prefix
whatever the order. Shingles are told by 64 bits, those that meet in step 2 by 48, where equal ones
can only keep a set too many.

Defined results: null and blank texts have no shingles and are linked with nothing; a text of fewer
than ``k`` words has one shingle, its whole word sequence; a null id is never linked and its
component is null; repeated rows give repeated results; rows of one id with different texts are
rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import U64, WordHashes, chunks_by_bytes, discard, materialize, mix, table
from .linking import class_sets, components_of_documents, linked_components, shared_buckets
from .shingles import set_digests, shingle_sets

#: Share of the hash space whose shingles meet in step 2: the larger, the fewer sets without a partner stay.
SHARE = 0.3
#: Shingles that a task folds together before they meet.
CHUNK = 500_000


def missing(n, percent: int):
    """How many shingles of a set of n a linked one may lack; for numbers and arrays."""
    return n - (percent * n + 99) // 100


def signed_sets(docs: DataFrame, id_col: str, text_col: str, k: int, share: float) -> DataFrame:
    """doc_id, the text's hash k, n_shingles, digest (d1, d2) and the shingles of the share, sorted."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))
    names, limit = ["doc_id", "k", "n_shingles", "d1", "d2", "some"], U64(int(share * 2.0**64))

    def run(batches):
        cache = WordHashes()
        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(2)]
            for lo, hi in chunks_by_bytes(texts, 2_000_000):
                values, counts = shingle_sets(texts[lo:hi], k, cache)
                d1, d2 = set_digests(values, counts)
                end = np.cumsum(counts)
                some = [values[e - n : e][: np.searchsorted(values[e - n : e], limit)].tobytes() for e, n in zip(end, counts)]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(lo, hi - lo) for i in (0, 1)], pa.array(counts.astype(np.int64)), pa.array(d1), pa.array(d2), pa.array(some, pa.binary())], names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, k long, n_shingles long, d1 long, d2 long, some binary")


def folded_chunk(gram: np.ndarray, owner: np.ndarray, sizes: np.ndarray, digests: np.ndarray, percent: int, chunk: int):
    """Rows (gram, seat, w) of different sets that stand together in a task.

    A seat is 40 bits of a set's digest and 8 of the chunk. Shingles of one set only go as they are
    (w = 1, to be counted if another set has them); of those that two or more sets have only the
    first two go (w = 0), as they are known to be shared. A row per set has what is
    known already less what must be reached (its gram is negative).
    """
    seat = (digests.view(np.uint64) >> U64(24) << U64(8) | U64(chunk & 255)).view(np.int64)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(gram)))
    place, shared = np.arange(len(gram)) - np.repeat(first, count), np.repeat(count, count) > 1
    known = np.bincount(owner[shared], minlength=len(sizes))
    need = np.bincount(owner, minlength=len(sizes)) - missing(sizes, percent)
    goes = ~shared | (place < 2)
    return (np.concatenate([gram[goes], -1 - (seat & ((1 << 47) - 1))]), np.concatenate([seat[owner[goes]], seat]),
            np.concatenate([(~shared[goes]).astype(np.int32), (known - need).astype(np.int32)]))


def can_link(signed: DataFrame, percent: int) -> DataFrame:
    """d40: the first 40 bits of the digests of sets that may have a partner."""

    def run(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def fold():
            digests, sizes, some = np.array(list(held), np.int64), np.array([n for n, _ in held.values()]), [np.frombuffer(s, np.uint64) for _, s in held.values()]
            owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
            mixed = int(mix(np.array([task * 1_000_003 + number], np.uint64))[0])
            out = folded_chunk((np.concatenate(some) >> U64(16)).view(np.int64), owner, sizes, digests, percent, mixed)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["gram", "seat", "w"])

        for b in batches:
            for d1, n, some in zip(*[c.to_pylist() for c in b.columns]):
                if d1 not in held:
                    held[d1] = (n, some)
                    size += len(some) // 8 + 1
                if size > CHUNK:
                    yield fold()
                    number, held, size = number + 1, {}, 0
        if held:
            yield fold()

    rows = signed.filter("n_shingles > 0 and doc_id is not null").select("d1", "n_shingles", "some").mapInArrow(run, "gram long, seat long, w int")
    by_gram = W.partitionBy("gram")
    one = F.shiftright("seat", 8)
    met = rows.withColumn("others", F.min(one).over(by_gram) != F.max(one).over(by_gram)).filter("gram < 0 or others and w > 0")
    enough = met.groupBy("seat").agg(F.sum("w").alias("w")).filter("w >= 0")
    return enough.select(one.alias("d40")).distinct()


def prefixes(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """key (a shingle), c, n and pos, the shingle's place in the set's rare-first order from 0, for shared shingles of the prefix."""

    def run(batches):
        for b in batches:
            grams = [np.frombuffer(s, np.int64) for s in b.column(1).to_pylist()]
            c = np.repeat(b.column(0).to_numpy(), [len(g) for g in grams])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(c)], ["key", "c"])

    rows = sets.select("c", "shingles").mapInArrow(run, "key long, c long")
    uses = rows.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    shared = rows.join(uses, "key")
    own = W.partitionBy("c")  # a set's own shingles
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    ranked = shared.join(sizes.select("c", "n"), "c").withColumn("pos", alone + F.row_number().over(own.orderBy("uses", "key")) - 1)
    return ranked.filter(F.col("pos") <= F.col("n") - F.expr(f"({percent} * n + 99) div 100")).select("key", "c", "n", "pos")


def jaccard_join(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5, percent: int = 80, share: float = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``."""
    signed = materialize(signed_sets(docs, id_col, text_col, k, share))
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    folded = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min("k").alias("k"))
    classes = materialize(folded.withColumn("c", F.monotonically_increasing_id()))
    able = materialize(can_link(signed, percent))
    slim = materialize(signed.drop("some"))
    discard(signed)
    open_ = materialize(classes.join(able, F.shiftrightunsigned("d1", 24) == F.col("d40"), "left_semi"))
    sets = materialize(class_sets(docs, text_col, open_, k))
    members = shared_buckets(prefixes(sets, open_, percent))
    roots = linked_components(members, sets, percent, positions=True)
    discard(members, sets, able, open_)
    return components_of_documents(slim, classes, roots)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
