"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and components.

1. Each text becomes its set of 5-word shingles (64-bit hashes), a digest of that set and a
   SuperMinHash signature: element by element, the ranks 0, 1, 2, ... are dealt to the
   signature's places by a random permutation, so the places' minima are correlated and vary
   less than independent ones. Level j deals rank j of all elements at once; a text stops as
   soon as every place holds a value below the next level (early stopping).
2. Texts with the same set fold into one class at once, so copies never multiply.
3. Bands of signature places meet in buckets, whose pairs are the candidates; ``linking`` decides
   them on full sets by hubs and components, so a bucket of near copies costs a pair per member.
4. The links' connected components, folded back to all members, are the groups.

Defined results: null and blank texts have no shingles and are linked with nothing; a text
of fewer than ``k`` words has one shingle, its whole word sequence; a null id is never
linked and its component is null and it is kept; repeated rows give repeated results; rows of
one id with different texts are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHashes, chunks_by_bytes, discard, materialize, mix, table
from .linking import class_sets, components_of_documents, linked_components, shared_buckets
from .shingles import set_digests, shingle_sets

PLACES, ROWS = 96, 4
#: Chance to miss a pair at similarity s with b bands of r places: (1 - s ** r) ** b, 2e-8 at 0.85 (24 bands of 4).


def superminhash(values: np.ndarray, counts: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One row of ``places`` 64-bit minima per text; a row of an empty set holds the largest value."""
    n = len(counts)
    out = np.full(n * places, np.iinfo(np.uint64).max, U64)
    doc, element = np.repeat(np.arange(n), counts), values
    deal = None  # each element's permutation, kept only for texts that go on
    with np.errstate(over="ignore"):
        for level in range(places):
            if not len(element):
                break
            r = mix(element + U64(level + 1) * U64(0x9E3779B97F4A7C15))
            pick = level + ((r & U64(0xFFFFFF)) % U64(places - level)).astype(np.int64)
            rank = U64(level) << U64(40) | r >> U64(24)
            if deal is None:
                place = pick
            else:
                at = np.arange(len(element))
                place = deal[at, pick].astype(np.int64)
                deal[at, pick] = deal[at, level]
                deal[at, level] = place
            np.minimum.at(out, doc * places + place, rank)
            going = out.reshape(n, places).max(axis=1) >= U64(level + 1) << U64(40)
            keep = going[doc]
            if deal is None:
                doc, element, place = doc[keep], element[keep], place[keep]
                deal = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(element), 1))
                deal[np.arange(len(element)), place] = 0
                deal[:, 0] = place
            elif not keep.all():
                doc, element, deal = doc[keep], element[keep], deal[keep]
    return out.reshape(n, places)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` places, the band's number mixed in."""
    n, places = signature.shape
    parts = signature[:, : places // rows * rows].reshape(n, places // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(places // rows, dtype=np.uint64) * U64(0x632BE59BD9B4E019), (n, places // rows)).copy()
        for i in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def signed_documents(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5) -> DataFrame:
    """doc_id, the text's hash k, n_shingles, digest (d1, d2) and band keys."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))
    names = ["doc_id", "k", "n_shingles", "d1", "d2", "bands"]

    def run(batches):
        cache = WordHashes()
        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(2)]
            for lo, hi in chunks_by_bytes(texts, 2_000_000):
                values, counts = shingle_sets(texts[lo:hi], k, cache)
                keys = band_keys(superminhash(values, counts)).view(np.int64)
                d1, d2 = set_digests(values, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(lo, hi - lo) for i in (0, 1)], pa.array(counts.astype(np.int64)), pa.array(d1), pa.array(d2), lists], names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, k long, n_shingles long, d1 long, d2 long, bands array<long>")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``; ids may be of any type with an order."""
    signed = materialize(signed_documents(docs, id_col, text_col, k))
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    # classes of equal sets; the smallest id stands for its class
    folded = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min("k").alias("k"), F.first("bands").alias("bands"))
    classes = materialize(folded.withColumn("c", F.monotonically_increasing_id()))
    members = shared_buckets(classes.select(F.explode("bands").alias("key"), "c", "n"))
    wanted = classes.join(members.select("c").distinct(), "c", "left_semi")
    sets = materialize(class_sets(docs, text_col, wanted, k))
    roots = linked_components(members, sets, percent, keys=wanted.select("c", F.col("bands").alias("keys")))
    discard(members, sets)
    return components_of_documents(signed, classes, roots)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
