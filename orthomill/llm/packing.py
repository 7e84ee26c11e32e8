"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they are read; only (document, piece, length, checksum)
rows are shuffled, evenly by hash, and every partition packs its pieces online with
bounded space: a fixed number of open bins, found through a bitset keyed by free space.
A piece goes to the open bin with the least sufficient room; if none has room a new bin
opens, and when too many are open the fullest closes. Rows are sorted by a hash before
packing, so a task that runs again gives the same sequences. Of ``look_ahead`` rows that arrive
together the longest come first; 1 takes them strictly as they come.

Defined results: a null or empty text is its end id alone; a document of at most
``capacity`` ids is never cut; a longer one is cut from the end into full pieces, so only
its first piece may be shorter; a repeated row is packed again as a document of its own;
an empty table gives no sequences; other columns of the input are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

END_ID = 0
#: Pieces that arrive together, the longest first: short ones then find bins that long ones left room in.
LOOK_AHEAD = 64


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken: same ids, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_ids(text: str | None, path: str) -> np.ndarray:
    enc, special = encoder(path)
    text = text or ""
    ids = enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)
    ids.append(END_ID)
    return np.frombuffer(array("I", ids), dtype="<u4")


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, id_col="doc_id", text_col="text", capacity: int = 2048) -> DataFrame:
    """doc_id, row (a number of the input row), piece, start, length, ids_crc32."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        path, task, row = tokenizer or default_tokenizer(), TaskContext.get().partitionId(), 0
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1)):
                ids = token_ids(text.as_py(), path)
                for k, (start, length) in enumerate(pieces(len(ids), capacity)):
                    at.append(i)
                    out.append((task << 40 | row, k, start, length, zlib.crc32(ids[start : start + length])))
                row += 1
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit with at most ``max_open`` open bins; ``put`` returns (bin, offset)."""

    def __init__(self, capacity: int = 2048, max_open: int = 1024):
        self.capacity, self.max_open = capacity, max_open
        self.bits, self.open, self.bins = 0, 0, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        roomy = self.bits >> length
        if roomy:
            room = length + (roomy & -roomy).bit_length() - 1
            bin_id = self._take(room)
        else:
            room, bin_id = self.capacity, self.bins
            self.bins += 1
        left = room - length
        if left:
            self.by_room[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.max_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return bin_id, self.capacity - room

    def _take(self, room: int) -> int:
        at = self.by_room[room]
        bin_id = at.pop()
        self.open -= 1
        if not at:
            self.bits ^= 1 << room
        return bin_id


def pack(docs: DataFrame, tokenizer: str | None = None, id_col="doc_id", text_col="text", capacity: int = 2048, max_open: int = 1024, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    cut = materialize(tokenized_pieces(docs, tokenizer, id_col, text_col, capacity))
    spread = F.xxhash64("row", "piece")
    # no partition count: AQE joins small partitions, and each holds enough pieces to fill its bins
    dealt = cut.repartition(spread).sortWithinPartitions(spread, "row", "piece")
    schema = cut.drop("row").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        task, bins = TaskContext.get().partitionId(), BestFit(capacity, max_open)
        for b in batches:
            lengths, stretch = b.column("length").to_numpy(), np.arange(b.num_rows) // look_ahead
            order = np.lexsort((-lengths, stretch))
            placed = np.array([bins.put(n) for n in lengths[order].tolist()], np.int64).reshape(-1, 2)
            cols = [b.column(c).take(pa.array(order)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(placed[:, 0] | task << 40), pa.array(placed[:, 1])], schema.fieldNames())

    return dealt.mapInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
