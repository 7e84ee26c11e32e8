"""Quality classifier by co-training a text view and a metadata view.

The text view counts the byte trigrams of the whole text in 2^16 buckets and places its word
count and the ratios of ``quality_rules`` in bins; the metadata view sees language, source, both
together, and the stated length only. Both views are naive Bayes tables of log-count ratios, with
a small logistic model over the ratios' sums (one for the trigrams, one for each other
feature). In every round each view, taught by labelled rows and the rows given to it, gives the unlabelled rows
that it is surest of to the other view: of each class as large a share of all unlabelled rows
as ``step`` times the class's share among labels. A row that both views choose in a round with
opposite labels is given to neither; a row's first label stays. At the end both views are
calibrated and their log-odds combined, and all documents are scored.

Everything but the logistic models covers all rows: tables are counted over all labelled and all given
rows, choices are made among all unlabelled ones, in one pass over the written features each. The
logistic models, the calibration and the cutoff use about ``sample`` labelled rows, one for an id,
those whose hash lies in a share of all hashes, dealt into tenths: 0 is held out of everything (``CoTrained.held_out`` has the
results there), 1 sets the cutoff, 2 and 3 calibrate and combine, the others teach.

Defined results: null texts count as empty, null metadata as a value of its own; null labels
are not used; of several labels of one id the largest counts; without both classes in the labels every score is 1 and all rows are kept; a part
of the labels that lacks a class is replaced by all of them; equal rows score alike, so ties fall
on the same side; repeated rows are counted and scored as rows of their own; an empty table gives an empty result; other
columns, whatever their names, are carried along and not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, sampled, table
from .linear import apply_dense, fit_dense, sigmoid
from .quality_rules import RULES, measure

GRAM_BITS = 16
META_SLOTS, LENGTH_BINS = 1024, 16
#: Bins of the text's other features: a bin each for 0 and for each doubling of a ratio's 64ths, and for each doubling of the word count.
RATIO_BINS, COUNT_BINS = 8, 24
#: A text's mean ratio over its trigrams counts as much as so many of them.
GRAM_WEIGHT = 20.0
#: Labels are broadcast to the views up to this many (about 24 MB).
BROADCAST_LABELS = 1_000_000
TEXT_FEATURES, META_FEATURES = 2 + len(RULES), 4
TEXT_SLOTS = (1 << GRAM_BITS) + COUNT_BINS + len(RULES) * RATIO_BINS


def gram_counts(data: bytes) -> bytes:
    """The buckets of byte trigrams that occur and how often, as shares of 255 of the most frequent one, at least 1; packed by ``Grams.pack``."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return b""
    with np.errstate(over="ignore"):
        h = ((x[:-2] * np.uint32(0x01000193) + x[1:-1]) * np.uint32(0x01000193) + x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)
    counts = np.bincount(h, minlength=1 << GRAM_BITS)
    at = np.flatnonzero(counts)
    return Grams.pack(at, -(-counts[at] * 255 // counts.max()))


class Grams:
    """Rows of (bucket, share) with the occupied buckets only; a row's shares add up to 1."""

    def __init__(self, at: np.ndarray, share: np.ndarray, size: np.ndarray):
        self.at, self.share, self.size = at, share, size
        self.row = np.repeat(np.arange(len(size)), size)  # batches are small

    @staticmethod
    def pack(at: np.ndarray, counts: np.ndarray) -> bytes:
        """Gaps between buckets, low bytes and high bytes apart, then the counts, compressed."""
        gaps = np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T
        return zstandard.compress(gaps.tobytes() + counts.astype(np.uint8).tobytes(), 1)

    @classmethod
    def unpack(cls, packed: list[bytes]) -> Grams:
        opened = zstandard.ZstdDecompressor()
        at, share, size = [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(len(packed), np.int64)
        for i, p in enumerate(packed):
            if not p:
                continue
            raw = np.frombuffer(opened.decompress(p), np.uint8)
            n = size[i] = len(raw) // 3
            at.append(np.cumsum(raw[:n] + raw[n : 2 * n].astype(np.int64) * 256))
            share.append(raw[2 * n :] / raw[2 * n :].sum(dtype=np.int64))
        return cls(np.concatenate(at), np.concatenate(share), size)

    def __len__(self) -> int:
        return len(self.size)

    def __matmul__(self, ratio: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.share * ratio[self.at], len(self.size))

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """By bucket, over the rows of ``mask``."""
        mine = mask[self.row]
        return np.bincount(self.at[mine], self.share[mine], 1 << GRAM_BITS)


def text_view(text: str | None) -> tuple[bytes, list[int]]:
    """Trigram counts, and the slots of the other features."""
    n_words, _, _, _, _, *ratios = measure(text)
    at = 1 << GRAM_BITS
    slots = [at + min(COUNT_BINS - 1, n_words.bit_length())]
    at += COUNT_BINS
    for i, ratio in enumerate(ratios):
        slots.append(at + i * RATIO_BINS + min(RATIO_BINS - 1, int(ratio * 64).bit_length()))
    return gram_counts((text or "").encode("utf-8", "surrogatepass")), slots


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Slots of hashed language, source and both together, and of the stated length."""
    hashed = [zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % META_SLOTS for name, value in (("lang", lang), ("source", source), ("both", f"{lang}\t{source}"))]
    return [*hashed, META_SLOTS + (0 if n_chars is None else 1 + min(LENGTH_BINS - 2, max(0, n_chars).bit_length() * 2 // 3))]


VIEWS = "grams binary, slots array<int>, meta array<int>"


def views_of(batch: pa.RecordBatch, at: int) -> list[pa.Array]:
    """Both views of a batch whose columns from ``at`` on are text, lang, source, n_chars."""
    texts = [text_view(t.as_py()) for t in batch.column(at)]
    metas = [meta_view(*x) for x in zip(*[batch.column(at + i).to_pylist() for i in (1, 2, 3)])]
    slots = pa.list_(pa.int32())
    return [pa.array([g for g, _ in texts], pa.binary()), pa.array([s for _, s in texts], slots), pa.array(metas, slots)]


def unpacked(grams: pa.Array, slots: pa.Array, meta: pa.Array) -> tuple[Grams, np.ndarray, np.ndarray]:
    """Trigrams, text slots and metadata slots, a row for each text."""
    n = len(grams)
    return Grams.unpack(grams.to_pylist()), slots.flatten().to_numpy().reshape(n, -1), meta.flatten().to_numpy().reshape(n, -1)


class View:
    """Log-count ratios by slot, a logistic model over their sums by feature, and a calibration of its log-odds."""

    def __init__(self, text: bool, good: np.ndarray, bad: np.ndarray):
        self.text, self.scale, self.shift = text, 1.0, 0.0
        first = 1 << GRAM_BITS if text else 0
        self.ratio = np.zeros(len(good))
        for a, b in ((0, first), (first, len(good))):
            self.ratio[a:b] = np.log((good[a:b] + 0.5) / (good[a:b].sum() + 0.5 * (b - a))) - np.log((bad[a:b] + 0.5) / (bad[a:b].sum() + 0.5 * (b - a)))
        self.beta = np.append(np.ones(TEXT_FEATURES if text else META_FEATURES), 0.0)

    def features(self, x) -> np.ndarray:
        counts, slots, meta = x
        if not self.text:
            return self.ratio[meta]
        return np.column_stack([GRAM_WEIGHT * (counts @ self.ratio[: 1 << GRAM_BITS]), self.ratio[slots]])

    def odds(self, x) -> np.ndarray:
        return apply_dense(self.features(x), self.beta)


class CoTrained:
    """Both calibrated views and how their log-odds are combined; rows that score less than the cutoff are rejected."""

    def __init__(self, views: tuple[View, View]):
        self.views, self.join, self.cutoff, self.held_out = views, np.array([1.0, 1.0, 0.0]), 0.5, {}

    def odds(self, x) -> np.ndarray:
        """Calibrated log-odds, a column per view."""
        return np.column_stack([v.scale * v.odds(x) + v.shift for v in self.views])

    def score(self, x) -> np.ndarray:
        return sigmoid(apply_dense(self.odds(x), self.join))


class Choices:
    """Who gave which label to an unlabelled row: a pair of views and their limits for every round so far."""

    def __init__(self):
        self.rounds: list[tuple[tuple[View, View], list[tuple[float, float]]]] = []

    def given(self, x) -> tuple[np.ndarray, np.ndarray]:
        """The label (1, 0, or -1 for none yet) that each row has in the text view's and in the metadata view's lessons."""
        n = len(x[0])
        text, meta = np.full(n, -1), np.full(n, -1)
        for views, limits in self.rounds:
            free = (text < 0) & (meta < 0)
            chosen = []
            for view, (low, high) in zip(views, limits):
                odds = view.odds(x)
                chosen.append(np.where(free & (odds >= high), 1, np.where(free & (odds <= low), 0, -1)))
            by_text, by_meta = chosen
            clash = (by_text >= 0) & (by_meta >= 0) & (by_text != by_meta)
            meta = np.where(clash | (by_text < 0), meta, by_text)  # each view learns from the other's choice
            text = np.where(clash | (by_meta < 0), text, by_meta)
        return text, meta


def with_views(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", length_col="n_chars") -> DataFrame:
    """doc_id and both views of every row, computed where the texts are read."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(length_col).cast("long"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *views_of(b, 1)], ["doc_id", "grams", "slots", "meta"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {VIEWS}")


def counted(rows: DataFrame, choices: Choices) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Good and bad counts by slot for the text view, then for the metadata view, over all taught rows; each task adds up its rows first."""

    def run(batches):
        sums = [np.zeros((2, TEXT_SLOTS)), np.zeros((2, META_SLOTS + LENGTH_BINS))]
        for b in batches:
            if not b.num_rows:
                continue
            x = unpacked(*[b.column(i) for i in (1, 2, 3)])
            label = b.column(0).to_numpy()
            text, meta = choices.given(x)
            text, meta = (np.where(label >= 0, np.where(label < 2, label, -1), np.where(label == -1, given, -1)) for given in (text, meta))
            for k in (0, 1):
                mine = text == k
                sums[0][k, : 1 << GRAM_BITS] += x[0].sums(mine)
                sums[0][k] += np.bincount(x[1][mine].ravel(), minlength=TEXT_SLOTS)
                sums[1][k] += np.bincount(x[2][meta == k].ravel(), minlength=META_SLOTS + LENGTH_BINS)
        flat = np.concatenate([s.ravel() for s in sums])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.rint(flat[at] * 2**20).astype(np.int64))], ["at", "v"])

    # whole numbers, so that the order of adding doesn't matter; one row per slot reaches the driver
    flat = np.zeros(2 * (TEXT_SLOTS + META_SLOTS + LENGTH_BINS))
    found = rows.select("label", "grams", "slots", "meta").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat[found["at"].to_numpy()] = found["v"].to_numpy() / 2**20
    a, b = flat[: 2 * TEXT_SLOTS].reshape(2, -1), flat[2 * TEXT_SLOTS :].reshape(2, -1)
    return a[1], a[0], b[1], b[0]


def surest(rows: DataFrame, views: tuple[View, View], choices: Choices, shares: tuple[float, float]) -> list[tuple[float, float]]:
    """For each view the log-odds up to which and from which its surest free rows lie, so many of all unlabelled rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = unpacked(*[b.column(i) for i in (0, 1, 2)])
                text, meta = choices.given(x)
                free = (text < 0) & (meta < 0)
                yield pa.RecordBatch.from_arrays([pa.array(v.odds(x)[free]) for v in views], ["a", "b"])

    pool = rows.filter("label = -1").select("grams", "slots", "meta")
    quantiles = [F.percentile_approx(c, F.array(F.lit(shares[0]), F.lit(1 - shares[1])), 10_000).alias(c) for c in ("a", "b")]
    row = pool.mapInArrow(run, "a double, b double").agg(*quantiles).first()
    # a view gives no row a label that it doubts
    return [(min(row[c][0], 0.0), max(row[c][1], 0.0)) if row[c] else (-np.inf, np.inf) for c in ("a", "b")]


def held_out_results(score: np.ndarray, y: np.ndarray, cutoff: float) -> dict:
    """Rows, area under the curve, share of good rows rejected and of bad rows rejected."""
    good, bad = score[y == 1], score[y == 0]
    if not len(good) or not len(bad):
        return {"rows": len(y)}
    order = np.sort(bad)
    area = (np.searchsorted(order, good, "left") + np.searchsorted(order, good, "right")).mean() / 2 / len(bad)
    return {"rows": len(y), "auc": float(area), "good_rejected": float((good < cutoff).mean()), "bad_rejected": float((bad < cutoff).mean())}


def tenth_of(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(10))


def labelled_views(docs: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality", **cols) -> DataFrame:
    """Both views of every row, written, with its label: 0 and 1 teach, 2 and 3 are the same in the tenths kept aside, -1 is none."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)  # else the views are shuffled to the labels
    label = F.coalesce(F.when(tenth_of(F.col("doc_id")) < 4, F.col("label") + 2).otherwise(F.col("label")), F.lit(-1))
    return materialize(with_views(docs, id_col, **cols).join(known, "doc_id", "left").select("doc_id", "grams", "slots", "meta", label.alias("label")))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality", sample: int = 10_000, rounds: int = 3, step: float = 0.05, false_reject: float = 0.005, **cols) -> CoTrained | None:
    """None where the labels don't have both classes."""
    rows = labelled_views(docs, labels, id_col, label_col, **cols)
    model = fit_views(rows, sample, rounds, step, false_reject)
    discard(rows)
    return model


def by_slices(packed: pa.Table, work) -> np.ndarray:
    """``work`` on some rows of (grams, slots, meta) at a time, so that few are unpacked together."""
    parts = [work(unpacked(*[c.combine_chunks() for c in packed.slice(lo, 500).columns])) for lo in range(0, packed.num_rows, 500)]
    return np.concatenate(parts)


def fit_views(rows: DataFrame, sample: int = 10_000, rounds: int = 3, step: float = 0.05, false_reject: float = 0.005) -> CoTrained | None:
    taught = rows.filter("label >= 0")
    taught = taught.filter(sampled(F.col("doc_id"), taught.count(), sample))
    # one row for each labelled id, about ``sample`` of them; they reach the driver
    one = taught.groupBy("doc_id").agg(F.min(F.struct("label", "grams", "slots", "meta")).alias("r")).orderBy("doc_id")
    picked = one.select(tenth_of(F.col("doc_id")).cast("int").alias("tenth"), (F.col("r.label") % 2).alias("y"), "r.grams", "r.slots", "r.meta").toArrow()
    if picked.num_rows == 0:
        return None
    fold, y = (np.array(picked.column(i).to_pylist()) for i in (0, 1))
    x = picked.select([2, 3, 4])  # stays packed
    if len(set(y.tolist())) < 2:
        return None

    def part(*tenths):
        mask = np.isin(fold, tenths)
        mask = mask if len(set(y[mask].tolist())) == 2 else np.ones(len(y), bool)
        return x.filter(pa.array(mask)), y[mask].astype(float)

    teach, aside, limit, test = part(*range(4, 10)), part(2, 3), part(1), part(0)
    good_share, choices = float(teach[1].mean()), Choices()
    for r in range(rounds + 1):
        tables = counted(rows, choices)
        views = (View(True, *tables[:2]), View(False, *tables[2:]))
        for v in views:
            v.beta = fit_dense(by_slices(teach[0], v.features), teach[1], ridge=1.0)
        if r < rounds:
            choices.rounds.append((views, surest(rows, views, choices, (step * (1 - good_share), step * good_share))))
    for v in views:
        v.scale, v.shift = fit_dense(by_slices(aside[0], v.odds)[:, None], aside[1], ridge=1e-2)
    model = CoTrained(views)
    model.join = fit_dense(by_slices(aside[0], model.odds), aside[1], ridge=1.0)
    good = np.sort(by_slices(limit[0], model.score)[limit[1] == 1])
    model.cutoff = float(min(0.5, good[int(len(good) * false_reject)]))
    model.held_out = held_out_results(by_slices(test[0], model.score), test[1], model.cutoff)
    return model


def scored(features: DataFrame, model: CoTrained | None) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of the rows of ``with_views``."""
    names = ["doc_id", "text_score", "meta_score", "score", "kept"]

    def run(batches):
        for b in batches:
            if model is None or not b.num_rows:
                one = np.ones(b.num_rows)
                views, score, kept = (one, one), one, one > 0
            else:
                x = unpacked(*[b.column(i) for i in (1, 2, 3)])
                views, score = sigmoid(model.odds(x)).T, model.score(x)
                kept = score >= model.cutoff
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v) for v in (*views, score, kept)]], names)

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.select("doc_id", "grams", "slots", "meta").mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, model: CoTrained | None, text_col="text", lang_col="lang", source_col="source", length_col="n_chars") -> DataFrame:
    """The rows of ``docs`` that the model keeps, decided where they are read; they travel as one struct, so columns of any name are safe."""
    if model is None:
        return docs
    seen = docs.select(F.struct(*docs.columns).alias("given"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(length_col).cast("long").alias("n_chars"))
    names = docs.columns

    def run(batches):
        for b in batches:
            rows = pa.RecordBatch.from_arrays(b.column(0).flatten(), names)
            if b.num_rows:
                rows = rows.filter(pa.array(model.score(unpacked(*views_of(b, 1))) >= model.cutoff))
            yield rows

    return seen.mapInArrow(run, docs.schema)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_views(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(rows, fit_views(rows))  # reads the written views, so they stay
