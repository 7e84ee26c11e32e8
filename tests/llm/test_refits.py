"""The co-trained classifier refitted in plain Python, labels that disagree, and repeated rows of the substring operators."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.llm import quality_model, quality_rules, repeats, substring_dedup, suffix_dedup

SIZE = 1 << quality_model.GRAM_BITS


def plain_grams(text):
    """Share of each bucket of byte trigrams."""
    data = (text or "").encode()
    at = collections.Counter((((a * 0x01000193 + b) * 0x01000193 + c) * 0x9E3779B1 % 2**32) >> 32 - quality_model.GRAM_BITS for a, b, c in zip(data, data[1:], data[2:]))
    most = max(at.values(), default=1)
    count = {g: -(-n * 255 // most) for g, n in at.items()}
    total = sum(count.values())
    return {g: n / total for g, n in count.items()}


def logistic(rows, y, ridge):
    """Newton's method with halved steps, the intercept last and hardly shrunk."""
    x, y = np.column_stack([np.array(rows, float), np.ones(len(rows))]), np.array(y, float)
    shrink = np.array([ridge] * (x.shape[1] - 1) + [1e-3])
    worth = lambda b: np.logaddexp(0, x @ b).sum() - y @ x @ b + (shrink * b * b).sum() / 2
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ beta)))
        way = np.linalg.solve((x * (p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * beta)
        size = 1.0
        while size > 1e-6 and worth(beta + size * way) > worth(beta):
            size /= 2
        beta = beta + size * way
    return beta


def plain_model(docs, labels, rounds, step, false_reject):
    """Scores by id and the cutoff, from rows (doc_id, text, lang, source, n_chars) and labels by id."""
    gram = [plain_grams(r[1]) for r in docs]
    slot = [quality_model.text_view(r[1])[1] for r in docs]
    meta = [quality_model.meta_view(*r[2:]) for r in docs]
    tenth = [zlib.crc32(str(r[0]).encode()) % 10 for r in docs]
    label = [labels.get(r[0]) for r in docs]
    some = [i for i, y in enumerate(label) if y is not None]

    def part(*of):
        mine = [i for i in some if tenth[i] in of]
        return mine if len({label[i] for i in mine}) == 2 else some

    teach, aside, limit = part(4, 5, 6, 7, 8, 9), part(2, 3), part(1)
    share = np.mean([label[i] for i in teach])
    given = {"text": {}, "meta": {}}

    def ratios(which):
        sums = [collections.Counter(), collections.Counter()]
        for i in range(len(docs)):
            y = label[i] if label[i] is not None and tenth[i] >= 4 else given[which].get(i) if label[i] is None else None
            if y is None:
                continue
            for at in slot[i] if which == "text" else meta[i]:
                sums[y][at] += 1
            for g, s in gram[i].items() if which == "text" else ():
                sums[y][g] += s
        first = SIZE if which == "text" else 0
        last = quality_model.TEXT_SLOTS if which == "text" else quality_model.META_SLOTS + quality_model.LENGTH_BINS
        log = {}
        for lo, hi in ((0, first), (first, last)):
            total = [sum(v for k, v in s.items() if lo <= k < hi) + 0.5 * (hi - lo) for s in sums]
            log[lo] = lambda at, total=total: math.log((sums[1][at] + 0.5) / total[1]) - math.log((sums[0][at] + 0.5) / total[0])
        if which == "meta":
            return [[log[0](at) for at in m] for m in meta]
        return [[quality_model.GRAM_WEIGHT * sum(s * log[0](g) for g, s in gr.items()), *[log[SIZE](at) for at in sl]] for gr, sl in zip(gram, slot)]

    odds = {}
    for r in range(rounds + 1):
        for which in ("text", "meta"):
            x = ratios(which)
            beta = logistic([x[i] for i in teach], [label[i] for i in teach], 1.0)
            odds[which] = np.array(x) @ beta[:-1] + beta[-1]
        if r == rounds:
            break
        free = [i for i, y in enumerate(label) if y is None and i not in given["text"] and i not in given["meta"]]
        chosen = {}
        for which, other in (("text", "meta"), ("meta", "text")):
            ranked = sorted(odds[which][i] for i in free)
            low, high = (ranked[max(0, math.ceil(p * len(ranked)) - 1)] for p in (step * (1 - share), 1 - step * share))
            chosen[other] = {i: int(odds[which][i] >= max(high, 0)) for i in free if odds[which][i] >= max(high, 0) or odds[which][i] <= min(low, 0)}
        for i in set(chosen["text"]) | set(chosen["meta"]):
            a, b = chosen["text"].get(i), chosen["meta"].get(i)
            if a is None or b is None or a == b:
                for which in ("text", "meta"):
                    if i in chosen[which]:
                        given[which][i] = chosen[which][i]
    y = [label[i] for i in aside]
    both = []
    for which in ("text", "meta"):
        scale, shift = logistic(odds[which][aside][:, None], y, 1e-2)
        both.append(scale * odds[which] + shift)
    both = np.column_stack(both)
    join = logistic(both[aside], y, 1.0)
    score = 1 / (1 + np.exp(-(both @ join[:-1] + join[-1])))
    good = sorted(score[i] for i in limit if label[i] == 1)
    return {r[0]: s for r, s in zip(docs, score)}, min(0.5, good[int(len(good) * false_reject)]), given


def test_quality_model_is_that_of_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").unionByName(spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None}
    want, cutoff, given = plain_model(rows, known, 2, 0.1, 0.005)
    views = quality_model.labelled_views(docs, labels)
    model = quality_model.fit_views(views, rounds=2, step=0.1)
    got = {r.doc_id: r for r in quality_model.scored(views, model).collect()}
    assert len(given["text"]) > 10 and len(given["meta"]) > 10
    assert all(got[i].score == pytest.approx(s, abs=2e-4) for i, s in want.items()) and model.cutoff == pytest.approx(cutoff, abs=2e-4)
    assert all(got[i].kept == (s >= cutoff) for i, s in want.items() if abs(s - cutoff) > 1e-3)


def test_packed_grams_come_back():
    rng = np.random.default_rng(8)
    for at in ([], [0], [SIZE - 1], [0, SIZE - 1], np.unique(rng.integers(0, SIZE, 900))):
        at = np.array(at, np.int64)
        counts = rng.integers(1, 256, len(at))
        packed = quality_model.Grams.pack(at, counts) if len(at) else b""
        grams = quality_model.Grams.unpack([b"", packed, packed])
        assert grams.size.tolist() == [0, len(at), len(at)] and grams.at.tolist() == [*at, *at] and np.allclose(grams.share[: len(at)] * counts.sum(), counts)
        ratio = rng.standard_normal(SIZE)
        assert np.allclose(grams @ ratio, [0, (ratio[at] * counts).sum() / max(1, counts.sum())] + [(ratio[at] * counts).sum() / max(1, counts.sum())])


def test_labels_that_disagree_are_decided_by_a_rule(spark):
    labels = [(i, y) for i in range(60) for y in (i % 2, 1 if i < 10 else i % 2)]
    docs = spark.createDataFrame([(i, ("good text number " if i % 2 else "### $$$ ") * 20 + str(i), "en", "a", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for order in (labels, labels[::-1]):
        rows = quality_model.labelled_views(docs, spark.createDataFrame(order, "doc_id long, quality int").repartition(3)).collect()
        assert len(rows) == 60 and all(r.label % 2 == (1 if r.doc_id < 10 else r.doc_id % 2) for r in rows)


def test_a_repeated_document_counts_once_in_the_holdout(spark):
    docs = [(i, ("fine words " if i % 4 else "### $$$ && ") * 40 + str(i), "en") for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(800)], "doc_id long, quality int")
    cutoffs = []
    for rows in (docs, docs + docs[:300] * 3):
        measured = quality_rules.text_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        cutoffs.append(sorted(map(str, quality_rules.calibrate(measured, labels).collect())))
    assert cutoffs[0] == cutoffs[1] and "0." in cutoffs[0][0]


@pytest.mark.parametrize("unit,length,k", [("word", 35, 6), ("byte", 400, 24)])
def test_spans_of_repeated_rows_are_listed_once(spark, unit, length, k):
    text = " ".join(f"w{i * i % 977}" for i in range(400))
    sizes = []
    for r in (2, 60):
        docs = spark.createDataFrame([(i % 3, text) for i in range(r)], "doc_id long, text string").repartition(3)
        orders = suffix_dedup.suffix_order if unit == "byte" else repeats.sorted_order
        got = repeats.covered_documents(docs, unit, length, k, orders=orders).select(F.size("spans").alias("n")).collect()
        assert len(got) == r
        sizes.append({row.n for row in got})
        run = substring_dedup.remove_repeated_words if unit == "word" else suffix_dedup.remove_repeated_bytes
        assert all(row.n == row.n_removed > 0 for row in run(docs).collect())
    assert sizes[0] == sizes[1] and len(sizes[0]) == 1
