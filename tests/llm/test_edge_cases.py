"""Every operator and stage on nulls, empty and very long texts, repeated rows, no rows, and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orthomill.llm import media, mixing, near_dup, packing, pii, quality_model, quality_rules, substring_dedup, suffix_dedup, toxicity

random.seed(11)
VOCAB = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choice(VOCAB) for _ in range(40_000))
PASSAGE = " ".join(random.choice(VOCAB) for _ in range(120))
BASE = [random.choice(VOCAB) for _ in range(200)]
NEAR = BASE[:197] + ["other", "last", "words"]
ROWS = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", None, 4), (3, "one two", "de", "b", 7), (4, "ONE Two", "de", "b", 7), (5, LONG, "en", "a", len(LONG)),
    (6, " ".join(BASE), "en", "a", 1), (7, " ".join(NEAR), None, "a", 1), (7, " ".join(NEAR), None, "a", 1), (8, "x " * 30 + PASSAGE + " tail é😀", "en", "c", 5), (9, "head\n" + PASSAGE, "en", "c", 5),
    (10, "a" * 3000, "en", "z", 3000), (11, PASSAGE + " " + PASSAGE, "fr", "", 9), (None, "no id here " + PASSAGE, "en", "a", 3), (12, "é" * 900 + "x" + "é" * 900, "fr", "b", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["k1", "k2", "anchor", "ctx", "n", "spans", "cluster", "size", "rank", "d1", "bands", "score", "key", "range", "row", "piece", "label", "kept", "stratum", "rep", "root", "taken", "epochs", "_view_0", "_mix_copy", "_mix_epochs", "given", "copy", "part", "grams", "slots", "meta", "held", "places", "group", "hub", "first", "none", "media", "id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (8, 1, 0), (8, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


def windows_covered(sequences, length):
    seen = collections.Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    masks = []
    for s in sequences:
        mask = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return masks


def as_bag(rows):
    return collections.Counter(map(tuple, rows))


def test_substring_dedup(docs, none):
    words = [tuple((r[1] or "").encode().split()) for r in ROWS]
    want = [(r[0], len(w), int(m.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, m) if not g)).hexdigest()) for r, w, m in zip(ROWS, words, windows_covered(words, 35))]
    got = substring_dedup.remove_repeated_words(docs).select("doc_id", "n", "n_removed", "kept_sha256").collect()
    assert as_bag(got) == as_bag(want)
    assert substring_dedup.remove_repeated_words(none).count() == 0


def test_suffix_dedup(docs, none):
    data = [(r[1] or "").encode() for r in ROWS]
    masks = windows_covered(data, 400)
    runs = [int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()) for m in masks]
    want = [(r[0], len(d), int(m.sum()), n, hashlib.sha256(np.frombuffer(d, np.uint8)[~m].tobytes()).hexdigest()) for r, d, m, n in zip(ROWS, data, masks, runs)]
    got = suffix_dedup.remove_repeated_bytes(docs).select("doc_id", "n", "n_removed", "n_spans", "kept_sha256").collect()
    assert as_bag(got) == as_bag(want)
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


def test_near_duplicates(docs, none):
    sets = []
    for r in ROWS:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    parent = {r[0]: r[0] for r in ROWS if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ROWS):
        for j in range(i):
            if a[0] is not None and ROWS[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(a[0]), find(ROWS[j][0])))
                parent[y] = x
    want = [(r[0], len(s), find(r[0]) if r[0] is not None else None, r[0] is None or find(r[0]) == r[0]) for r, s in zip(ROWS, sets)]
    got = near_dup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert as_bag(got) == as_bag(want)
    assert near_dup.near_duplicates(none).count() == 0


def test_quality_rules(docs, none, labels):
    want = []
    for r in ROWS:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines, seen = 0, set()
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines += line in seen
                seen.add(line)
        want.append((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)))
    got = quality_rules.judge(docs, labels)
    assert as_bag(got.select("doc_id", *quality_rules.COUNTS, "base_failed").collect()) == as_bag(want)
    assert not got.filter("base_failed and kept").count()
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.judge(docs, labels.limit(0)).count() == len(ROWS)


def test_packing(docs, none):
    path = packing.default_tokenizer()
    want = collections.Counter()
    for r in ROWS:
        ids = packing.token_ids(r[1], path)
        for k, (start, length) in enumerate(packing.pieces(len(ids), 2048)):
            want[(r[0], k, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
    rows = packing.pack(docs).collect()
    assert as_bag([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_personal_data(docs, none):
    got = pii.personal_data(docs).collect()
    assert len(got) == len(ROWS) and all(r.spans == "" for r in got)
    assert pii.personal_data(none).count() == 0
    same = pii.mask_documents(docs)
    assert same.columns == docs.columns and as_bag(r[:2] for r in same.collect()) == as_bag(r[:2] for r in ROWS)


def test_mixing(docs, none):
    sizes = [(r[0], len((r[1] or "").split())) for r in ROWS]
    got = mixing.mix_sources(docs)
    rows = got.collect()
    assert as_bag((r.doc_id, r.size) for r in rows) == as_bag(sizes) and all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    total = sum({r.source: r.target for r in rows}.values())
    assert total == pytest.approx(1.5 * sum(s for _, s in sizes))
    assert as_bag(rows) == as_bag(mixing.mix_sources(docs.repartition(5)).collect())
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixed_rows(none).count() == 0


def test_gif(docs, none):
    got = {(r.doc_id, r.n_bytes): r for r in media.stored_texts(docs).collect()}
    for r in ROWS:
        data = (r[1] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        row = got[(r[0], len(data))]
        assert (row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.stored_texts(docs).count() == len(ROWS) and media.stored_texts(none).count() == 0


def test_toxicity(docs, none, labels):
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0


def test_quality_model(docs, none, labels):
    model = quality_model.fit(docs, labels)
    views = quality_model.with_views(docs)
    assert model is not None and quality_model.scored(views, model).count() == len(ROWS) and quality_model.fit(none, labels) is None
    assert quality_model.scored(quality_model.with_views(none), model).count() == 0
    scores = {(r.doc_id, round(r.score, 9)) for r in quality_model.scored(views, model).collect() if r.doc_id == 7}
    assert len(scores) == 1  # equal rows score alike
    kept = quality_model.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality_model.scored(views, model).filter("kept").count()
    assert quality_model.keep_good(docs, None).count() == len(ROWS)


def test_pipeline_on_edge_cases(spark, docs, none, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "pii", "mixing", "packing"]
    for given, least in ((docs, 3), (none, 0)):
        now = given
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, sf)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert now.columns == given.columns
                now = corpus_pipeline.materialize(now)
                assert now.count() >= least
                if least:
                    assert {v for c in CLASHES for r in now.select(c).distinct().collect() for v in r} == {"clash"}
        assert (now.count() > 0) == bool(least)
