"""Cases in which an operator or stage once did less than its whole job."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from orthomill.llm import common, mixing, near_dup, packing, pii, quality_model, toxicity
from orthomill.sources import tables
from test_methods import plain_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_links_from_similarity_080(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [words[:-m] + [f"{m}x{i}" for i in range(m)] if m else words for m in (0, 20, 40)]
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in texts]
    similarity = lambda a, b: len(a & b) / len(a | b)
    assert 0.80 < similarity(sets[0], sets[1]) < 0.85 and all(similarity(s, sets[2]) < 0.80 for s in sets[:2])
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [0, 2]


def test_rows_with_repeated_and_null_ids_are_mixed_one_by_one(spark):
    ids = [None] * 12 + [7] * 12 + list(range(100, 112))
    rows = [(i, " ".join(f"r{n}w{w}" for w in range(5 + n % 9)), "en", "abc"[n % 3], n) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    budget, words, of_row = {}, collections.Counter(), collections.Counter()
    for r in mixing.mix_sources(docs).select("source", "target").distinct().collect():
        budget[r.source] = round(r.target)
    for r in mixing.mixed_rows(docs).collect():
        words[r.source] += len(r.text.split())
        of_row[r.text.split("w")[0], r.source] += len(r.text.split())
    assert words == budget
    assert all(of_row[f"r{n}", s] <= 2 * len(text.split()) for n, (_, text, _, s, _) in enumerate(rows))


@pytest.mark.parametrize("hidden", ["bob{@}example.com", "bob<@>example.com", "bob [ @ ] example.com", "bob { at } example.com", "bob < at > example.com", "bob [\tat\t] example.com", "bob(\t@ )example.com", "10{.}0{.}0{.}1", "10[ . ]0[ . ]0[ . ]1",
                                    "five five five oh oh five five oh five five", "john @ example.com", "john @ mail.example.com", "john @ mail.example dot com"])
def test_disguises_pass_the_gate(hidden):
    text = f"write: {hidden}, now"
    assert [text[a:b] for a, _, b in pii.find_spans(text)[1]] == [hidden]


SIGNS = [*"ab1.-+,é[](){}<>@\t \n", " ", " ", "at", "AT", "dot", "Dot", " at ", " @ ", " dot ", "com", "one", "oh", "Six", "fİve", "ſeven", "а", "１", "\u200b"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join))
def test_gate_is_open_whenever_a_text_changes(text):
    patterns = (pii.ODD, pii.BRACKET_AT, pii.BRACKET_DOT, pii.SPACED, pii.SPELLED_RUN)
    assert pii.disguised(text) == any(p.search(text) for p in patterns)
    assert pii.disguised(text) or pii.normalise(text).text == text


def test_disguises_around_base_spans_are_added():
    cases = {"john (dot) smith@example.com": "smith@example.com", "bob@mail.example [dot] com": "bob@mail.example", "4111 1111 1111 1111 (at) shop.example": "4111 1111 1111 1111"}
    for text, inner in cases.items():
        base, spans = pii.find_spans(f"to {text}.")
        assert inner in [text[a - 3 : b - 3] for a, _, b in base] and set(base) < set(spans)
    assert pii.masked("to john (dot) smith@example.com, bob@mail.example [dot] com, a@b.co, 4111 1111 1111 1111 (at) shop.example.") == "to [EMAIL], [EMAIL], [EMAIL], [CARD]."
    assert pii.find_spans("x@exаmple.com y@b.co")[1] == [(0, 0, 13), (14, 0, 20)]


DISGUISED = [
    "mail ann@site.org or bob [at] mail dot example dot com today", "10.0.0.1 and 10{.}0{.}0{.}2, 300.1.1.1", "card 4111 1111 1111 1111, +1 (555) 010-9999", "call five five five one two three four five six seven",
    "x аnna@exаmple.com, a.b@c", "1.2.3.4.5 4111111111111112 @ nobody a@b", "", None, "john @ mail.example dot com",
]


def test_query_on_personal_data_equals_plain_regexes(spark):
    """Base columns by the contract's expressions; added spans are the disguised ones, and only those."""
    rows = [(i, t) for i, t in enumerate(DISGUISED)]
    for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = DISGUISED[r.doc_id] or ""
        want = plain_spans(text)
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(named) <= set(spans) and len(spans) == len(named) + r.n_added
    hidden = {0: ("email", "bob [at] mail dot example dot com"), 1: ("ip", "10{.}0{.}0{.}2"), 3: ("phone", DISGUISED[3][5:]), 4: ("email", "аnna@exаmple.com"), 8: ("email", DISGUISED[8])}
    hidden = {i: f"{kind}:{DISGUISED[i].index(t)}:{DISGUISED[i].index(t) + len(t)}" for i, (kind, t) in hidden.items()}
    got = {r.doc_id: r.spans.split(",") for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_added}
    assert got.keys() == hidden.keys() and all(hidden[i] in s for i, s in got.items())


def test_equal_rows_under_one_id_are_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(7, text), (7, text), (None, text), (3, text + " more"), (7, "another " * 9), (None, None), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert got == collections.Counter([(3, text + " more"), (7, "another " * 9), (None, None), (None, None), (9, "")])


@pytest.fixture(scope="module")
def small_corpus(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet")
    return docs, docs.toPandas()


def test_pipeline_equals_its_stages_in_plain_python(spark, sf, small_corpus):
    """Every stage on its own input, and the whole: which rows stay, what their texts are, and where their pieces go."""
    docs, _ = small_corpus
    model = quality_model.fit(docs, spark.read.parquet(sf + "/labels.parquet"))
    now = corpus_pipeline.materialize(corpus_pipeline.good_quality(spark, docs, sf))
    rows = docs.collect()
    good = [r for r in rows if model.score(quality_model.unpacked(*quality_model.views_of(one_row(r), 0)))[0] >= model.cutoff]
    assert bag(now) == collections.Counter(map(tuple, good)) and 0.5 * len(rows) < len(good) < len(rows)

    sets = {}
    for i, r in enumerate(good):
        w = (r.text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = list(range(len(good)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, r in enumerate(good):
        first[find(i)] = min(first.get(find(i), r.doc_id), r.doc_id)
    single = [r for i, r in enumerate(good) if first[find(i)] == r.doc_id]
    now = corpus_pipeline.materialize(corpus_pipeline.one_of_each(spark, now, sf))
    assert bag(now) == collections.Counter(map(tuple, single)) and len(single) < len(good)

    masked = [tuple({**r.asDict(), "text": pii.masked(r.text), "n_chars": len(pii.masked(r.text))}.values()) for r in single]
    now = corpus_pipeline.materialize(corpus_pipeline.without_personal_data(spark, now, sf))
    assert bag(now) == collections.Counter(masked) and any("[EMAIL]" in r[1] for r in masked)

    taken = {r.doc_id: r for r in mixing.mix_sources(now).collect()}
    budget = {r.source: round(r.target) for r in taken.values()}
    mixed = corpus_pipeline.materialize(corpus_pipeline.to_weights(spark, now, sf))
    words, texts = collections.Counter(), {r[0]: r[1] for r in masked}
    copies = collections.defaultdict(list)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        copies[r.doc_id].append(r.text)
    assert words == budget
    for i, got in copies.items():
        assert sum(len(t.split()) for t in got) == taken[i].taken and sum(t != texts[i] for t in got) <= 1
        assert all(texts[i].split()[: len(t.split())] == t.split() for t in got)

    want = collections.Counter()
    for r in mixed.collect():
        ids = packing.token_ids(r.text, packing.default_tokenizer())
        want.update((r.doc_id, start, zlib.crc32(ids[start : start + length].tobytes())) for start, length in packing.pieces(len(ids), 2048))
    packed = corpus_pipeline.packed(spark, mixed, sf).collect()
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in packed) == want
    ends = collections.defaultdict(list)
    for r in packed:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    assert all(a == b for s in ends.values() for (_, a), (b, _) in zip(sorted(s), sorted(s)[1:])) and max(e for s in ends.values() for _, e in s) <= 2048


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def one_row(r):
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((r.text, pa.string()), (r.lang, pa.string()), (r.source, pa.string()), (r.n_chars, pa.int64()))], ["text", "lang", "source", "n_chars"])


def test_toxicity_equals_a_plain_refit(spark):
    """Counts, log-count ratios and the fit once more, one gram and one step at a time."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(60):
        toxic = i % 3 == 0
        rows.append((i, " ".join(rng.choice(["vile", "nasty", "grr"] if toxic and rng.random() < 0.5 else ["calm", "kind", "tea", "sun"]) for _ in range(8))))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, known)).collect()}

    def grams(text):
        data = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
        out = set()
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                h = data[i]
                for c in data[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) % 2**32
                out.add((h ^ n) * 0x9E3779B1 % 2**32 >> 14)
        return out

    train = sorted(((y, grams(t)) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5), key=lambda x: (x[0], sorted(x[1])))
    n, n1 = len(train), sum(y for y, _ in train)
    counts = {y: collections.Counter(g for k, gs in train if k == y for g in gs) for y in (0, 1)}
    ratio = {}
    for g in counts[0] | counts[1]:
        a, b, p = counts[1][g] / n1, counts[0][g] / (n - n1), (counts[1][g] + counts[0][g]) / n
        if counts[1][g] + counts[0][g] >= 3 and abs(a - b) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / (n - n1))) >= 3:
            ratio[g] = (counts[1][g] + 1, counts[0][g] + 1)
    sums = [sum(x) for x in zip(*ratio.values())]
    scale = {g: math.log(a / sums[0] / (b / sums[1])) for g, (a, b) in ratio.items()}
    w, bias = dict.fromkeys(scale, 0.0), math.log((n1 + 1) / (n + 2) / (1 - (n1 + 1) / (n + 2)))
    m, v = collections.Counter(), collections.Counter()
    train = [(y, gs & scale.keys()) for y, gs in train]
    for t in range(1, 301):
        grad = {g: 0.3 * w[g] for g in w} | {"bias": 0.0}
        for y, gs in train:
            error = (2.0 if y else 1.0) * (1 / (1 + math.exp(-sum(w[g] * scale[g] for g in gs) - bias)) - y)
            grad["bias"] += error
            for g in gs:
                grad[g] += error * scale[g]
        for g, d in grad.items():
            d /= n
            m[g], v[g] = 0.9 * m[g] + 0.1 * d, 0.999 * v[g] + 0.001 * d * d
            step = 0.05 * m[g] / (1 - 0.9**t) / (math.sqrt(v[g] / (1 - 0.999**t)) + 1e-8)
            if g == "bias":
                bias -= step
            else:
                w[g] -= step
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(w[g] * scale[g] for g in grams(t) & scale.keys()) - bias)), abs=1e-5)
    assert len(scale) > 10 and all((got[i] >= 0.5) == y for i, y in labels)


def test_quality_model_counts_and_held_out_rows(spark, small_corpus):
    """Tables of the first round against plain counts; results on labels that took no part."""
    docs, _ = small_corpus
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality_model.labelled_views(docs, labels)
    given = {r.doc_id: r.quality for r in labels.collect()}
    good = collections.Counter()
    for r in docs.collect():
        if r.doc_id in given and zlib.crc32(str(r.doc_id).encode()) % 10 >= 4 and given[r.doc_id] == 1:
            data = r.text.encode()
            at = [(((a * 0x01000193 + b) * 0x01000193 + c) * 0x9E3779B1 % 2**32) >> 32 - quality_model.GRAM_BITS for a, b, c in zip(data, data[1:], data[2:])]
            shares = {g: -(-n * 255 // max(collections.Counter(at).values())) for g, n in collections.Counter(at).items()}
            for g, n in shares.items():
                good[g] += n / sum(shares.values())
    table = quality_model.counted(rows, quality_model.Choices())[0]
    assert sum(good.values()) > 10 and all(table[g] == pytest.approx(good[g], abs=1e-3) for g in range(1 << quality_model.GRAM_BITS))
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_model.fit(big, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.held_out["rows"] > 20 and model.held_out["auc"] > 0.9 and model.held_out["good_rejected"] <= 0.1


class Stub:
    def __init__(self, odds):
        self.fixed = np.array(odds)

    def odds(self, x):
        return self.fixed


def test_views_that_disagree_give_nothing():
    choices, rows = quality_model.Choices(), [np.zeros(4)] * 3
    choices.rounds.append(((Stub([5, 5, 0, -5]), Stub([-5, 5, 5, 0])), [(-1, 1), (-1, 1)]))
    text, meta = choices.given(rows)
    assert text.tolist() == [-1, 1, 1, -1] and meta.tolist() == [-1, 1, -1, 0]
    choices.rounds.append(((Stub([5, -5, -5, 5]), Stub([0, -5, -5, 5])), [(-1, 1), (-1, 1)]))
    assert [x.tolist() for x in choices.given(rows)] == [[-1, 1, 1, -1], [1, 1, -1, 0]]  # a first label stays


def test_hot_buckets_and_blank_texts(spark):
    """Many near copies of one text, many blank rows and one odd one."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:99] + [f"x{i}"])) for i in range(150)] + [(1000 + i, "") for i in range(150)] + [(2000, "quite another text of six words")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(150)) and all(got[1000 + i] == 1000 + i for i in range(150)) and got[2000] == 2000


def test_samples_are_bounded_and_the_same_again(spark):
    few, many = (spark.range(n).filter(common.sampled(F.col("id"), n, 1000)) for n in (900, 40_000))
    assert few.count() == 900 and 850 < many.count() < 1150
    assert sorted(r.id for r in many.collect()) == sorted(r.id for r in spark.range(40_000).repartition(7).filter(common.sampled(F.col("id"), 40_000, 1000)).collect())


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "none"

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_folder(Session)


def test_written_tables_go_when_discarded(spark):
    kept, gone = common.materialize(spark.range(5)), common.materialize(spark.range(5))
    path = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    common.discard(gone)
    assert not os.path.exists(path) and kept.count() == 5
    common.discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))  # not one of materialize()
    assert os.path.exists("/root/testdata/sf0.001/region.parquet")


def test_pipeline_hands_texts_to_python_in_small_batches(spark):
    """A task's texts once reached Python in one batch, and executors ran out of their memory."""

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    def seen(session, words):
        text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" lorem ipsum"), words))
        docs = session.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.length(text).cast("long").alias("n_chars"))
        corpus_pipeline.without_personal_data(session, docs, "")
        rows = docs.mapInArrow(measured, "n long, size long").collect()
        assert sum(r.n for r in rows) == 3000
        return max(r.n for r in rows), max(r["size"] for r in rows)

    assert seen(spark.newSession(), 1)[0] <= 1024
    assert seen(spark.newSession(), 700)[1] < 5_000_000  # 25 MB in all
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    assert seen(own, 1)[0] == 50
