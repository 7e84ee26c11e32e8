"""Hard negatives, the n-gram join, vector codes and links by hubs, against brute force and on edge cases."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.llm import hard_negatives, linking, near_dup, ngram_join, queries, vector_codes
from orthomill.llm.shingles import set_digests
from orthomill.llm.vectors import integer_vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n, dims=32, seed=1):
    """Random rows, a very common vector, repeated rows and ids, null and non-finite components, null labels, ids and vectors."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, dims).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    hot = rng.normal(0, 0.3, dims).astype(np.float32).tolist()
    rows += [(10_000 + i, hot, i % 3) for i in range(n // 3)]
    rows += [rows[3], rows[100], rows[100], (100, rows[5][1], 2), (200, hot, 1), (None, hot, 0), (None, rows[7][1], 2)]
    rows += [(300, None, 1), (301, [None] + [0.5] * (dims - 1), 1), (302, [math.nan] + [0.5] * (dims - 1), 1), (303, [math.inf] + [0.5] * (dims - 1), 2), (304, rows[0][1], None), (305, [0.0] * dims, 1), (306, [-0.001] * dims, 1), (400, rows[9][1], None)]
    return rows


def kept(rows):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v], np.int64), label) for i, v, label in good]


def plain_hard_negatives(rows):
    use = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in kept(rows) if label is not None]
    order = lambda r: (-r[0], r[1] is None, r[1])
    out = []
    for at, (i, v, label) in enumerate(use):
        if i is None or i % 100:
            continue
        scores = [(int(v @ w), j, other) for k, (j, w, other) in enumerate(use) if k != at]
        for ps, positive, _ in sorted([s for s in scores if s[2] == label], key=order)[:5]:
            window = sorted([s for s in scores if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps], key=order)[:5]
            out += [(i, positive, rank, j, ps, s) for rank, (s, j, _) in enumerate(window, 1)]
    return out


def as_bag(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("block", [8192, 60])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vector_rows(330)
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("row", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("slot", F.lit(2))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(integer_vectors(df).withColumn("label", label), F.col("vec_id") % 100 == 0).collect()
    want = plain_hard_negatives(rows)
    assert len(want) > 50 and as_bag(got) == as_bag(want)


def test_hard_negatives_of_few_and_no_rows(spark):
    anchors = F.col("vec_id") % 100 == 0
    none = hard_negatives.hard_negatives(integer_vectors(spark.createDataFrame([], VECTORS)), anchors)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, [-1.0, 0.0], 2)]
    got = [tuple(r) for r in hard_negatives.hard_negatives(integer_vectors(spark.createDataFrame(few, VECTORS)), anchors).collect()]
    assert got == [(0, 1, 1, 2, 256 * 256, 256 * 230)]


@pytest.mark.parametrize("seed", range(4))
def test_threshold_join_is_exact(seed):
    rng = np.random.default_rng(seed)
    q, x = rng.integers(-300, 300, (40, 21)), rng.integers(-300, 300, (500, 21))
    x[:, 10:] //= 1 + 40 * (seed % 2)  # little energy in the tails, so that the index omits them
    full = q @ x.T
    least = np.quantile(full, [0.99, 0.5, 0.0, 0.999], axis=1)[seed].astype(np.int64)
    least[:3] = hard_negatives.LOW
    a, b, score = hard_negatives.joined(q, x, least, lambda s, t: (s + t) % 3 > 0)
    want = {(i, j): full[i, j] for i, j in zip(*np.nonzero(full >= least[:, None])) if (i + j) % 3}
    assert dict(zip(zip(a.tolist(), b.tolist()), score.tolist())) == want and len(a) == len(want)


def plain_codes(rows, parts, entries, rounds):
    use = sorted(kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([r[1] for r in use]).reshape(len(use), parts, -1)
    books = [[x[e, j] for e in range(min(entries, len(use)))] for j in range(parts)]
    assign = lambda: [[min(range(len(books[j])), key=lambda e: (int(((v[j] - books[j][e]) ** 2).sum()), e)) for j in range(parts)] for v in x]
    for _ in range(rounds):
        at = assign()
        for j in range(parts):
            for e in range(len(books[j])):
                mine = [v[j] for v, a in zip(x, at) if a[j] == e]
                if mine:
                    books[j][e] = np.array([int(c) // len(mine) for c in np.sum(mine, axis=0)])
    at = assign()
    error = [sum(int(((v[j] - books[j][a[j]]) ** 2).sum()) for j in range(parts)) for v, a in zip(x, at)]
    of_label = collections.Counter()
    for r, e in zip(use, error):
        of_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for j in range(parts) for b in books[j] for c in b).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for e in a), e, of_label[r[2]], digest) for r, a, e in zip(use, at, error)]


@pytest.mark.parametrize("n", [150, 9])
def test_vector_codes(spark, n):
    rows = vector_rows(120, seed=4) if n > 100 else vector_rows(120, seed=4)[3:12]
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("near", F.lit("clash")).withColumn("of", F.lit(1)).withColumn("error", F.lit(2))
    got = vector_codes.vector_codes(integer_vectors(df), 8, 16, 2).collect()
    assert as_bag(got) == as_bag(plain_codes(rows, 8, 16, 2))


def test_vector_codes_of_no_rows(spark):
    none = vector_codes.vector_codes(integer_vectors(spark.createDataFrame([], VECTORS)))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.vector_codes(integer_vectors(spark.createDataFrame([(1, None, 2), (2, [math.nan] * 16, 1)], VECTORS))).count() == 0
    mixed = spark.createDataFrame([(1, [0.5] * 16, 2), (2, [0.25] * 16, None), (3, [0.25] * 32, 1)], VECTORS)
    assert sorted(r.vec_id for r in vector_codes.vector_codes(integer_vectors(mixed)).collect()) == [1, 2]


def test_nearest_entries_by_pivots():
    rng = np.random.default_rng(2)
    entries = rng.integers(-60, 60, (64, 4))
    entries[40] = entries[3]
    x = np.concatenate([entries[rng.integers(0, 64, 800)] + rng.integers(-4, 5, (800, 4)), rng.integers(-200, 200, (200, 4))])
    pivots = vector_codes.far_apart(entries, 4)
    moved_entries = entries + rng.integers(-5, 6, entries.shape)
    moved_entries[40] = moved_entries[3]
    at, best, taken = vector_codes.nearest(x, vector_codes.distances(x, pivots), moved_entries, vector_codes.distances(moved_entries, pivots))
    full = ((x[:, None] - moved_entries[None]) ** 2).sum(axis=2)
    assert (best == full.min(axis=1)).all() and (at == full.argmin(axis=1)).all() and taken < full.size / 5


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(rows, percent):
    """Components of rows; equal ids are rows of their own."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(name, len(s), least[find(i)] if name is not None else None) for i, ((name, _), s) in enumerate(zip(rows, sets))]


def near_texts(n, seed):
    """Families of near copies around 0.8, common passages, short, blank and repeated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(n // 10):
        base = rng.choices(words, k=rng.randrange(5, 160))
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 40) + 1)):
                t[rng.randrange(len(t))] = f"x{rng.random()}"
            texts.append(t + rng.choices(words, k=rng.randrange(0, 12)))
        texts.append(base[:20] + passage + base[20:40])
        texts.append(passage + rng.choices(words, k=rng.randrange(0, 30)))
    texts += [["only", "Three", "words"], ["ONLY", "three", "words"], [], ["a"], ["a", "b", "c", "d", "e"], ["A", "b", "c", "d", "E"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (3, rows[9][1]), (None, rows[0][1]), (None, None), (7000, None), (7001, " \t\n"), (7002, " ".join(rng.choices(words, k=30_000)))]


@pytest.mark.parametrize("percent", [80, 60])
def test_ngram_join(spark, percent):
    rows = near_texts(120, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("k", "c", "n", "key", "pos", "rep", "seat", "d40", "comp", "root", "node", "gram", "some"):
        df = df.withColumn(c, F.lit("clash"))
    got = ngram_join.jaccard_join(df, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    want = plain_components(rows, percent)
    assert as_bag(got) == as_bag(want) and len({w[2] for w in want}) < 100


def test_ngram_join_of_no_rows_and_of_names(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(f"id{i}", t) for i, (_, t) in enumerate(near_texts(40, 3))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert as_bag(ngram_join.jaccard_join(df).drop("kept").collect()) == as_bag(plain_components(rows, 80))
    assert as_bag(near_dup.near_duplicates(df).drop("kept").collect()) == as_bag(plain_components(rows, 85))


def test_sets_that_can_link_stay():
    """Chunk by chunk, every set that has a partner reaches what is asked of it."""
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**62, 80)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[: len(b) - d], rng.integers(0, 2**62, d)])) for b in base for d in (0, 3, 8)] + [np.unique(rng.integers(0, 2**62, 80)) for _ in range(40)]
    digests = np.array([set_digests(s.astype(np.uint64), np.array([len(s)]))[0][0] for s in sets])
    total, seats = collections.Counter(), collections.defaultdict(set)
    chunks = []
    for chunk, mine in enumerate(np.array_split(rng.permutation(len(sets)), 4)):
        some = [np.sort(sets[i][sets[i] % 10 < 3] >> 16) for i in mine]
        chunks.append(ngram_join.folded_chunk(np.concatenate(some), np.repeat(np.arange(len(mine)), [len(s) for s in some]), np.array([len(sets[i]) for i in mine]), digests[mine], 80, chunk))
    for gram, seat, _ in chunks:
        for g, s in zip(gram.tolist(), seat.tolist()):
            seats[g].add(s >> 8)
    for gram, seat, w in chunks:
        for g, s, x in zip(gram.tolist(), seat.tolist(), w.tolist()):
            total[s >> 8] += x if g < 0 or (x and len(seats[g]) > 1) else 0
    stays = {i for i, d in enumerate(digests) if total[int(d.view(np.uint64) >> np.uint64(24))] >= 0}
    linked = {i for i, a in enumerate(sets) for b in sets if a is not b and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    assert linked <= stays and len(linked) >= 24 and len(stays) < len(sets) - 20


@pytest.mark.parametrize("shape", ["star", "chain"])
def test_pairs_compared_grow_with_the_rows(spark, monkeypatch, shape):
    compared = []
    decided = linking.verified

    def counting(pairs, sets, percent):
        compared[-1] += pairs.count()
        return decided(pairs, sets, percent)

    monkeypatch.setattr(linking, "verified", counting)
    base = [f"b{i}" for i in range(100)]
    for n in (100, 400):
        if shape == "star":
            rows = [(i, " ".join([*base, f"s{i}"])) for i in range(n)]
        else:
            rows = [(i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for run in (near_dup.near_duplicates, ngram_join.jaccard_join):
            compared.append(0)
            assert {r.component_id for r in run(df).collect()} == {0}
    # a hub for each row of a star, and at most the 25 rows that share a shingle with it for each row of a chain
    per_row = 3 if shape == "star" else 25
    assert all(pairs <= per_row * n for pairs, n in zip(compared, (100, 100, 400, 400)))


def test_contract_queries(spark, sf):
    """The registered queries on a small table against brute force."""
    vectors = [tuple(r) for r in spark.read.parquet(sf + "/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert as_bag(queries.QUERIES["op11_hard_negatives"](spark, sf).collect()) == as_bag(plain_hard_negatives(vectors))
    assert as_bag(queries.QUERIES["op13_vector_codes"](spark, sf).collect()) == as_bag(plain_codes(vectors, 16, 64, 2))
    docs = [tuple(r) for r in spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text").collect()]
    assert as_bag(queries.QUERIES["op12_ngram_join"](spark, sf).collect()) == as_bag(plain_components(docs, 80))


def test_a_pair_is_made_in_one_bucket_of_a_hub(spark):
    """Two sets that share many buckets give one pair, for a hub that has all of these buckets or only some."""
    sets = {1: [10, 11, 12, 13], 2: [10, 11, 12, 14], 3: [11, 12, 15], 4: [16]}
    counts = [1] * linking.COARSE
    rows = [(k, c, c, 16, counts, list(keys)) for c, keys in sets.items() for k in keys]
    ranges = [F.get("ranges", F.lit(i)).alias(f"r{i}") for i in range(linking.COARSE)]
    members = spark.createDataFrame(rows, "key long, c long, comp long, n int, ranges array<int>, keys array<long>").select("*", *ranges)
    for chosen in ({1: [10, 11, 12, 13]}, {1: [12, 13]}, {1: [10], 3: [11, 12]}):
        hubs = members.filter(" or ".join(f"c = {c} and key in ({', '.join(map(str, k))})" for c, k in chosen.items()))
        once = hubs.drop("keys").join(hubs.groupBy("c").agg(F.collect_set("key").alias("hub_keys")), "c")
        pairs = lambda right: linking.candidates(members, right, 80, False)
        expected = {(max(c, d), min(c, d)) for c, keys in chosen.items() for d, other in sets.items() if c != d and set(keys) & set(other)}
        assert {tuple(r) for r in pairs(once).collect()} == {tuple(r) for r in pairs(hubs).collect()} == expected
