"""The methods themselves, against brute force, exact round trips and held-out labels."""

import collections
import random
import re
import struct
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as registry
from orthomill.llm import common, media, near_dup, packing, pii, quality_rules, repeats, substring_dedup, suffix_dedup
from orthomill.llm.components import connected_components


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([7, 8]))
def test_lzw_round_trip(data, bits):
    data = bytes(b & 127 for b in data) if bits == 7 else data
    assert media.lzw_decode(media.lzw_encode(data, bits), bits, len(data)) == data


def test_lzw_long_and_damaged():
    data = bytes(random.Random(1).choices(b"abcde ", k=300_000))
    body = media.lzw_encode(data)
    assert media.lzw_decode(body, 8, len(data)) == data
    assert data.startswith(media.lzw_decode(body[: len(body) // 2], 8, len(data))[:1000])


def test_gif_rules():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    frames = [{"indices": bytes([1] * 16), "width": 4, "height": 4, "delay": 10, "disposal": 1}, {"indices": bytes([2, 0, 0, 2]), "width": 2, "height": 2, "left": 1, "top": 1, "delay": 20, "disposal": 2, "transparent": 0},
              {"indices": bytes([3] * 4), "width": 2, "height": 2, "delay": 5, "disposal": 3}, {"indices": bytes([2]), "width": 1, "height": 1, "left": 3, "top": 3}]
    data = media.write_gif(frames, 4, 4, palette)
    w, h, back = media.read_gif(data)
    assert (w, h) == (4, 4) and [f["indices"] for f in back] == [f["indices"] for f in frames] and [f["delay"] for f in back] == [10, 20, 5, 4]
    shown = list(media.compose(w, h, back))
    assert tuple(shown[1][1, 1]) == (0, 255, 0, 255) and tuple(shown[1][1, 2]) == (255, 0, 0, 255)  # see-through pixel
    assert shown[2][2, 2, 3] == 0 and tuple(shown[2][0, 0]) == (0, 0, 255, 255)  # the second frame's area was cleared
    assert tuple(shown[3][0, 0]) == (255, 0, 0, 255)  # the third was undone
    assert sum(media.histogram(shown[0])) == 16
    interlaced = bytearray(data)
    at = data.index(b",", 13 + 12)
    interlaced[at + 9] |= 0x40
    rows = np.frombuffer(media.read_gif(bytes(interlaced))[2][0]["indices"], np.uint8)
    assert len(rows) == 16 and media.read_gif(b"nothing") == (0, 0, []) and struct.unpack("<HH", data[6:10]) == (4, 4)


def test_media_frames(spark):
    data = media.as_gif(b"ab" * 64 * 1500)
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    rows = media.media_frames(df).orderBy("frame").collect()
    assert [r.doc_id for r in rows] == [1] * 3 and [r.start_ms for r in rows] == [0, 40, 80] and all(sum(r.histogram) == 64 * 1024 for r in rows)


def test_frames_without_pictures(spark, sf):
    """Histograms are the same without RGBA, also where pixels are see-through, cleared or undone; files share batches, and the query makes no RGBA."""
    rng = random.Random(4)
    files = []
    for _ in range(30):
        sizes = [(rng.randrange(1, 7), rng.randrange(1, 7)) for _ in range(4)]
        frames = [{"indices": bytes(rng.choices(range(8), k=w * h)), "width": w, "height": h, "left": rng.randrange(4), "top": rng.randrange(4), "disposal": rng.randrange(4), "transparent": rng.choice([None, 0, 3]),
                   "palette": rng.choice([None, rng.randbytes(24)]), "delay": rng.randrange(9)} for w, h in sizes]
        files.append(media.write_gif(frames, 6, 5))
    df = spark.createDataFrame([*[(i, bytearray(f)) for i, f in enumerate(files)], (30, None)], "doc_id long, media binary").coalesce(1)
    full, bare = media.media_frames(df), media.media_frames(df, pictures=False)
    assert "rgba" in full.columns and bare.columns == [c for c in full.columns if c != "rgba"]
    rows = sorted(bare.collect())
    assert len(rows) == 120 and rows == sorted(full.drop("rgba").collect())
    assert bare.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), bare.schema).count() == 1
    plan = media.gif_frames(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "rgba" not in plan


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = pool[:250], pool[50:]
        sig = near_dup.superminhash(np.concatenate([a, b]), np.array([len(a), len(b)]), 96)
        errors.append((sig[0] == sig[1]).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(2 / 9 / 96) * 1.15
    small = near_dup.superminhash(np.array([5, 9, 5, 9], np.uint64), np.array([2, 2]), 96)
    assert (small[0] == small[1]).all() and (small[0] < np.uint64(96) << np.uint64(40)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 300 + i) for i in range(50)] + [(900, 900), (None, 3), (700, 701), (700, 701)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[300 + i] == 300 for i in range(50)) and got[500] == 300 and got[701] == 700 and 900 not in got


def test_large_clusters_are_exact(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(120)] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(116)} for i, t in rows for w in [t.split()]}
    parent = dict.fromkeys(sets)
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in sets}


def test_best_fit_keeps_few_bins_open_and_wastes_little():
    rng = random.Random(2)
    bins = packing.BestFit(100, 16)
    fill = collections.Counter()
    for _ in range(20_000):
        n = rng.randrange(1, 101)
        b, offset = bins.put(n)
        assert fill[b] == offset
        fill[b] += n
        assert fill[b] <= 100 and bins.open <= 16
    assert sum(fill.values()) / (100 * len(fill)) > 0.93


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9)).map(lambda s: (s[0], s[0] + s[1])), max_size=8), st.integers(0, 30), st.integers(0, 9))
def test_spans_within_spans(spans, a, size):
    assert pii.within(spans)(a, a + size) == any(s <= a and a + size <= e for s, e in spans)


def test_look_ahead_only_changes_the_order(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i * 37 % 900)) for i in range(120)], "doc_id long, text string")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for look_ahead in (1, 64, 2048):
        rows = packing.pack(docs, look_ahead=look_ahead).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        assert all(sum(n for _, n in places[:i]) == at for places in map(sorted, by.values()) for i, (at, _) in enumerate(places))
        bag = sorted(tuple(r[c] for c in columns) for r in rows)
        first = bag if look_ahead == 1 else first
        assert bag == first and len(by) <= 1.15 * -(-sum(r.length for r in rows) // 2048) + 1


def test_few_sequences_are_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_tokens_equal_the_tokenizer_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    texts = ["", "Hello  world\n\n it's 12345 ünï çödé 😀", "  lead", "tab\tand\r\n", "<|endoftext|> x", "日本語 text", "a" * 500, "don't WE'LL 3.14%%% |x|"]
    for s in texts:
        assert packing.token_ids(s, path).tolist() == [*t.encode(s, add_special_tokens=False).ids, 0]
    assert packing.pieces(2048, 2048) == [(0, 2048)] and packing.pieces(2050, 2048) == [(0, 2), (2, 2048)]


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789 .@-+a()é", max_size=70))
def test_base_spans(text):
    assert pii.detect(text) == plain_spans(text)


def test_disguises_map_back():
    cases = {"write to bob [at] mail dot example dot com now": ["bob [at] mail dot example dot com"], "jane (at) site (dot) org": ["jane (at) site (dot) org"], "joe at example dot com": ["joe at example dot com"],
             "call five five five one two three four five six seven": ["five five five one two three four five six seven"], "x аnna@exаmple.com y": ["аnna@exаmple.com"], "４１１１ １１１１ １１１１ １１１１": ["４１１１ １１１１ １１１１ １１１１"],
             "we met at noon. dot the line": [], "one two three go": []}
    for text, want in cases.items():
        base, spans = pii.find_spans(text)
        assert [text[a:b] for a, _, b in spans] == want and set(base) <= set(spans)
    assert pii.masked("a b@c.de, 1.2.3.4") == "a [EMAIL], [IP]"


def test_binomial_tail_and_cutoff():
    for k, n, p in [(0, 10, 0.1), (3, 40, 0.2), (10, 10, 0.5)]:
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    # of each step, the documents that it rejects first; 950 of a thousand good ones are never rejected
    good, bad = [0, 2, 8, 40, 950], [50, 40, 5, 5, 0]
    assert quality_rules.proven_step(good, bad, 0.02, 0.02, 10.0) == 2  # the third step's gain is not worth its price, the fourth is not proven
    assert quality_rules.proven_step(good, bad, 0.02, 0.02, 0.0) == 3
    assert quality_rules.proven_step([0, 10], [5, 5], 0.02, 0.01, 5.0) == 0 and quality_rules.proven_step([0], [9], 0.02, 0.01, 5.0) == 0
    cells = {"upper_ratio": {0: (0, 90), 5: (1, 4), 9: (8, 0)}, "bang_ratio": {0: (0, 90), 3: (3, 0)}}
    assert quality_rules.tightening_path(cells, 64) == [("upper_ratio", 9), ("bang_ratio", 3), ("upper_ratio", 5)]


def test_rules_keep_their_promise(spark):
    """kept against a plain computation of path, holdout and verdict, and the false rejections that it allows."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(1600):
        good = rng.random() < 0.75
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for _ in range(rng.randrange(0, 3) if good else rng.randrange(0, 30)):
            words[rng.randrange(60)] = rng.choice(["YES!", "###", "NOW"])
        rows.append((i, " ".join(words), "xy"[i % 2]))
        labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    held = {r.doc_id for r in known.filter("pmod(xxhash64('holdout', doc_id), 2L) = 1").collect()}
    grid, want, good_of = quality_rules.GRID, {}, dict(labels)
    cell = {i: {r: min(grid - 1, int(v * grid)) for r, v in zip(quality_rules.RULES, quality_rules.measure(t)[5:])} for i, t, _ in rows}
    for lang in "xy":
        mine = [i for i, _, s in rows if s == lang]
        cells = {}
        for i in mine:
            if i not in held:
                for r, c in cell[i].items():
                    cells.setdefault(r, {}).setdefault(c, [0, 0])[good_of[i]] += 1
        path = quality_rules.tightening_path(cells, grid)
        tested, cut, best, proven = [i for i in mine if i in held], {}, (0.0, {}), True
        n = [sum(good_of[i] == g for i in tested) for g in (0, 1)]
        for rule, c in path:
            cut[rule] = c
            gone = [sum(good_of[i] == g and any(cell[i][r] >= at for r, at in cut.items()) for i in tested) for g in (0, 1)]
            tail = sum(comb(n[1], j) * 0.02**j * 0.98 ** (n[1] - j) for j in range(gone[1] + 1))
            proven = proven and tail <= 0.05 / 2
            worth = gone[0] / n[0] - 5 * gone[1] / n[1]
            if proven and worth > best[0] + 1e-12:
                best = (worth, dict(cut))
        assert best[1]
        want |= {i: not any(cell[i][r] >= at for r, at in best[1].items()) for i in mine}
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, known).filter("not base_failed").collect()}
    assert len(got) > 1500 and all(want[i] == k for i, k in got.items())
    rejected = [i for i, k in got.items() if not k]
    assert sum(1 - good_of[i] for i in rejected) > 100 and sum(good_of[i] for i in rejected) <= 0.02 * sum(good_of.values())


def test_anchors_cover_every_window():
    rng = np.random.default_rng(8)
    units = rng.integers(0, 50, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.array([300, 20, 580])
    owner, _, _, place, far, near = repeats.find_anchors(units, counts, 35, 6)
    starts = sorted((o, p - d) for o, p, a, b in zip(owner, place, far, near) for d in range(b, a + 1))
    assert starts == [(o, s) for o, n in ((0, 300), (2, 580)) for s in range(n - 34)] and (far - near < 30).all()


@pytest.mark.parametrize("remove,unit", [(substring_dedup.remove_repeated_words, "word"), (suffix_dedup.remove_repeated_bytes, "byte")])
def test_hot_anchors_give_the_same_result(spark, monkeypatch, remove, unit):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(250)]
    rows = [(i, " ".join([f"a{rng.random()}" for _ in range(rng.randrange(40))] + passage[rng.randrange(9) :] + [f"b{rng.randrange(3)}" for _ in range(rng.randrange(60))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, remove(docs).collect()))
    for limit in (1, 9):  # all by parts that became equal, or small groups after some rounds
        monkeypatch.setattr(repeats, "HOT_CONTEXTS", limit)
        assert sorted(map(tuple, remove(docs).collect())) == want and sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("unit,length,orders", [("byte", 20, repeats.sorted_order), ("word", 9, repeats.sorted_order), ("byte", 20, suffix_dedup.suffix_order), ("byte", 130, suffix_dedup.suffix_order)])
def test_maximal_repeats_cover_what_all_pairs_do(unit, length, orders):
    rng = random.Random(length)
    for _ in range(40):
        anchor, reach, bodies = [], [], []
        for g in range(rng.randrange(1, 6)):
            base, seen = [rng.randrange(3) for _ in range(2 * length)], set()
            for _ in range(rng.choice([1, 2, 2, 3, 5, 40])):
                x = list(base)
                for _ in range(rng.randrange(4)):
                    x[rng.randrange(len(x))] = rng.randrange(5)
                far = rng.randrange(0, length - 3)
                part = x[length - far : 2 * length - rng.randrange(0, far + 1)]
                body = bytes(part) if unit == "byte" else np.array(part, np.uint64).tobytes()
                if (body, far) not in seen:
                    seen.add((body, far))
                    anchor, reach, bodies = [*anchor, g], [*reach, far << 16], [*bodies, body]
        size = 1 if unit == "byte" else 8
        windows = [[(a, (r >> 16) - s, b[s * size : (s + length) * size]) for s in range(len(b) // size - length + 1)] for a, r, b in zip(anchor, reach, bodies)]
        seen = collections.Counter(w for ws in windows for w in set(ws))
        got = [[False] * len(ws) for ws in windows]
        for i, back, share in zip(*map(np.ndarray.tolist, repeats.repeated_in_group(np.array(anchor), np.array(reach), bodies, unit, length, orders))):
            far = reach[i] >> 16
            got[i][far - back : far + share - length + 1] = [True] * (back + share - length + 1)
        assert got == [[seen[w] > 1 for w in ws] for ws in windows]


def test_the_suffix_array_decides(monkeypatch):
    """With its suffixes in another order, repeats are missed."""
    bodies = [bytes([i % 7] * 30) + b"anchor" + bytes([i % 5] * 40) for i in range(35)]
    given = (np.zeros(35, np.int64), np.full(35, 30 << 16), bodies, "byte", 40)
    right = set(zip(*map(np.ndarray.tolist, repeats.repeated_in_group(*given, suffix_dedup.suffix_order))))
    sort = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: random.Random(1).sample(sort(text), len(text)))
    try:
        wrong = set(zip(*map(np.ndarray.tolist, repeats.repeated_in_group(*given, suffix_dedup.suffix_order))))
    except (IndexError, KeyError, ValueError):
        wrong = set()
    assert {w for w, _, _ in right} == set(range(35)) and wrong != right


def test_repeats_too_short_to_go_are_told(spark, monkeypatch):
    """A passage of 330 bytes in many documents stays, but longest tells of it, of hot anchors at least sometimes; documents of their own have none."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = letters(330)
    docs = spark.createDataFrame([(i, letters(500) + (passage if i < 30 else letters(330)) + letters(500)) for i in range(60)], "doc_id long, text string")
    for hot in (2000, 5):
        monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
        rows = suffix_dedup.remove_repeated_bytes(docs).collect()
        assert all(r.n_removed == 0 for r in rows) and all(r.longest == 0 for r in rows if r.doc_id >= 30)
        assert all(hot == 5 and r.longest == 0 or 256 <= r.longest <= 340 for r in rows if r.doc_id < 30)


def test_word_hash_cache_is_bounded():
    cache = common.WordHashes(10)
    hashes, counts = common.word_hashes([b" ".join(b"w%d" % i for i in range(50)), b"w1 w2"], cache)
    assert len(cache) <= 10 and list(counts) == [50, 2] and hashes[1] == hashes[50]


def plain_lzw(data, bits, n):
    """A reader of LZW codes as they are described, one code at a time."""
    out, at, width, table, last = [], 0, bits + 1, [], None
    number = int.from_bytes(data, "little")
    while True:
        code = number >> at & (1 << width) - 1
        at += width
        if code == 1 << bits:
            table, width, last = [bytes([i]) for i in range(1 << bits)] + [b"", b""], bits + 1, None
            continue
        if code == (1 << bits) + 1:
            return b"".join(out)[:n]
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) == 1 << width and width < 12:
            width += 1


@pytest.mark.parametrize("text", ["", "abc", "the cat " * 900, "é😀x" * 3000])
def test_stored_texts_by_a_plain_reader(text):
    payload, n = media.payload_of(text)
    data = media.as_gif(payload)
    assert len(text.encode()) == n and data[:6] == b"GIF89a"
    at, shown = 13 + 768, []
    while data[at : at + 1] == b"\x21":
        delay = struct.unpack("<H", data[at + 4 : at + 6])[0]
        at += 8
        w, h = struct.unpack("<HH", data[at + 5 : at + 9])
        at, body = at + 11, b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        shown.append((delay * 10, plain_lzw(body, 8, w * h)))
    assert b"".join(x for _, x in shown) == payload
    cells = [collections.Counter(((i >> 5) * 255 // 7 >> 6) * 16 + ((i >> 2 & 7) * 255 // 7 >> 6) * 4 + ((i & 3) * 85 >> 6) for i in x) for _, x in shown[:1]]
    first = media.digest(text)[6].split(";")[1]
    assert first == "0+40:" + ",".join(f"{c}={k}" for c, k in sorted(cells[0].items()))


def test_registered_names():
    names = registry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
