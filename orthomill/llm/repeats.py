"""Text that also stands elsewhere: every unit (word or byte) covered by a repeated window.

Both substring operators share these steps; a window is ``length`` consecutive units.

1. Seeds. In every window the smallest hash of its ``k``-unit grams, the rightmost on ties,
   is the window's anchor (winnowing with windows of ``length - k + 1`` grams), so equal
   windows have the same anchor at the same place. The windows of one anchor start at
   consecutive places and together span the anchor's context.
2. Occurrences of an anchor meet; of one task only the first two need to, as the others are
   known to have company. Equal contexts fold into one row with a count, so copies of a
   passage never meet pair by pair.
3. Extension. Contexts of an anchor that differ are sorted by what stands from the anchor on
   and by what stands before it. Neighbours in these orders are extended from the anchor both
   ways, unit by unit, and joining them by falling length gives each context's maximal repeats;
   those of ``length`` units or more count. A context that occurs twice is a repeat as a whole.
   An anchor with more than ``HOT_CONTEXTS`` different contexts is never gathered in one task:
   its contexts are cut in halves and dealt by what the windows of a half have in common, until
   groups are small (``narrowed``).
4. The repeats go back to their documents, which lose the units they cover.

Rows are known by their id and the hash of their text, so repeated rows, repeated ids and
null ids are handled: equal rows count as occurrences of each other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import U64, WordHashes, chunks_by_bytes, discard, materialize, mix, word_hashes

BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = U64(28)
PLACE_MASK = U64((1 << 28) - 1)
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 1 << (n + 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    steps = np.full(size, base, U64)
                    steps[0] = 1
                    setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


class Runs:
    """Hashes of any run of units, from one prefix sum."""

    def __init__(self, units: np.ndarray):
        up, self.down = Powers.get(len(units))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[U64(0)], np.cumsum(units * up[: len(units)], dtype=np.uint64)])

    def of(self, start, stop) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def each(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def units_of(texts: list[bytes], unit: str, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    if unit == "word":
        return word_hashes(texts, cache)
    return BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    low = values
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - done :]) if done < width else low


def find_anchors(units: np.ndarray, counts: np.ndarray, length: int, k: int):
    """For each anchor: text number, hash, context hash, place in the text, and how far before it its first and last windows start."""
    if len(units) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(units) > int(PLACE_MASK):
        raise ValueError(f"a text of {len(units)} units is too long: places have 28 bits")
    ends = np.cumsum(counts)
    runs = Runs(units)
    gram = runs.each(k)
    places = np.arange(len(gram), dtype=np.uint64)
    low = sliding_min((gram >> PLACE_BITS << PLACE_BITS) | (PLACE_MASK - places), length - k + 1)
    place = (PLACE_MASK - (low & PLACE_MASK)).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + length <= ends[doc])
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = place[inside]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(at) - 1]])
    at, first, final = at[new], inside[new], inside[last]
    owner = doc[first]
    return owner, gram[at].view(np.int64), runs.of(first, final + length).view(np.int64), at - (ends - counts)[owner], at - first, at - final


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(text, F.lit(7)).alias("k2"), F.coalesce(text, F.lit("")).alias("text"))


def encoded(column) -> list[bytes]:
    return [t.as_py().encode("utf-8", "surrogatepass") for t in column]


#: Bytes of contexts that a task takes together, and contexts one anchor may have there; each has less than 2 * length units.
BATCH_BYTES, HOT_CONTEXTS = 3_000_000, 2_000
OCCURRENCE = "anchor long, ctx long, reach int, k1 long, k2 long, place int"


def occurrences(keyed_docs: DataFrame, unit: str, length: int, k: int) -> DataFrame:
    """Anchors with their documents. ``meet`` is where a row must go: its anchor, or anywhere if two of the task go there already."""
    names = ["anchor", "ctx", "reach", "k1", "k2", "place", "known", "meet"]

    def run(batches):
        cache, seen = WordHashes(), {}
        for b in batches:
            texts = encoded(b.column(2))
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in chunks_by_bytes(texts, 1_000_000):
                owner, anchor, ctx, place, far, near = find_anchors(*units_of(texts[lo:hi], unit, cache), length, k)
                if not len(owner):
                    continue
                if len(seen) > 400_000:
                    seen.clear()
                known = np.zeros(len(owner), bool)
                for i, key in enumerate(anchor.tolist()):
                    n = seen[key] = seen.get(key, 0) + 1
                    known[i] = n > 2
                spread = mix(k2[lo:hi][owner].view(np.uint64) ^ place.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, ctx, (far << 16 | near).astype(np.int32), k1[lo:hi][owner], k2[lo:hi][owner], place.astype(np.int32), known, np.where(known, spread, anchor))], names)

    return keyed_docs.select("k1", "k2", "text").mapInArrow(run, OCCURRENCE + ", known boolean, meet long")


def contexts(keyed_docs: DataFrame, wanted: DataFrame, unit: str, length: int) -> DataFrame:
    """The units around each wanted anchor: from its first window's start to its last window's end."""
    per_doc = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "ctx", "reach", "n", "place")).alias("wanted"))
    joined = keyed_docs.select("k1", "k2", "text").join(per_doc.hint("shuffle_hash"), ["k1", "k2"]).select("text", "wanted", "k1", "k2")
    names = ["anchor", "ctx", "reach", "n", "body"]

    def run(batches):
        cache, seen = WordHashes(), set()
        for b in batches:
            texts = encoded(b.column(0))
            for i, (text, row) in enumerate(zip(texts, zip(b.column(2).to_pylist(), b.column(3).to_pylist()))):
                if row in seen:  # equal rows have the same contexts
                    continue
                seen.add(row)
                if len(seen) > 400_000:
                    seen.clear()
                want = b.column(1)[i].values
                anchor, ctx, reach, n, place = (want.field(j) for j in range(5))
                body = np.frombuffer(text, np.uint8) if unit == "byte" else word_hashes([text], cache)[0]
                cut = [body[p - (r >> 16) : p - (r & 0xFFFF) + length].tobytes() for p, r in zip(place.to_pylist(), reach.to_pylist())]
                yield pa.RecordBatch.from_arrays([anchor, ctx, reach, n, pa.array(cut, pa.binary())], names)

    return joined.mapInArrow(run, "anchor long, ctx long, reach int, n long, body binary")


def padded(units: np.ndarray, start: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """A row per context: ``size`` units from ``start`` on, forwards or backwards, and zeros after them."""
    out = np.zeros((len(size), int(size.max(initial=0))), units.dtype)
    for row, a, n in zip(out, start.tolist(), size.tolist()):
        row[:n] = units[a : a + n] if step > 0 else units[a - n + 1 : a + 1][::-1]
    return out


def sorted_order(group: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each side, its rows in order of group and content; a row that another begins with comes first."""
    out = []
    for rows, size in sides:
        keys = np.ascontiguousarray(np.column_stack([group.astype(np.uint64), rows.astype(np.uint64), size.astype(np.uint64)]).astype(">u8"))
        out.append(np.argsort(keys.view(f"V{keys.shape[1] * 8}").ravel(), kind="stable"))
    return out


def common_lengths(order: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many units each row in order shares with the one before it."""
    a, b = order[:-1], order[1:]
    differ = np.column_stack([rows[a] != rows[b], np.ones(len(a), bool)])
    return np.concatenate([[0], np.minimum(differ.argmax(axis=1), np.minimum(size[a], size[b]))])


def least_of_range(values: list[int]):
    """A function (a, b) -> min(values[a + 1 .. b]) for a < b."""
    levels = [values]
    while 2 << len(levels) - 1 <= len(values):
        half, last = 1 << len(levels) - 1, levels[-1]
        levels.append(list(map(min, last[:-half], last[half:])))

    def least(a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return min(levels[k][a + 1], levels[k][b + 1 - (1 << k)])

    return least


def maximal_repeats(right: list[int], left_rank: list[int], left: list[int], length: int) -> list[tuple[int, int, int]]:
    """(member, units to the left, units from the anchor on) of repeats of at least ``length`` units, the maximal ones among them.

    Members of one anchor are in order of what stands from the anchor on; ``right`` is what each
    shares with the one before it, ``left`` the same for the order by what stands before the
    anchor, read backwards, in which member i has place ``left_rank[i]``. Runs of members join at
    falling ``right``. When two join, a member can only gain from its neighbours by left place in
    the other run: others share less to the left, and no more to the right. The smaller run's
    places are put into the larger one's, so m members take about m log(m) steps, never m * m.
    """
    least, member = least_of_range(left), {place: i for i, place in enumerate(left_rank)}
    run, places = list(range(len(right))), [[x] for x in left_rank]
    reach, found = max(left, default=0), []
    for at in sorted(range(1, len(right)), key=lambda i: -right[i]):
        share = right[at]
        if share + reach < length:
            break
        small, large = run[at - 1], run[at]
        if len(places[small]) > len(places[large]):
            small, large = large, small
        into = places[large]
        for place in places[small]:
            i = bisect(into, place)
            for other in into[max(0, i - 1) : i + 1]:
                back = least(min(place, other), max(place, other))
                if back + share >= length:
                    found += [(member[place], back, share), (member[other], back, share)]
        for place in places[small]:
            run[member[place]] = large
        places[large] = sorted(into + places[small])
        places[small] = []
    return found


def repeated_in_group(anchor: np.ndarray, reach: np.ndarray, bodies: list[bytes], unit: str, least: int, orders=sorted_order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least ``least`` units among the contexts of each anchor: context number, units before the anchor, units from it on.

    Equal anchors stand together. Each context is extended from its anchor both ways against
    those next to it in order; ``orders`` sorts the contexts by what stands on either side.
    """
    raw = b"".join(bodies)
    units = np.frombuffer(raw, np.uint8 if unit == "byte" else np.uint64)
    size = np.array([len(x) for x in bodies], np.int64) // units.itemsize
    far, base = reach >> 16, np.cumsum(size) - size
    group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]])).astype(np.int64)
    sides = [(padded(units, base + far, size - far, 1), size - far), (padded(units, base + far - 1, far, -1), far)]
    by_right, by_left = orders(group, sides)
    right, left = (common_lengths(o, *side) for o, side in zip((by_right, by_left), sides))
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    members = np.diff(np.append(start, len(group)))
    left_place = np.empty(len(group), np.int64)
    left_place[by_left] = np.arange(len(group))
    # both orders keep groups together, in the same places
    two = start[members == 2] + 1
    two = two[right[two] + left[two] >= least]
    found = [(np.repeat(by_right[two], 2), np.repeat(left[two], 2), np.repeat(right[two], 2))]
    found[0][0][1::2] = by_right[two - 1]
    for a, n in zip(start[members > 2].tolist(), members[members > 2].tolist()):
        hits = maximal_repeats(right[a : a + n].tolist(), (left_place[by_right[a : a + n]] - a).tolist(), left[a : a + n].tolist(), least)
        if hits:
            i, back, share = np.array(sorted(set(hits))).T
            found.append((by_right[a + i], back, share))
    return tuple(np.concatenate(x) for x in zip(*found))


FOUND = "anchor long, ctx long, reach int, runs array<int>, longest int"


def extended(members: DataFrame, unit: str, length: int, report: int, orders=sorted_order) -> DataFrame:
    """Repeated windows of contexts that occur once, as runs counted from the context's start, and their longest repeat of at least ``report`` units.

    ``members`` has a group, the part of its context that a row stands for (``span``, as in
    ``reach``) with its units, how often that part occurs, and the context. Rows are sorted by
    group; whole groups are taken together up to ``BATCH_BYTES``.
    """
    budget = BATCH_BYTES
    names = ["anchor", "ctx", "reach", "runs", "longest"]

    def work(rows):
        # the same row of a repeated document goes
        rows = [r for i, r in enumerate(rows) if not i or (r[0], *r[4:]) != (rows[i - 1][0], *rows[i - 1][4:])]
        group, span = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        runs: dict[int, list[int]] = {}
        longest: dict[int, int] = {}
        for w, back, share in zip(*map(np.ndarray.tolist, repeated_in_group(group, span, [r[3] for r in rows], unit, report, orders))):
            far = rows[w][6] >> 16  # of the whole context, where the windows are counted
            if rows[w][2] > 1:
                continue
            longest[w] = max(longest.get(w, 0), back + share)
            if back + share >= length:
                runs.setdefault(w, []).extend((far - back, far + share - length))
        columns = [pa.array([rows[w][c] for w in longest], k) for c, k in ((4, pa.int64()), (5, pa.int64()), (6, pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([runs.get(w, []) for w in longest], pa.list_(pa.int32())), pa.array(list(longest.values()), pa.int32())], names)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if size > budget and row[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield work(held)

    dealt = members.select("g", "span", "n", "body", "anchor", "ctx", "reach").repartition("g").sortWithinPartitions("g", "anchor", "ctx", "reach")
    return dealt.mapInArrow(run, FOUND)


def halved(rows: DataFrame, unit: str, length: int, width: int) -> DataFrame:
    """Each row's windows in parts of ``width`` places, by how far before the anchor they start.

    All windows of a part hold the same ``length - width + 1`` units around the anchor; rows that
    differ there can share none of them. So g becomes a hash of those units; h1 and h2 are
    128 bits of all units of the part.
    """
    size = 1 if unit == "byte" else 8
    names = ["g", "span", "h1", "h2", "n", "body", "anchor", "ctx", "reach"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches):
        for b in batches:
            out = []
            for g, span, n, body, *ids in zip(*[c.to_pylist() for c in b.columns]):
                far, near = span >> 16, span & 0xFFFF
                for part in range(near // width, far // width + 1):
                    lo, hi = max(near, part * width), min(far, (part + 1) * width - 1)
                    cut = body[(far - hi) * size : (far - lo + length) * size]
                    common = cut[(hi - part * width) * size : (hi + length - (part + 1) * width + 1) * size]
                    key, h = xxhash.xxh3_64_intdigest(common, (g + part) % (1 << 64)), xxhash.xxh3_128_intdigest(cut)
                    out.append((signed(key), hi << 16 | lo, signed(h >> 64), signed(h % (1 << 64)), n, cut, *ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 9, kinds)], names)

    return rows.select("g", "span", "n", "body", "anchor", "ctx", "reach").mapInArrow(run, "g long, span int, h1 long, h2 long, n long, body binary, anchor long, ctx long, reach int")


def narrowed(members: DataFrame, unit: str, length: int, report: int, written: list[DataFrame], orders=sorted_order) -> DataFrame:
    """The result of ``extended`` for groups with very many contexts, in rounds that halve the contexts.

    A round cuts every context into two ranges of windows and groups each by what its windows have
    in common; parts that became equal fold into one with a count, so what a passage's many
    surroundings share is soon one row. Groups that are small then go to ``extended``. In the last
    round a part is one window and a group one content, so the rounds end. ``written`` gets the
    tables that the result still reads.
    """
    rows, found, width = members.dropDuplicates(["anchor", "ctx", "reach"]), None, 1 << (length - 1).bit_length()
    part = ["g", "span", "h1", "h2"]
    while width > 1:
        width //= 2
        parts = materialize(halved(rows, unit, length, width))
        folded = materialize(parts.groupBy(*part).agg(F.sum("n").alias("total"), F.min(F.struct("anchor", "ctx", "reach", "body")).alias("one")))
        sizes = materialize(folded.groupBy("g").count().filter("count > 1"))
        written += [parts, folded, sizes]
        # written tables on both sides: adaptive execution can split a part or group that very many rows have
        twice = parts.filter("n = 1").join(folded.filter("total > 1").select(*part), part, "left_semi")
        edge = lambda c: F.shiftright("reach", 16) - c
        far, near = F.shiftright("span", 16), F.col("span").bitwiseAND(0xFFFF)
        whole = twice.select("anchor", "ctx", "reach", F.array(edge(far), edge(near)).alias("runs"), (far - near + length).alias("longest"))
        again = folded.join(sizes, "g").select("g", "span", F.col("total").alias("n"), "one.*", "count")
        found = whole if found is None else found.unionByName(whole)
        found = found.unionByName(extended(again.filter(F.col("count") <= HOT_CONTEXTS), unit, length, report, orders))
        rows = again.filter(F.col("count") > HOT_CONTEXTS)
        if rows.isEmpty():
            break
        if length - width + 1 >= report:  # what a group's rows have in common is a repeat, too short perhaps to count
            alike = parts.join(sizes.filter(F.col("count") > HOT_CONTEXTS).select("g"), "g", "left_semi")
            found = found.unionByName(alike.select("anchor", "ctx", "reach", F.array().cast("array<int>").alias("runs"), F.lit(length - width + 1).alias("longest")))
    return found


def covered_documents(docs: DataFrame, unit: str, length: int, k: int, id_col="doc_id", text_col="text", orders=sorted_order, report: int | None = None) -> DataFrame:
    """doc_id, text, ``spans``: the repeated stretches [start, stop, ...] in units, null if none, and ``longest``.

    ``longest`` is the longest repeat found around the document's anchors, if it has ``report`` units (``length``
    by default) or more. Repeats of ``length`` are always found; shorter ones if an anchor of the
    windows around lies in them (of hot anchors only those that a round's groups have in common), and longer ones count as far as their anchor's context goes.
    """
    report = report or length
    source = keyed(docs, id_col, text_col)
    seen = occurrences(source, unit, length, k)
    met = F.count(F.lit(1)).over(W.partitionBy("meet"))
    common = materialize(seen.withColumn("met", met).filter("met > 1 or known").select("anchor", "ctx", "reach", "k1", "k2", "place"))
    folded = materialize(common.groupBy("anchor", "ctx", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("rep")))
    several = materialize(folded.groupBy("anchor").count().filter("count > 1"))

    def around(anchors: DataFrame) -> DataFrame:
        wanted = folded.join(anchors.select("anchor"), "anchor", "left_semi").select("anchor", "ctx", "reach", "n", "rep.*")
        return contexts(source, wanted, unit, length).withColumns({"g": F.col("anchor"), "span": F.col("reach")})

    partly = extended(around(several.filter(F.col("count") <= HOT_CONTEXTS)), unit, length, report, orders)
    hot, rounds = several.filter(F.col("count") > HOT_CONTEXTS), []
    if not hot.isEmpty():
        partly = partly.unionByName(narrowed(around(hot), unit, length, report, rounds, orders))
    windows = F.shiftright("reach", 16) - F.col("reach").bitwiseAND(0xFFFF)
    whole = folded.filter("n > 1").select("anchor", "ctx", "reach", F.array(F.lit(0), windows).alias("runs"), (windows + length).alias("longest"))
    found = common.join(whole.unionByName(partly), ["anchor", "ctx", "reach"])
    span = F.struct((F.col("place") - F.shiftright("reach", 16)).alias("start"), "runs")
    spans = found.select("k1", "k2", F.when(F.size("runs") > 0, span).alias("span"), "longest")
    # a set, as equal rows have equal spans: all of a row's occurrences are listed once, however often the row is repeated
    per_doc = spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"), F.max("longest").alias("longest"))
    listed = materialize(per_doc)
    discard(common, folded, several, *rounds)
    return source.join(listed.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans", "longest")


def covered_mask(n: int, spans, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if spans is not None:
        start = spans.field(0).to_numpy(zero_copy_only=False)
        lists = spans.field(1)
        runs = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        base = np.repeat(start, np.diff(lists.offsets.to_numpy()) // 2)
        np.add.at(edge, base + runs[:, 0], 1)
        np.add.at(edge, base + runs[:, 1] + length, -1)
    return np.cumsum(edge)[:n] > 0


def without_repeats(covered: DataFrame, unit: str, length: int, texts: bool = False) -> DataFrame:
    """doc_id, n, n_removed, n_spans, longest, kept_sha256, and the kept text itself if ``texts``."""
    kind = covered.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "n_removed", "n_spans", "longest", "kept_sha256", *["kept"] * texts]

    def run(batches):
        for b in batches:
            rows = []
            for text, spans, longest in zip(b.column(1), b.column(2), b.column(3)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                pieces = data.split() if unit == "word" else data
                gone = covered_mask(len(pieces), spans.values if spans.is_valid else None, length)
                if unit == "word":
                    kept = b" ".join([w for w, g in zip(pieces, gone.tolist()) if not g] if gone.any() else pieces)
                else:
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                edges = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                rows.append((len(pieces), int(gone.sum()), edges, longest.as_py() or 0, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * texts))
            cols = list(zip(*rows)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)]], names)

    return covered.mapInArrow(run, f"doc_id {kind}, n long, n_removed long, n_spans long, longest long, kept_sha256 string" + ", kept string" * texts)
