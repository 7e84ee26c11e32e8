"""Substring dedup on bytes, with suffix groups from linear grouping construction.

Seeds and contexts come from ``repeats``. In each task the contexts of many anchors form one
text of symbols: for either side of a context its anchor's symbol, then a symbol for each
64-byte block away from the anchor, in byte order, and a separator. ``suffix_array`` sorts it by
grouping: groups of suffixes, which share their Lyndon prefix, are processed in descending
order, each suffix passes its rank to the previous smaller one, and a second pass emits the
order inside the groups; nothing is renamed or solved recursively. The suffixes that begin with
an anchor's symbol are its contexts in order; the bytes that neighbours share, to the right and
to the left, decide which strings of ``window`` bytes are repeats (``maximal_repeats``). Blocks
keep the text short, as Python takes several microseconds a symbol; shared lengths are
compared byte by byte. Anchors with very many contexts are narrowed down first (``repeats.narrowed``),
their parts are sorted the same way.

Defined results: null texts are empty; texts shorter than a window lose nothing; overlapping
copies inside one document count; equal rows remove each other's bytes; cuts may fall inside
a character, as texts are bytes here; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import covered_documents, without_repeats

BLOCK = 64


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; its last symbol must be smaller than all others."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # groups are intervals of this, at first by symbol
    place = [0] * n
    group = [0] * n  # start of each suffix's group: comparing starts compares groups
    for at, s in enumerate(order):
        place[s] = at
        group[s] = group[order[at - 1]] if at and text[order[at - 1]] == text[s] else at
    size = [0] * n
    for g in group:
        size[g] += 1
    previous = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for s in sorted(order[start:end]):
            j = s - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        # those pointed to most often come last in their old groups, each number as a group of its own
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(by_times, reverse=True):
            for old, moved in by_times[times].items():
                size[old] -= len(moved)
                new = old + size[old]
                if not size[old]:
                    size[old] = len(moved)
                    continue
                last = new + len(moved)
                for j in moved:
                    last -= 1
                    other, at = order[last], place[j]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                for j in moved:
                    group[j] = new
                size[new] = len(moved)
        end = start
    free = list(range(n))  # next place in the group that starts there
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
    return out


def suffix_order(group: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``repeats.sorted_order`` from one suffix array of the blocks of both sides of all contexts."""
    blocks = [[row[i : min(i + BLOCK, n)] for i in range(0, n, BLOCK)] for rows, size in sides for row, n in zip(map(bytes, rows), size.tolist())]
    groups = int(group.max(initial=-1)) + 1
    # 0 ends the text and 1 a context; then the anchors, a symbol for each and side, and the blocks in byte order
    symbol = {block: i for i, block in enumerate(sorted({b for row in blocks for b in row}), 2 + groups * len(sides))}
    text, heads = [], []
    for i, row in enumerate(blocks):
        side, context = divmod(i, len(group))
        heads.append(len(text))
        text += [2 + side * groups + int(group[context]), *map(symbol.__getitem__, row), 1]
    number = np.full(len(text) + 1, -1)
    number[heads] = np.arange(len(blocks))
    found = number[np.array(suffix_array([*text, 0]))]
    return list(found[found >= 0].reshape(len(sides), -1) % max(1, len(group)))


def remove_repeated_bytes(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 400, seed: int = 24, report: int = 256, texts: bool = False) -> DataFrame:
    """doc_id, n, n_removed, n_spans, longest, kept_sha256 and optionally the kept text (broken characters dropped).

    ``longest`` tells of repeats of ``report`` bytes or more, also of those too short to go (``repeats.covered_documents``).
    """
    return without_repeats(covered_documents(docs, "byte", window, seed, id_col, text_col, suffix_order, report), "byte", window, texts)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).selectExpr("doc_id", "n AS n_bytes", "n_removed", "n_spans", "kept_sha256", "longest AS longest_repeat")
