"""Shingle sets of texts and their digests."""

from __future__ import annotations

import numpy as np

from .common import U64, WordHashes, grams, mix, word_hashes


def shingle_sets(texts: list[bytes], k: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each lower-cased text (sorted, text after text) and their numbers."""
    hashes, n_words = word_hashes([t.lower() for t in texts], cache)
    ends = np.cumsum(n_words)
    doc = np.repeat(np.arange(len(texts)), n_words)
    long = grams(hashes, k)
    inside = np.arange(len(long)) + k <= ends[doc[: len(long)]] if len(long) else np.zeros(0, bool)
    values, owner = [long[inside]], [doc[: len(long)][inside]]
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        own = hashes[ends[i] - n_words[i] : ends[i]]
        values.append(grams(own, len(own)) ^ U64(len(own)))
        owner.append(np.array([i]))
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.bincount(owner[first], minlength=len(texts))


def set_digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set: wrapped sums of two mixes of its members; equal sets, equal digests."""
    sums = []
    with np.errstate(over="ignore"):
        for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            run = np.concatenate([[U64(0)], np.cumsum(mix(values ^ U64(salt)), dtype=np.uint64)])
            end = np.cumsum(counts)
            sums.append(mix(run[end] - run[end - counts] + counts.astype(np.uint64)))
    return sums[0].view(np.int64), sums[1].view(np.int64)
