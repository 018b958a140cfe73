"""ProbMinHash signatures of weighted shingles.

A document is its runs of five words, each weighted by how often it occurs. Every shingle sends out points of a Poisson
process whose rate is its weight; a point falls on a register at random, and a register keeps the shingle of its
earliest point. A shingle stops as soon as its next point comes later than the latest of all registers, so large
documents need little more than one point per shingle. Two documents agree on a register with the probability Jaccard
similarity of their weighted shingles.
"""

from __future__ import annotations

import numpy as np

from .common import gram_hashes, hashed_words, mix64

REGISTERS = 64
BANDS = 16
_SHIFT = np.uint64(11)


def shingles(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Hashes of every run of ``size`` words (lower case) of each text; a shorter text is one run; no words, no run."""
    words = hashed_words([t and t.lower() for t in texts])
    return [gram_hashes(w, min(size, len(w))) if len(w) else w for w in words]


def weighted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(grams, return_counts=True)


def occurrences(grams: np.ndarray) -> np.ndarray:
    """Ascending hashes in which the k-th occurrence of a shingle has a hash of its own.

    The plain Jaccard similarity of two such sets is the weighted one of the shingles.
    """
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    nth = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    repeated = nth > 0
    grams[repeated] = mix64(grams[repeated] + nth[repeated].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(grams)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets; two empty ones have 0."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def signatures(grams: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of shingle hashes per document; a document without shingles has a row of zeros."""
    pairs = [weighted(g) for g in grams]
    sizes = np.array([len(g) for g, _ in pairs], np.int64)
    element = np.concatenate([g for g, _ in pairs]) if len(pairs) else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in pairs]).astype(float) if len(pairs) else np.empty(0)
    doc = np.repeat(np.arange(len(pairs)), sizes)
    earliest = np.full((len(pairs), registers), np.inf)
    holder = np.zeros((len(pairs), registers), np.uint64)
    when = np.zeros(len(element))
    state = element
    while len(element):
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        register = (mix64(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
        # exponential waiting times from the upper 53 bits
        when = when - np.log(((state >> _SHIFT).astype(float) + 1.0) * 2.0**-53) / weight
        place = doc * registers + register
        order = np.lexsort([when, place])
        first = order[np.concatenate([[True], np.diff(place[order]) > 0])]  # earliest point of this round on a register
        new = first[when[first] < earliest.ravel()[place[first]]]
        earliest.ravel()[place[new]], holder.ravel()[place[new]] = when[new], element[new]
        going = when < earliest.max(axis=1)[doc]
        element, weight, doc, when, state = element[going], weight[going], doc[going], when[going], state[going]
    return holder


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per document and band of consecutive registers."""
    docs, registers = signature.shape
    rows = signature.reshape(docs, bands, registers // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (docs, bands)).copy()
    for i in range(rows.shape[2]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return out.view(np.int64)
