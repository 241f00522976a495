"""Word shingles as sorted 64-bit hashes, and circulant MinHash signatures, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers (the finalizer of MurmurHash3)."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def shingle_sets(texts: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of k-word shingles, text after text, and the n + 1 bounds of the texts in them.

    A-Z are lower-cased; words are what ASCII white space separates; a text with fewer than k words has its whole
    sequence as one shingle, one without words none."""
    word_hash: dict[bytes, int] = {}
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    get = xxhash.xxh3_64_intdigest
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        counts[i] = len(words)
        for w in words:
            h = word_hash.get(w)
            if h is None:
                h = word_hash[w] = get(w)
            flat.append(h)
    w = np.array(flat, dtype=_U)
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(w))
    # fold each window from left to right; shorter sequences fold what they have
    h = mix64(w + _U(1))
    for j in range(1, k):
        inside = place + j < ends
        nxt = np.zeros(len(w), dtype=_U)
        nxt[inside] = w[place[inside] + j]
        h = np.where(inside, mix64(h ^ (nxt + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))), h)
    begins = ends - np.repeat(counts, counts)
    keep = (place + k <= ends) | (place == begins)
    h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def circulant_signature(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x size) of non-empty sets: coordinate i is the least second permutation of a set's elements,
    first permuted and then shifted by i around the ring of 32-bit integers. Two permutations serve all coordinates."""
    first = (mix64(shingles ^ _U(0xA0761D6478BD642F)) >> _U(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, size), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(size):
            out[:, i] = np.minimum.reduceat(mix32(first + np.uint32(i)), bounds[:-1])
    return out
