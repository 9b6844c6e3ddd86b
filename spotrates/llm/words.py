"""Words, word hashes and shingle sets of whole texts (inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

CHARS = 4_000_000     # of text, hashed at a time
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S31, _S29 = np.uint64(31), np.uint64(29)


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; words are runs without the six ASCII space characters."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S31)) * _M1
    return x ^ (x >> _S29)


def word_hashes(texts):
    """For every text (bytes or None) the 64-bit hashes of its words, in order."""
    for i, j in slices(texts, CHARS):
        lists = [words_of(t) for t in texts[i:j]]
        distinct = list(set().union(*lists))
        table = dict(zip(distinct, map(xxhash.xxh64_intdigest, distinct)))
        for words in lists:
            yield np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of word hashes; a
    shorter text is one shingle of all its words; no words: empty."""
    n = len(h)
    if not n:
        return h
    if n < k:
        k = n
    out = mixed(h[: n - k + 1] + np.uint64(k))
    for i in range(1, k):
        out = mixed(out * _M2 + h[i: n - k + 1 + i])
    return np.unique(out)


def slices(texts, size: int):
    """(begin, end) of neighbouring texts with about ``size`` characters together, at least one text."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text or "") > size:
            yield begin, i
            begin, total = i, 0
        total += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)
