"""Sets of word shingles of Arrow string columns, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from seqspark.llm import bytesops as B

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and where each text's begin."""
    data = _LOWER[data]
    start, end, first = B.words(data, offsets)
    n_words = np.diff(first)
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(count)), count)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    lone = B.span_hashes(data, start, end)
    hashes, length = np.zeros(len(at), dtype=np.uint64), np.minimum(shingle, n_words[owner])
    for n in range(1, shingle + 1):
        own = length == n
        if own.any():
            hashes[own] = B.sequence_hashes(lone, n)[at[own]]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(count) + 1))
