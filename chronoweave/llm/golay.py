"""Keys of 64-bit fingerprints such that any two at 4 or fewer differing bits share one.

The binary Golay code [23, 12, 7] is perfect: each 23-bit word lies within 3
bits of exactly one codeword. A word is given the index of every codeword
within 4 bits: 1 or 6 of them. Two words at 2 or fewer differing bits share
one, for the codeword nearest a word between them is within 4 bits of both.

A fingerprint is cut into segments of 23, 23 and 18 bits. If 4 or fewer bits
differ, either each segment has 2 differing bits at most, or one has 3 or more
and the other two share at most one.

* Each at most 2: one of three parts of 6 bits of the third segment has none,
  and the first two share a codeword each. Keys: (index, index, part), about
  5.3 * 5.3 * 3 of 30 bits.
* One of 3 or more: of the other two, one is equal and of the other one half.
  Keys: (segment, half), 12 of 27 to 35 bits.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed value: generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101
MOST_BITS = 4


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= _GENERATOR << (i - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 12-bit and 11-bit half of a word; and for each syndrome up to 6 error patterns (-1: none)."""
    unit = [_remainder(1 << i) for i in range(23)]
    halves = np.zeros((2, 4096), np.int64)
    for half, first, n in ((0, 0, 12), (1, 12, 11)):
        for i in range(n):
            bit = np.arange(4096) >> i & 1
            halves[half] ^= bit * unit[first + i]
    from itertools import combinations

    errors = np.full((2048, 6), -1, np.int64)
    found = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s, e = 0, 0
            for b in bits:
                s ^= unit[b]
                e |= 1 << b
            if weight < 4 or found[s]:  # weights 0 to 3 fill every syndrome once
                errors[s, found[s]] = e
                found[s] += 1
    return halves, errors


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices (the top 12 bits) of the codewords within 4 bits of n 23-bit words; -1 where there are fewer."""
    halves, errors = tables()
    words = np.asarray(words, np.int64)
    e = errors[halves[0][words & 4095] ^ halves[1][words >> 12]]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): every key of every fingerprint, rows giving the fingerprint's place."""
    x = np.asarray(prints).astype(np.uint64)
    a, b, c = ((x >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((41, 23), (18, 23), (0, 18)))
    n = len(x)
    ia, ib = indices(a), indices(b)
    both = np.where((ia[:, :, None] < 0) | (ib[:, None, :] < 0), -1, ia[:, :, None] << 12 | ib[:, None, :]).reshape(n, 36)
    parts = np.stack([c >> (6 * k) & 63 | k << 6 for k in range(3)], 1)
    near = np.where(both[:, :, None] < 0, -1, both[:, :, None] << 8 | parts[:, None, :]).reshape(n, 108)
    cut = ((a, 12, 11), (b, 12, 11), (c, 9, 9))  # segment, bits of its low and its high half
    exact = []
    for i, (whole, _, _) in enumerate(cut):
        for j, (other, low, _) in enumerate(cut):
            if i != j:
                exact += [whole << 12 | other & ((1 << low) - 1), whole << 12 | other >> low]
    exact = np.stack([v | (k + 1) << 40 for k, v in enumerate(exact)], 1)
    every = np.concatenate([near, exact], 1)
    rows, cols = np.nonzero(every >= 0)
    return rows, every[rows, cols]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.asarray(a).astype(np.uint64) ^ np.asarray(b).astype(np.uint64))


@cache
def ball() -> np.ndarray:
    """All 64-bit patterns of 2 or fewer bits: the 2081 midpoints of fingerprints at 4 or fewer differing bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
