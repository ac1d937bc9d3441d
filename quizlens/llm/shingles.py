"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Words are the maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. All words of a chunk of texts are hashed at once: a running sum
of byte values times powers of an odd base gives every word's polynomial hash
as a difference of two prefix sums.
"""

from __future__ import annotations

import functools

import numpy as np

WIDTH = 5
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]                      # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _rng.integers(1, 2 ** 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2 ** 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, in order; index of each text's first word)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[data])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = 1 << max(20, len(data).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, np.searchsorted(begin, at)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its ``width``-word shingles
    (at most 5); the whole sequence is one shingle if it has fewer words, and
    a text without words has none."""
    h, at = _word_hashes(texts)
    n = len(h) - width + 1
    full = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width):
        if n > 0:
            full += h[k:n + k] * _PLACE[k]
    full = mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            s = np.sort(full[a:b - width + 1])
            new = np.empty(len(s), dtype=bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        elif b > a:
            few = (h[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([few], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
