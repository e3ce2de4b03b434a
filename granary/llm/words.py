"""Words and word shingles as 64-bit hashes, a batch of texts at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_CODE = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_CODE[65:91] = _CODE[97:123]  # A-Z count as a-z
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of spans of bytes, the same wherever they stand."""
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[raw] * up[: len(raw)])])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and the number of words of each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = _WHITE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    h = span_hashes(raw, begin, end)
    borders = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.concatenate([[0], np.searchsorted(begin, borders)]))


def runs(texts: list[bytes], most: int = 1 << 20):
    """Runs of texts of about so many bytes."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most or k == len(texts) - 1:
            yield begin, k + 1
            begin, size = k + 1, 0


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The set of n-word shingles of each text, as sorted hashes; with fewer words, the whole sequence as one."""
    out = []
    for a, b in runs(texts):
        h, counts = word_hashes(texts[a:b])
        rolled = np.full(max(len(h) - n + 1, 0), 0x51_7C_C1_B7 + n, np.uint64)
        for k in range(n):
            rolled = mix((rolled ^ h[k : k + len(rolled)]) * U64(0x2545F4914F6CDD1D) + U64(1))
        at = 0
        for c in counts:
            if c >= n:
                out.append(np.unique(rolled[at : at + c - n + 1]))
            elif c:
                one = np.full(1, 0x51_7C_C1_B7 + c, np.uint64)
                for k in range(c):
                    one = mix((one ^ h[at + k : at + k + 1]) * U64(0x2545F4914F6CDD1D) + U64(1))
                out.append(one)
            else:
                out.append(np.empty(0, np.uint64))
            at += c
    return out
