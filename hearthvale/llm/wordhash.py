"""Hashes of all words of a batch of texts, by array operations.

A word is a run of ASCII letters (A-Z lower-cased), digits and bytes beyond
ASCII. Its 64-bit hash is a polynomial over its bytes, read off one running
sum, then mixed. Buffers are worked through in windows cut between words, so
memory follows the window, not the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20

_BYTES = np.arange(256)
WORDS = ((_BYTES >= 0x80) | ((_BYTES >= 48) & (_BYTES < 58)) | ((_BYTES >= 65) & (_BYTES < 91))
         | ((_BYTES >= 97) & (_BYTES < 123))).astype(np.uint8)
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, WINDOW + 4096), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window(data: np.ndarray, fresh: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the runs of one window; ``fresh`` marks bytes
    that begin a text."""
    kind = classes[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | fresh[1:]
    edge = np.flatnonzero(edge)
    inside = kind[edge[:-1]] > 0
    starts, ends = edge[:-1][inside], edge[1:][inside]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=total[1:])
    sums = (total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix(sums + (ends - starts).astype(np.uint64)), starts, ends


def runs(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one class (0: between runs): hashes, starts,
    ends, cut and the bytes; text ``i`` has the runs ``cut[i]:cut[i + 1]``.
    Nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    if values is None or offsets[-1] == offsets[0]:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint8)
    data = np.frombuffer(values, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets[:-1]] = True
    parts, at = [], 0
    with np.errstate(over="ignore"):
        while at < len(data):
            end = min(at + WINDOW, len(data))
            while end < len(data) and classes[data[end]] and not fresh[end]:    # cut between runs
                stop = min(end + WINDOW, len(data))
                gap = np.flatnonzero((classes[data[end:stop]] == 0) | fresh[end:stop])
                end = end + int(gap[0]) if len(gap) else stop
            h, s, e = _window(data[at:end], fresh[at:end], classes)
            parts.append((h, s + at, e + at))
            at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    return hashes, starts, ends, np.searchsorted(starts, offsets), data


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, cut): text ``i`` has the words
    ``cut[i]:cut[i + 1]``."""
    hashes, _, _, cut, _ = runs(texts, WORDS)
    return hashes, cut


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, as signed 64-bit."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.full(n, k, np.uint64)
        for j in range(k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
        return mix(g).view(np.int64)
