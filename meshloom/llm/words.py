"""Vectorised word and shingle hashing over UTF-8 buffers (numpy).

Words are maximal runs of bytes outside the six ASCII white-space characters;
A-Z is folded to a-z. A word's 64-bit hash is a polynomial over per-byte random
values, finished by an avalanche mix; a shingle's hash mixes the hashes of its
words by position. Texts are processed whole, a few MB at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit avalanche; x is overwritten."""
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def _byte_table() -> np.ndarray:
    folded = np.arange(256)
    folded[65:91] += 32
    values = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE)) | U(1)
    values = values[folded]
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


TABLE = _byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for n texts n + 1 offsets into them."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, dtype=np.uint8)
    up, down = power(max(len(buf) + 1, CHUNK + 65536))
    space = _SPACE[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(TABLE[buf] * up[: len(buf)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(lens)))
    return hashes, np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles: with 1 to
    k - 1 words the whole sequence as one, without words none."""
    seeds = mix(np.arange(1, k + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)
    n = len(words)
    if n >= k:
        rolled = words[: n - k + 1] * seeds[0]
        for j in range(1, k):
            rolled = mix(rolled) + words[j : n - k + 1 + j] * seeds[j]
        rolled = mix(rolled)
    else:
        rolled = np.empty(0, np.uint64)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if hi - lo >= k:
            s = np.sort(rolled[lo : hi - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            acc = np.array([hi - lo], dtype=np.uint64) * U(_BASE)
            for j in range(lo, hi):
                acc = mix(acc) + words[j : j + 1] * seeds[j - lo]
            out.append(mix(acc))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    for lo, hi in chunks(texts):
        yield from shingle_hashes(*word_hashes(texts[lo:hi]), k)
