"""Vectorised polynomial (Rabin-Karp) hashes of words and of fixed-length word windows."""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240229)
_TABLE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X, _Y, _Z = (int(v) * 4 + 1 for v in _SEED.integers(2**60, 2**61, 3))
#: Powers that a worker keeps; longer texts make their own and give them up.
_KEPT = 1 << 19
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _KEPT), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= _KEPT:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, from prefix sums."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[end] - total[start]) * powers(pow(base, -1, 2**64), len(values) + 1)[start]


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than the space and U+0009 to U+000D."""
    return text.split()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the number of words of each text."""
    flat = [b" ".join(w) + b" " if w else b"" for w in map(words_of, texts)]
    data = np.frombuffer(b"".join(flat), dtype=np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    offsets = np.r_[0, np.cumsum([len(x) for x in flat])]
    counts = np.diff(np.searchsorted(ends, offsets))
    hashes = mix(spans_hash(_TABLE[data], starts, ends, _X) + (ends - starts).astype(np.uint64))
    return hashes, counts


def window_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n consecutive words of one text, text after text, and each text's number of windows."""
    windows = np.maximum(counts - n + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return mix(spans_hash(words, at, at + n, _Y)), windows


def second_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the same windows, in the same order, that tell more: from another base and other word values."""
    windows = np.maximum(counts - n + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return mix(spans_hash(mix(words + np.uint64(0x9E3779B97F4A7C15)), at, at + n, _Z))


def pieces(texts: list[bytes], size: int = 1 << 18):
    """Slices of the list with about `size` bytes each, so that temporary arrays stay small."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
