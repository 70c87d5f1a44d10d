"""Word and shingle hashes on numpy arrays, shared by the operators that work
on word sequences."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash

_MAX_CACHED = 1 << 17
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _WordHashes(dict):
    """Word to 64-bit hash, computed once per word and worker (emptied when it
    holds many: a cache only)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()
_holder: list = [None, None]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory goes back to the system.  Arrow's and C's allocators keep
    some 50 MB of a worker otherwise, also while it waits between stages, and
    an executor's JVM and workers share one limit."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def hold(name: str, release=None) -> None:
    """A Python worker serves many stages: when operators of another name
    begin there, ``release`` drops what the one before kept, and the memory
    goes back to the system."""
    if _holder[0] != name:
        if _holder[1] is not None:
            _holder[1]()
            gc.collect()
            give_back()
        _holder[:] = name, release


def split(text: str | bytes | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; with ``lower``, A-Z lower-cased."""
    data = text.encode() if isinstance(text, str) else text or b""
    return (data.translate(_LOWER) if lower else data).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    hold("words", _hashes.clear)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any runs of a hash sequence, from one cumulative sum:
    a polynomial modulo 2 ** 64, made position-free by the inverse power."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    @classmethod
    def _table(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = max(n, 2 * len(cls._powers))
            for name, base in (("_powers", _MULTIPLIER), ("_inverses", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))

    def __init__(self, h: np.ndarray):
        self._table(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self._powers[:len(h)], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words [start, end) for each pair."""
        return mix((self.sums[end] - self.sums[start]) * self._inverses[start] + (end - start).astype(np.uint64) * _MULTIPLIER)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of a shorter, non-empty
    text one hash of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    h, n = hashes(words), max(len(words) - size + 1, 1)
    k, out = min(size, len(words)), np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MULTIPLIER + h[j:j + n]
    return mix(out + np.uint64(k))
