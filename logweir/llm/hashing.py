"""Words of texts as 64-bit hashes, and rolling hashes of word windows."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

#: Odd bases of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes:
    """xxh3 of words, with the words seen lately kept; two generations bound the memory."""

    def __init__(self, limit: int = 120_000, longest: int = 48):
        self.limit, self.longest = limit, longest
        self.hot = self._generation({})

    def _generation(self, old: dict) -> dict:
        longest = self.longest

        class Seen(dict):
            def __missing__(self, word: bytes) -> int:
                h = old.get(word)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(word)
                if len(word) <= longest:
                    self[word] = h
                return h

        return Seen()

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.hot) > self.limit:
            self.hot = self._generation(dict(self.hot))
        return np.fromiter(map(self.hot.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


_SEEN: list[WordHashes] = []


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """Hashes of all words of ``texts``, one after the other; one cache per Python worker."""
    if not _SEEN:
        _SEEN.append(WordHashes())
    return _SEEN[0].of(texts)


def rolling(words: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every k consecutive entries: the polynomial in ``base`` modulo 2**64, by doubling."""
    if len(words) < k:
        return words[:0]
    out, out_len, cur, cur_len, power = None, 0, words, 1, base
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                if out is None:
                    out = cur
                else:
                    n = min(len(cur), len(out) - cur_len)
                    out = cur[:n] * np.uint64(pow(base, out_len, 1 << 64)) + out[cur_len : cur_len + n]
                out_len += cur_len
            k >>= 1
            if k:
                cur = cur[:-cur_len] * np.uint64(power) + cur[cur_len:]
                cur_len, power = 2 * cur_len, power * power % (1 << 64)
    return out


def window_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``counts`` words one after the other: where windows of k words start, whose they are, and the place in the text."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    n = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first[owner] + place, owner, place


def steady_memory() -> None:
    """Let freed arrays go back to the system at once, so that one stage's peak doesn't stay with a worker that serves the next.

    The C library otherwise raises the size from which it maps memory, and keeps what lies below; Arrow
    has pools of its own.  Without such a library nothing changes.
    """
    global _STEADY
    forget("tokens", "_KEPT")
    if _STEADY:
        return
    _STEADY = True
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(AttributeError, OSError):
        tune = ctypes.CDLL(None).mallopt
        tune(-3, 1 << 17)  # M_MMAP_THRESHOLD
        tune(-1, 1 << 20)  # M_TRIM_THRESHOLD


_STEADY = False


def forget(module: str, cache: str) -> None:
    """Empty a cache that another operator's stage has left in this worker."""
    other = sys.modules.get(f"logweir.llm.{module}")
    if other is not None:
        getattr(other, cache).clear()


def slices(batch, column: int, limit: int = 4_000_000):
    """(from, to, texts as bytes or None) of a record batch, some megabytes of text at a time."""
    steady_memory()
    at, col = 0, batch.column(column)
    while at < batch.num_rows:
        texts, size, to = [], 0, at
        while to < batch.num_rows and (size < limit or to == at):
            t = col[to].as_py()
            size, to = size + len(t or b""), to + 1
            texts.append(t)
        yield at, to, texts
        at = to
