"""Count-min sketches, made by slice and merged by part of the hash space, that tell what may occur twice.

A count-min sketch never estimates too low, so what is estimated below two occurs once; nothing that
repeats is lost.  A part's sketch has twice as many counters in each row as hashes were asked about, and parts
are added as the input grows (see ``dealt``), so estimates are as good at any size.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the rows' hash functions.
ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
LEAST_BITS = 10


def width_bits(expected: int) -> int:
    """Counters in a row, as a power of two: twice what is expected or more."""
    return max(LEAST_BITS, (2 * max(1, expected) - 1).bit_length())


def positions(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * np.uint64(ROWS[row])) >> np.uint64(64 - bits)


def sketch(codes: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A slice's sketch: the counters that it touches in each row, and what it adds to them."""
    out = []
    for row in range(len(ROWS)):
        at, which = np.unique(positions(codes, row, bits), return_inverse=True)
        out.append((at.astype(np.int64), np.bincount(which, counts, len(at)).astype(np.int64)))
    return out


class CountMin:
    """Sketches merged, in counters that stop at 65,535."""

    def __init__(self, bits: int):
        self.bits = bits
        self.rows = np.zeros((len(ROWS), 1 << bits), np.uint16)

    def merge(self, partial: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for row, (at, n) in zip(self.rows, partial, strict=True):
            row[at] = np.minimum(row[at] + n, 65_535)

    def estimate(self, codes: np.ndarray) -> np.ndarray:
        return np.minimum(*(self.rows[r][positions(codes, r, self.bits)] for r in range(len(ROWS))))


def may_repeat(codes: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Of all slices' codes in a part, whether the merged sketch estimates that they occur twice or more."""
    merged = CountMin(width_bits(sum(map(len, codes))))
    for c, n in zip(codes, counts, strict=True):
        merged.merge(sketch(c, n, merged.bits))
    return [(merged.estimate(c) > 1).astype(np.uint8) for c in codes]
