"""Removal of word windows that occur more than once, with a count-min prefilter.

Every window picks the least of the hashes of its sub-windows of a few words.  Windows with the same words
pick alike, from different places, so the number of places with a pick is no less than the number of
windows with the same words; one pick serves about a dozen windows that follow each other.  Slices sketch
their picks, the sketches are merged by part of the hash space and tell which picks may repeat.  A second
pass groups, exactly by 128 bits of hash, only windows whose pick may repeat, and says of each whether it
does.  The texts are shuffled once, by slice, and all passes read that shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import dealt, hashing
from logweir.llm.countmin import may_repeat
from logweir.llm.storage import lean_batches, shuffle_partitions

WINDOW = 35
#: Words of the sub-windows that are picked from.
PICK = 8
#: Windows in a part of the exact pass, about, and bytes that are kept of a word on average.
EXACT, WORD_BYTES = 1_500_000, 6


def least_of(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``n`` consecutive values, and where the first such one is, by doubling."""
    at = np.arange(len(values))
    width = 1
    while width < n:
        step = min(width, n - width)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    return values, at


class Windows:
    """The windows of a slice's texts: where they start, their picks, and their hashes."""

    def __init__(self, texts: list[bytes | None], k: int):
        self.k = k
        self.split = [t.split() if t else [] for t in texts]
        self.counts = np.array([len(s) for s in self.split], np.int64)
        self.words = hashing.word_hashes(self.split)
        self.start, self.owner, self.place = hashing.window_starts(self.counts, k)
        pick = min(PICK, k)
        value, at = least_of(hashing.rolling(self.words, pick), k - pick + 1) if len(self.start) else (self.words[:0], self.start)
        self.value, self.at = value[self.start], at[self.start]

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct picks, ascending, and from how many places each is picked."""
        new = np.concatenate([[True], np.diff(self.at) != 0]) if len(self.at) else np.zeros(0, bool)
        return np.unique(self.value[new], return_counts=True)

    def hashes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.start[some]
        return hashing.rolling(self.words, self.k, hashing.BASES[0])[at], hashing.rolling(self.words, self.k, hashing.BASES[1])[at]


class Suspects:
    """The windows of a slice that may repeat, equal ones as one, in order of their hashes."""

    def __init__(self, windows: Windows, bits: int, answers: dict[int, bytes]):
        picks, _ = windows.picks()
        flags = dealt.told(picks, bits, answers)
        self.some = np.flatnonzero(flags[np.searchsorted(picks, windows.value)]) if len(picks) else np.zeros(0, np.int64)
        h1, h2 = windows.hashes(self.some) if len(self.some) else (windows.words[:0], windows.words[:0])
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(order) else np.zeros(0, bool)
        self.h1, self.h2 = h1[new], h2[new]
        self.sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
        self.which = np.zeros(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def asks(self, bits: int) -> Iterator[tuple[int, bytes]]:
        parts, cuts = dealt.cuts_of(self.h1, bits)
        for p, lo, hi in zip(parts.tolist(), cuts[:-1], cuts[1:], strict=True):
            yield p, self.h1[lo:hi].tobytes() + self.h2[lo:hi].tobytes() + (self.sizes[lo:hi] > 1).tobytes()

    def repeated(self, bits: int, answers: dict[int, bytes]) -> np.ndarray:
        """Which windows repeat, by their number among all of the slice."""
        parts, cuts = dealt.cuts_of(self.h1, bits)
        flags = [np.unpackbits(np.frombuffer(answers[p], np.uint8), count=hi - lo) for p, lo, hi in zip(parts.tolist(), cuts[:-1], cuts[1:], strict=True)]
        return self.some[np.concatenate(flags)[self.which] > 0] if flags else self.some[:0]


def exactly(payloads: list[bytes]) -> list[bytes]:
    """Of a part's windows, a list from each slice, whether each occurs again, here or in its own slice."""
    lengths = [len(p) // 17 for p in payloads]
    h1 = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, lengths, strict=True)])
    h2 = np.concatenate([np.frombuffer(p, np.uint64, n, 8 * n) for p, n in zip(payloads, lengths, strict=True)])
    again = np.concatenate([np.frombuffer(p, bool, n, 16 * n) for p, n in zip(payloads, lengths, strict=True)])
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = again.copy()
    again[order] |= np.repeat(size > 1, size)
    return [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(lengths)[:-1])]


def without(words: list[bytes], places: np.ndarray, k: int) -> tuple[int, bytes]:
    """Number of words removed, and the kept ones joined by a space."""
    if not len(places):
        return 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    change[places] += 1
    np.add.at(change, places + k, -1)
    keep = np.cumsum(change[:-1]) == 0
    return int(len(words) - keep.sum()), b" ".join(compress(words, keep.tolist()))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space.  A word goes if a window of ``window`` words over
    it has the same words as another window, of any text or of the same one, that starts elsewhere; what
    repeats is judged on the texts as they come.  A null text has no words and an empty ``kept_text``;
    texts with fewer words than a window stay whole; texts of any length are searched to the end.
    Rows that repeat a text lose all that a window covers, and so do rows that repeat a doc_id as well.
    Null doc_ids are kept.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    docs, size = dealt.sliced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    windows = size // WORD_BYTES
    least = shuffle_partitions(spark)
    bits = dealt.part_bits(windows * 2 // max(2, window - PICK + 2), least)
    exact_bits = dealt.part_bits(windows * dealt.PART // EXACT, least)

    def texts(table: pa.Table) -> list[bytes | None]:
        hashing.steady_memory()
        return table.column("text").to_pylist()

    def ask_picks(table: pa.Table) -> pa.Table:
        rows = list(dealt.ask(*Windows(texts(table), window).picks(), bits))
        name = table.column("slice")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "slice", "payload"])

    def ask_windows(table: pa.Table, first: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["part", "slice", "payload"])
        rows = list(Suspects(Windows(texts(table), window), bits, by_part(first)).asks(exact_bits))
        name = table.column("slice")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "slice", "payload"])

    def answer(table: pa.Table) -> pa.Table:
        hashing.steady_memory()
        told = exactly([x.as_py() for x in table.column("payload")])
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "told": pa.array(told, pa.binary())})

    def drop(table: pa.Table, both: pa.Table) -> pa.Table:
        names, types = ["doc_id", "n_words", "n_removed", "kept_text"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        w = Windows(texts(table), window)
        exact = np.asarray(both.column("exact")) > 0
        gone = Suspects(w, bits, by_part(both.filter(pa.array(~exact)))).repeated(exact_bits, by_part(both.filter(pa.array(exact))))
        cuts = np.searchsorted(w.owner[gone], np.arange(len(w.split) + 1))
        places = w.place[gone]
        rows = [without(words, places[lo:hi], window) for words, lo, hi in zip(w.split, cuts[:-1], cuts[1:], strict=True)]
        kept = [r[1].decode("utf-8", "replace") for r in rows]
        return pa.table([table.column("doc_id").combine_chunks(), pa.array(w.counts), pa.array([r[0] for r in rows], pa.int64()), pa.array(kept, pa.string())], names)

    first = dealt.answered(docs.groupBy("slice").applyInArrow(ask_picks, dealt.ASKS), bits, may_repeat)
    asked = docs.groupBy("slice").cogroup(first.groupBy("slice")).applyInArrow(ask_windows, dealt.ASKS)
    exact = asked.repartition(max(least, 1 << exact_bits), "part").groupBy("part").applyInArrow(answer, dealt.ANSWERS)
    both = first.withColumn("exact", F.lit(0)).unionByName(exact.withColumn("exact", F.lit(1)))
    return docs.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(drop, "doc_id long, n_words long, n_removed long, kept_text string")


def by_part(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers.column("part").to_pylist(), answers.column("told").to_pylist(), strict=True))
