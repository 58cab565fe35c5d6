"""Questions about all hashes of a corpus, dealt over parts of the hash space and answered there.

Texts are dealt into slices of some megabytes by one shuffle, which every pass over them uses again.  A
slice sends each part its hashes, sorted, as differences; the part's task answers with one number for each
hash, in the order asked, and the slice, which makes the same hashes again, knows whose answer is whose.
Parts and slices grow in number with the input, not in size, so no step saturates, and nothing is broadcast.
A hash that fills the corpus is asked about once by each slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.hashing import steady_memory
from logweir.llm.storage import shuffle_partitions

#: Bytes of text in a slice and in a task, and hashes in a part, about.
SLICE, TASK, PART = 4 << 20, 64 << 20, 3_000_000
#: Bits of a hash that are sent, besides those that name its part.
SENT = 48

ASKS = "part int, slice long, payload binary"
ANSWERS = "slice long, part int, told binary"


def sliced(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """``docs`` with a column ``slice``, dealt out by it, and the bytes of all texts.

    Wholly equal rows differ by the partition that they come from, so copies of one row don't fill a slice.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_slices = max(1, -(-size // SLICE))
    name = F.pmod(F.xxhash64(*docs.columns, F.spark_partition_id()), F.lit(n_slices))
    n = max(shuffle_partitions(docs.sparkSession), -(-size // TASK))
    return docs.withColumn("slice", name).repartition(int(n), "slice"), size


def part_bits(expected: int, least: int) -> int:
    """Bits that name a part: for parts of about PART hashes, and ``least`` parts or more."""
    return max(1, (max(least, -(-expected // PART)) - 1).bit_length())


def packed(sorted_codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes of SENT bits and a count each (255: or more), as differences with their bytes in planes."""
    steps = np.diff(sorted_codes, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T[: SENT // 8]
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(steps)).tobytes() + planes.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    wide = np.zeros((8, n), np.uint8)
    wide[: SENT // 8] = np.frombuffer(raw, np.uint8, SENT // 8 * n, 4).reshape(-1, n)
    return np.cumsum(np.ascontiguousarray(wide.T).view("<u8").ravel(), dtype=np.uint64), np.frombuffer(raw, np.uint8, offset=4 + SENT // 8 * n)


def cuts_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted hashes belong to, and where each part's begin, with the end of the last."""
    part = hashes >> np.uint64(64 - bits)
    parts, first = np.unique(part, return_index=True)
    return parts.astype(np.int64), np.append(first, len(hashes))


def ask(hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """(part, payload) of a slice's distinct hashes, which ascend, with how often each occurs in the slice."""
    parts, cuts = cuts_of(hashes, bits)
    codes = (hashes << np.uint64(bits)) >> np.uint64(64 - SENT)
    for p, lo, hi in zip(parts.tolist(), cuts[:-1], cuts[1:], strict=True):
        yield p, packed(codes[lo:hi], counts[lo:hi])


def told(hashes: np.ndarray, bits: int, answers: dict[int, bytes]) -> np.ndarray:
    """What was answered to a slice's distinct hashes, which ascend, a byte each."""
    parts, _ = cuts_of(hashes, bits)
    out = [np.frombuffer(zstandard.ZstdDecompressor().decompress(answers[p]), np.uint8) for p in parts.tolist()]
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def answered(asks: DataFrame, bits: int, judge: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """Answers (slice, part, told) to ``asks``: ``judge`` gets all codes and counts of a part, a list by slice, and tells a byte for each."""
    import pyarrow as pa

    def answer(table: pa.Table) -> pa.Table:
        steady_memory()
        got = [unpacked(x.as_py()) for x in table.column("payload")]
        given = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, np.uint8).tobytes()) for x in judge([g[0] for g in got], [g[1] for g in got])]
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "told": pa.array(given, pa.binary())})

    n = max(shuffle_partitions(asks.sparkSession), 1 << bits)
    return asks.repartition(n, "part").groupBy("part").applyInArrow(answer, ANSWERS)


def levels(codes: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """How often each code occurs in all, as the bit length of the count."""
    flat = np.concatenate(codes)
    order = np.argsort(flat, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0])) if len(flat) else np.zeros(0, np.int64)
    sums = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], new) if len(flat) else new
    out = np.zeros(len(flat), np.uint8)
    out[order] = np.repeat(np.minimum(np.searchsorted(1 << np.arange(62), sums, side="right"), 62), np.diff(np.append(new, len(flat))))
    return np.split(out, np.cumsum([len(c) for c in codes])[:-1])
