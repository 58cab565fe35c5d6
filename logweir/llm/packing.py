"""Best-fit packing of documents into sequences by a linear grouping scheme.

Pieces are packed by length, not one by one: lengths are whole numbers up to the sequence length, so
their histogram has a fixed number of rows however large the corpus.  A plan made from the histogram
says, for every length and stretch of ranks, into which sequences and at which offset those pieces go.
The plan too is bounded by the number of lengths, not of pieces; each piece finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import tokens
from logweir.llm.ranking import rank_within
from logweir.llm.storage import lean_batches, materialize

#: Numbers of groups that are tried; the plan with the fewest sequences is used.
GROUPS = (8, 12, 16, 24)

#: A stretch of the plan: pieces of ``length`` with rank lo <= rank < hi; every ``per`` of them share a sequence.
Stretch = tuple[int, int, int, int, int, int]  # length, lo, hi, first sequence, offset, per


def simplex_masters(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> dict[tuple[int, ...], float]:
    """Configurations of few sizes and how often to use each: the fractional optimum, by column generation.

    The basis starts with one size to a sequence.  Prices come from the basis; a knapsack over the
    capacity finds the configuration worth most at these prices, which enters while it is worth over 1.
    """
    k = len(sizes)
    columns = [tuple((capacity // s) * (i == j) for j in range(k)) for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        price = np.ones(k) @ inverse
        best = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        for j in range(k):  # unbounded knapsack, a size at a time; whole multiples in one pass each
            for _ in range(capacity // sizes[j]):
                better = best[: -sizes[j]] + price[j] > best[sizes[j] :] + 1e-12
                if not better.any():
                    break
                grown = np.where(better, best[: -sizes[j]] + price[j], best[sizes[j] :])
                at = np.nonzero(better)[0] + sizes[j]
                best[sizes[j] :] = grown
                took[at] = j
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = [0] * k, capacity
        while room > 0 and took[room] >= 0:
            column[took[room]] += 1
            room -= sizes[took[room]]
        way = inverse @ np.array(column, float)
        ratios = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        leaves = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaves]):
            break
        step = ratios[leaves]
        x = x - step * way
        x[leaves] = step
        columns[leaves] = tuple(column)
        inverse[leaves] /= way[leaves]
        for i in range(k):
            if i != leaves:
                inverse[i] -= way[i] * inverse[leaves]
    return {c: float(v) for c, v in zip(columns, x, strict=True) if v > 1e-9}


def plan_packing(counts: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS, small: float = 0.125) -> tuple[list[Stretch], int]:
    """The plan that uses the fewest sequences, of one for each number of groups."""
    if not groups or min(groups) < 1:
        raise ValueError("a plan has one group or more")
    return min((grouped_plan(counts, capacity, g, small) for g in groups), key=lambda plan: plan[1])


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, small: float) -> tuple[list[Stretch], int]:
    """A plan for the pieces counted by length, and the number of sequences it uses.

    Lengths above ``small`` of the capacity are large.  The large pieces, longest first, form groups of
    equal cardinality, or one for each length if there are no more lengths than groups; each group's
    pieces count as its longest.  A linear program over these few sizes
    chooses configurations; whole uses of each are kept, and actual pieces take the slots of their group,
    longest first, so slots hold runs of one length.  What the rounding down leaves over, and then the
    small pieces, go longest first into the sequence with the least room that holds them.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    out: list[Stretch] = []
    n_bins = 0
    full = counts.pop(capacity, 0)
    if full:
        out.append((capacity, 0, full, 0, 0, 1))
        n_bins = full
    if counts.get(0):
        raise ValueError("pieces have at least one token")
    large = sorted((s for s in counts if s > small * capacity), reverse=True)
    n_large = sum(counts[s] for s in large)
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room: (first sequence, how many, filled up to)

    def open_room(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
            rooms[room].append((first, n, capacity - room))

    if n_large:
        per_group = -(-n_large // groups)
        grouped: list[list[list[int]]] = []
        left, sizes, demand = 0, [], []
        for s in large:
            lo, n = 0, counts[s]
            while n:
                if not left or len(large) <= groups and not lo:
                    grouped.append([])
                    sizes.append(s)
                    demand.append(0)
                    left = per_group
                take = min(n, left)
                grouped[-1].append([s, lo, take])
                demand[-1] += take
                lo, n, left = lo + take, n - take, left - take
        # groups of one size are one size to the program
        by_size: dict[int, int] = {}
        for i, s in enumerate(sizes):
            if s in by_size:
                grouped[by_size[s]] += grouped[i]
                demand[by_size[s]] += demand[i]
                demand[i] = 0
            else:
                by_size[s] = i
        keep = [i for i in range(len(sizes)) if demand[i]]
        sizes, demand, grouped = [sizes[i] for i in keep], [demand[i] for i in keep], [grouped[i] for i in keep]
        uses = simplex_masters(sizes, demand, capacity)
        queue = [list(map(list, g)) for g in grouped]
        for config, times in sorted(uses.items(), reverse=True):
            m = int(times + 1e-6)
            for c, d in zip(config, [sum(r[2] for r in q) for q in queue], strict=True):
                if c:
                    m = min(m, d // c)
            if not m:
                continue
            # cuts of 0..m at which some slot goes over to another length
            state = [(0, m, 0)]  # from, to, filled
            for g, c in enumerate(config):
                for _ in range(c):
                    at, split = 0, []
                    pieces = iter(state)
                    frm, to, filled = next(pieces)
                    while True:
                        run = queue[g][0]
                        n = min(run[2], to - frm)
                        out.append((run[0], run[1], run[1] + n, n_bins + frm, filled, 1))
                        split.append((frm, frm + n, filled + run[0]))
                        run[1], run[2] = run[1] + n, run[2] - n
                        if not run[2]:
                            queue[g].pop(0)
                        frm, at = frm + n, at + n
                        if frm == to:
                            nxt = next(pieces, None)
                            if nxt is None:
                                break
                            frm, to, filled = nxt
                    state = split
            for frm, to, filled in state:
                open_room(capacity - filled, n_bins + frm, to - frm)
            n_bins += m
        rest = [run for q in queue for run in q if run[2]]
    else:
        rest = []
    small_runs = [[s, 0, counts[s]] for s in sorted((s for s in counts if s <= small * capacity), reverse=True)]
    sizes_left = sorted(rest, key=lambda r: -r[0]) + small_runs
    order = sorted(rooms)

    for s, lo, n in sizes_left:
        while n:
            i = bisect.bisect_left(order, s)
            if i == len(order):
                # new sequences, filled with this length as far as it goes
                per = capacity // s
                bins = -(-n // per)
                first = n_bins
                n_bins += bins
                rooms.setdefault(capacity, []).append((first, bins, 0))
                bisect.insort(order, capacity)
                continue
            room = order[i]
            first, m, filled = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            per = room // s
            whole = min(m, n // per)

            def keep_room(r: int, f: int, k: int) -> None:
                if r > 0 and k > 0:
                    if r not in rooms:
                        rooms[r] = []
                        bisect.insort(order, r)
                    rooms[r].append((f, k, capacity - r))

            if whole:
                out.append((s, lo, lo + whole * per, first, filled, per))
                keep_room(room - per * s, first, whole)
                lo, n = lo + whole * per, n - whole * per
            used = whole
            if n and used < m and n < per:
                out.append((s, lo, lo + n, first + used, filled, n))
                keep_room(room - n * s, first + used, 1)
                used, lo, n = used + 1, lo + n, 0
            keep_room(room, first + used, m - used)
    return out, n_bins


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str | None, end_id: int | None, with_ids: bool, split_words: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each document's pieces."""
    import pyarrow as pa

    tokenizer = tokenizer or tokens.default_path()
    end = b"" if end_id is None else struct.pack("<I", end_id)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.word_ids(tokenizer, split_words)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int | None = 1, groups: tuple[int, ...] = GROUPS, with_ids: bool = False, split_words: bool = True) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if ``with_ids``.  A
    document longer than a sequence is cut into pieces of ``capacity`` tokens, of which the last may be
    shorter; no other document is cut.  A null or empty text is the end id alone (with ``end_id`` None it
    has no piece).  Rows that repeat a doc_id are packed each for itself; a null doc_id is kept.  Ties
    among pieces of one length are settled by doc_id and piece.  An empty table gives no rows.  Other
    columns of ``docs`` are not read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    lean_batches(spark)
    pieces = materialize(pieces_of(docs, capacity, tokenizer, end_id, with_ids, split_words), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    stretches, _ = plan_packing(histogram, capacity, groups)
    stretches.sort()
    table = np.array(stretches, np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast(table)  # bounded by the number of lengths and groups
    ranked = rank_within(pieces, ["length"], [F.col("doc_id").asc_nulls_first(), F.col("piece")], "packing")
    columns = [c for c in pieces.columns]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = plan.value
        key = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            nth = rank - t[i, 1]
            if len(i) and ((t[i, 0] != length) | (rank >= t[i, 2])).any():
                raise ValueError("a piece has no place in the plan")
            per = t[i, 5]
            where = [pa.array(t[i, 3] + nth // per), pa.array(t[i, 4] + nth % per * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + where, [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids: sequence_id, ids, from ``pack(..., with_ids=True)``.

    A sequence has at most ``capacity`` pieces, so collecting it is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.count(F.lit(1)).alias("n_pieces"))
