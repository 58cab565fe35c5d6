"""Cropped or edited copies of images by local descriptors.

A media column holds grey pictures as binary PGM.  Corners are found at scales a third of an octave apart, down
to the smallest that holds a descriptor; each is described by binary tests in a neighbourhood turned to its own
orientation.  A corner and one of its nearest neighbours, with how they lie to each other, are an entry of a
table; pictures that share an entry are compared: their descriptors are matched by Hamming distance, and a
copy needs enough matches that agree on one shift, turn and change of scale.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.components import connected_components
from logweir.llm.storage import materialize

#: Between one scale and the next.
STEP = 2 ** (1 / 3)
#: Pixels around a corner in which it is the strongest: so many at least, and one more for each so many pixels of the level's side.
APART, SIDE_APART = 2, 150
RADIUS = 7
BITS, TURNS = 128, 32
#: Neighbours that a corner has entries with.
NEIGHBOURS = 4
#: Differing bits of a match, pixels by which it may miss the common placement, and matches that make a copy:
#: so many at least, and this share of the corners of the picture that has fewer.
NEAR, MISS, MATCHES, SHARE = 20, 3.5, 7, 0.2
SEED = 8
#: Steps in which a picture is compared with one other.
STARS = 2
#: Distances that are held at once.
CELLS = 1 << 18


def pattern() -> np.ndarray:
    """[turn, test, end, (dy, dx)]: pairs of points in a disc, drawn once and turned by each step."""
    rng = np.random.default_rng(SEED)
    points = np.clip(rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    angles = 2 * np.pi * np.arange(TURNS) / TURNS
    c, s = np.cos(angles)[:, None, None], np.sin(angles)[:, None, None]
    y, x = points[None, ..., 0], points[None, ..., 1]
    return np.rint(np.stack([y * c + x * s, x * c - y * s], axis=-1)).astype(np.int64)


PATTERN = pattern()
# The tests whose outcomes an entry has.  They were chosen one by one, on the corners of 40 random
# textures, for outcomes that are even and little correlated with those chosen before.
CODED = np.array([9, 123, 42, 46, 124, 50, 120, 73, 77, 57, 8, 22, 117, 79, 16, 0, 90, 32, 59, 49])


def levels(height: int, width: int) -> list[float]:
    """By how much a picture is made smaller, while corners fit in."""
    out, by = [], 1.0
    while min(int(height / by), int(width / by)) > 2 * RADIUS + 3:
        out.append(by)
        by *= STEP
    return out


def apart_at(height: int, width: int) -> int:
    """Large levels have corners farther apart, so their number grows slower than the area; a crop has those of its source, and more."""
    return max(APART, round(math.sqrt(height * width) / SIDE_APART))
DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """A binary PGM of up to 8 bits as an array, or None if it isn't one."""
    try:
        fields, at = [], 0
        while len(fields) < 4:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
                if end > len(data):
                    return None
            fields.append(data[at:end])
            at = end
        width, height = int(fields[1]), int(fields[2])
        if fields[0] != b"P5" or int(fields[3]) > 255 or len(data) < at + 1 + width * height:
            return None
        return np.frombuffer(data, np.uint8, width * height, at + 1).reshape(height, width)
    except (ValueError, IndexError, TypeError):
        return None


def write_pgm(picture: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (picture.shape[1], picture.shape[0]) + np.ascontiguousarray(picture, np.uint8).tobytes()


def smaller(stack: np.ndarray, by: float) -> np.ndarray:
    """Pictures made smaller by taking the mean of what falls on a pixel, along each axis in turn."""
    if by == 1.0:
        return stack
    for axis in (1, 2):
        n = int(stack.shape[axis] / by)
        edges = np.arange(n + 1) * by
        sums = np.concatenate([np.zeros_like(stack.take([0], axis)), np.cumsum(stack, axis)], axis)
        whole = np.minimum(edges.astype(int), stack.shape[axis] - 1)
        rest = (edges - whole).reshape([-1 if a == axis else 1 for a in range(3)])
        at = sums.take(whole, axis) + rest * (sums.take(whole + 1, axis) - sums.take(whole, axis))
        stack = np.diff(at, axis=axis) / by
    return stack


def blurred(stack: np.ndarray) -> np.ndarray:
    """Mean of 3 x 3 pixels; the edge repeats."""
    p = np.pad(stack, ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return (rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:]) / 9


def corners(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[picture, corner, (y, x)] of all peaks of the Harris response, and whether each exists.

    A peak is the greatest within ``apart_at`` pixels, so whether there is one depends on its neighbourhood
    alone, and a crop has the corners of its source.
    """
    n, h, w = stack.shape
    room, apart = RADIUS + 1, apart_at(h, w)
    if h <= 2 * room + 1 or w <= 2 * room + 1:
        return np.zeros((n, 0, 2), np.int64), np.zeros((n, 0), bool)
    gy, gx = np.gradient(stack, axis=(1, 2))
    yy, xx, xy = blurred(gy * gy), blurred(gx * gx), blurred(gy * gx)
    r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    p = np.pad(r, ((0, 0), (apart, apart), (apart, apart)), constant_values=-np.inf)
    peak = r > 1e-3
    for dy in range(2 * apart + 1):
        for dx in range(2 * apart + 1):
            if (dy, dx) != (apart, apart):
                other = p[:, dy : dy + h, dx : dx + w]
                peak &= (r > other) if (dy, dx) < (apart, apart) else (r >= other)
    inner = peak[:, room:-room, room:-room].reshape(n, -1)
    most = int(inner.sum(1).max(initial=0))
    best = np.argsort(~inner, axis=1, kind="stable")[:, :most]
    at = np.stack([best // (w - 2 * room) + room, best % (w - 2 * room) + room], axis=2)
    return at, np.take_along_axis(inner, best, 1)


def describe(stack: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Of pictures of one size: place (y, x in the picture), scale, angle and bits of each one's corners."""
    n = len(stack)
    found: list[list[np.ndarray]] = [[] for _ in range(4)]
    exists = []
    for by in levels(*stack.shape[1:]):
        level = smaller(stack.astype(np.float32), by)
        at, there = corners(level)
        soft = blurred(level)
        pick = np.arange(n)[:, None, None]
        angle, bits = np.zeros(at.shape[:2], level.dtype), np.zeros((*at.shape[:2], BITS // 8), np.uint8)
        step = max(1, 10_000 // n)
        for lo in range(0, at.shape[1], step):  # corners in memory at a time
            here = at[:, lo : lo + step]
            disc = level[pick, here[:, :, None, 0] + DISC[:, 0], here[:, :, None, 1] + DISC[:, 1]]
            angle[:, lo : lo + step] = np.arctan2((disc * DISC[:, 0]).sum(2), (disc * DISC[:, 1]).sum(2))
            turn = np.rint(angle[:, lo : lo + step] / (2 * np.pi) * TURNS).astype(int) % TURNS
            tests = PATTERN[turn]
            spots = soft[pick[..., None], here[:, :, None, None, 0] + tests[..., 0], here[:, :, None, None, 1] + tests[..., 1]]
            bits[:, lo : lo + step] = np.packbits(spots[..., 0] < spots[..., 1], axis=2)
        found[0].append((at + 0.5) * by)
        found[1].append(np.full(at.shape[:2], by))
        found[2].append(angle)
        found[3].append(bits)
        exists.append(there)
    if not exists:
        return [{"place": np.zeros((0, 2)), "scale": np.zeros(0), "angle": np.zeros(0), "bits": np.zeros((0, BITS // 8), np.uint8)}] * n
    place, scale, angle, bits = (np.concatenate(x, 1) for x in found)
    there = np.concatenate(exists, 1)
    return [{"place": place[i, m], "scale": scale[i, m], "angle": angle[i, m], "bits": bits[i, m]} for i, m in enumerate(there)]


def pack_features(f: dict[str, np.ndarray]) -> bytes:
    """Corners as rows of four 32-bit floats and the descriptor."""
    numbers = np.concatenate([f["place"], f["scale"][:, None], f["angle"][:, None]], 1).astype("<f4")
    return np.concatenate([numbers.view(np.uint8).reshape(len(numbers), 16), f["bits"]], 1).tobytes()


def unpack_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 16 + BITS // 8)
    return np.ascontiguousarray(rows[:, :16]).view("<f4").astype(np.float64), rows[:, 16:]


Corners = tuple[np.ndarray, np.ndarray]


def words(bits: np.ndarray) -> np.ndarray:
    """Descriptors as rows of 64-bit words."""
    return np.ascontiguousarray(bits).view(np.uint64)


def entries(numbers: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Distinct entries of a picture's corners, as unpacked: hashes of a corner's code, a neighbour's, and where and how the neighbour lies.

    Neighbours are the nearest of the same scale.  Direction and turn are taken from the corner's own
    orientation, in eighths of a circle, the distance in powers of two of the scale's pixels.
    """
    out = [np.zeros(0, np.uint64)]
    outcomes = np.unpackbits(bits, axis=1).astype(np.uint64)
    code = outcomes[:, CODED] @ (np.uint64(1) << np.arange(len(CODED), dtype=np.uint64))
    eighth = lambda angle: (angle % (2 * np.pi) / (2 * np.pi) * 8).astype(np.uint64) % np.uint64(8)
    for by in np.unique(numbers[:, 2]):
        m = np.flatnonzero(numbers[:, 2] == by)
        k = min(NEIGHBOURS, len(m) - 1)
        if k < 1:
            continue
        y, x, _, angles = numbers[m].T
        step = max(1, 4 * CELLS // len(m))
        for at in range(0, len(m), step):
            own = np.arange(at, min(len(m), at + step))
            apart = (y[own, None] - y) ** 2 + (x[own, None] - x) ** 2
            apart[np.arange(len(own)), own] = np.inf
            near = np.argsort(apart, axis=1, kind="stable")[:, :k]
            direction = np.arctan2(y[near] - y[own, None], x[near] - x[own, None])
            far = np.minimum(np.log2(np.sqrt(np.take_along_axis(apart, near, 1)) / by + 1).astype(np.uint64), 7)
            lie = eighth(direction - angles[own, None]) * np.uint64(64) + eighth(angles[near] - angles[own, None]) * np.uint64(8) + far
            with np.errstate(over="ignore"):
                mixed = code[m][own, None] * np.uint64(0x9E3779B97F4A7C15) ^ (code[m][near] * np.uint64(0xC2B2AE3D27D4EB4F) + lie * np.uint64(0xD6E8FEB86659FD93))
                out.append((mixed * np.uint64(0xA0761D6478BD642F)).ravel())
    return np.unique(np.concatenate(out))


def nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the descriptors ``y``, the first nearest one of ``x`` within NEAR, and the bits in which the nearest differs."""
    least, first = np.full(len(y), 255, np.uint8), np.zeros(len(y), np.int64)
    step = max(1, CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        apart = np.bitwise_count(x[at : at + step, None, 0] ^ y[:, 0])
        for k in range(1, x.shape[1]):
            apart += np.bitwise_count(x[at : at + step, None, k] ^ y[:, k])
        here = apart.min(0)
        less = np.flatnonzero((here < least) & (here <= NEAR))
        first[less] = apart[:, less].argmin(0) + at
        least = np.minimum(least, here)
    return first, least


def mutual(x: np.ndarray, y: np.ndarray, j: np.ndarray, i: np.ndarray, least: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the corners ``j`` of ``y`` that are in turn the nearest, within their picture, of the corner ``i`` of ``x``.

    ``j`` holds all corners within NEAR of one of ``x``, picture by picture, so what is nearer is among them.
    """
    if not len(j):
        return j, i, owner
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(j))))
    good = np.zeros(len(j), bool)
    step = max(1, CELLS // len(j))
    for at in range(0, len(x), step):
        apart = np.bitwise_count(x[at : at + step, None, 0] ^ y[j, 0])
        for k in range(1, x.shape[1]):
            apart += np.bitwise_count(x[at : at + step, None, k] ^ y[j, k])
        best = np.minimum.reduceat(apart, begin, axis=1)
        mine = np.flatnonzero((i >= at) & (i < at + step))
        good[mine] = best[i[mine] - at, group[mine]] == least[mine]
    good = np.flatnonzero(good)
    first = good[np.sort(np.unique(group[good] * len(x) + i[good], return_index=True)[1])]
    return j[first], i[first], owner[first]


def one_placement(p: np.ndarray, q: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of each picture, the most matches that one placement explains: [picture, match] corners ``p`` with ``q``.

    Every match proposes a placement: its change of scale, its turn, and the shift that lays its corner on
    the other; all matches are tried under each.  ``there`` tells which matches exist.
    """
    p, q = p.astype(np.float32), q.astype(np.float32)
    s, t = q[..., 2] / p[..., 2], q[..., 3] - p[..., 3]
    c, d = s * np.cos(t), s * np.sin(t)
    most, step = np.zeros(len(p), np.int64), max(1, CELLS // max(1, there.size))
    for at in range(0, there.shape[1], step):
        h = slice(at, at + step)
        dy, dx = p[:, None, :, 0] - p[:, h, 0, None], p[:, None, :, 1] - p[:, h, 1, None]
        bound = (MISS * np.maximum(1, s[:, h]))[..., None]
        near = np.abs(c[:, h, None] * dy + d[:, h, None] * dx + q[:, h, 0, None] - q[:, None, :, 0]) <= bound
        near &= np.abs(c[:, h, None] * dx - d[:, h, None] * dy + q[:, h, 1, None] - q[:, None, :, 1]) <= bound
        near &= there[:, None, :] & there[:, h, None]
        most = np.maximum(most, near.sum(2).max(1))
    return most


def needed(a: int, b: np.ndarray, matches: int, share: float) -> np.ndarray:
    """Matches that pictures of so many corners need with one of ``a`` corners."""
    return np.maximum(matches, np.ceil(share * np.minimum(a, b)).astype(np.int64))


def linked(a: Corners, numbers: np.ndarray, bits: np.ndarray, starts: np.ndarray, matches: int = MATCHES, share: float = SHARE) -> np.ndarray:
    """Which pictures have as many corners as a copy needs that agree with those of ``a`` on one placement.

    The pictures' corners follow each other; ``starts`` has where each begins, and the end of the last.
    Corners match if each is the other's nearest in the two pictures, the first of equally near ones.
    """
    p, x = a
    out = np.zeros(len(starts) - 1, bool)
    if not len(p):
        return out
    lo, least_of = 0, needed(len(p), np.diff(starts), matches, share)
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CELLS // len(p), side="right")) - 1)
        base, cuts = starts[lo], starts[lo : hi + 1] - starts[lo]
        y = bits[base : starts[hi]]
        i, least = nearest(x, y)
        least_here = least_of[lo:hi]
        owner = np.repeat(np.arange(hi - lo), np.diff(cuts))
        j = np.flatnonzero(least <= NEAR)
        chosen = np.zeros((hi - lo, len(p)), bool)
        chosen[owner[j], i[j]] = True
        j = j[(chosen.sum(1) >= least_here)[owner[j]]]
        j, i, owner = mutual(x, y, j, i[j], least[j], owner[j])
        counts = np.bincount(owner, minlength=hi - lo)
        full = np.flatnonzero(counts >= least_here)
        if len(full):
            keep = (counts >= least_here)[owner]
            j, i, owner = j[keep], i[keep], owner[keep]
            sizes = counts[full]
            begin = np.cumsum(sizes) - sizes
            order = np.argsort(sizes, kind="stable")
            for at in np.array_split(order, max(1, len(order) * int(sizes.max()) ** 2 // (4 * CELLS))):
                if not len(at):
                    continue
                there = np.arange(int(sizes[at].max())) < sizes[at][:, None]
                m = np.where(there, begin[at][:, None] + np.arange(there.shape[1]), begin[at][:, None])
                out[lo + full[at]] = one_placement(p[i[m]], numbers[j[m] + base], there) >= least_here[full[at]]
        lo = hi
    return out


def agreeing(a: bytes, others: list[bytes], matches: int = MATCHES, share: float = SHARE) -> np.ndarray:
    """Which of the other pictures' corners, as packed, are linked with those of ``a``."""
    p, x = unpack_features(a)
    parts = [unpack_features(b) for b in others]
    starts = np.concatenate([[0], np.cumsum([len(q) for q, _ in parts])]).astype(np.int64)
    return linked((p, words(x)), np.concatenate([q for q, _ in parts]), words(np.concatenate([y for _, y in parts])), starts, matches, share)


def verified(pairs: DataFrame, own: DataFrame, matches: int, share: float, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, from the corners (node, features) of both."""
    import pyarrow as pa

    both = pairs.join(own.select(F.col("node").alias("b"), F.col("features").alias("fb")), "b").join(own.select(F.col("node").alias("a"), F.col("features").alias("fa")), "a")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
            keep = [agreeing(batch.column(2)[lo].as_py(), batch.column(3).slice(lo, hi - lo).to_pylist(), matches, share) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if lo < hi]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return materialize(both.select("a", "b", "fa", "fb").mapInArrow(check, "a long, b long"), name)


def copies(images: DataFrame, matches: int = MATCHES, share: float = SHARE) -> DataFrame:
    """image_id, n_corners, component_id of ``images`` (image_id, image as binary PGM).

    Two different pictures are linked if ``matches`` of their corners, and a ``share`` of the corners of the one
    that has fewer, agree on one placement; the component is the least image_id that links reach.  Equal pictures are one
    class.  A null image, one that can't be read, or one without corners has none and is linked with its
    equals alone (a null with nothing).  Pictures of any size are taken whole; repeated rows are in one
    class; null ids don't count as least.  An empty table gives no rows; other columns are not read.

    Pictures that share an entry are compared in steps: each with the one picture that is most often the first of its
    entries, again among those that aren't connected yet, and at last all that share an entry and still aren't.  So a
    group of copies costs a few comparisons for each, and no pair that could change a component is left out.  An entry
    whose pictures are all connected stays so, and later steps leave it out.  A copy that shares no entry is missed.
    """
    import pyarrow as pa

    images = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("image").cast("binary").alias("image"))
    images = images.withColumn("digest", F.md5("image"))
    classes = images.filter(F.col("image").isNotNull()).groupBy("digest").agg(F.min("image_id").alias("least"), F.min("image").alias("image"))
    classes = classes.withColumn("node", F.monotonically_increasing_id())

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "digest", "least", "n_corners", "features"]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                pictures = [read_pgm(x.as_py()) for x in part.column(3)]
                out: list[dict | None] = [None] * len(pictures)
                for shape in {p.shape for p in pictures if p is not None and p.size}:
                    some = [i for i, p in enumerate(pictures) if p is not None and p.shape == shape]
                    for lo in range(0, len(some), max(1, 500_000 // (shape[0] * shape[1]))):
                        mine = some[lo : lo + max(1, 500_000 // (shape[0] * shape[1]))]
                        for i, f in zip(mine, describe(np.stack([pictures[i] for i in mine])), strict=True):
                            out[i] = f
                rows = [(0, b"") if f is None else (len(f["bits"]), pack_features(f)) for f in out]
                arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *arrays], names)

    described = classes.select("node", "digest", "least", "image").mapInArrow(features, "node long, digest string, least long, n_corners int, features binary")
    described = materialize(described, "image-features")
    own = described.select("node", "features")

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [entries(*unpack_features(x.as_py())).view(np.int64) for x in part.column(1)]
                nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(found))], ["node", "entry"])

    tables = own.mapInArrow(enter, "node long, entry long")
    same = Window.partitionBy("entry")  # two numbers a row, which Spark spills where an entry is widespread
    tables = tables.withColumn("_lo", F.min("node").over(same)).withColumn("_hi", F.max("node").over(same))
    shared = materialize(tables.filter(F.col("_lo") < F.col("_hi")).select("entry", "node"), "image-entries")

    links: DataFrame | None = None
    tested: DataFrame | None = None
    open_ = shared.withColumn("_c", F.col("node"))
    for k in range(STARS + 1):
        if links is not None:
            known = materialize(connected_components(links, "image-components"), "image-known")
            # one row for each of open_: a node is known once
            placed = open_.select("entry", "node").join(known.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("entry", "node", F.coalesce("component", "node").alias("_c"))
            placed = placed.withColumn("_lo", F.min("_c").over(same)).withColumn("_hi", F.max("_c").over(same))
            open_ = materialize(placed.filter(F.col("_lo") < F.col("_hi")).select("entry", "node", "_c"), "image-open")
        if k < STARS:
            first = open_.withColumn("_m", F.min(F.struct("_c", "node")).over(same)).filter(F.col("_c") != F.col("_m._c"))
            met = first.groupBy("node", F.col("_m.node").alias("a")).agg(F.count(F.lit(1)).alias("_times"))
            best = met.groupBy("node").agg(F.max_by("a", F.struct("_times", (-F.col("a")).alias("_first"))).alias("_a"))
            pairs = best.select(F.least("_a", "node").alias("a"), F.greatest("_a", "node").alias("b")).distinct()
        else:
            one, two = open_.select("entry", F.col("node").alias("a"), F.col("_c").alias("_ca")), open_.select("entry", F.col("node").alias("b"), F.col("_c").alias("_cb"))
            pairs = one.join(two, "entry").filter((F.col("a") < F.col("b")) & (F.col("_ca") != F.col("_cb"))).select("a", "b").distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "image-pairs")
        found = verified(pairs, own, matches, share, "image-links")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)

    members = connected_components(links, "image-components").join(described.select("node", "least"), "node")
    members = materialize(members, "image-members")
    names = members.groupBy("component").agg(F.min("least").alias("_id"))
    named = members.join(names, "component").select("node", "_id")
    facts = described.select("node", "digest", "least", "n_corners").join(named, "node", "left").drop("node")
    out = images.select("image_id", "digest").join(facts, "digest", "left")
    return out.select("image_id", F.coalesce("n_corners", F.lit(0)).alias("n_corners"), F.coalesce("_id", "least", "image_id").alias("component_id"))


def field(k: int, side: int) -> np.ndarray:
    """A fixed pattern of fine and coarse grain for the k-th component of a vector."""
    rng = np.random.default_rng([SEED, k])
    fine, coarse = rng.normal(size=(2, 1, side, side))
    for n, stack in ((2, fine), (12, coarse)):
        for _ in range(n):
            stack[:] = blurred(stack)
    return (fine / fine.std() + coarse / coarse.std())[0]


def textures(vectors: DataFrame, side: int = 72) -> DataFrame:
    """image_id, image: each vector as a picture, its components the weights of fixed patterns.

    The given tables have no media column; this makes one, of all vectors, in which near-copies of a vector
    are edited copies of a picture, and each part of a picture depends on the whole vector.  Null vectors have
    null pictures; null and non-finite components count as 0; an empty vector, or one of zeros, is grey.
    """
    import pyarrow as pa

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = np.zeros((0, side, side))
        for batch in batches:
            out = []
            for v in batch.column(1):
                if not v.is_valid:
                    out.append(None)
                    continue
                x = np.nan_to_num(np.array([0.0 if c is None else c for c in v.as_py()], np.float64), posinf=0.0, neginf=0.0)
                if len(x) > len(patterns):
                    patterns = np.concatenate([patterns, [field(k, side) for k in range(len(patterns), len(x))]])
                most = np.abs(x).max(initial=0.0)
                x = x / most / np.sqrt(((x / most) ** 2).sum()) if most else x
                out.append(write_pgm(np.clip(128 + 50 * np.tensordot(x, patterns[: len(x)], 1), 0, 255).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(draw, "image_id long, image binary")
