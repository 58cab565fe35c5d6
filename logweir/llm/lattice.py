"""Near-duplicate embeddings by lattice hashing.

Each table projects the unit vectors at random to eight dimensions and decodes them to points of the E8
lattice.  A vector is stored in the cell of its nearest point and also probes the neighbouring cells
nearest to it.  What meets in a cell is compared by cosine.  Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from logweir.llm.components import connected_components
from logweir.llm.storage import materialize, shuffle_partitions

COSINE = 0.93
#: Tables, neighbouring cells that a vector probes in each, and the lattice's scale: a pair of cosine 0.93
#: meets in one of the tables with probability 0.99, one of 0.95 with 0.999.
TABLES, PROBES, SCALE = 3, 8, 0.5
#: Largest bucket that is compared at once; larger ones are compared chunk by chunk.
BUCKET = 4096
SEED = 20

Projections = tuple[np.ndarray, np.ndarray]


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = roots()


def nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest points of D8: whole coordinates with an even sum."""
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(1) % 2)
    rest = (y - f)[odd]
    worst = np.abs(rest).argmax(1)
    f[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8: D8, or D8 moved by a half."""
    a, b = nearest_even(y), nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def projections(dimensions: int, tables: int = TABLES, scale: float = SCALE, seed: int = SEED) -> Projections:
    rng = np.random.default_rng([seed, dimensions])
    out = []
    for _ in range(tables):
        m = rng.normal(size=(8, max(8, dimensions)))
        out.append(np.linalg.qr(m.T)[0].T[:, :dimensions] * np.sqrt(max(8, dimensions) / 8.0) / scale)
    return np.array(out), rng.random((tables, 8))


def cells(unit: np.ndarray, how: Projections, probes: int = PROBES) -> np.ndarray:
    """Codes of each unit vector's cells: [vector, table, 0] is its own, the rest are probed.

    Sums run in a fixed order, so a vector has the same cells in every batch.
    """
    matrices, offsets = how
    out = np.zeros((len(unit), len(matrices), 1 + probes), np.int64)
    with np.errstate(over="ignore"):
        mix = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(8)], np.uint64)
        for t, (m, offset) in enumerate(zip(matrices, offsets, strict=True)):
            y = np.tile(offset, (len(unit), 1))
            for k in range(unit.shape[1]):
                y += unit[:, k : k + 1] * m[:, k]
            own = nearest_e8(y)
            toward = np.zeros((len(unit), len(ROOTS)))
            for k in range(8):
                toward += (y - own)[:, k : k + 1] * ROOTS[:, k]
            near = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
            points = np.concatenate([own[:, None, :], own[:, None, :] + ROOTS[near]], axis=1)
            out[:, t] = ((2 * points).astype(np.int64).astype(np.uint64) * mix).sum(2).astype(np.int64)
    return out


def unit_vectors(column) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision."""
    x = np.array(column.to_pylist(), np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def compare(rows: np.ndarray, columns: np.ndarray, threshold: float, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors whose cosine reaches the threshold, some rows at a time."""
    for at in range(0, len(rows), block):
        i, j = np.nonzero(rows[at : at + block] @ columns.T >= threshold)
        yield i + at, j


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a[i] - b[i]: what is linked, also by others, has the least label of all."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, least = a[apart], b[apart], np.minimum(x, y)[apart]
        np.minimum.at(label, x[apart], least)
        np.minimum.at(label, y[apart], least)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def join_bucket(table: int, cell: int, left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None, threshold: float) -> Iterator[tuple[int, int | None, int]]:
    """Links found in a bucket: (node, None, weight of links) and edges (node, other, 0) that span them.

    At least one of a pair has the cell as its own.  A pair that meets in several buckets counts in the
    first: the first table in which it meets at all, and there the cell with the lesser code.
    """
    same = right is None
    right = left if same else right
    codes_l, codes_r = left["codes"], right["codes"]
    weights_l, weights_r = np.zeros(len(left["node"]), np.int64), np.zeros(len(right["node"]), np.int64)
    shift = 0 if same else len(left["node"])
    nodes = left["node"] if same else np.concatenate([left["node"], right["node"]])
    label = np.arange(len(nodes))
    for i, j in compare(left["unit"], right["unit"], threshold):
        keep = (left["home"][i] | right["home"][j]) & (i < j if same else left["node"][i] != right["node"][j])
        i, j = i[keep], j[keep]
        for lo in range(0, len(i), 200_000):
            a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
            open_ = np.ones(len(a), bool)
            mine = np.zeros(len(a), bool)
            for t in range(table + 1):
                own_a, own_b = codes_l[a, t, 0], codes_r[b, t, 0]
                at_a = (codes_r[b, t] == own_a[:, None]).any(1)
                at_b = (codes_l[a, t] == own_b[:, None]).any(1)
                if t == table:
                    first = np.where(at_a & at_b, np.minimum(own_a, own_b), np.where(at_a, own_a, own_b))
                    mine = open_ & (first == cell)
                open_ &= ~(at_a | at_b)
            a, b = a[mine], b[mine]
            np.add.at(weights_l, a, right["mult"][b])
            np.add.at(weights_l if same else weights_r, b, left["mult"][a])
            label = joined(label, a, b + shift)
    for side, weights in ((left, weights_l), (right, weights_r)):
        for k in np.flatnonzero(weights):
            yield int(side["node"][k]), None, int(weights[k])
        if same:
            break
    for k in np.flatnonzero(label != np.arange(len(label))):
        yield int(nodes[k]), int(nodes[label[k]]), 0


def components_of(vectors: DataFrame) -> str:
    """The type that holds the vectors as they are: doubles stay doubles."""
    return "array<float>" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "array<double>"


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of ``vectors`` (vec_id, embedding, label).

    Vectors are compared only within a label.  A null label or vector, a vector of zeros, or one that
    holds a null or a non-finite component links with nothing; so do vectors of different lengths.
    n_links counts the other rows linked directly, the component is the least vec_id that links reach,
    its own included, and kept tells whether it is its own.  Rows with equal vectors are one class, weighed
    by its size, and linked with each other.  Null vec_ids don't count as least; such a row alone has a null
    component and isn't kept.  An empty table gives no rows; other columns are not read.

    Every pair that is found is checked in double precision; a pair may be missed where its cells are not
    probed (see TABLES).  Links are counted where they are found, never listed.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(components_of(vectors)).alias("embedding"), "label")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0.0)
    usable = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("bucket_label", F.xxhash64("label", F.size("embedding"))), "vector-classes")
    kept: dict[int, Projections] = {}

    def how(dimensions: int) -> Projections:
        if dimensions not in kept:
            kept[dimensions] = projections(dimensions)
        return kept[dimensions]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "label", "table", "cell", "home", "codes"]
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(2)])
            for dimensions in np.unique(sizes):
                at = np.flatnonzero(sizes == dimensions)
                own = batch.take(pa.array(at))
                codes = cells(unit_vectors(own.column(2)), how(int(dimensions)))
                n, t, p = codes.shape
                arrays = [np.repeat(own.column(0).to_numpy(), t * p), np.repeat(own.column(1).to_numpy(), t * p), np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n), codes.ravel()]
                home = np.tile(np.arange(p) == 0, n * t)
                every = np.repeat(codes.reshape(n, t * p), t * p, axis=0).astype("<i8")  # all of a vector's codes, with each of them
                bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * t * p), n * t * p, [None, pa.py_buffer(every)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(home), bytes_], names)

    placed = classes.select("node", "bucket_label", "embedding").mapInArrow(place, "node long, label long, table int, cell long, home boolean, codes binary")
    placed = materialize(placed, "vector-cells")
    key = ["label", "table", "cell"]
    buckets = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("home").alias("_home")).filter((F.col("_n") > 1) & F.col("_home"))
    placed = placed.join(buckets, key).withColumn("_chunks", F.ceil(F.col("_n") / BUCKET).cast("int"))
    c = F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda o: F.struct(F.least(c, o).cast("int").alias("lo"), F.greatest(c, o).cast("int").alias("hi"), (c <= o).alias("base")))
    placed = placed.withColumn("_pair", F.explode(pairs)).select("node", *key, "home", "codes", "_pair.*")
    n = shuffle_partitions(spark)
    full = placed.join(classes.select("node", "mult", "embedding"), "node")
    full = full.repartition(n, *key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi").select(*key, "lo", "hi", "base", "home", "node", "mult", "embedding", "codes")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            base = t.column("base").to_numpy()
            side = {"node": t.column("node").to_numpy(), "mult": t.column("mult").to_numpy(), "home": t.column("home").to_numpy(), "unit": unit_vectors(t.column("embedding"))}
            side["codes"] = np.frombuffer(b"".join(t.column("codes").to_pylist()), "<i8").reshape(t.num_rows, TABLES, -1)
            pick = lambda m: {k: v[m] for k, v in side.items()}
            own = current[3] == current[4]
            rows = list(join_bucket(current[1], current[2], pick(base), None if own else pick(~base), threshold))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "weight"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                k = tuple(keys[lo].tolist())
                if k != current:
                    if held:
                        yield from done()
                    current, held = k, []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    found = materialize(full.mapInArrow(join, "a long, b long, weight long"), "vector-links")
    degrees = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("_links"))
    members = connected_components(found.filter(F.col("b").isNotNull()).select("a", "b"), "vector-components")
    members = materialize(members.join(classes.select("node", "least"), "node"), "vector-members")
    names = members.groupBy("component").agg(F.min("least").alias("_id"))
    named = members.join(names, "component").select("node", "_id")
    classes = classes.select("label", "embedding", "node", "least", "mult").join(degrees, "node", "left").join(named, "node", "left")
    out = vectors.join(classes, ["label", "embedding"], "left")
    component = F.coalesce("_id", "least", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("_links", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
