"""Jaccard join of word n-gram sets by prefix trees.

n-grams have a global order by frequency, counted by part of the hash space (see ``dealt``).  Two sets of
the threshold's similarity share an n-gram among the rarest few of each, so only those index a document,
and of them only n-grams that occur elsewhere; widespread passages index nothing.  A document whose
rarest few are all its own is linked with nothing and goes no further.
What shares indexed n-grams forms blocks; in a block the ordered sets are stored in a prefix tree, which
each set traverses, sharing the overlap with a path among all sets below it and leaving a subtree where
the lengths that remain can't reach the threshold, or where all sets are linked with it already.
In a block too large to be joined at once all sets are first compared with one of it; those linked with that one
are connected, and only the others are joined with all, chunk by chunk.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm import dealt, hashing
from logweir.llm.components import connected_components
from logweir.llm.storage import lean_batches, materialize, shuffle_partitions

WORDS = 4
#: The threshold as a fraction: linked if UNDER * intersection >= OVER * union.
OVER, UNDER = 85, 100
#: Largest block that is joined at once: documents, and n-grams over all of them.
BLOCK_DOCS, BLOCK_GRAMS = 1000, 400_000
RARE = np.uint64(1 << 63)


def gram_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Distinct hashes of each text's n-grams of k words, A-Z lower-cased; of all its words, if they are fewer."""
    split = [t.lower().split() if t else [] for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    words = hashing.word_hashes(split)
    start, _, _ = hashing.window_starts(counts, k)
    grams = hashing.rolling(words, k)[start] >> np.uint64(1)
    ends = np.cumsum(np.maximum(counts - k + 1, 0))
    out = []
    first = np.cumsum(counts) - counts
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            out.append(np.unique(grams[ends[i] - (n - k + 1) : ends[i]]))
        elif n:
            whole = words[first[i] : first[i] + n].tobytes()
            out.append(np.array([xxhash.xxh3_64_intdigest(whole, seed=n) >> 1], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def n_index(size: int, over: int, under: int) -> int:
    """How many of a set's last n-grams index it: all sets linked with it share one of them."""
    return size - -(-over * size // under) + 1


class Node:
    """A path of a prefix tree: its n-grams, where it ends, and what is below."""

    __slots__ = ("children", "end", "grams", "hi", "least", "lo", "most", "one", "own")

    def __init__(self, grams, end, lo, hi, least, most):
        self.grams, self.end, self.lo, self.hi, self.least, self.most = grams, end, lo, hi, least, most
        self.children: list[Node] = []
        self.own, self.one = -1, hi - lo == 1


class PrefixTree:
    """Ordered sets (lists of whole numbers, distinct from each other) in a tree with shared prefixes."""

    def __init__(self, sets: list[list[int]]):
        self.order = sorted(range(len(sets)), key=sets.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = [len(s) for s in self.sets]
        self.root = Node([], 0, 0, len(sets), min(self.sizes, default=0), max(self.sizes, default=0))
        todo = [self.root] if sets else []
        while todo:
            node = todo.pop()
            lo, depth = node.lo, node.end
            if lo < node.hi and self.sizes[lo] == depth:
                node.own = lo
                lo += 1
            while lo < node.hi:
                gram, hi, step = self.sets[lo][depth], lo + 1, 1
                while hi < node.hi and self.sets[hi][depth] == gram:
                    hi += 1
                a, b = self.sets[lo], self.sets[hi - 1]
                end, short = depth + 1, min(len(a), len(b))
                if hi - lo == 1:
                    end = len(a)
                else:
                    while end < short and a[end] == b[end]:
                        end += 1
                sizes = self.sizes[lo:hi]
                child = Node(a[depth:end], end, lo, hi, min(sizes), max(sizes))
                node.children.append(child)
                todo.append(child)
                lo = hi


class Links:
    """Which sets are linked, directly or by others."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def link_sets(tree: PrefixTree, names: list[int], probes: list[tuple[int, list[int]]], links: Links, over: int = OVER, under: int = UNDER) -> None:
    """Join in ``links`` every probe (name, set) with every set of the tree that is similar enough.

    ``names`` are the tree's sets' names in ``links``, in the order given.  A subtree whose sets are all
    linked with the probe already is left: more links there change no component.
    """
    named = [names[i] for i in tree.order]
    find, both = links.find, over + under

    def linked(node: Node) -> int:
        """The one component of all sets below a node, or -1."""
        todo = [node]
        path = []
        while todo:  # children first
            n = todo.pop()
            if not n.one:
                path.append(n)
                todo.extend(n.children)
        for n in reversed(path):
            first = find(named[n.lo])
            n.one = all(c.one and find(named[c.lo]) == first for c in n.children)
        return find(named[node.lo]) if node.one else -1

    for name, probe in probes:
        mine, size = set(probe), len(probe)
        if not size:
            continue
        todo = [(tree.root, 0)]
        hits = 0
        while todo:
            node, overlap = todo.pop()
            if node.most * under < over * size or node.least * over > under * size:
                continue
            if node.one and find(named[node.lo]) == find(name):
                continue
            if node.grams:
                overlap += len(mine.intersection(node.grams))
                left = size - bisect_right(probe, node.grams[-1])
                if both * (overlap + min(left, node.most - node.end)) < over * (size + node.least):
                    continue
            if node.own >= 0:
                y = named[node.own]
                if y != name and under * overlap >= over * (size + tree.sizes[node.own] - overlap):
                    links.join(name, y)
                    hits += 1
                    if hits & 15 == 1:
                        linked(tree.root)
            todo.extend((c, overlap) for c in node.children if c.grams[0] not in mine)
            todo.extend((c, overlap) for c in node.children if c.grams[0] in mine)


def join_block(base: list[tuple[bytes, bytes]], probes: list[tuple[bytes, bytes]] | None, over: int, under: int) -> Iterator[tuple[bytes, bytes]]:
    """(digest, digest) edges that span the components of a block; with ``probes``, of links across alone."""
    hashing.steady_memory()
    hashing.forget("hashing", "_SEEN")
    found = dict(base) if probes is None else dict(base) | dict(probes)
    digests = sorted(found)
    at = {d: i for i, d in enumerate(digests)}
    keys = np.unique(np.concatenate([np.frombuffer(found[d], np.uint64) for d in digests]))
    as_ranks = lambda own: [np.searchsorted(keys, np.frombuffer(found[d], np.uint64)).tolist() for d in own]
    links = Links(len(digests))
    own = sorted(dict(base))
    sets = as_ranks(own)
    other = own if probes is None else sorted(dict(probes))
    link_sets(PrefixTree(sets), [at[d] for d in own], list(zip([at[d] for d in other], sets if probes is None else as_ranks(other), strict=True)), links, over, under)
    for i, d in enumerate(digests):
        if (r := links.find(i)) != i:
            yield d, digests[r]


def jaccard_components(docs: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER, with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  A document's set has its
    distinct n-grams of ``words`` words; of a text with fewer words, the whole sequence as one.  A null or
    empty text, or one of white space, has an empty set and is linked with nothing.  Two documents are
    linked if ``under`` * intersection >= ``over`` * union; a component_id is the least doc_id that can be
    reached by links, the document's own included.  Equal sets are one class and linked without a pair for
    each two; repeated rows are in the class of their text.  Among linked rows null doc_ids don't count; a
    null doc_id alone has a null component.  Texts of any length are taken whole.  An empty table gives no
    rows.  Other columns are not read.

    ``with_key`` adds ``key``, two hashes of doc_id and text, to tell rows that share a doc_id apart.
    A block over the limits is joined chunk by chunk, each pair of chunks once, of which one holds sets that aren't linked with the block's centre.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    lean_batches(spark)
    docs, size = dealt.sliced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *row_key(with_key)))
    bits = dealt.part_bits(size // 6, shuffle_partitions(spark))

    def ask(table: pa.Table) -> pa.Table:
        hashing.steady_memory()
        grams, counts = np.unique(np.concatenate(gram_sets(table.column("text").to_pylist(), words)) << np.uint64(1), return_counts=True)
        rows = list(dealt.ask(grams, counts, bits))
        name = table.column("slice")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "slice", "payload"])

    keys_of = ["_k1", "_k2"] * with_key
    fields = ["doc_id", *keys_of, "n_shingles", "digest", "grams", "keys"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def index(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in [pa.int64()] * (1 + len(keys_of)) + types], fields)
        hashing.steady_memory()
        sets = gram_sets(table.column("text").to_pylist(), words)
        flat = np.concatenate(sets)
        asked, which = np.unique(flat << np.uint64(1), return_inverse=True)
        levels = dealt.told(asked, bits, dict(zip(answers.column("part").to_pylist(), answers.column("told").to_pylist(), strict=True)))[which]
        rows, end = [], 0
        for s in sets:
            level = levels[end : end + len(s)]
            end += len(s)
            few, common = n_index(len(s), over, under), level > 1
            if not len(s) or few <= len(s) - int(common.sum()):
                rows.append((len(s), None, None, None))
                continue
            rarest = np.lexsort((s, level))[:few]
            grams = np.concatenate([s[common], s[~common] | RARE]).tobytes()
            rows.append((len(s), xxhash.xxh3_128_digest(grams), grams, s[rarest][level[rarest] > 1].astype(np.int64)))
        given = [table.column(c).combine_chunks() for c in ["doc_id", *keys_of]]
        return pa.table([*given, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], fields)

    answers = dealt.answered(docs.groupBy("slice").applyInArrow(ask, dealt.ASKS), bits, dealt.levels)
    schema = ", ".join(["doc_id long", *[f"{k} long" for k in keys_of], "n_shingles long, digest binary, grams binary, keys array<long>"])
    indexed = materialize(docs.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(index, schema), "jaccard-index")
    sets = indexed.filter(F.col("digest").isNotNull())
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")  # written, so ids are fixed
    keyed = classes.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_top")).filter(F.col("b") != F.col("_top"))
    shared = keyed.join(least, "key").select(F.col("node").alias("a"), "b").filter(F.col("a") != F.col("b"))
    coarse = connected_components(shared, "jaccard-coarse")

    blocks = classes.select("digest", "least", "node", "n").join(coarse, "node").select("digest", "least", "n", F.col("component").alias("block"))
    firsts = classes.select("digest", "least")
    own_sets = sets.select("digest", "doc_id", "grams").join(firsts, "digest").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("digest", "grams")
    sums = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n").alias("_grams"), F.min(F.struct(F.xxhash64("digest"), "digest")).alias("_m"))
    large = sums.filter((F.col("_docs") > BLOCK_DOCS) | (F.col("_grams") > BLOCK_GRAMS)).select("block", F.col("_m.digest").alias("centre"))
    stars = materialize(star_links(blocks, large, own_sets, over, under), "jaccard-stars")

    connected = stars.select(F.col("a").alias("digest")).unionByName(stars.select(F.col("b").alias("digest"))).distinct()
    # In a large block what is linked with the centre is connected; the rest is joined with all of the block.
    placed = blocks.join(connected.withColumn("_done", F.lit(True)), "digest", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    of = lambda test, c: F.sum(F.when(test, c).otherwise(0))
    chunks = lambda test: F.greatest(F.ceil(of(test, F.lit(1)) / BLOCK_DOCS), F.ceil(of(test, F.col("n")) / BLOCK_GRAMS)).cast("int")
    numbers = placed.groupBy("block").agg(chunks(~F.col("_done")).alias("_open"), chunks(F.col("_done")).alias("_closed"))
    placed = placed.join(numbers, "block")
    hashed = F.xxhash64("digest", F.lit(1))
    chunk = F.when(F.col("_done"), F.col("_open") + F.pmod(hashed, F.col("_closed"))).otherwise(F.pmod(hashed, F.col("_open"))).cast("int")
    placed = placed.withColumn("chunk", chunk)
    c = F.col("chunk")
    with_open = F.when(F.col("_open") > 0, F.sequence(F.lit(0), F.col("_open") - 1)).otherwise(F.array().cast("array<int>"))
    others = F.when(F.col("_done"), with_open).otherwise(F.sequence(F.lit(0), F.col("_open") + F.col("_closed") - 1))
    pairs = F.transform(others, lambda o: F.struct(F.least(c, o).cast("int").alias("lo"), F.greatest(c, o).cast("int").alias("hi"), (c <= o).alias("base")))
    placed = placed.withColumn("_pair", F.explode(pairs)).select("digest", "block", "_pair.*")
    n = shuffle_partitions(spark)
    named_sets = own_sets.join(placed, "digest")
    spread = named_sets.repartition(n, "block", "lo", "hi").sortWithinPartitions("block", "lo", "hi")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, base, probes = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            rows = list(join_block(base, probes if current[1] != current[2] else None, over, under)) if base and (probes or current[1] == current[2]) else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["a", "b"])

        for batch in batches:
            digests, grams = batch.column(0), batch.column(1)
            for i, (key, is_base) in enumerate(zip(zip(*[batch.column(j).to_pylist() for j in (2, 3, 4)], strict=True), batch.column(5).to_pylist(), strict=True)):
                if key != current:
                    if current is not None:
                        yield from done()
                    current, base, probes = key, [], []
                (base if is_base else probes).append((digests[i].as_py(), grams[i].as_py()))
        if current is not None:
            yield from done()

    edges = spread.select("digest", "grams", "block", "lo", "hi", "base").mapInArrow(join, "a binary, b binary")
    members = connected_components(edges.unionByName(stars), "jaccard-links")
    members = materialize(members.join(firsts, members["node"] == firsts["digest"]).select("node", "component", "least"), "jaccard-members")
    names = members.groupBy("component").agg(F.min("least").alias("_id"))
    named = members.join(names, "component").select("node", "_id")
    equal = indexed.select("doc_id", *keys_of, "n_shingles", "digest").join(firsts, "digest", "left")
    out = equal.join(named, equal["digest"] == named["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_id", "least", "doc_id").alias("component_id"), *[F.struct("_k1", "_k2").alias("key")] * with_key)


def star_links(blocks: DataFrame, large: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Edges (a, b) of the documents of the ``large`` blocks (block, centre) that are linked with their block's centre."""
    import pyarrow as pa

    centres = large.join(sets.withColumnRenamed("grams", "centre_grams"), F.col("centre") == F.col("digest")).select(F.col("block").alias("_block"), "centre", "centre_grams")
    members = blocks.join(large, "block", "left_semi").select("digest", "block").join(sets, "digest")
    both = members.join(centres, F.col("block") == F.col("_block")).filter(F.col("digest") != F.col("centre"))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for mine, theirs in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(g.as_py(), np.uint64) for g in (mine, theirs))
                shared = len(np.intersect1d(x & ~RARE, y & ~RARE, assume_unique=True))
                keep.append(under * shared >= over * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("digest", "centre", "grams", "centre_grams").mapInArrow(near, "a binary, b binary")


def row_key(wanted: bool = True) -> list[Column]:
    """Two hashes of doc_id and text, 128 bits in all."""
    return [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("_k2")] if wanted else []


def keep_one_each(docs: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """``docs`` with one row of each group that links connect: the one of the least doc_id.

    Of rows that share that doc_id the one with the least hash of its text stays, and of wholly equal ones
    any.  A row without a doc_id stays unless it is linked with one that has an id.
    """
    key = "__logweir_key"
    docs_keyed = docs.withColumn(key, F.struct(*row_key()))
    found = materialize(jaccard_components(docs, words, over, under, with_key=True), "jaccard-kept")
    best = found.filter(F.col("component_id").isNotNull()).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_best"))
    alone = found.filter(F.col("component_id").isNull()).select("key").distinct()
    kept = best.select(F.col("_best.key").alias("key")).unionByName(alone).withColumnRenamed("key", key)
    out = docs_keyed.join(kept, key, "left_semi").dropDuplicates([key])
    return out.select(*[f"`{c}`" for c in docs.columns])
