"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.ranking import rank_within
from logweir.llm.storage import materialize

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null and for empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Share the total of ``sizes`` (source, source_size) out by weight.

    Sources in order of code points, null last, take the weights in turn.  A source never gets more
    than ``most`` times its size; what it can't take is shared again by weight among the rest until
    none is above.  Returns source, source_size, target.  Only sums come to the driver: each round
    asks for the total weight and size of the sources that are still below their limit.
    """
    ranked = rank_within(sizes.withColumn("_last", F.col("source").isNull()), [], [F.col("_last"), F.col("source")], "sources").drop("_last")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("_w", weight).drop("_rank"), "source-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full_size, full_weight = 0.0, None, None
    all_weight = ranked.agg(F.sum("_w")).first()[0] or 0
    below = F.lit(False)
    while True:
        got = ranked.filter(below).agg(F.sum("source_size"), F.sum("_w")).first()
        at = (got[0] or 0, got[1] or 0)
        if at == (full_size, full_weight) or at[1] >= all_weight:
            break
        full_size, full_weight = at
        level = (total - most * full_size) / (all_weight - full_weight)
        below = F.lit(float(most)) * F.col("source_size") < F.lit(level) * F.col("_w")
    return ranked.select("source", "source_size", F.least(F.col("source_size") * float(most), F.lit(level) * F.col("_w")).alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """The one random offset of a source, in [0, 1), from the seed and the source's name."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def systematic_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """Copies that the mix takes of each row of ``docs`` (doc_id, source, size).

    Returns doc_id, source, size, source_size, target, copies, taken.  Within a source every document
    expects target / source_size copies.  The documents stand in order of size, the expectations are
    prefix-summed from the source's one random offset, and a document is emitted once for each whole
    number that its stretch crosses: copies are the expectation rounded down or up, never above
    ``most``.  As neighbours have like sizes, the words taken stay within about one of the longest
    documents of the target.  The same rows give the same mix whatever their order or partitioning.

    Rows with a null source form a source of their own, the last.  Documents without words have size
    0; they may be emitted but take no words.  A source without any words gets target 0 and is not emitted.
    Repeated rows are documents of their own.  An empty table gives an empty mix.  Other
    columns are not read.
    """
    docs = materialize(docs.select("doc_id", "source", "size"), "mix-sizes")
    targets = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ranked = rank_within(docs, ["source"], [F.col("size"), F.col("doc_id")], "mix")
    t = targets.withColumnRenamed("source", "_source")
    out = ranked.join(t, ranked["source"].eqNullSafe(t["_source"])).drop("_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u, i = offset_of(F.col("source"), seed), F.col("_rank").cast("double")
    copies = F.floor((i + F.lit(1.0)) * expected + u) - F.floor(i * expected + u)
    out = out.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).drop("_rank")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """``documents`` with each row emitted as often as the mix takes it; columns as given.

    Among rows of one size the doc_id and then the hash of all columns decide the order, so rows that share a
    doc_id but differ are drawn separately and alike in every run; wholly equal rows, between which the choice
    makes no difference, are drawn each for itself.  Rows with null columns and empty tables are as for ``systematic_mix``.
    """
    key, content = "__logweir_key", F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in documents.dtypes])
    keyed = materialize(documents.withColumn(key, F.monotonically_increasing_id()), "mix-docs")  # written, so ids are fixed
    copies = systematic_mix(keyed.select(F.struct("doc_id", content.alias("content"), key).alias("doc_id"), "source", n_words(F.col("text")).alias("size")), weights, most, seed)
    times = copies.filter(F.col("copies") > 0).select(F.col(f"doc_id.{key}").alias(key), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("__logweir_copies"))
    taken = keyed.join(times, key).withColumn("__logweir_copy", F.explode("__logweir_copies"))
    return taken.select(*[f"`{c}`" for c in documents.columns])
