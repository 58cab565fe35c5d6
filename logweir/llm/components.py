"""Connected components of a graph given by edges, of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.storage import materialize, release


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b), a > b: neighbours of a node are tied to the least of them and it.

    The large step ties the greater neighbours, the small step the lesser ones and the node itself.
    """
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ways.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("_m", "a").alias("_m"))
    tied = ways.join(least, ways["a"] == least["_a"])
    if large:
        out = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Large and small star steps alternate until all components are stars, about as often as the logarithm
    of the longest path.  The edges never outnumber those given, a node of many edges is aggregated before
    it is shuffled and joined as a skewed key, and after each round the edges are a written table.  Null
    ends and loops are left out; repeated edges count once; an empty graph has no nodes.
    """
    edges = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(edges, name), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(mark):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(mark)
        after = materialize(_round(_round(now, True), False), name)
        release(now)
        now = after
