"""Ordered computations within logs of any length, without bringing a log into one task.

A log is cut into cells of consecutive numbers.  What a cell needs to know of the cells before it is one
aggregated row each; windows run over a cell's rows, or over a log's cells, of which a log of a billion
records has a thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the numbers within a cell.
BITS = 20


def cell_of(order: str, bits: int = BITS) -> Column:
    return F.shiftright(F.col(order).cast("long"), bits)


def running(df: DataFrame, by: list[str], order: str, value: Column, how: str, name: str, before: bool = False, bits: int = BITS) -> DataFrame:
    """``df`` with ``name``: the sum, max, min or count of ``value`` over the rows up to each in its group, itself left out with ``before``.

    ``order`` is a whole number; rows that tie in it stand in any order.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[how]
    again = {"count": F.sum}.get(how, agg)
    df = df.withColumn("_cell", cell_of(order, bits)).withColumn("_value", value)
    last = -1 if before else 0
    own = agg("_value").over(Window.partitionBy(*by, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, last))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_cell").agg(agg("_value").alias("_t")).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_cell").alias("_c2"), again("_t").over(earlier).alias("_before"))
    df = df.withColumn("_own", own)
    on = df["_cell"] == totals["_c2"]
    for i, b in enumerate(by):
        on = on & df[b].eqNullSafe(totals[f"_b{i}"])
    both = {"sum": F.coalesce("_before", F.lit(0)) + F.coalesce("_own", F.lit(0)), "count": F.coalesce("_before", F.lit(0)) + F.col("_own"), "max": F.greatest("_before", "_own"), "min": F.least("_before", "_own")}[how]
    return df.join(totals, on).withColumn(name, both).drop("_cell", "_value", "_own", "_before", "_c2", *[f"_b{i}" for i in range(len(by))])


def steps(df: DataFrame, by: list[str], order: str, bits: int = BITS) -> DataFrame:
    """(by..., before, after) of the numbers of each group that follow each other, where they aren't neighbours."""
    cells = df.select(*by, F.col(order).cast("long").alias("_o")).withColumn("_cell", cell_of("_o", bits))
    inner = cells.select(*by, F.col("_o").alias("before"), F.lead("_o").over(Window.partitionBy(*by, "_cell").orderBy("_o")).alias("after"))
    ends = cells.groupBy(*by, "_cell").agg(F.min("_o").alias("_lo"), F.max("_o").alias("before"))
    outer = ends.select(*by, "before", F.lead("_lo").over(Window.partitionBy(*by).orderBy("_cell")).alias("after"))
    return inner.unionByName(outer).filter(F.col("after") > F.col("before") + 1)


def runs(df: DataFrame, by: list[str], order: str, bits: int = BITS) -> DataFrame:
    """(by..., lo, hi) of runs of consecutive numbers.

    Runs are found cell by cell; only those that touch a cell's border, two a cell at most, are put together.
    """
    rows = df.select(*by, F.col(order).cast("long").alias("_o")).distinct().withColumn("_cell", cell_of("_o", bits))
    number = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_o"))
    short = rows.withColumn("_run", F.col("_o") - number).groupBy(*by, "_cell", "_run").agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"))
    first, last = F.shiftleft("_cell", bits), F.shiftleft(F.col("_cell") + 1, bits) - 1
    touching = (F.col("lo") == first) | (F.col("hi") == last)
    w = Window.partitionBy(*by).orderBy("lo")
    joined = short.filter(touching).withColumn("_new", (F.coalesce(F.lag("hi").over(w), F.lit(-2)) + 1 != F.col("lo")).cast("int"))
    joined = joined.withColumn("_k", F.sum("_new").over(w)).groupBy(*by, "_k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return short.filter(~touching).select(*by, "lo", "hi").unionByName(joined.select(*by, "lo", "hi"))
