"""Ranks within groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.storage import materialize, shuffle_partitions


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "ranked") -> DataFrame:
    """Add ``_rank`` (long, from 0): a row's place within its group by ``order``.

    Rows are dealt out by range over (group, order), so a group that holds a third of all rows spreads
    over a third of the tasks.  A rank is the number of rows of the group in earlier ranges, from one
    count per range and group, plus the place within the range.  Null keys form a group of their own.
    Rows that tie in every column of ``order`` share a range and take their places in any order.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *[F.col(g).asc_nulls_first() for g in group], *order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), name)
    counts = dealt.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_range").alias("_r2"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    own = Window.partitionBy("_range", *group).orderBy(*order)
    placed = dealt.withColumn("_own", F.row_number().over(own))
    on = placed["_range"] == starts["_r2"]
    for i, g in enumerate(group):
        on = on & placed[g].eqNullSafe(starts[f"_g{i}"])
    joined = placed.join(starts, on).withColumn("_rank", (F.col("_start") + F.col("_own") - 1).cast("long"))
    return joined.drop("_range", "_own", "_start", "_r2", *[f"_g{i}" for i in range(len(group))])
