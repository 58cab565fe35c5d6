"""Range joins as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of ``points`` with the rows of ``ranges`` that hold lo <= point <= hi, without comparing all pairs.

    Both sides are cut into cells of ``width``: a point is in one, a range in all that it touches.  So the
    join is by equality of cells, and Spark shuffles, broadcasts or splits it by the sides' sizes.  The width
    should be about a range's length.
    """
    p = points.withColumn("_cell", F.floor(F.col(point) / width))
    r = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    on = (p["_cell"] == r["_cell"]) & (p[point] >= r[lo]) & (p[point] <= r[hi])
    return p.join(r, on, how).drop("_cell")
