"""Bounded samples of labelled rows, for fitting only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_sample(rows: DataFrame, label: str, per_class: int, order: str = "doc_id") -> tuple[dict, dict]:
    """({label: [text, ...]}, {label: rows}): about ``per_class`` whole texts of each class, and how many rows it has.

    A row is drawn if the hash of its id falls below per_class / (rows of its class), so the draw is
    even over the table and no task gathers a class.  That bounds the rows that come to the driver, to about
    ``per_class`` times the number of classes.  Rows with a null label or text are left out; an empty table has no
    classes; rows that repeat an id are drawn together, in order of their texts.
    """
    rows = rows.select(F.col(label).alias("_label"), F.col("text").cast("string").alias("_text"), F.xxhash64(F.col(order)).alias("_hash"))
    rows = rows.filter(F.col("_label").isNotNull() & F.col("_text").isNotNull())
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    drawn = F.lit(False)
    for value, n in counts.items():
        below = int(min(1.0, per_class / n) * (1 << 32))
        drawn = drawn | ((F.col("_label") == F.lit(value)) & (F.col("_hash").bitwiseAND(0xFFFFFFFF) < F.lit(below)))
    out: dict = {value: [] for value in counts}
    for r in rows.filter(drawn).orderBy("_hash", "_text").collect():
        out[r["_label"]].append(r["_text"])
    return {k: v for k, v in out.items() if v}, counts
