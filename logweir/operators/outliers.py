"""Outliers of a few samples, by deviation from the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = float(np.finfo(np.float32).eps)


def threshold(rest: np.ndarray, method: str, deviations: float, margin: float) -> float:
    """Where an outlier of samples begins: their centre, some deviations, and a share of the centre."""
    if method == "rmsd":
        centre = float(rest.mean())
        spread = float(np.sqrt(((rest - centre) ** 2).mean()))
    elif method == "mad":
        centre = float(np.median(rest))
        spread = float(np.median(np.abs(rest - centre)))
    else:
        raise ValueError(method)
    return centre + deviations * spread + margin * centre + EPSILON


def outliers(names: list, values: list[float], method: str, deviations: float, most: int, margin: float = 0.0, allowed: list[bool] | None = None) -> list:
    """The names of the largest outliers, the greatest first.

    Of the numbers up to ``most`` the largest is taken such that just so many samples reach the threshold
    that the samples besides them set.  Samples that aren't allowed can't be outliers but count among the rest.
    """
    allowed = allowed or [True] * len(names)
    order = sorted(range(len(names)), key=lambda i: -values[i])
    candidates = [i for i in order if allowed[i]]
    for k in range(min(most, len(names) - 1, len(candidates)), 0, -1):
        first = candidates[:k]
        rest = np.array([values[i] for i in range(len(names)) if i not in set(first)], np.float64)
        t = threshold(rest, method, deviations, margin)
        if all(values[i] >= t for i in first) and not any(values[i] >= t for i in candidates[k:]):
            return [names[i] for i in first]
    return []


def outliers_by(samples: DataFrame, group: str, name: str, value: str, method: str = "rmsd", deviations: float = 3.0, most: int = 3, margin: float = 0.0, above: float | None = None) -> DataFrame:
    """(group, name, value, place) of each group's outliers; only samples over ``above`` can be.

    A group is what one detector sees: a sample for each node of a cluster, which one task holds.
    """
    import pandas as pd

    kinds = dict(samples.dtypes)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        allowed = None if above is None else (pdf[value] > above).tolist()
        found = outliers(pdf[name].tolist(), pdf[value].tolist(), method, deviations, most, margin, allowed)
        at = {n: k for k, n in enumerate(found)}
        out = pdf[pdf[name].isin(at)].copy()
        out["place"] = out[name].map(at)
        return out[[group, name, value, "place"]]

    return samples.select(group, name, F.col(value).cast("double").alias(value)).groupBy(group).applyInPandas(find, f"`{group}` {kinds[group]}, `{name}` {kinds[name]}, `{value}` double, place long")


def largest_beyond(samples: DataFrame, group: str, name: str, value: str, deviations: float, margin: float = 0.0, allowed: Column | None = None) -> DataFrame:
    """(group, name, value, limit) of each group's largest sample, if it is beyond what the others set (root mean square).

    The one-outlier case in closed form: the others' mean and deviation follow from sums, without Python.  Only
    samples for which ``allowed`` holds can be outliers; all others count among the rest.
    """
    can = F.lit(True) if allowed is None else allowed
    top = F.max(F.when(can, F.struct(F.col(value).alias("v"), F.col(name).alias("k"))))
    second = F.max(F.struct(F.col(value).alias("v"), F.col(name).alias("k")))
    sums = samples.groupBy(group).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), top.alias("_top"), second.alias("_max"))
    v, n = F.col("_top.v"), F.col("_n") - 1
    mean = (F.col("_s") - v) / n
    spread = F.sqrt(F.greatest((F.col("_q") - v * v) / n - mean * mean, F.lit(0.0)))
    limit = mean + deviations * spread + margin * mean
    return sums.filter((n > 0) & F.col("_top").isNotNull()).select(group, F.col("_top.k").alias(name), v.alias(value), limit.alias("limit")).filter(F.col(value) >= F.col("limit"))


def append_outliers(samples: DataFrame, period_sec: int, sensitivity: float, grace: int, deviations: float = 3.0, margin: float = 0.0, most: int = 1) -> DataFrame:
    """(node, since, periods, worst) of nodes whose appends fail too often, next to the others', for long enough.

    ``samples`` has node, ts, successes and fails.  In each period a node with appends has a share of failures;
    the outliers are those that stand out among all nodes' shares (root mean square deviation), at most ``most``
    and only with a share above ``sensitivity``.  A node that is an outlier for more than ``grace`` periods in a
    row is given, the worst share first, then by node.
    """
    period = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / period_sec)
    total = F.sum("fails") + F.sum("successes")
    ratios = samples.groupBy(period.alias("_p"), "node").agg((F.sum("fails") / F.nullif(total, F.lit(0))).alias("_share")).filter(F.col("_share").isNotNull())
    if most == 1:
        found = largest_beyond(ratios, "_p", "node", "_share", deviations, margin, F.col("_share") > sensitivity)
    else:
        found = outliers_by(ratios, "_p", "node", "_share", "rmsd", deviations, most, margin, sensitivity)
    run = F.col("_p") - F.row_number().over(Window.partitionBy("node").orderBy("_p"))
    runs = found.withColumn("_run", run).groupBy("node", "_run").agg(F.min("_p").alias("since"), F.count(F.lit(1)).alias("periods"), F.max("_share").alias("worst"))
    return runs.filter(F.col("periods") > grace).drop("_run").orderBy(F.desc("worst"), "node")
