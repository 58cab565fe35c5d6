"""Telemetry: counters, rates over several intervals, histograms and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values from here on fall into the last bucket of a compact histogram.
TOP = 1 << 58


def merged_counters(samples: DataFrame, how: dict[str, str]) -> DataFrame:
    """(name, value) of samples (name, value, and ts if any is assigned) from many threads or nodes.

    Counters are summed, but for those that ``how`` says ``max`` of, or ``assign``: the value of the latest sample.
    """
    of = lambda kind: F.col("name").isin([k for k, v in how.items() if v == kind]) if kind in how.values() else F.lit(False)
    aggregates = [F.sum("value").alias("_s"), F.max("value").alias("_m")]
    aggregates.append((F.max_by("value", "ts") if "ts" in samples.columns else F.lit(None).cast("long")).alias("_l"))
    merged = samples.groupBy("name").agg(*aggregates)
    return merged.select("name", F.when(of("max"), F.col("_m")).when(of("assign"), F.col("_l")).otherwise(F.col("_s")).alias("value"))


def keyed_counters(samples: DataFrame, key: str) -> DataFrame:
    """(name, value): sums of each counter by key (shard, traffic class, message type, ...), named ``counter.key``, and over all keys."""
    sums = samples.groupBy("name", F.col(key).cast("string").alias("_k")).agg(F.sum("value").alias("value"))
    each = sums.select(F.concat_ws(".", "name", F.coalesce("_k", F.lit("null"))).alias("name"), "value")
    return each.unionByName(sums.groupBy("name").agg(F.sum("value").alias("value")))


def derived_counters(counters: DataFrame, formulas: dict[str, tuple[str, str, str]]) -> DataFrame:
    """``counters`` (name, value) and, for each of ``formulas``, name -> (counter, '-' or '/' or '+', counter), what follows from merged ones.

    A counter that is missing counts as 0; a share of nothing is null.
    """
    wanted = sorted({c for a, _, b in formulas.values() for c in (a, b)})
    row = counters.filter(F.col("name").isin(wanted)).agg(*[F.coalesce(F.sum(F.when(F.col("name") == c, F.col("value"))), F.lit(0)).cast("double").alias(f"_{i}") for i, c in enumerate(wanted)])
    at = {c: F.col(f"_{i}") for i, c in enumerate(wanted)}
    result = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "/": lambda x, y: x / F.nullif(y, F.lit(0.0))}
    entries = F.array(*[F.struct(F.lit(n).alias("name"), result[op](at[a], at[b]).alias("value")) for n, (a, op, b) in formulas.items()])
    return counters.select("name", F.col("value").cast("double").alias("value")).unionByName(row.select(F.explode(entries).alias("_e")).select("_e.*"))


def counter_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """(name, value): how far counters went between two snapshots; one that is new counts from zero."""
    b = before.select("name", F.col("value").alias("_b"))
    return now.join(b, "name", "left").select("name", (F.col("value") - F.coalesce("_b", F.lit(0))).alias("value"))


def trailing_rates(records: DataFrame, by: str, now: Column, seconds: tuple[int, ...]) -> DataFrame:
    """(by, rate_<s>...): bytes a second of each group over trailing intervals that end at ``now``."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    rate = lambda s: (F.sum(F.when((age >= 0) & (age < s), F.col("payload_size")).otherwise(0)) / s).alias(f"rate_{s}")
    return records.groupBy(by).agg(*[rate(s) for s in seconds])


def top_rates(rates: DataFrame, by: str, columns: list[str], k: int, least: float = 0.0) -> DataFrame:
    """The ``k`` groups with the greatest rate in any interval, ties by name; groups below ``least`` everywhere are left out."""
    top = F.greatest(*columns)
    return rates.withColumn("_top", top).filter(F.col("_top") >= least).orderBy(F.desc("_top"), by).limit(k).drop("_top")


def custom_counters(records: DataFrame, by: str, counters: Column) -> DataFrame:
    """(by, key, total): sums of a map of counters."""
    return records.select(by, F.explode(counters).alias("key", "value")).groupBy(by, "key").agg(F.sum("value").alias("total"))


def compact_bucket(value: Column) -> Column:
    """0 for values up to 0, else the place of the highest bit set, from 1; 59 for the largest."""
    v = value.cast("long")
    return F.when(v <= 0, 0).when(v >= TOP, 59).otherwise(F.length(F.bin(v))).cast("int")


def compact_histogram(samples: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by..., bucket, n) with powers of two as bounds."""
    return samples.filter(value.isNotNull()).groupBy(*by, compact_bucket(value).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def multiscale_bounds(value: Column, first: int = 1) -> tuple[Column, Column]:
    """[low, high) of the bucket of a value: ten-fold scales from ``first`` on, nine equal steps in each."""
    v = F.greatest(value.cast("double"), F.lit(float(first)))
    digits = F.length(F.floor(v / first).cast("long").cast("string")) - 1
    width = F.round(F.pow(F.lit(10.0), digits)).cast("long") * first
    low = (F.floor(v / width) * width).cast("long")
    return low, low + width


def multiscale_histogram(samples: DataFrame, by: list[str], value: Column, first: int = 1) -> DataFrame:
    """(by..., low, high, n, total): counts and sums of values by bucket; smaller values fall into the first."""
    low, high = multiscale_bounds(value, first)
    rows = samples.filter(value.isNotNull())
    return rows.groupBy(*by, low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def size_bounds(value: Column) -> tuple[Column, Column]:
    """[low, high) of a size's bucket: in units of 1024**k steps of 1, 10 and 100 units, and one up to the next unit."""
    v = F.greatest(value.cast("long"), F.lit(1))
    unit = F.lit(1).cast("long")
    for k in range(1, 6):
        unit = F.when(v >= 1 << (10 * k), F.lit(1 << (10 * k))).otherwise(unit)
    steps = F.floor(v / unit)
    width = F.when(steps < 10, unit).when(steps < 100, unit * 10).when(steps < 900, unit * 100).otherwise(unit * 124)
    low = F.when(steps < 900, F.floor(v / width) * width).otherwise(unit * 900).cast("long")
    return low, low + width


def histogram_percentiles(histogram: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by..., share, estimate) from (by..., low, high, n, total): three points in the bucket of the share.

    The value rises from the bucket's low bound to its mean over the first half of its samples, and from
    there to its high bound over the second.
    """
    w = Window.partitionBy(*by).orderBy("low")
    rows = histogram.withColumn("_to", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    rows = rows.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    want = F.col("share") * F.col("_all")
    rows = rows.filter((want <= F.col("_to")) & (want > F.col("_to") - F.col("n")))
    part = (want - (F.col("_to") - F.col("n"))) / F.col("n")
    mean = F.col("total") / F.col("n")
    estimate = F.when(part <= 0.5, F.col("low") + (mean - F.col("low")) * part * 2).otherwise(mean + (F.col("high") - mean) * (part * 2 - 1))
    return rows.select(*by, "share", estimate.alias("estimate"))


def compact_percentiles(histogram: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by..., share, estimate) from a compact histogram: linear within the bucket of the share."""
    w = Window.partitionBy(*by).orderBy("bucket")
    rows = histogram.withColumn("_to", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    rows = rows.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    want, before = F.col("share") * F.col("_all"), F.col("_to") - F.col("n")
    rows = rows.filter((want <= F.col("_to")) & ((want > before) | (before == 0)))
    part = (want - before) / F.col("n")
    width = F.when(F.col("bucket") == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.col("bucket") - 1))
    low = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(width)
    return rows.select(*by, "share", (low + F.floor(part * width + 0.5)).cast("long").alias("estimate"))


def compact_sum(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., estimate): what a compact histogram's samples add up to, about: each counts three quarters of its bucket's bound.

    The estimate is rounded to the nearest whole number, halves to the even one.
    """
    bound = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.col("bucket")))
    return histogram.groupBy(*by).agg(F.rint(F.sum(F.col("n") * bound) * 0.75).cast("long").alias("estimate"))


def at_least(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., bucket, n_at_least): how many samples are in a bucket or above."""
    w = Window.partitionBy(*by).orderBy(F.desc("bucket"))
    return histogram.select(*by, "bucket", F.sum("n").over(w).cast("long").alias("n_at_least"))


def histogram_text(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., text): ``bucket:count`` of all buckets, in order, with commas."""
    item = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    return histogram.groupBy(*by).agg(F.array_join(F.transform(item, lambda s: F.concat_ws(":", s["bucket"].cast("string"), s["n"].cast("string"))), ",").alias("text"))


def histogram_from_text(rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by..., bucket, n): the reverse of ``histogram_text``."""
    parts = rows.select(*by, F.explode(F.split(text, ",")).alias("_p")).filter("_p != ''")
    pair = F.split("_p", ":")
    return parts.select(*by, pair[0].cast("int").alias("bucket"), pair[1].cast("long").alias("n"))


def histogram_subtracted(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., bucket, n): what ``a`` counted beyond ``b``, not below zero."""
    other = b.select(*by, "bucket", F.col("n").alias("_b"))
    return a.join(other, [*by, "bucket"], "left").select(*by, "bucket", F.greatest(F.col("n") - F.coalesce("_b", F.lit(0)), F.lit(0)).alias("n"))


def summaries(samples: DataFrame, by: str, value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """(by, n, low, p50, p75, p95, p99, p9999, high, mean) with exact percentiles, interpolated between neighbours.

    Values are counted first, so equal ones are one row; a group's values are ranked cell by cell of their
    order, and only those at the wanted ranks come together, so no group is held by one task.
    """
    shares = shares or {"p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p9999": 0.9999}
    counted = samples.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    facts = samples.groupBy(by).agg(F.count(value).alias("n"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.avg(value).alias("mean"))
    # a cell: one of 1024 equal stretches between a group's least and greatest value
    f = facts.select(F.col(by).alias("_by"), F.col("n").alias("_all"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    rows = counted.join(f, F.col(by).eqNullSafe(F.col("_by")))
    width = (F.col("_high") - F.col("_low")) / 1024
    rows = rows.withColumn("_cell", F.when(width > 0, F.floor((F.col("v") - F.col("_low")) / width)).otherwise(F.lit(0)).cast("long")).drop("_by")
    totals = rows.groupBy(by, "_cell").agg(F.sum("n").alias("_t"))
    earlier = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(by).alias("_by"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.join(totals, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_cell") == F.col("_c"))).drop("_by", "_c")
    own = Window.partitionBy(by, "_cell").orderBy("v")
    upto = F.col("_before") + F.sum("n").over(own)
    rows = rows.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("n"))
    at = lambda s: F.lit(s) * (F.col("_all") - 1)
    holds = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_to"))
    picks = [F.max(F.when(holds(rank(at(s))), F.col("v"))).alias(f"_{name}_{i}") for name, s in shares.items() for i, rank in enumerate((F.floor, F.ceil))]
    found = rows.groupBy(by).agg(F.max("_all").alias("_all"), *picks)
    ends = [(F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * (at(s) - F.floor(at(s)))).alias(n) for n, s in shares.items()]
    out = found.select(F.col(by).alias("_by"), *ends)
    joined = facts.join(out, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, "n", "low", *shares, "high", "mean")


def estimated_log_size(replies: DataFrame, shards: int, replication: int) -> DataFrame:
    """(estimate) of a log's bytes from the replies (shard, status, size, arrival) of some of its shards.

    The first good reply of each shard counts; the sum over copies is divided by the replication and
    scaled from the shards that answered to all.
    """
    first = replies.filter(F.col("status") == "OK").groupBy("shard").agg(F.min_by("size", "arrival").alias("size"))
    total, n = F.floor(F.sum("size") / replication), F.count(F.lit(1))
    return first.agg(F.round(F.floor(total / n) * shards).cast("long").alias("estimate"))
