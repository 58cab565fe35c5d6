"""Tables that commands of a cluster's nodes answer with, as DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.scalars import column_name
from logweir.operators import cells

ANSWER = "headers array<string>, rows array<array<string>>"


def json_tables(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and failures of answers (node_id, answer), an answer being ``{"headers": [...], "rows": [[...]]}``.

    Rows come long, as (node_id, row, cells: map from column name to text or null); failures as (node_id,
    reason).  An answer that can't be read, or in which a row's length isn't the headers', fails as a whole
    and alone; headers may stand in any place.
    """
    read = answers.withColumn("_a", F.from_json("answer", ANSWER))
    reason = (
        F.when(F.col("_a").isNull() | F.col("_a.headers").isNull() | F.col("_a.rows").isNull(), "not a table")
        .when(F.exists("_a.rows", lambda r: F.size(r) != F.size("_a.headers")), "a row's length differs from the header's")
    )
    read = read.withColumn("_reason", reason)
    failures = read.filter(F.col("_reason").isNotNull()).select("node_id", F.col("_reason").alias("reason"))
    names = F.transform("_a.headers", column_name)
    good = read.filter(F.col("_reason").isNull()).select("node_id", names.alias("_names"), F.posexplode("_a.rows").alias("row", "_cells"))
    return good.select("node_id", "row", F.map_from_arrays("_names", "_cells").alias("cells")), failures


def parsed_answers(answers: DataFrame) -> DataFrame:
    """(node_id, row, cells, error): rows and failures of ``json_tables`` in one table, from one pass over the answers."""
    read = answers.withColumn("_a", F.from_json("answer", ANSWER))
    error = (
        F.when(F.col("_a").isNull() | F.col("_a.headers").isNull() | F.col("_a.rows").isNull(), "not a table")
        .when(F.exists("_a.rows", lambda r: F.size(r) != F.size("_a.headers")), "a row's length differs from the header's")
    )
    read = read.withColumn("error", error)
    none = F.array(F.lit(None).cast("array<string>"))
    rows = read.select("node_id", "error", F.transform("_a.headers", column_name).alias("_names"), F.posexplode_outer(F.when(F.col("error").isNull(), F.col("_a.rows")).otherwise(none)).alias("row", "_cells"))
    return rows.select("node_id", "row", F.when(F.col("_cells").isNotNull(), F.map_from_arrays("_names", "_cells")).alias("cells"), "error")


def typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The long rows as columns of declared types: missing ones and what can't be read are null, others are dropped."""
    how = {"INTEGER": "int", "BIGINT": "long", "LSN": "long", "LOGID": "long", "TIME": "long", "REAL": "double", "TEXT": "string"}

    def cell(name: str, kind: str):
        value = F.col("cells")[name]
        if kind == "BOOL":
            return F.when(value.isNotNull(), value.isin("true", "1")).alias(name)
        return value.try_cast(how[kind]).alias(name)

    return rows.filter(F.col("cells").isNotNull()).select("node_id", *[cell(n, k) for n, k in columns.items() if n != "node_id"])


def stat_lines(lines: DataFrame, arity: int) -> DataFrame:
    """(node_id, name, values) of lines ``STAT name v1 v2 ...`` (node_id, value); other lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select("node_id", parts.alias("_p")).filter((F.col("_p")[0] == "STAT") & (F.size("_p") == arity + 2)).select("node_id", F.col("_p")[1].alias("name"), F.slice("_p", 3, arity).alias("values"))


def union_partials(parts: list[DataFrame]) -> DataFrame:
    """Partial results one after the other, by name, with nulls for columns that some lack."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def log_groups_of_config(spark: SparkSession, text: str) -> DataFrame:
    """(name, logid_lo, logid_hi, attributes) of the log groups of a JSON configuration.

    Commas before a closing bracket are forgiven; ids are a number, its text, or ``lo..hi``.  Attributes of
    the defaults are inherited.  Groups without an id, with overlapping ids, or that replicate less than
    once are refused.
    """
    conf = json.loads(re.sub(r",(\s*[\]}])", r"\1", re.sub(r"(?m)^\s*#.*$", "", text)))
    defaults = conf.get("defaults", {})
    rows = []
    for group in conf.get("logs", []):
        if "id" not in group:
            raise ValueError(f"log group {group.get('name')} has no id")
        lo, _, hi = str(group["id"]).partition("..")
        attributes = {**defaults, **{k: v for k, v in group.items() if k not in ("id", "name")}}
        if int(attributes.get("replication_factor", 1)) < 1:
            raise ValueError(f"log group {group.get('name')} is replicated less than once")
        rows.append((group.get("name"), int(lo), int(hi or lo), {k: json.dumps(v) if not isinstance(v, str) else v for k, v in attributes.items()}))
    rows.sort(key=lambda r: r[1])
    for a, b in zip(rows, rows[1:], strict=False):
        if b[1] <= a[2]:
            raise ValueError(f"log groups {a[0]} and {b[0]} overlap")
    return spark.createDataFrame(rows, "name string, logid_lo long, logid_hi long, attributes map<string,string>")


def as_records(events: DataFrame) -> DataFrame:
    """The ``events`` table as records of logs: one log per user, sequence numbers from the event's number."""
    return events.select(
        F.col("user_id").alias("log_id"), (F.col("event_id") + 1).alias("lsn"), "ts", F.col("event_type").alias("filter_key"),
        F.col("props").alias("payload"), F.octet_length("props").cast("long").alias("payload_size"), F.col("value").alias("counter"),
    )


def poisson_appends(spark: SparkSession, n: int, rate: float, seed: int = 0, logs: int = 1) -> DataFrame:
    """(log_id, lsn, at_seconds) of synthetic appends with exponential gaps, ``n`` for each log."""
    rows = spark.range(logs * n).select((F.col("id") % logs).alias("log_id"), (F.floor(F.col("id") / logs) + 1).alias("lsn"))
    u = (F.xxhash64(F.lit(seed), "log_id", "lsn").bitwiseAND((1 << 53) - 1).cast("double") + 1) / float(1 << 53)
    rows = rows.withColumn("gap", -F.log(u) / rate)
    return cells.running(rows, ["log_id"], "lsn", F.col("gap"), "sum", "at_seconds").select("log_id", "lsn", "at_seconds")


def log2_rates(spark: SparkSession, logs: int, shares: list[float], seed: int = 0) -> DataFrame:
    """(log_id, rate): rates drawn from a histogram by powers of two; ``shares[i]`` of the logs have a rate in [2**i, 2**(i+1))."""
    total, bounds = sum(shares), []
    for s in shares:
        bounds.append((bounds[-1] if bounds else 0.0) + s / total)
    u = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "log_id").bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)
    bucket = F.lit(len(shares) - 1)
    for i in range(len(shares) - 1, -1, -1):
        bucket = F.when(F.col("_u") < bounds[i], i).otherwise(bucket)
    rows = spark.range(logs).withColumnRenamed("id", "log_id").withColumn("_u", u(0))
    return rows.select("log_id", (F.pow(F.lit(2.0), bucket) * (1 + u(1))).alias("rate"))


def spiky(appends: DataFrame, period: float, share_of_time: float, share_of_load: float) -> DataFrame:
    """Appends (at_seconds, ...) moved in time so that ``share_of_load`` of them fall into the first ``share_of_time`` of each period."""
    at = F.col("at_seconds") / period
    whole, part = F.floor(at), at - F.floor(at)
    moved = F.when(part < share_of_load, part / share_of_load * share_of_time).otherwise(share_of_time + (part - share_of_load) / (1 - share_of_load) * (1 - share_of_time))
    return appends.withColumn("at_seconds", (whole + moved) * period)
