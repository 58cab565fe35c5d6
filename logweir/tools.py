"""Small tools over logs kept as Parquet folders: cat, tail, write, trim, and stores of benchmark events and statistics.

    python -m logweir.tools cat FOLDER LOG [FROM [UNTIL]]
    python -m logweir.tools tail FOLDER LOG [N]
    python -m logweir.tools write FOLDER LOG PAYLOAD...
    python -m logweir.tools trim FOLDER LOG UPTO

A folder holds ``records`` (log_id, lsn, ts, payload, payload_size) and ``trims`` (log_id, trim_point), to which rows
are added; nothing is changed in place.
"""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators import log

RECORDS = "log_id long, lsn long, ts timestamp, payload string, payload_size long"
TRIMS = "log_id long, trim_point long"


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of one of the folder's tables; none if it hasn't been written yet."""
    schema = RECORDS if name == "records" else TRIMS
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
        rows.schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.groupBy("log_id").agg(F.max("trim_point").alias("trim_point")) if name == "trims" else rows


def cat(spark: SparkSession, folder: str, log_id: int, since: int = 1, until: int | None = None) -> DataFrame:
    """(kind, lo, hi, payload) of a log's records and gaps, in order."""
    records, trims = stored(spark, folder, "records").filter(F.col("log_id") == log_id), stored(spark, folder, "trims")
    alive = log.trimmed(records, trims).filter(F.col("lsn") >= since)
    if until is not None:
        alive = alive.filter(F.col("lsn") <= until)
    data = alive.select(F.lit("RECORD").alias("kind"), F.col("lsn").alias("lo"), F.col("lsn").alias("hi"), "payload")
    holes = log.typed_gaps(alive, trims, since, until).select(F.col("type").alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("payload"))
    return data.unionByName(holes).orderBy("lo")


def tail(spark: SparkSession, folder: str, log_id: int, n: int = 10) -> DataFrame:
    """The last ``n`` records, the newest first."""
    records = log.trimmed(stored(spark, folder, "records").filter(F.col("log_id") == log_id), stored(spark, folder, "trims"))
    return records.orderBy(F.desc("lsn")).limit(n).select("lsn", "ts", "payload")


def write(spark: SparkSession, folder: str, log_id: int, payloads: list[str]) -> list[int]:
    """Append payloads; returns their numbers."""
    records = stored(spark, folder, "records").filter(F.col("log_id") == log_id)
    new = spark.createDataFrame([(log_id, k, p, len(p.encode())) for k, p in enumerate(payloads)], "log_id long, seq long, payload string, payload_size long")
    tails = records.groupBy("log_id").agg(F.max("lsn").alias("last_released"))
    numbered = log.append(new, tails).select("log_id", "lsn", F.current_timestamp().alias("ts"), "payload", "payload_size")
    rows = sorted(numbered.collect(), key=lambda r: r["lsn"])  # as many as payloads were given
    spark.createDataFrame(rows, RECORDS).write.mode("append").parquet(f"{folder}/records")
    return [r["lsn"] for r in rows]


def trim(spark: SparkSession, folder: str, log_id: int, upto: int) -> str:
    """Move a log's trim point; returns OK, or TOOBIG for a number beyond the tail, which changes nothing."""
    tails = stored(spark, folder, "records").filter(F.col("log_id") == log_id).groupBy("log_id").agg(F.max("lsn").alias("last_released"))
    request = spark.createDataFrame([(log_id, upto)], "log_id long, upto long")
    outcome = log.trim_request(stored(spark, folder, "trims"), request, tails).first()
    if outcome["status"] == "OK":
        spark.createDataFrame([(log_id, outcome["trim_point"])], TRIMS).write.mode("append").parquet(f"{folder}/trims")
    return outcome["status"]


# Benchmark runs keep events and statistics as JSON lines, a folder for each kind.


def keep_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(f"{folder}/events")


def keep_stats(stats: DataFrame, folder: str) -> None:
    """Statistics (time, name, value) of a run's step."""
    stats.select("time", "name", "value").write.mode("append").json(f"{folder}/stats")


def kept_stats(spark: SparkSession, folder: str) -> DataFrame:
    """(name, steps, first, last, total) of all statistics kept."""
    rows = spark.read.schema("time double, name string, value double").json(f"{folder}/stats")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("steps"), F.min_by("value", "time").alias("first"), F.max_by("value", "time").alias("last"), F.sum("value").alias("total"))


def main(arguments: list[str]) -> None:
    from logweir.plans.engine import rendered
    from logweir.session import session

    verbs = {"cat": cat, "tail": tail, "write": write, "trim": trim}
    if len(arguments) < 3 or arguments[0] not in verbs:
        raise SystemExit(__doc__)
    verb, folder, log_id, *rest = arguments
    spark = session("tools")
    if verb == "write":
        print("\n".join(map(str, write(spark, folder, int(log_id), rest))))
    else:
        out = verbs[verb](spark, folder, int(log_id), *map(int, rest))
        print(out if isinstance(out, str) else rendered(out))


if __name__ == "__main__":
    main(sys.argv[1:])
