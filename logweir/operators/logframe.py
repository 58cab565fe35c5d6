"""A cluster's logs as one object, with the verbs of a client."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.operators import log
from logweir.plans.logs_tree import LogsTree


def time_at(text: str) -> Column:
    """A time as a column, from ``YYYY-MM-DD HH:MM:SS``."""
    return F.lit(text).cast("timestamp_ntz")


def time_of_ms(ms: int) -> Column:
    """A time as a column, from milliseconds since the epoch."""
    return F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")


@dataclass(frozen=True)
class LogFrame:
    """Records (log_id, lsn, ts, payload, payload_size, ...), trim points (log_id, trim_point) and the catalog.

    A LogFrame is a value: append and trim return another one.
    """

    records: DataFrame
    trims: DataFrame
    tree: LogsTree

    def append(self, new: DataFrame) -> LogFrame:
        """With new records (log_id, seq, ts, payload, payload_size, ...) behind each log's tail."""
        numbered = log.append(new, log.tail_attributes(self.records)).drop("seq")
        return replace(self, records=self.records.unionByName(numbered, allowMissingColumns=True))

    def trim(self, log_id: int, upto: int) -> tuple[LogFrame, str]:
        """Trimmed up to a number, and the status: OK, or TOOBIG for one beyond the tail."""
        spark = self.records.sparkSession
        request = spark.createDataFrame([(log_id, upto)], "log_id long, upto long")
        outcome = log.trim_request(self.trims, request, log.tail_attributes(self.records.filter(F.col("log_id") == log_id))).first()
        others = self.trims.filter(F.col("log_id") != log_id)
        moved = spark.createDataFrame([(log_id, int(outcome["trim_point"]))], "log_id long, trim_point long")
        return replace(self, trims=others.unionByName(moved)), outcome["status"]

    def _one(self, log_id: int) -> DataFrame:
        return self.records.filter(F.col("log_id") == log_id)

    def find_time(self, log_id: int, at: Column, approximate: bool = False) -> int:
        if approximate:
            row = log.find_time_approximate(log.partition_directory(self._one(log_id)), at).first()
            return row["lsn"] if row else log.LSN_OLDEST
        logs = self.records.sparkSession.createDataFrame([(log_id,)], "log_id long")
        return log.find_time(self._one(log_id), at, self.trims, logs).first()["lsn"]

    def find_key(self, log_id: int, key: str, column: str = "find_key") -> tuple[int | None, int | None]:
        row = log.find_key(self._one(log_id), key, column).first()
        return (row["lo"], row["hi"]) if row else (None, None)

    def is_log_empty(self, log_id: int) -> bool:
        logs = self.records.sparkSession.createDataFrame([(log_id,)], "log_id long")
        return not log.empty_logs(logs, self._one(log_id), self.trims).isEmpty()

    def data_size(self, log_id: int, since: Column, until: Column, now: Column) -> int:
        row = log.data_size(log.partition_directory(self._one(log_id)), since, until, now).first()
        return row["bytes"] if row else 0

    def get_tail_lsn(self, log_id: int) -> int:
        return self._one(log_id).agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("m")).first()["m"]

    def get_tail_attributes(self, log_id: int):
        return log.tail_attributes(self._one(log_id)).first()

    def get_head_attributes(self, log_id: int):
        return log.head_attributes(self._one(log_id), self.trims.filter(F.col("log_id") == log_id)).first()

    def create_reader(self, log_id: int, since: int = 1, until: int | None = None) -> DataFrame:
        """(kind, lo, hi, payload) of records and typed gaps, in order."""
        one = log.trimmed(self._one(log_id), self.trims).filter(F.col("lsn") >= since)
        if until is not None:
            one = one.filter(F.col("lsn") <= until)
        holes = log.typed_gaps(one, self.trims, since, until)
        data = one.select(F.lit("RECORD").alias("kind"), F.col("lsn").alias("lo"), F.col("lsn").alias("hi"), F.col("payload").cast("string").alias("payload"))
        return data.unionByName(holes.select(F.col("type").alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("payload"))).orderBy("lo")
