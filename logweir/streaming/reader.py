"""Unbounded reading of logs with Structured Streaming: release pointers, copies, gaps and replicated state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Records of Parquet files as they arrive; the number of files in a batch is the flow-control window."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def released(records: DataFrame, last_released: DataFrame) -> DataFrame:
    """Records up to their log's release pointer (log_id, last_released)."""
    return records.join(last_released, "log_id").filter(F.col("lsn") <= F.col("last_released")).drop("last_released")


#: How far below a log's highest number a record may still come.
LATE = 1 << 20


class FirstCopies(StatefulProcessor):
    """Lets each number of a log through once; state is the runs of numbers met, as far as late ones may fall between."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getValueState("met", "runs string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).drop_duplicates("lsn").sort_values("lsn")
        runs = json.loads(self.met.get()[0]) if self.met.exists() else []
        if runs:
            starts, ends = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
            at = np.searchsorted(starts, new["lsn"].to_numpy(), side="right") - 1
            known = (at >= 0) & (new["lsn"].to_numpy() <= ends[np.maximum(at, 0)])
            new = new[~known & (new["lsn"].to_numpy() > ends[-1] - LATE)]
        if len(new):
            merged: list[list[int]] = []
            for lo, hi in sorted(runs + [[n, n] for n in new["lsn"].tolist()]):
                if merged and lo <= merged[-1][1] + 1:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            top = merged[-1][1]
            self.met.update((json.dumps([r for r in merged if r[1] > top - LATE]),))
            yield new

    def close(self) -> None:
        pass


def without_copies(records: DataFrame) -> DataFrame:
    """The first copy of each (log_id, lsn); what comes LATE numbers or more below its log's highest is dropped, which bounds the state."""
    return records.groupBy("log_id").transformWithStateInPandas(FirstCopies(), records.schema, "Append", "None")


class GapFinder(StatefulProcessor):
    """Keeps each log's last number and gives the numbers that are missing before the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "lsn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        numbers = pd.concat([r["lsn"] for r in rows]).drop_duplicates().sort_values()
        if self.last.exists():
            last = self.last.get()[0]
            numbers = numbers[numbers > last]
            numbers = pd.concat([pd.Series([last]), numbers])
        if len(numbers):
            before, after = numbers[:-1].to_numpy(), numbers[1:].to_numpy()
            some = after > before + 1
            self.last.update((int(numbers.iloc[-1]),))
            yield pd.DataFrame({"log_id": key[0], "lo": before[some] + 1, "hi": after[some] - 1})

    def close(self) -> None:
        pass


def stream_gaps(records: DataFrame) -> DataFrame:
    """(log_id, lo, hi) of gaps as batches arrive, by number and not by time; needs the RocksDB state store."""
    return records.select("log_id", "lsn").groupBy("log_id").transformWithStateInPandas(GapFinder(), "log_id long, lo long, hi long", "Append", "None")


class KeyValueState(StatefulProcessor):
    """The value of each key by the delta with the greatest number; older deltas are skipped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "lsn long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        deltas = pd.concat(list(rows)).sort_values("lsn")
        top = deltas.iloc[-1]
        if not self.version.exists() or self.version.get()[0] < int(top["lsn"]):
            self.version.update((int(top["lsn"]), top["value"]))
            yield pd.DataFrame({"key": [key[0]], "lsn": [int(top["lsn"])], "value": [top["value"]]})

    def close(self) -> None:
        pass


def stream_key_values(deltas: DataFrame) -> DataFrame:
    """(key, lsn, value) each time that a key's value changes, from deltas (key, lsn, value)."""
    return deltas.groupBy("key").transformWithStateInPandas(KeyValueState(), "key string, lsn long, value string", "Update", "None")


def folded_state(snapshot: DataFrame, deltas: DataFrame, version: int, stops: DataFrame | None = None) -> DataFrame:
    """(key, value) of a snapshot (key, value) taken at ``version`` and the deltas (key, lsn, value) after it.

    A null value removes the key.  ``stops`` (lo, hi) are gaps of the deltas' log that may hide deltas (TRIM,
    DATALOSS): the state stalls before the first one behind the version, until a newer snapshot.
    """
    later = deltas.filter(F.col("lsn") > version).select("key", "lsn", "value")
    if stops is not None:
        first = stops.filter(F.col("hi") > version).agg(F.min("lo").alias("_stop"))
        later = later.join(F.broadcast(first)).filter(F.col("_stop").isNull() | (F.col("lsn") < F.col("_stop"))).drop("_stop")  # one row
    all_ = snapshot.select("key", F.lit(version).cast("long").alias("lsn"), "value").unionByName(later)
    return all_.groupBy("key").agg(F.max_by("value", "lsn").alias("value")).filter(F.col("value").isNotNull())


class SuspectedLoss(RuntimeError):
    """A batch that must be delivered again."""


def deliver(stream: DataFrame, checkpoint: str, on_batch, attempts: int = 3, every: str | None = None):
    """Push batches to ``on_batch(records, batch_id)``; one for which it returns False is delivered again, ``attempts`` times at most.

    What there is is delivered, and then the call returns; with ``every`` (such as ``2 seconds``, the delivery
    latency) delivery goes on until the returned query is stopped.
    """

    def push(batch: DataFrame, batch_id: int) -> None:
        if on_batch(batch, batch_id) is False:
            raise SuspectedLoss(f"batch {batch_id} was refused")

    for left in range(attempts, 0, -1):
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(push)
        if every:
            return writer.trigger(processingTime=every).start()
        query = writer.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return query
        except Exception as e:
            if left == 1 or "was refused" not in str(e):
                raise
    return None


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is into Parquet files, exactly once over restarts with the same checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()
