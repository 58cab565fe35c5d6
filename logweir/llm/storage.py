"""Where intermediate tables go, and how lineage is cut.

Tables are written under the folder named by ``spark.checkpoint.dir`` (shared by the driver and all
executors).  Only in local mode, and only where that setting is absent, a folder of our own is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="logweir-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = "file://" + own
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/logweir/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table, so that a lost executor costs a reread only."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of all tables that this driver has written and not deleted, in order."""
    return list(_WRITTEN)


def discard_all(spark: SparkSession, besides: list[str]) -> None:
    """Delete the tables written, but for some; nothing that is still to be computed may rest on them."""
    for path in [p for p in _WRITTEN if p not in besides]:
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of ours through Hadoop's file system interface, so that any store will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def release(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote for ``df``."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, next((p for p in _WRITTEN if f.endswith(p.rsplit("/", 1)[1])), f))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean_batches(spark: SparkSession, size: str = "8m") -> None:
    """Texts go to Python some megabytes at a time, unless the session sets a size of its own.

    Batches are in memory on both sides at once; the default of 64 MB is much for texts and n-gram sets.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(key, size)
