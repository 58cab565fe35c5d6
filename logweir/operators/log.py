"""The algebra of logs: ordered records of (log_id, lsn, ts, filter_key, payload, payload_size).

Records of a log are ordered by lsn; there is no order between logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.lsn import LSN_OLDEST, lsn_to_epoch, lsn_to_esn
from logweir.operators import cells


def range_read(records: DataFrame, since: int, until: int, logs: list[int] | None = None) -> DataFrame:
    """Records with ``since`` <= lsn <= ``until``; the bounds and the logs reach the scan as filters."""
    out = records.filter(F.col("lsn").between(since, until))
    return out if logs is None else out.filter(F.col("log_id").isin(logs))


def passes(kind: str, low: str, high: str | None = None) -> Column:
    """Whether a record passes a server-side filter by its filter_key; one without a key always does.

    ``equality`` asks for the key itself, ``range`` for low <= key <= high by bytes; a range whose bounds
    are reversed filters nothing.
    """
    key = F.col("filter_key")
    if kind == "equality":
        test = key == low
    elif kind == "range":
        test = key.between(low, high) if low <= high else F.lit(True)
    else:
        raise ValueError(kind)
    return key.isNull() | test


def filtered_out_gaps(records: DataFrame, test: Column) -> DataFrame:
    """(log_id, lo, hi) of runs of filtered records whose numbers follow each other, none between."""
    return cells.runs(records.filter(~test).select("log_id", "lsn"), ["log_id"], "lsn")


def gaps(records: DataFrame) -> DataFrame:
    """(log_id, lo, hi) of the numbers missing between records of a log, bounds included."""
    found = cells.steps(records.select("log_id", "lsn"), ["log_id"], "lsn")
    return found.select("log_id", (F.col("before") + 1).alias("lo"), (F.col("after") - 1).alias("hi"))


def typed_gaps(records: DataFrame, trims: DataFrame, since: int = 1, until: int | None = None, window: int = 1, lost: DataFrame | None = None) -> DataFrame:
    """(log_id, type, lo, hi) of what a reader finds missing from ``since`` on.

    ``trims`` (log_id, trim_point) says up to where a log was trimmed.  A stretch that the trim point
    divides is a TRIM gap up to it and another gap behind it.  A gap in an epoch of ``lost`` (log_id, epoch),
    of which no shard is authoritative, is DATALOSS.  Else a gap up to the trim point is TRIM; one
    before a record that is among the first ``window`` of an epoch, with nothing of that epoch delivered
    before, is BRIDGE; one within an epoch is DATALOSS; other changes of epoch are BRIDGE.  Gaps end at
    ``until``.
    """
    some = records.filter(F.col("lsn") >= since).select("log_id", "lsn")
    inner = gaps(some).select("log_id", F.col("lo").alias("_n"), (F.col("hi") + 1).alias("_g"), F.lit(False).alias("_fresh"))
    first = some.groupBy("log_id").agg(F.min("lsn").alias("_g")).filter(F.col("_g") > since)
    rows = inner.unionByName(first.select("log_id", F.lit(since).cast("long").alias("_n"), "_g", F.lit(True).alias("_fresh")))
    rows = rows.join(trims, "log_id", "left").withColumn("_t", F.coalesce("trim_point", F.lit(0)))
    split = (F.col("_n") <= F.col("_t")) & (F.col("_t") + 1 < F.col("_g"))
    piece = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    whole = F.array(piece(F.col("_n"), F.col("_g") - 1))
    parts = F.when(split, F.array(piece(F.col("_n"), F.col("_t")), piece(F.col("_t") + 1, F.col("_g") - 1))).otherwise(whole)
    rows = rows.withColumn("_p", F.explode(parts)).select("*", "_p.*").withColumn("_dead", F.lit(False))
    if lost is not None:
        dead = lost.select(F.col("log_id").alias("_l"), F.col("epoch").alias("_e")).distinct()
        rows = rows.drop("_dead").join(dead, (F.col("log_id") == F.col("_l")) & (lsn_to_epoch(F.col("lo")) == F.col("_e")), "left").withColumn("_dead", F.col("_e").isNotNull())
    epoch_next, epoch_lo, epoch_done = lsn_to_epoch(F.col("_g")), lsn_to_epoch(F.col("lo")), lsn_to_epoch(F.col("lo") - 1)
    kind = (
        F.when(F.col("_dead"), "DATALOSS")
        .when(F.col("hi") <= F.col("_t"), "TRIM")
        .when((lsn_to_esn(F.col("_g")) <= window) & (F.col("_fresh") | (epoch_done < epoch_next)), "BRIDGE")
        .when(epoch_next == epoch_lo, "DATALOSS")
        .otherwise("BRIDGE")
    )
    hi = F.col("hi") if until is None else F.least(F.lit(until), F.col("hi"))
    out = rows.select("log_id", kind.alias("type"), "lo", hi.alias("hi"))
    return out if until is None else out.filter(F.col("lo") <= until)


def find_time(records: DataFrame, at: Column, trims: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """(log_id, lsn) from which on all records at or after a time are read.

    It is the first record at or after the time; past the last record, the number that comes next; before the
    first, the number behind the trim point.  ``logs`` (log_id) may name logs without records, whose
    answer is the oldest number.  Records up to the trim point of ``trims`` (log_id, trim_point) don't count.
    """
    alive = records.select("log_id", "lsn", "ts")
    if trims is not None:
        alive = trimmed(alive, trims)
    found = alive.groupBy("log_id").agg(F.min(F.when(F.col("ts") >= at, F.col("lsn"))).alias("_first"), F.max("lsn").alias("_last"), F.min_by("ts", "lsn").alias("_oldest"))
    every = (logs if logs is not None else records).select("log_id").distinct().join(found, "log_id", "left")
    if trims is not None:
        every = every.join(trims.groupBy("log_id").agg(F.max("trim_point").alias("_trim")), "log_id", "left")
    else:
        every = every.withColumn("_trim", F.lit(0))
    lsn = F.when(F.col("_last").isNull(), F.lit(LSN_OLDEST)).when(F.col("_oldest") > at, F.coalesce("_trim", F.lit(0)) + 1).otherwise(F.coalesce("_first", F.col("_last") + 1))
    return every.select("log_id", lsn.cast("long").alias("lsn"))


def find_time_approximate(directory: DataFrame, at: Column) -> DataFrame:
    """(log_id, lsn): the first number of a log in its newest time partition that starts at or before a time.

    Only the partition directory (log_id, start, first_lsn, ...) is read, see ``partition_directory``.
    """
    return directory.groupBy("log_id").agg(F.coalesce(F.max_by("first_lsn", F.when(F.col("start") <= at, F.col("start"))), F.min("first_lsn")).alias("lsn"))


def find_key(records: DataFrame, key: str, column: str = "find_key") -> DataFrame:
    """(log_id, lo, hi): the last number whose key is below, and the first whose key isn't."""
    k = F.col(column)
    return records.groupBy("log_id").agg(F.max(F.when(k < key, F.col("lsn"))).alias("lo"), F.min(F.when(k >= key, F.col("lsn"))).alias("hi"))


def merge_find_replies(replies: DataFrame) -> DataFrame:
    """(req, status, lo, hi) of shards' half-open answers (req, shard, status, lo, hi): the greatest lo and the least hi."""
    good = (F.col("status") == "OK") & (F.col("lo") < F.col("hi"))
    out = replies.groupBy("req").agg(F.max(F.when(good, F.col("lo"))).alias("lo"), F.min(F.when(good, F.col("hi"))).alias("hi"), F.bool_and(good).alias("_all"), F.bool_or(good).alias("_any"))
    done = F.col("_all") | (F.col("hi") - F.col("lo") <= 1)
    return out.select("req", F.when(~F.col("_any"), "FAILED").when(done, "OK").otherwise("PARTIAL").alias("status"), "lo", "hi")


def tail_attributes(records: DataFrame) -> DataFrame:
    """(log_id, last_released, last_timestamp, byte_offset) of each log's end."""
    return records.groupBy("log_id").agg(F.max("lsn").alias("last_released"), F.max_by("ts", "lsn").alias("last_timestamp"), F.sum("payload_size").cast("long").alias("byte_offset"))


def head_attributes(records: DataFrame, trims: DataFrame) -> DataFrame:
    """(log_id, trim_point, trim_point_timestamp): the timestamp is the next record's, null if there is none."""
    after = records.join(trims, "log_id").filter(F.col("lsn") > F.col("trim_point")).groupBy("log_id").agg(F.min_by("ts", "lsn").alias("trim_point_timestamp"))
    return trims.join(after, "log_id", "left").select("log_id", "trim_point", "trim_point_timestamp")


def empty_logs(logs: DataFrame, records: DataFrame, trims: DataFrame, pseudo: Column | None = None) -> DataFrame:
    """The log_ids of ``logs`` without a record behind the trim point; those for which ``pseudo`` holds (bridges, holes) aren't records."""
    if pseudo is not None:
        records = records.filter(~F.coalesce(pseudo, F.lit(False)))
    alive = records.join(trims, "log_id", "left").filter(F.col("lsn") > F.coalesce("trim_point", F.lit(0)))
    return logs.select("log_id").distinct().join(alive.select("log_id"), "log_id", "left_anti")


def trimmed(records: DataFrame, trims: DataFrame) -> DataFrame:
    """Records behind their log's trim point."""
    return records.join(trims.select("log_id", "trim_point"), "log_id", "left").filter(F.col("lsn") > F.coalesce("trim_point", F.lit(0))).drop("trim_point")


def trim_request(trims: DataFrame, requests: DataFrame, tails: DataFrame) -> DataFrame:
    """(log_id, trim_point, status) after requests (log_id, upto); one beyond the tail is TOOBIG and has no effect."""
    all_ = requests.join(trims, "log_id", "left").join(tails.select("log_id", "last_released"), "log_id", "left")
    big = F.col("upto") > F.coalesce("last_released", F.lit(0))
    old = F.coalesce("trim_point", F.lit(0))
    return all_.select("log_id", F.when(big, old).otherwise(F.greatest(old, "upto")).alias("trim_point"), F.when(big, "TOOBIG").otherwise("OK").alias("status"))


def retention_trims(records: DataFrame, backlog: DataFrame, now: Column) -> DataFrame:
    """(log_id, trim_point): the last number older than the log's backlog (log_id, backlog_sec); 0 if none is."""
    old = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > F.col("backlog_sec")
    return records.join(backlog, "log_id").groupBy("log_id").agg(F.coalesce(F.max(F.when(old, F.col("lsn"))), F.lit(0)).cast("long").alias("trim_point"))


def partition_directory(records: DataFrame, partition: str = "day") -> DataFrame:
    """(log_id, start, end, first_lsn, max_lsn, approx_bytes) of each log's time partitions; they end where the next of all starts."""
    start = F.date_trunc(partition, "ts").cast("timestamp_ntz").alias("start")
    rows = records.groupBy("log_id", start).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("max_lsn"), F.sum("payload_size").cast("long").alias("approx_bytes"))
    starts = rows.select("start").distinct()  # one row per time partition
    ends = starts.select("start", F.lead("start").over(Window.orderBy("start")).alias("end"))
    return rows.join(ends, "start")


def data_size(directory: DataFrame, since: Column, until: Column, now: Column) -> DataFrame:
    """(log_id, bytes) stored between two times: whole partitions, and shares of those that are only partly within."""
    lo, hi = since, F.least(until, now)
    seconds = lambda t: F.unix_seconds(t.cast("timestamp"))
    start, end = F.col("start"), F.coalesce("end", now)
    covered = seconds(F.least(hi, end)) - seconds(F.greatest(lo, start))
    length = seconds(end) - seconds(start)
    whole = (lo <= start) & (end <= hi)
    share = F.when(whole | (length <= 0), F.col("approx_bytes")).otherwise(F.round(F.col("approx_bytes") * covered / length))
    return directory.filter((end >= lo) & (start <= hi) & (lo < hi)).groupBy("log_id").agg(F.sum(share.cast("long")).alias("bytes"))


def obsolete_partitions(directory: DataFrame, trims: DataFrame) -> DataFrame:
    """The starts of time partitions, oldest first, before the first that still holds a record of any log."""
    alive = directory.join(trims, "log_id", "left").filter(F.col("max_lsn") > F.coalesce("trim_point", F.lit(0))).agg(F.min("start").alias("_oldest"))
    return directory.select("start").distinct().join(F.broadcast(alive)).filter(F.col("_oldest").isNull() | (F.col("start") < F.col("_oldest"))).select("start")


def byte_offsets(records: DataFrame) -> DataFrame:
    """(log_id, lsn, byte_offset): bytes of the log up to and with each record."""
    summed = cells.running(records.select("log_id", "lsn", "payload_size"), ["log_id"], "lsn", F.col("payload_size").cast("long"), "sum", "byte_offset")
    return summed.select("log_id", "lsn", F.col("byte_offset").cast("long").alias("byte_offset"))


def batches(records: DataFrame, size: int) -> DataFrame:
    """(log_id, batch, first_lsn, n, bytes, payloads): records of a log in batches of about ``size`` bytes, in order."""
    rows = cells.running(records.select("log_id", "lsn", "payload", "payload_size"), ["log_id"], "lsn", F.col("payload_size").cast("long"), "sum", "_sum", before=True)
    rows = rows.withColumn("batch", F.floor(F.col("_sum") / size).cast("long"))
    item = F.sort_array(F.collect_list(F.struct("lsn", "payload")))
    return rows.groupBy("log_id", "batch").agg(F.min("lsn").alias("first_lsn"), F.count(F.lit(1)).alias("n"), F.sum("payload_size").cast("long").alias("bytes"), F.transform(item, lambda s: s["payload"]).alias("payloads"))


def timed_batches(records: DataFrame, size: int, seconds: int) -> DataFrame:
    """As ``batches``, but a batch also ends with each stretch of ``seconds``: (log_id, stretch, batch, first_lsn, n, bytes, payloads)."""
    stretch = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).cast("long")
    rows = records.select("log_id", "lsn", "payload", "payload_size", stretch.alias("stretch"))
    rows = cells.running(rows, ["log_id", "stretch"], "lsn", F.col("payload_size").cast("long"), "sum", "_sum", before=True).withColumn("batch", F.floor(F.col("_sum") / size).cast("long"))
    item = F.sort_array(F.collect_list(F.struct("lsn", "payload")))
    return rows.groupBy("log_id", "stretch", "batch").agg(F.min("lsn").alias("first_lsn"), F.count(F.lit(1)).alias("n"), F.sum("payload_size").cast("long").alias("bytes"), F.transform(item, lambda s: s["payload"]).alias("payloads"))


def sequenced(appends: DataFrame, size: int, passthrough: int) -> DataFrame:
    """(log_id, batch, first_lsn, n, bytes, payloads) as a log's sequencer batches appends; larger ones than ``passthrough`` bytes go alone.

    An append that goes alone ends the batch before it, so numbers stay in order.
    """
    big = (F.col("payload_size") > passthrough).cast("long")
    rows = appends.select("log_id", "lsn", "payload", "payload_size").withColumn("_big", big)
    rows = cells.running(rows, ["log_id"], "lsn", F.col("_big"), "sum", "_upto")
    rows = rows.withColumn("_part", F.col("_upto") * 2 - F.col("_big"))  # odd: alone; even: what lies between
    rows = cells.running(rows, ["log_id", "_part"], "lsn", F.col("payload_size").cast("long"), "sum", "_sum", before=True).withColumn("_at", F.floor(F.col("_sum") / size).cast("long"))
    item = F.sort_array(F.collect_list(F.struct("lsn", "payload")))
    return rows.groupBy("log_id", "_part", "_at").agg(F.min("lsn").alias("first_lsn"), F.count(F.lit(1)).alias("n"), F.sum("payload_size").cast("long").alias("bytes"), F.transform(item, lambda s: s["payload"]).alias("payloads")).drop("_part", "_at")


def unbatched(batched: DataFrame) -> DataFrame:
    """(log_id, lsn, batch_offset, payload): the records of batches, which share a number; for those of null see ``undecodable``.

    Batches without records are left out behind the step; left out before, their payloads would be decoded twice.
    """
    rows = batched.select("log_id", F.col("first_lsn").alias("lsn"), F.posexplode_outer("payloads").alias("batch_offset", "payload"))
    return rows.filter(F.col("batch_offset").isNotNull())


def undecodable(batched: DataFrame) -> DataFrame:
    """(log_id, type, lo, hi): a DATALOSS gap at the number of each batch that couldn't be decoded (null payloads)."""
    return batched.filter(F.col("payloads").isNull()).select("log_id", F.lit("DATALOSS").alias("type"), F.col("first_lsn").alias("lo"), F.col("first_lsn").alias("hi"))


def append(records: DataFrame, tails: DataFrame) -> DataFrame:
    """New records (log_id, seq, ...) with numbers that go on behind their log's tail, in order of ``seq``, a whole number."""
    numbered = cells.running(records, ["log_id"], "seq", F.lit(1), "count", "_nth")
    return numbered.join(tails.select("log_id", "last_released"), "log_id", "left").withColumn("lsn", F.coalesce("last_released", F.lit(0)) + F.col("_nth")).drop("last_released", "_nth")


def log_digest(records: DataFrame, since: int | None = None, until: int | None = None, width: int = 1 << 16) -> DataFrame:
    """(log_id, part, lsns, n): the sorted numbers of each log in a range, in parts of ``width`` numbers, so that a row stays small."""
    if since is not None and until is not None:
        records = range_read(records, since, until)
    return records.groupBy("log_id", F.floor(F.col("lsn") / width).alias("part")).agg(F.sort_array(F.collect_list("lsn")).alias("lsns"), F.count(F.lit(1)).alias("n"))


def read_ordered(records: DataFrame, logs: list[int] | None = None, partitions: int | None = None) -> DataFrame:
    """Records of several logs, in order within each log: dealt by range of (log_id, lsn), so a hot log spreads, and sorted in each partition."""
    out = records if logs is None else records.filter(F.col("log_id").isin(logs))
    keys = [F.col("log_id"), F.col("lsn")]
    dealt = out.repartitionByRange(*keys) if partitions is None else out.repartitionByRange(partitions, *keys)
    return dealt.sortWithinPartitions("log_id", "lsn")


def read_some(records: DataFrame, found_gaps: DataFrame, log_id: int, since: int, n: int) -> DataFrame:
    """(kind, lo, hi, payload): what a reader of one log gets next from ``since`` on, up to ``n`` records or one gap.

    Records come until a gap; a gap comes alone, as the first thing.
    """
    data = records.filter((F.col("log_id") == log_id) & (F.col("lsn") >= since)).select(F.lit("RECORD").alias("kind"), F.col("lsn").alias("lo"), F.col("lsn").alias("hi"), F.col("payload").cast("string").alias("payload"))
    holes = found_gaps.filter((F.col("log_id") == log_id) & (F.col("hi") >= since)).select(F.lit("GAP").alias("kind"), F.greatest("lo", F.lit(since)).alias("lo"), "hi", F.lit(None).cast("string").alias("payload"))
    ahead = data.unionByName(holes).orderBy("lo").limit(n)
    so_far = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)  # over n rows at most
    seen = ahead.withColumn("_gaps", F.sum((F.col("kind") == "GAP").cast("int")).over(so_far)).withColumn("_at", F.row_number().over(Window.orderBy("lo")))
    return seen.filter((F.col("_gaps") == 0) | ((F.col("_at") == 1) & (F.col("kind") == "GAP"))).select("kind", "lo", "hi", "payload")


def after_location(records: DataFrame, log_id: int, lsn: int, n: int) -> DataFrame:
    """The next ``n`` records in storage order, by log and number, behind a location; the last one's is the location to go on from."""
    behind = (F.col("log_id") > log_id) | ((F.col("log_id") == log_id) & (F.col("lsn") > lsn))
    return records.filter(behind).orderBy("log_id", "lsn").limit(n)


def shadowed(records: DataFrame, ratio: float) -> DataFrame:
    """The share of records that a shadow log gets, chosen by a hash of (log_id, lsn), so reruns agree."""
    return records.filter(F.pmod(F.xxhash64("log_id", "lsn"), F.lit(1_000_000)) < int(ratio * 1_000_000))


def dedup_copies(copies: DataFrame) -> DataFrame:
    """One record for each (log_id, lsn), of the copies of several nodes."""
    return copies.dropDuplicates(["log_id", "lsn"])


def merged_copies(copies: DataFrame) -> DataFrame:
    """Records in order within each log, merged from the copies of all shards, one each."""
    return read_ordered(dedup_copies(copies))


def one_trim_gap(found_gaps: DataFrame) -> DataFrame:
    """Typed gaps (log_id, type, lo, hi) with TRIM gaps that adjoin as one, so that a reader sees a trimmed section once."""
    from logweir.operators.integrity import merged_ranges

    trim = F.col("type") == "TRIM"
    whole = merged_ranges(found_gaps.filter(trim).select("log_id", "lo", "hi"), ["log_id"])
    return found_gaps.filter(~trim).select("log_id", "type", "lo", "hi").unionByName(whole.select("log_id", F.lit("TRIM").alias("type"), "lo", "hi"))


def update_checkpoints(checkpoints: DataFrame, updates: DataFrame) -> DataFrame:
    """(customer, log_id, lsn) after updates; an update with a null lsn removes the checkpoint."""
    both = checkpoints.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return both.groupBy("customer", "log_id").agg(F.max_by("lsn", "_new").alias("lsn")).filter(F.col("lsn").isNotNull())


def groups_by_name(groups: DataFrame, namespace: str, delimiter: str = "/") -> DataFrame:
    """Log groups (name, logid_lo, logid_hi) in a namespace and those below it, or the group of that name."""
    root = namespace.rstrip(delimiter)
    return groups.filter((F.col("name") == root) | F.col("name").startswith(root + delimiter)) if root else groups


def group_of_log(groups: DataFrame, log_id: int) -> DataFrame:
    """The log group that holds a log."""
    return groups.filter(F.lit(log_id).between(F.col("logid_lo"), F.col("logid_hi")))


def bounded_sample(records: DataFrame, by: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` records of each group at most, drawn evenly by a hash, so reruns agree.

    Cells of each group give their first ``k`` by the hash, and of these the first ``k`` are kept, so no group comes into one task.
    """
    drawn = F.xxhash64(F.lit(seed), "log_id", "lsn")
    rows = records.withColumn("_h", drawn).withColumn("_cell", F.pmod("_h", F.lit(512)))
    first = lambda part: F.row_number().over(Window.partitionBy(*part).orderBy("_h", "log_id", "lsn"))
    rows = rows.withColumn("_r", first([by, "_cell"])).filter(F.col("_r") <= k)
    return rows.withColumn("_r", first([by])).filter(F.col("_r") <= k).drop("_r", "_h", "_cell")
