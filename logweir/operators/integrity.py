"""Checks of replicas and of delivery, placement and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logweir.operators import cells

# Bits of the replica checker's findings.
ERRORS = {
    "DATALOSS": 1 << 0, "DIFFERENT_COPYSET_IN_LATEST_WAVE": 1 << 1, "COPYSET_WITHOUT_SELF": 1 << 2, "COPYSET_NOT_IN_NODESET": 1 << 3,
    "SMALL_COPYSET": 1 << 4, "NO_ACCURATE_COPYSET": 1 << 5, "DATA_MISMATCH": 1 << 6, "BAD_REPLICATION_LAST_WAVE": 1 << 7,
    "BAD_REPLICATION": 1 << 8, "HOLE_RECORD_CONFLICT": 1 << 9, "BRIDGE_RECORD_CONFLICT": 1 << 10, "DUPLICATES_IN_COPYSET": 1 << 11,
}
NO_WAVE = 4294967295


def precedence(recovery: Column, wave: Column) -> Column:
    """Order of a record's copies: those written by recovery first, then by wave; wave 0 of an append is the latest."""
    return F.struct(recovery.cast("int").alias("recovery"), F.when(~recovery & (wave == 0), F.lit(NO_WAVE)).otherwise(wave).cast("long").alias("wave"))


def winning_copies(copies: DataFrame) -> DataFrame:
    """The copy of each (log_id, lsn) that precedes the others; ties go to the lowest node."""
    w = Window.partitionBy("log_id", "lsn").orderBy(precedence(F.col("recovery"), F.col("wave")).desc(), "node")
    return copies.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merged_writes(writes: DataFrame) -> DataFrame:
    """(log_id, lsn, payload, copyset, flags): the latest payload there is, the latest copyset, all flags."""
    p = precedence(F.col("recovery"), F.col("wave"))
    return writes.groupBy("log_id", "lsn").agg(
        F.max_by("payload", F.when(F.col("payload").isNotNull(), p)).alias("payload"), F.max_by("copyset", p).alias("copyset"), F.bit_or("flags").alias("flags")
    )


def digest_mutations(copies: DataFrame, seal_epoch: int) -> DataFrame:
    """(esn, winner, winner_epoch, amend, success, conflict, needs_mutation) of copies (esn, node, type, epoch).

    Types are NORMAL, MUTATED, HOLE and BRIDGE.  The winner precedes; nodes that hold it as recovery of this
    seal epoch would have written it are done, those with the same kind of content are amended, the others
    conflict.
    """
    content = F.when(F.col("type").isin("NORMAL", "MUTATED"), "RECORD").otherwise(F.col("type"))
    recovery = F.col("type") != "NORMAL"
    rows = copies.withColumn("_content", content).withColumn("_p", precedence(recovery, F.col("epoch")))
    top = F.max_by(F.struct("type", "epoch", "_content"), "_p").over(Window.partitionBy("esn"))
    rows = rows.withColumn("_w", top)
    same = F.col("_content") == F.col("_w._content")
    done = same & recovery & (F.col("epoch") == seal_epoch)
    nodes = lambda test: F.sort_array(F.collect_set(F.when(test, F.col("node"))))
    out = rows.groupBy("esn").agg(F.first("_w.type").alias("winner"), F.first("_w.epoch").alias("winner_epoch"), nodes(same & ~done).alias("amend"), nodes(done).alias("success"), nodes(~same).alias("conflict"))
    return out.withColumn("needs_mutation", (F.size("amend") > 0) | (F.size("conflict") > 0))


def replica_errors(copies: DataFrame, replication: int, domains: int = 2, nodesets: DataFrame | None = None) -> DataFrame:
    """(log_id, lsn, n_copies, errors) of records whose copies break a rule; ``errors`` has a bit for each (ERRORS).

    Copies are (log_id, lsn, node, wave, copyset, payload_hash, kind: RECORD, HOLE or BRIDGE, domain).  The
    latest wave is 0 if there is one, else the greatest.  One of its copysets is accurate if as many of its
    nodes as copies are asked for hold the record with it, and well replicated if these are in ``domains``
    domains.  ``nodesets`` (log_id, nodeset: array) tells which nodes a log's copies may name.

    Copies are dealt out by record once, and judged by copyset, then wave, then record.  What a copy shows by
    itself is bits from the start.  All that is aggregated has a fixed width (but for more than 2 ``domains``), so
    nothing is listed or sorted; unknown nodes, domains and payloads don't count as different ones.
    """
    key = ["log_id", "lsn"]
    hole, record, bridge = (1 << (20 + i) for i in range(3))
    bit = lambda test, b: F.when(test, F.lit(b).cast("long")).otherwise(F.lit(0).cast("long"))
    size = F.size("_set")
    own = (
        bit(~F.array_contains("_set", F.col("node")), ERRORS["COPYSET_WITHOUT_SELF"])
        + bit(size < replication, ERRORS["SMALL_COPYSET"])
        + bit(size > F.size(F.array_distinct("_set")), ERRORS["DUPLICATES_IN_COPYSET"])
        + bit(F.col("kind") == "HOLE", hole) + bit(F.col("kind") == "RECORD", record) + bit(F.col("kind") == "BRIDGE", bridge)
    )
    order = F.when(F.col("wave") == 0, F.lit(NO_WAVE).cast("long")).otherwise(F.col("wave").cast("long"))
    content = F.when(F.col("kind") == "RECORD", F.col("payload_hash"))
    rows = copies.withColumn("_set", F.sort_array("copyset")).select(*key, order.alias("_order"), "_set", "node", "domain", own.alias("_own"), content.alias("_least"))
    if domains <= 2:
        placed, placed_again = [F.min("domain").alias("_near"), F.max("domain").alias("_far")], [F.min("_near").alias("_near"), F.max("_far").alias("_far")]
        spread = F.col("_near") != F.col("_far") if domains == 2 else F.col("_near").isNotNull() | F.lit(domains < 1)
    else:
        placed, placed_again = [F.collect_set("domain").alias("_domains")], [F.array_distinct(F.flatten(F.collect_list("_domains"))).alias("_domains")]
        spread = F.size("_domains") >= domains
    again = [F.sum("n_copies").alias("n_copies"), F.bit_or("_own").alias("_own"), F.min("_least").alias("_least"), F.max("_most").alias("_most"), *placed_again]

    rows = rows.repartition(*key).groupBy(*key, "_order", "_set").agg(
        F.count(F.lit(1)).alias("n_copies"), F.bit_or("_own").alias("_own"), F.min("_least").alias("_least"), F.max("_least").alias("_most"), *placed, F.count_distinct("node").alias("_nodes")
    )
    if nodesets is not None:
        rows = rows.join(nodesets.select("log_id", "nodeset"), "log_id", "left")
        outside = F.col("nodeset").isNotNull() & (F.size(F.array_except("_set", "nodeset")) > 0)
        rows = rows.withColumn("_own", F.col("_own") + bit(outside, ERRORS["COPYSET_NOT_IN_NODESET"]))
    level = F.when(F.col("_nodes") < F.least(size, F.lit(replication)), 0).when(spread, 2).otherwise(1)
    waves = rows.groupBy(*key, "_order").agg(F.count(F.lit(1)).alias("_sets"), F.max(level).alias("_level"), *again)
    last = F.max_by(F.when(F.col("_sets") > 1, 3).otherwise(0) + F.col("_level"), F.col("_order"))
    found = waves.groupBy(*key).agg(last.alias("_last"), *again)

    has = lambda b: F.col("_own").bitwiseAND(F.lit(b).cast("long")) > 0
    holes, bridges = has(hole) & has(record), has(bridge) & has(record)
    level = F.col("_last") % 3
    errors = (
        F.col("_own").bitwiseAND(F.lit(hole - 1).cast("long"))
        + bit(F.col("_last") > 2, ERRORS["DIFFERENT_COPYSET_IN_LATEST_WAVE"])
        + bit(level == 0, ERRORS["NO_ACCURATE_COPYSET"])
        + bit(holes, ERRORS["HOLE_RECORD_CONFLICT"])
        + bit(bridges, ERRORS["BRIDGE_RECORD_CONFLICT"])
        + bit(~holes & ~bridges & (F.col("_least") != F.col("_most")), ERRORS["DATA_MISMATCH"])
        + bit(level < 2, ERRORS["BAD_REPLICATION_LAST_WAVE"])
        + bit((level < 2) & ~F.coalesce(spread, F.lit(False)), ERRORS["BAD_REPLICATION"])
    )
    return found.select(*key, "n_copies", errors.alias("errors")).filter("errors > 0")


def lost_numbers(found_gaps: DataFrame) -> DataFrame:
    """(log_id, lsn, n_copies, errors): DATALOSS for each DATALOSS gap (log_id, type, lo, hi), at its first number; n_copies is 0."""
    return found_gaps.filter(F.col("type") == "DATALOSS").select("log_id", F.col("lo").alias("lsn"), F.lit(0).cast("long").alias("n_copies"), F.lit(ERRORS["DATALOSS"]).cast("long").alias("errors"))


def error_counts(found: DataFrame, examples: int = 3) -> DataFrame:
    """(error, n, examples) of each kind of finding, with the first few records as examples.

    One pass over the findings: each task counts its own and keeps its first few of each kind, in Arrow batches, as
    no built-in aggregate keeps the least few; only these come together.
    """
    names = F.array(*[F.lit(n) for n in ERRORS])
    key = ["log_id", "lsn"]
    rows = found.select(*key, F.col("errors").cast("long").alias("errors"))
    schema = StructType([StructField("kind", LongType()), StructField("n", LongType()), *[StructField(c, rows.schema[c].dataType) for c in key]])
    kept = rows.mapInArrow(first_of_kinds(list(ERRORS.values()), examples), schema)
    first = F.slice(F.sort_array(F.collect_list(F.when(F.col("n") == 0, F.struct("log_id", "lsn")))), 1, examples)
    return kept.groupBy(F.element_at(names, (F.col("kind") + 1).cast("int")).alias("error")).agg(F.sum("n").alias("n"), first.alias("examples"))


def first_of_kinds(bits: list[int], k: int):
    """For mapInArrow: (kind, n, log_id, lsn) of rows (log_id, lsn, errors): a row with each kind's count, and its first ``k`` records with n = 0."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        counts, best, schema = [0] * len(bits), [None] * len(bits), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            schema = table.schema
            errors = table["errors"]
            for i, bit in enumerate(bits):
                hit = pc.greater(pc.bit_wise_and(errors, bit), 0)
                n = pc.sum(hit).as_py() or 0
                if n:
                    counts[i] += n
                    rows = table.select(["log_id", "lsn"]).filter(hit)
                    rows = rows if best[i] is None else pa.concat_tables([best[i], rows])
                    best[i] = rows.take(pc.select_k_unstable(rows, k, [("log_id", "ascending"), ("lsn", "ascending")])).combine_chunks()
        for i, rows in enumerate(best):
            if rows is not None:
                kinds, n = pa.array([i] * (rows.num_rows + 1), pa.int64()), pa.array([counts[i]] + [0] * rows.num_rows, pa.int64())
                ids = [pa.concat_arrays([pa.nulls(1, schema.field(c).type), *rows[c].chunks]) for c in ("log_id", "lsn")]
                yield pa.RecordBatch.from_arrays([kinds, n, *ids], names=["kind", "n", "log_id", "lsn"])

    return run


def delivery_errors(reads: DataFrame) -> DataFrame:
    """(log_id, writer_id, read_pos, error) of what a reader got wrong.

    ``reads`` has log_id, writer_id, read_pos, lsn, seq and good (whether the checksum held).  A sequence
    number met before is DUPLICATE; one below the highest before it is REORDERING; a bad checksum is
    CHECKSUM_MISMATCH and counts for nothing else.
    """
    good = F.col("good")
    once = Window.partitionBy("log_id", "writer_id", "seq", "good").orderBy("read_pos")
    rows = cells.running(reads, ["log_id", "writer_id"], "read_pos", F.when(good, F.col("seq")), "max", "_high", before=True)
    rows = rows.withColumn("_times", F.row_number().over(once))
    error = F.when(~good, "CHECKSUM_MISMATCH").when(F.col("_times") > 1, "DUPLICATE").when(F.col("seq") < F.col("_high"), "REORDERING")
    return rows.select("log_id", "writer_id", "read_pos", error.alias("error")).filter(F.col("error").isNotNull())


def lost_records(acked: DataFrame, reads: DataFrame) -> DataFrame:
    """(log_id, writer_id, seq, error): DATALOSS for what was acknowledged but not read, LSN_MISMATCH where the numbers differ."""
    seen = reads.groupBy("log_id", "writer_id", "seq").agg(F.min("lsn").alias("_lsn"))
    rows = acked.join(seen, ["log_id", "writer_id", "seq"], "left")
    error = F.when(F.col("_lsn").isNull(), "DATALOSS").when(F.col("_lsn") != F.col("lsn"), "LSN_MISMATCH")
    return rows.select("log_id", "writer_id", "seq", error.alias("error")).filter(F.col("error").isNotNull())


def lost_acks(reads: DataFrame, acks: DataFrame) -> DataFrame:
    """(log_id, writer_id, seq, error): LOST_ACK for what was read but not acknowledged by the time its writer had nothing as old in flight.

    ``reads`` has log_id, writer_id, read_pos, seq and oldest_in_flight, ``acks`` log_id, writer_id, seq and the
    read_pos of the record that carried the acknowledgement.  A record is due at the first record read from
    its own place on whose oldest number in flight is above its own; numbers in flight only grow along a log.
    """
    by = ["log_id", "writer_id"]
    first = reads.groupBy(*by, "seq").agg(F.min("read_pos").alias("read_pos"))
    asked = first.select(*by, F.col("seq").alias("_v"), F.lit(0).alias("_asks"), "seq", "read_pos", F.lit(None).cast("long").alias("_pos"))
    bounds = reads.groupBy(*by, F.col("oldest_in_flight").alias("_v")).agg(F.min("read_pos").alias("_pos"))
    bounds = bounds.select(*by, (F.col("_v") - 1).alias("_v"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("read_pos"), "_pos")
    # the first place whose bound is above a number: the least over all greater bounds, from the top down
    down = asked.unionByName(bounds).withColumn("_down", -2 * F.col("_v") + 1 - F.col("_asks"))
    due = cells.running(down, by, "_down", F.col("_pos"), "min", "_due").filter("_asks = 0")
    seen = acks.groupBy(*by, "seq").agg(F.min("read_pos").alias("_acked"))
    late = F.col("_due").isNotNull() & (F.col("_acked").isNull() | (F.col("_acked") > F.greatest("_due", "read_pos")))
    return due.join(seen, [*by, "seq"], "left").filter(late).select(*by, "seq", F.lit("LOST_ACK").alias("error"))


def f_majority(shards: DataFrame, replication: dict[str, int]) -> DataFrame:
    """(log_id, outcome) of which shards of a log's storage set answered.

    ``shards`` has log_id, shard, status, present and domains (a map from scope to the shard's domain).  A
    scope with replication R has a majority if all but R - 1 of its domains with data are complete: a
    complete domain's shards with data are all fully authoritative and present, and there is one.  One scope is enough.  The
    answer is complete if all fully authoritative shards are present.  UNDERREPLICATION shards are never
    complete; AUTHORITATIVE_EMPTY ones have no data.
    """
    full, empty = F.col("status") == "FULLY_AUTHORITATIVE", F.col("status") == "AUTHORITATIVE_EMPTY"
    wanted = F.create_map(*[x for k, v in replication.items() for x in (F.lit(k), F.lit(v))])
    by_domain = shards.select("log_id", F.explode("domains").alias("scope", "domain"), "status", "present").filter(F.col("scope").isin(list(replication)))
    by_domain = by_domain.groupBy("log_id", "scope", "domain").agg(F.count(F.lit(1)).alias("_n"), F.sum((full & F.col("present")).cast("int")).alias("_here"), F.sum(empty.cast("int")).alias("_empty"))
    complete = (F.col("_here") > 0) & (F.col("_here") + F.col("_empty") == F.col("_n"))
    scopes = by_domain.groupBy("log_id", "scope").agg(F.sum(complete.cast("int")).alias("_complete"), F.sum((F.col("_empty") < F.col("_n")).cast("int")).alias("_with_data"))
    enough = F.col("_complete") >= F.greatest(F.col("_with_data") - wanted[F.col("scope")] + 1, F.lit(0))
    majority = scopes.groupBy("log_id").agg(F.bool_or(enough).alias("_majority"))
    whole = shards.groupBy("log_id").agg((F.sum((full & F.col("present")).cast("int")) == F.sum(full.cast("int"))).alias("_all"))
    m, a = F.col("_majority"), F.col("_all")
    outcome = F.when(m & a, "AUTHORITATIVE_COMPLETE").when(m, "AUTHORITATIVE_INCOMPLETE").when(a, "NON_AUTHORITATIVE").otherwise("NONE")
    return majority.join(whole, "log_id").select("log_id", outcome.alias("outcome"))


def capacity_loss(nodes: DataFrame, percent: float) -> DataFrame:
    """(total, lost, loss): whether the weight that is down or about to go exceeds a share of all.

    ``nodes`` has weight, alive and to_disable.
    """
    gone = F.sum(F.when(~F.col("alive") | F.col("to_disable"), F.col("weight")).otherwise(0.0))
    return nodes.agg(F.sum("weight").alias("total"), gone.alias("lost"), (gone > percent / 100 * F.sum("weight")).alias("loss"))


def impact(epochs: DataFrame, shards: DataFrame, replication: int) -> DataFrame:
    """(log_id, epoch, n_left, writes_lost, reads_lost, rebuild_lost) for epochs (log_id, epoch, shards: array) if some shards go.

    ``shards`` has shard, writable and readable as they would be, and may have a domain.  Writes need as many
    shards as copies, in as many domains if domains are given; reads need more than all but so many; rebuilding
    a lost shard needs a readable copy to read and as many writable shards as copies among the readable ones.
    """
    rows = epochs.select("log_id", "epoch", F.explode("shards").alias("shard")).join(shards, "shard", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = lambda c: F.sum(flag(c).cast("int"))
    place = F.col("domain") if "domain" in shards.columns else F.col("shard")
    writable = F.count_distinct(F.when(flag("writable"), place))
    return rows.groupBy("log_id", "epoch").agg(
        ok("readable").alias("n_left"), (writable < replication).alias("writes_lost"), (ok("readable") < F.count(F.lit(1)) - replication + 1).alias("reads_lost"),
        ((ok("readable") == 0) | (F.sum((flag("writable") & flag("readable")).cast("int")) < replication)).alias("rebuild_lost"),
    )


def epoch_metadata(epochs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each (log_id, epoch) with the columns of the metadata (log_id, since, ...) in force.

    In force is the greatest ``since`` up to the epoch; before the first the first.  The two sides are put
    together and sorted once by log and epoch, so no pair of rows is compared.
    """
    others = [c for c in metadata.columns if c not in ("log_id", "since")]
    packed = F.struct("since", *others)
    tagged = metadata.select("log_id", F.col("since").alias("epoch"), packed.alias("_m"), F.lit(0).alias("_q"))
    asked = epochs.select("log_id", "epoch", F.lit(None).cast(tagged.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_q"))
    w = Window.partitionBy("log_id").orderBy("epoch", "_q")
    all_ = tagged.unionByName(asked)
    back = F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_m", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return all_.withColumn("_f", F.coalesce(back, ahead)).filter("_q = 1").select("log_id", "epoch", "_f.*")


def storage_sets(metadata: DataFrame, asked: DataFrame) -> DataFrame:
    """(log_id, lo, hi, nodes): all nodes that hold records of the epochs lo to hi (``asked``: log_id, lo, hi).

    ``metadata`` (log_id, since, nodes: array) holds from its epoch up to the next one's; the first also before.
    """
    w = Window.partitionBy("log_id").orderBy("since")
    spans = metadata.select("log_id", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("since")).alias("_from"), (F.lead("since").over(w) - 1).alias("_to"), "nodes")
    met = asked.join(spans, "log_id").filter((F.col("_from") <= F.col("hi")) & (F.col("_to").isNull() | (F.col("_to") >= F.col("lo"))))
    return met.groupBy("log_id", "lo", "hi").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("nodes")))).alias("nodes"))


def rebuilding_plan(metadata: DataFrame, logs: DataFrame, lost: list[int]) -> DataFrame:
    """(log_id, since_epoch, until_epoch) of what must be rebuilt when the nodes of ``lost`` lose their data.

    ``metadata`` is as for ``storage_sets``; ``logs`` (log_id, oldest_epoch, last_epoch) bounds each log's
    epochs by retention and by its tail.  Stretches of epochs whose nodes include a lost one, as far as
    they are within the bounds, are put together where they adjoin.
    """
    w = Window.partitionBy("log_id").orderBy("since")
    spans = metadata.select("log_id", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("since")).cast("long").alias("_from"), (F.lead("since").over(w) - 1).alias("_to"), "nodes")
    hit = spans.filter(F.arrays_overlap("nodes", F.array(*[F.lit(n).cast("long") for n in lost])))
    rows = hit.join(logs, "log_id").select("log_id", F.greatest("_from", "oldest_epoch").alias("lo"), F.least(F.coalesce("_to", "last_epoch"), "last_epoch").alias("hi")).filter("lo <= hi")
    return merged_ranges(rows, ["log_id"]).select("log_id", F.col("lo").alias("since_epoch"), F.col("hi").alias("until_epoch"))


def common_ranges(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., lo, hi): what is in the ranges of both sides; each side's own ranges are merged first."""
    x = merged_ranges(a, by)
    y = merged_ranges(b, by).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    both = x.join(y, by).filter((F.col("lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("hi")))
    return both.select(*by, F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"))


def ranges_without(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., lo, hi): what is in the ranges of ``a`` and in none of ``b``."""
    x = merged_ranges(a, by)
    cut = common_ranges(a, b, by).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    cut = cut.withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)})
    within = (F.col("_lo") >= F.col("lo")) & (F.col("_hi") <= F.col("hi"))
    for i, b in enumerate(by):
        within = within & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    rows = x.join(cut, within, "left")
    w = Window.partitionBy(*by, "lo", "hi").orderBy("_lo")
    first = F.row_number().over(w) == 1
    pieces = rows.withColumn("_next", F.lead("_lo").over(w)).withColumn("_first", first)
    head = pieces.filter(F.col("_first") & (F.col("_lo").isNull() | (F.col("_lo") > F.col("lo")))).select(*by, "lo", F.coalesce(F.col("_lo") - 1, "hi").alias("hi"))
    rest = pieces.filter(F.col("_lo").isNotNull()).select(*by, (F.col("_hi") + 1).alias("lo"), F.coalesce(F.col("_next") - 1, "hi").alias("hi")).filter("lo <= hi")
    return head.unionByName(rest)


def merged_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., lo, hi): ranges that overlap or touch as one."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    high = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", (high.isNull() | (F.col("lo") > high + 1)).cast("int"))
    rows = rows.withColumn("_i", F.sum("_new").over(w))
    return rows.groupBy(*by, "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_i")


#: Nodes of a cluster, whose list is brought to each log to choose from; more are refused.
MOST_NODES = 100_000


def nodesets(logs: DataFrame, nodes: DataFrame, size: int, seed: str = "nodeset", how: str = "consistent") -> DataFrame:
    """(log_id, node, place): for each log its ``size`` nodes.

    ``nodes`` (node, weight, and domain for some) is a cluster's list of nodes, MOST_NODES at most.  Kinds:
    ``all`` nodes of positive weight; ``consistent``, by weighted rendezvous hashing, so that a log keeps its
    nodes when others come or go; ``random``, the same with equal weights; ``cross_domain``, random with the
    first nodes from different domains, round by round; ``weight_aware``, by weight in rounds over the domains.
    """
    if how not in ("all", "consistent", "random", "cross_domain", "weight_aware"):
        raise ValueError(how)
    columns = ["node", "weight", "domain"] if "domain" in nodes.columns else ["node", "weight"]
    if how in ("cross_domain", "weight_aware") and "domain" not in columns:
        raise ValueError(f"{how} needs the nodes' domains")
    alive = nodes.filter("weight > 0").select(*columns)
    if alive.count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    listed = alive.agg(F.collect_list(F.struct(*columns)).alias("_nodes"))
    scored = logs.select("log_id").join(F.broadcast(listed)).select("log_id", F.explode("_nodes").alias("_n")).select("log_id", "_n.*")
    u = (F.xxhash64(F.lit(seed), "log_id", "node").bitwiseAND((1 << 53) - 1).cast("double") + 1) / float(1 << 53)
    weight = F.lit(1.0) if how in ("random", "cross_domain") else F.col("weight")
    scored = scored.withColumn("_s", F.col("node").cast("double") if how == "all" else -F.log(u) / weight)
    if how in ("cross_domain", "weight_aware"):
        scored = scored.withColumn("_round", F.row_number().over(Window.partitionBy("log_id", "domain").orderBy("_s", "node")))
    else:
        scored = scored.withColumn("_round", F.lit(0))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("log_id").orderBy("_round", "_s", "node")))
    return (placed if how == "all" else placed.filter(F.col("place") <= size)).select("log_id", "node", "place")


def tolerable_failures(groups: DataFrame) -> DataFrame:
    """(scope, factor, tolerable): the least replication of any group (replication: map scope -> factor) in each scope, and how many domains may fail."""
    least = groups.select(F.explode("replication").alias("scope", "factor")).groupBy("scope").agg(F.min("factor").alias("factor"))
    return least.select("scope", "factor", (F.col("factor") - 1).alias("tolerable"))


def maintenances(found: DataFrame, shards: list[str] | None = None, users: list[str] | None = None, status: list[str] | None = None) -> DataFrame:
    """(group_id, user, status, n_shards, shards, expires) of maintenances (group_id, user, status, shard, expires), by any of the filters.

    A group is shown as a whole if one of its shards is asked for; its status is the least advanced of its shards'.
    """
    order = ["BLOCKED_UNTIL_SAFE", "AWAITING_NODES_CONFIG_CHANGES", "AWAITING_START_DATA_MIGRATION", "STARTED", "COMPLETED"]
    step = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("status"))
    rows = found.groupBy("group_id", "user").agg(F.min_by("status", step).alias("status"), F.count_distinct("shard").alias("n_shards"), F.array_join(F.array_sort(F.collect_set("shard")), ",").alias("shards"), F.max("expires").alias("expires"))
    if shards:
        rows = rows.join(found.filter(F.col("shard").isin(shards)).select("group_id").distinct(), "group_id", "left_semi")
    if users:
        rows = rows.filter(F.col("user").isin(users))
    return rows.filter(F.col("status").isin(status)) if status else rows


def narrowest_replication(groups: DataFrame) -> DataFrame:
    """(scope, factor): the greatest replication that any group (name, replication: map scope -> factor) asks for in each scope."""
    return groups.select(F.explode("replication").alias("scope", "factor")).groupBy("scope").agg(F.max("factor").alias("factor"))


def copyset_filter(records: DataFrame, required: list[int], single: bool = False) -> DataFrame:
    """Copies that a reader asks for: those with any of the ``required`` nodes in their copyset; holes always, drained ones never.

    With ``single`` each record comes from one node alone: the first of its copyset, in its own order by a hash of the record, that is there.
    """
    asked = F.arrays_overlap("copyset", F.array(*[F.lit(n).cast("long") for n in required]))
    out = records.filter((F.col("kind") == "HOLE") | (asked & ~F.coalesce(F.col("drained"), F.lit(False))))
    if not single:
        return out
    turn = F.struct(F.xxhash64("log_id", "lsn", "node"), F.col("node"))
    chosen = out.groupBy("log_id", "lsn").agg(F.min_by("node", turn).alias("_node"))
    return out.join(chosen, ["log_id", "lsn"]).filter(F.col("node") == F.col("_node")).drop("_node")


def cluster_state(replies: DataFrame) -> DataFrame:
    """(node_id, status, dead_nodes, boycotted_nodes, unhealthy_nodes, overloaded_nodes) of nodes' views.

    ``replies`` has node_id, reply, peer and peer_alive, and may have peer_boycotted and peer_health (HEALTHY,
    UNHEALTHY, OVERLOADED).  A node is ALIVE, SUSPECT or DEAD by its reply; lists are in order, with commas.
    """
    status = F.when(F.col("reply") == "OK", "ALIVE").when(F.col("reply") == "TIMEOUT", "SUSPECT").otherwise("DEAD")
    no = F.lit(False)
    of = lambda c, test: test if c in replies.columns else no
    tests = {
        "dead_nodes": ~F.col("peer_alive"), "boycotted_nodes": of("peer_boycotted", F.col("peer_boycotted") if "peer_boycotted" in replies.columns else no),
        "unhealthy_nodes": of("peer_health", F.col("peer_health") == "UNHEALTHY" if "peer_health" in replies.columns else no),
        "overloaded_nodes": of("peer_health", F.col("peer_health") == "OVERLOADED" if "peer_health" in replies.columns else no),
    }
    listed = lambda test: F.array_join(F.transform(F.sort_array(F.collect_set(F.when(test, F.col("peer")))), lambda d: d.cast("string")), ",")
    return replies.groupBy("node_id").agg(F.min(status).alias("status"), *[listed(t).alias(n) for n, t in tests.items()])


def shard_status(events: DataFrame) -> DataFrame:
    """(shard, status, version) after the events (shard, version, kind) of rebuildings, in order of their versions.

    A shard that needs rebuilding is UNDERREPLICATION; once rebuilt, AUTHORITATIVE_EMPTY; marked as lost,
    UNAVAILABLE; acknowledged by its node, FULLY_AUTHORITATIVE again.  Rebuilt counts only after it was
    asked for.
    """
    turn = F.when(F.col("kind").isin("NEEDS_REBUILD", "LOST", "ACK"), F.col("version"))
    rows = events.groupBy("shard").agg(F.max_by("kind", turn).alias("_k"), F.max(turn).alias("_at"), F.max(F.when(F.col("kind") == "REBUILT", F.col("version"))).alias("_done"), F.max("version").alias("version"))
    needs = (F.col("_at").isNotNull()) & (F.col("_k") == "NEEDS_REBUILD")
    status = F.when(needs & (F.col("_done") > F.col("_at")), "AUTHORITATIVE_EMPTY").when(needs, "UNDERREPLICATION").when(F.col("_at").isNotNull() & (F.col("_k") == "LOST"), "UNAVAILABLE").otherwise("FULLY_AUTHORITATIVE")
    return rows.select("shard", status.alias("status"), "version")


def boycotts(reports: DataFrame, most: int, duration_sec: float, spread_sec: float = 0.0, longest_sec: float | None = None, calm_sec: float | None = None) -> DataFrame:
    """(cluster, node, since, until) of boycotts that follow from outlier reports (cluster, node, at), in seconds, in order of their time.

    A report of a node that isn't boycotted, while fewer than ``most`` nodes are, boycotts it from ``spread_sec`` later on,
    for ``duration_sec``.  With ``longest_sec`` the duration adapts: each further boycott of a node doubles it,
    up to that, and each ``calm_sec`` that pass without one halve it again.  What a cluster decides depends on
    all it decided before, so its reports, one for each suspicion of a node, are one group.
    """
    import pandas as pd

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        until: dict[int, float] = {}
        length: dict[int, float] = {}
        out = []
        for node, at in pdf.sort_values(["at", "node"])[["node", "at"]].itertuples(index=False):
            active = sum(t >= at for t in until.values())
            if active >= most or until.get(node, -1.0) >= at:
                continue
            span = duration_sec
            if longest_sec is not None and node in length:
                quiet = int((at - until[node]) // calm_sec) if calm_sec else 0
                span = min(longest_sec, max(duration_sec, length[node] * 2 / 2**quiet))
            length[node], until[node] = span, at + spread_sec + span
            out.append((pdf["cluster"].iloc[0], node, at + spread_sec, until[node]))
        return pd.DataFrame(out, columns=["cluster", "node", "since", "until"])

    columns = reports.select(F.col("cluster").cast("long").alias("cluster"), F.col("node").cast("long").alias("node"), F.col("at").cast("double").alias("at"))
    return columns.groupBy("cluster").applyInPandas(decide, "cluster long, node long, since double, until double")
