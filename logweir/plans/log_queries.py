"""Registered queries of further log operators: reading, batching, trimming, planning, counters, scalars and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import lsn as L
from logweir.functions import scalars
from logweir.operators import integrity, log, stats
from logweir.plans.logs_tree import CatalogError, LogsTree
from logweir.plans.queries import COMPACT, EPOCHS, REC, TRIMS, at, copies, epoch_records, order_histogram, query, read, records, trims

COPIES_OF_EVENTS = "SELECT user_id AS log_id, event_id + 1 AS lsn, event_type AS kind FROM events"

# --- reading ---------------------------------------------------------------------------------------------


@query(f"WITH {REC} SELECT log_id, lsn, payload, row_number() OVER (PARTITION BY log_id ORDER BY lsn) AS place FROM rec")
def ordered_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of three nodes merged into one ordered record each; the place within its log is counted as delivered."""
    rec = records(spark, sf_dir).select("log_id", "lsn", "payload")
    three = rec.withColumn("node", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    merged = log.merged_copies(three).select("log_id", "lsn", "payload")
    from logweir.operators import cells

    return cells.running(merged, ["log_id"], "lsn", F.lit(1), "count", "place")


@query(f"""WITH {REC}, n AS (SELECT lsn, payload, lead(lsn) OVER (ORDER BY lsn) AS nx FROM rec WHERE log_id = 7),
i AS (SELECT 'RECORD' AS kind, lsn AS lo, lsn AS hi, payload FROM n UNION ALL SELECT 'GAP', lsn + 1, nx - 1, NULL FROM n WHERE nx > lsn + 1),
a AS (SELECT *, row_number() OVER (ORDER BY lo) AS r, sum((kind = 'GAP')::INTEGER) OVER (ORDER BY lo) AS g FROM i WHERE hi >= 1 QUALIFY r <= 5)
SELECT kind, lo, hi, payload FROM a WHERE g = 0 OR (r = 1 AND kind = 'GAP')""")
def read_records_or_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return log.read_some(rec, log.gaps(rec), 7, 1, 5)


@query(f"WITH {REC} SELECT log_id, lsn FROM rec WHERE log_id > 40 OR (log_id = 40 AND lsn > 2000) ORDER BY log_id, lsn LIMIT 500")
def scan_from_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.after_location(records(spark, sf_dir), 40, 2000, 500).select("log_id", "lsn")


@query(f"WITH {REC}, n AS (SELECT log_id, lsn, lead(lsn) OVER (PARTITION BY log_id ORDER BY lsn) AS nx FROM rec) SELECT log_id, 'DATALOSS' AS type, lsn + 1 AS lo, least(nx - 1, 3000) AS hi FROM n WHERE nx > lsn + 1 AND lsn + 1 <= 3000 AND lsn >= 500")
def gaps_to_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between records from 500 on, none behind 3000."""
    rec = records(spark, sf_dir).filter("lsn >= 500")
    none = rec.select("log_id").distinct().withColumn("trim_point", F.lit(0))
    found = log.typed_gaps(rec, none, since=1, until=3000)
    return found.join(rec.groupBy("log_id").agg(F.min("lsn").alias("_first")), "log_id").filter(F.col("lo") > F.col("_first")).drop("_first")


@query(f"""WITH {REC}, {EPOCHS}, n AS (SELECT log_id, lsn, lead(lsn) OVER (PARTITION BY log_id ORDER BY lsn) AS nx FROM er)
SELECT log_id, CASE WHEN ((lsn + 1) >> 32) = 2 THEN 'DATALOSS' WHEN (nx & 4294967295) <= 1 AND (lsn >> 32) < (nx >> 32) THEN 'BRIDGE' WHEN (nx >> 32) = ((lsn + 1) >> 32) THEN 'DATALOSS' ELSE 'BRIDGE' END AS type, lsn + 1 AS lo, nx - 1 AS hi FROM n WHERE nx > lsn + 1""")
def gaps_of_lost_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In epoch 2 no shard is authoritative."""
    rec = epoch_records(spark, sf_dir)
    logs = rec.select("log_id").distinct()
    found = log.typed_gaps(rec, logs.withColumn("trim_point", F.lit(0)), lost=logs.withColumn("epoch", F.lit(2).cast("long")))
    return found.join(rec.groupBy("log_id").agg(F.min("lsn").alias("_first")), "log_id").filter(F.col("lo") > F.col("_first")).drop("_first")


@query(f"""WITH {REC}, f AS (SELECT log_id, min(lsn) AS f FROM rec WHERE lsn > 1500 GROUP BY log_id) SELECT log_id, 'TRIM' AS type, 1::BIGINT AS lo, least(f - 1, 1500) AS hi FROM f""")
def one_trim_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trimmed section of which pieces were read as gaps is one gap."""
    rec = records(spark, sf_dir).filter("lsn > 1500")
    pieces = log.typed_gaps(rec, rec.select("log_id").distinct().withColumn("trim_point", F.lit(1500))).filter("type = 'TRIM'")
    cut = pieces.withColumn("_p", F.explode(F.array(F.struct(F.col("lo").alias("lo"), F.least("hi", F.lit(700)).alias("hi")), F.struct(F.lit(701).cast("long").alias("lo"), F.col("hi").alias("hi"))))).select("log_id", "type", "_p.*")
    return log.one_trim_gap(cut)


@query(f"WITH {REC}, logs AS (SELECT range AS log_id FROM range(200)) SELECT log_id FROM logs WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.log_id = logs.log_id AND lsn > 9000 AND filter_key <> 'view')")
def log_is_empty_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for bridges and holes, which aren't records."""
    rec = records(spark, sf_dir)
    ends = rec.select("log_id").distinct().withColumn("trim_point", F.lit(9000))
    return log.empty_logs(spark.range(200).select(F.col("id").alias("log_id")), rec, ends, F.col("filter_key") == "view")


# --- trimming and finding --------------------------------------------------------------------------------


@query(f"WITH {REC}, {TRIMS}, t AS (SELECT log_id, max(lsn) AS m FROM rec GROUP BY log_id) SELECT log_id, CASE WHEN log_id * 97 > m THEN trim_point ELSE greatest(trim_point, log_id * 97) END AS trim_point, CASE WHEN log_id * 97 > m THEN 'TOOBIG' ELSE 'OK' END AS status FROM trims JOIN t USING (log_id)")
def trim_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    old = trims(rec)
    return log.trim_request(old, old.select("log_id", (F.col("log_id") * 97).alias("upto")), log.tail_attributes(rec))


@query("""WITH r AS (SELECT l_orderkey AS req, l_linenumber AS shard, CASE WHEN l_quantity > 45 THEN 'FAILED' ELSE 'OK' END AS status, l_partkey % 50 AS lo, 50 + l_suppkey % 40 AS hi FROM lineitem),
g AS (SELECT req, max(lo) FILTER (WHERE status = 'OK') AS lo, min(hi) FILTER (WHERE status = 'OK') AS hi, bool_and(status = 'OK') AS a, bool_or(status = 'OK') AS o FROM r GROUP BY req)
SELECT req, CASE WHEN NOT o THEN 'FAILED' WHEN a OR hi - lo <= 1 THEN 'OK' ELSE 'PARTIAL' END AS status, lo, hi FROM g""")
def find_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("shard"), F.when(F.col("l_quantity") > 45, "FAILED").otherwise("OK").alias("status"), (F.col("l_partkey") % 50).alias("lo"), (F.col("l_suppkey") % 40 + 50).alias("hi"))
    return log.merge_find_replies(rows)


# --- batches ---------------------------------------------------------------------------------------------


@query(f"""WITH {REC}, s AS (SELECT *, (epoch_ms(ts) // 1000 // 86400)::BIGINT AS stretch FROM rec), b AS (SELECT *, ((sum(payload_size) OVER (PARTITION BY log_id, stretch ORDER BY lsn) - payload_size) // 20)::BIGINT AS batch FROM s)
SELECT log_id, stretch, batch, min(lsn) AS first_lsn, count(*) AS n, sum(payload_size)::BIGINT AS bytes, string_agg(payload, '|' ORDER BY lsn) AS joined FROM b GROUP BY ALL""")
def batch_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.timed_batches(records(spark, sf_dir), 20, 86400).withColumn("joined", F.array_join("payloads", "|")).drop("payloads")


@query(f"""WITH {REC}, r AS (SELECT log_id, lsn, payload, payload_size + CASE WHEN lsn % 13 = 0 THEN 1000 ELSE 0 END AS z FROM rec), u AS (SELECT *, sum((z > 500)::INTEGER) OVER (PARTITION BY log_id ORDER BY lsn) * 2 - (z > 500)::INTEGER AS part FROM r),
b AS (SELECT *, ((sum(z) OVER (PARTITION BY log_id, part ORDER BY lsn) - z) // 40)::BIGINT AS place FROM u) SELECT log_id, min(lsn) AS first_lsn, count(*) AS n, sum(z)::BIGINT AS bytes, string_agg(payload, '|' ORDER BY lsn) AS joined FROM b GROUP BY log_id, part, place""")
def sequencer_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = records(spark, sf_dir).withColumn("payload_size", F.col("payload_size") + F.when(F.col("lsn") % 13 == 0, 1000).otherwise(0))
    return log.sequenced(sized, 40, 500).withColumn("joined", F.array_join("payloads", "|")).drop("payloads")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as bytes; every ninth is damaged."""
    packed = log.batches(records(spark, sf_dir), 64).withColumn("data", scalars.encoded_batch(F.transform("payloads", lambda p: p.cast("binary"))))
    broken = F.concat(F.col("data"), F.unhex(F.lit("00")))
    return packed.select("log_id", "batch", "first_lsn", F.when((F.col("log_id") + F.col("batch")) % 9 == 0, broken).otherwise(F.col("data")).alias("data"))


CODED = f"{REC}, b AS (SELECT *, ((sum(payload_size) OVER (PARTITION BY log_id ORDER BY lsn) - payload_size) // 64)::BIGINT AS batch FROM rec)"


@query(f"WITH {CODED} SELECT log_id, min(lsn) OVER (PARTITION BY log_id, batch) AS lsn, (row_number() OVER (PARTITION BY log_id, batch ORDER BY lsn) - 1)::INTEGER AS batch_offset, payload FROM b WHERE (log_id + batch) % 9 <> 0")
def batch_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(spark, sf_dir).withColumn("payloads", scalars.decoded_batch(F.col("data")))
    return log.unbatched(rows).withColumn("payload", F.col("payload").cast("string"))


@query(f"WITH {CODED} SELECT log_id, 'DATALOSS' AS type, min(lsn) AS lo, min(lsn) AS hi FROM b WHERE (log_id + batch) % 9 = 0 GROUP BY log_id, batch")
def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.undecodable(encoded(spark, sf_dir).withColumn("payloads", scalars.decoded_batch(F.col("data"))))


# --- integrity and planning ------------------------------------------------------------------------------


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL), c AS (SELECT l_orderkey AS esn, (p + l_linenumber) % 50 AS node, (['NORMAL', 'MUTATED', 'HOLE'])[s % 3 + 1] AS type, 10 * l_linenumber AS epoch FROM i),
d AS (SELECT *, CASE WHEN type = 'HOLE' THEN 'HOLE' ELSE 'RECORD' END AS content, ((type <> 'NORMAL')::INTEGER)::BIGINT * 1000000 + epoch AS p FROM c),
w AS (SELECT esn, arg_max(type, p) AS winner, arg_max(epoch, p) AS winner_epoch, arg_max(content, p) AS content FROM d GROUP BY esn),
k AS (SELECT d.esn, d.node, w.winner, w.winner_epoch, d.content = w.content AS same, d.content = w.content AND d.type <> 'NORMAL' AND d.epoch = 30 AS done FROM d JOIN w USING (esn))
SELECT esn, any_value(winner) AS winner, any_value(winner_epoch) AS winner_epoch, count(DISTINCT node) FILTER (WHERE same AND NOT done) AS n_amend, count(DISTINCT node) FILTER (WHERE done) AS n_success, count(DISTINCT node) FILTER (WHERE NOT same) AS n_conflict,
count(*) FILTER (WHERE NOT done) > 0 AS needs_mutation FROM k GROUP BY esn""")
def digest_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("NORMAL"), F.lit("MUTATED"), F.lit("HOLE")), (F.col("s") % 3 + 1).cast("int"))
    items = read(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    rows = items.select(F.col("l_orderkey").alias("esn"), ((F.col("p") + F.col("l_linenumber")) % 50).alias("node"), kind.alias("type"), (F.col("l_linenumber") * 10).alias("epoch"))
    found = integrity.digest_mutations(rows, 30)
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("esn", "winner", "winner_epoch", n("amend"), n("success"), n("conflict"), "needs_mutation")


SETS = "md AS (SELECT c_custkey AS log_id, since, [(c_custkey + since) % 12, (c_custkey * 3 + since) % 12, (c_custkey + 5) % 12] AS nodes FROM customer, (VALUES (1), (4), (9)) AS v(since))"


def epoch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, since = F.col("c_custkey"), F.col("since")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("since"))
    return rows.select(k.alias("log_id"), "since", F.array((k + since) % 12, (k * 3 + since) % 12, (k + 5) % 12).alias("nodes"))


SPANS = f"{SETS}, sp AS (SELECT log_id, CASE WHEN since = 1 THEN 0 ELSE since END AS f, lead(since) OVER (PARTITION BY log_id ORDER BY since) - 1 AS t, nodes FROM md)"


@query(f"""WITH {SPANS}, q AS (SELECT c_custkey AS log_id, 2 AS lo, 2 + c_custkey % 9 AS hi FROM customer), n AS (SELECT DISTINCT q.log_id, lo, hi, unnest(nodes) AS node FROM q JOIN sp USING (log_id) WHERE f <= hi AND (t IS NULL OR t >= lo))
SELECT log_id, lo, hi, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM n GROUP BY ALL""")
def storage_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("log_id"), F.lit(2).alias("lo"), (F.col("c_custkey") % 9 + 2).alias("hi"))
    return integrity.storage_sets(epoch_sets(spark, sf_dir), asked).withColumn("nodes", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","))


@query(f"""WITH {SPANS}, h AS (SELECT log_id, greatest(f, log_id % 3) AS lo, least(coalesce(t, 6 + log_id % 7), 6 + log_id % 7) AS hi FROM sp WHERE list_has_any(nodes, [2, 11])), k AS (SELECT * FROM h WHERE lo <= hi),
n AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY log_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM k), i AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY lo) AS r FROM n)
SELECT log_id, min(lo)::BIGINT AS since_epoch, max(hi)::BIGINT AS until_epoch FROM i GROUP BY log_id, r""")
def rebuilding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    logs = read(spark, sf_dir, "customer").select(k.alias("log_id"), (k % 3).alias("oldest_epoch"), (k % 7 + 6).alias("last_epoch"))
    return integrity.rebuilding_plan(epoch_sets(spark, sf_dir), logs, [2, 11])


def order_days(spark: SparkSession, sf_dir: str, odd: int, length: int) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    return read(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == odd).select((F.col("o_custkey") % 100).alias("k"), day.alias("lo"), (day + length).alias("hi"))


# Days one by one, then runs of them again.
DAYS = "d AS (SELECT o_custkey % 100 AS k, o_orderkey % 2 AS odd, epoch_ms(o_orderdate) // 86400000 AS lo FROM orders), a AS (SELECT DISTINCT k, unnest(range(lo, lo + 3)) AS x FROM d WHERE odd = 0), b AS (SELECT DISTINCT k, unnest(range(lo, lo + 5)) AS x FROM d WHERE odd = 1)"
RUNS = "r AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS run FROM m) SELECT k, min(x)::BIGINT AS lo, max(x)::BIGINT AS hi FROM r GROUP BY k, run"


@query(f"WITH {DAYS}, m AS (SELECT a.k, a.x FROM a JOIN b USING (k, x)), {RUNS}")
def range_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.merged_ranges(integrity.common_ranges(order_days(spark, sf_dir, 0, 2), order_days(spark, sf_dir, 1, 4), ["k"]), ["k"])


@query(f"WITH {DAYS}, m AS (SELECT a.k, a.x FROM a ANTI JOIN b USING (k, x)), {RUNS}")
def range_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.ranges_without(order_days(spark, sf_dir, 0, 2), order_days(spark, sf_dir, 1, 4), ["k"])


@query("""WITH m AS (SELECT 'g' || c_nationkey AS group_id, 'u' || c_nationkey % 4 AS user, 'N' || c_custkey % 60 || ':S' || c_custkey % 3 AS shard, c_custkey % 5 AS st, c_custkey % 100 AS expires FROM customer)
SELECT group_id, user, (['BLOCKED_UNTIL_SAFE', 'AWAITING_NODES_CONFIG_CHANGES', 'AWAITING_START_DATA_MIGRATION', 'STARTED', 'COMPLETED'])[min(st) + 1] AS status, count(DISTINCT shard) AS n_shards, string_agg(DISTINCT shard, ',' ORDER BY shard) AS shards, max(expires) AS expires
FROM m WHERE user IN ('u1', 'u2') AND group_id IN (SELECT group_id FROM m WHERE shard IN ('N7:S1', 'N30:S0')) GROUP BY group_id, user""")
def maintenance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("BLOCKED_UNTIL_SAFE", "AWAITING_NODES_CONFIG_CHANGES", "AWAITING_START_DATA_MIGRATION", "STARTED", "COMPLETED")]), (k % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("g"), n).alias("group_id"), F.concat(F.lit("u"), n % 4).alias("user"), status.alias("status"), F.concat(F.lit("N"), k % 60, F.lit(":S"), k % 3).alias("shard"), (k % 100).alias("expires"))
    return integrity.maintenances(rows, shards=["N7:S1", "N30:S0"], users=["u1", "u2"])


@query("SELECT scope, min(factor)::INTEGER AS factor, (min(factor) - 1)::INTEGER AS tolerable FROM (SELECT 'NODE' AS scope, 2 + p_size % 4 AS factor FROM part UNION ALL SELECT 'RACK', 3 + p_size % 3 FROM part WHERE p_partkey % 2 = 0) GROUP BY scope")
def tolerable_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, rack = (F.col("p_size") % 4 + 2).cast("int"), (F.col("p_size") % 3 + 3).cast("int")
    both = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("NODE"), node, F.lit("RACK"), rack)).otherwise(F.create_map(F.lit("NODE"), node))
    return integrity.tolerable_failures(read(spark, sf_dir, "part").select(both.alias("replication")))


@query(f"WITH {REC}, l AS (SELECT DISTINCT log_id FROM rec) SELECT log_id, n AS node, row_number() OVER (PARTITION BY log_id ORDER BY n)::INTEGER AS place FROM l, (SELECT range AS n FROM range(24) WHERE range % 4 > 0)")
def nodeset_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(24).select(F.col("id").alias("node"), (F.col("id") % 4).cast("double").alias("weight"))
    return integrity.nodesets(records(spark, sf_dir).select("log_id").distinct(), nodes, 5, how="all")


@query(f"WITH {REC}, l AS (SELECT count(DISTINCT log_id) AS n FROM rec) SELECT how, n * 4 AS rows, 4::BIGINT AS domains FROM l, (VALUES ('cross_domain'), ('weight_aware')) AS v(how)")
def nodeset_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nodes of four domains: each log's are all different."""
    nodes = spark.range(24).select(F.col("id").alias("node"), (F.col("id") % 5 + 1).cast("double").alias("weight"), (F.col("id") % 4).alias("domain"))
    logs = records(spark, sf_dir).select("log_id").distinct()
    out = None
    for how in ("cross_domain", "weight_aware"):
        sets = integrity.nodesets(logs, nodes, 4, how=how).groupBy("log_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("node") % 4).alias("d"))
        one = sets.agg(F.lit(how).alias("how"), F.sum("n").alias("rows"), F.min("d").alias("domains")).select("how", "rows", "domains")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH c AS (SELECT l_suppkey AS log_id, l_orderkey * 8 + l_linenumber AS lsn, (l_partkey + k) % 9 AS node, CASE WHEN l_orderkey % 103 = 0 THEN [l_partkey % 9, (l_partkey + 1) % 9] ELSE [l_partkey % 9, (l_partkey + 1) % 9, (l_partkey + 2) % 9] END AS copyset FROM lineitem, range(3) AS r(k))
SELECT log_id, lsn, 1::BIGINT AS n FROM c WHERE list_has_any(copyset, [1, 5]) GROUP BY log_id, lsn""")
def single_copy_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that is asked for comes once, whichever of its nodes sends it."""
    rows = copies(spark, sf_dir).withColumn("drained", F.lit(False)).withColumn("kind", F.lit("RECORD"))
    return integrity.copyset_filter(rows, [1, 5], single=True).groupBy("log_id", "lsn").agg(F.count_distinct("node").alias("n"))


# --- counters --------------------------------------------------------------------------------------------


@query("SELECT l_returnflag || l_linestatus AS name, CASE WHEN l_linestatus = 'F' THEN max(l_partkey) WHEN l_returnflag = 'N' THEN arg_max(l_partkey, l_orderkey * 8 + l_linenumber) ELSE sum(l_partkey) END::BIGINT AS value FROM lineitem GROUP BY l_returnflag, l_linestatus")
def counter_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_partkey").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ts"))
    return stats.merged_counters(samples, {"RF": "max", "AF": "max", "NF": "max", "NO": "assign"})


@query("SELECT event_type || '.' || user_id % 5 AS name, count(*)::BIGINT AS value FROM events GROUP BY ALL UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type")
def counter_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 5).alias("shard"), F.lit(1).cast("long").alias("value"))
    return stats.keyed_counters(samples, "shard")


@query("""WITH c AS (SELECT event_type AS name, count(*)::DOUBLE AS value FROM events GROUP BY event_type), v AS (SELECT coalesce(sum(value) FILTER (WHERE name = 'error'), 0) AS e, coalesce(sum(value) FILTER (WHERE name = 'view'), 0) AS v FROM c)
SELECT * FROM c UNION ALL SELECT 'error_share', e / v FROM v UNION ALL SELECT 'both', e + v FROM v UNION ALL SELECT 'none', NULL FROM v""")
def counter_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return stats.derived_counters(counts, {"error_share": ("error", "/", "view"), "both": ("error", "+", "view"), "none": ("error", "/", "missing")})


LEVELS = {"appends_in": (60, 300, 600), "appends_out": (60, 680), "reads": (900, 1800, 3600)}
AGE_MS = "(epoch_ms(TIMESTAMP '2024-01-30 20:00:00') // 1000 - epoch_ms(ts) // 1000)"


@query(f"WITH {REC} SELECT log_id, " + ", ".join(f"sum(CASE WHEN {AGE_MS} >= 0 AND {AGE_MS} < {s} THEN payload_size ELSE 0 END)::BIGINT AS {n}_{s}" for n, levels in LEVELS.items() for s in levels) + " FROM rec GROUP BY log_id")
def time_series_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of the time series of appends and reads: bytes over each trailing interval."""
    seconds = tuple(sorted({s for levels in LEVELS.values() for s in levels}))
    rates = stats.trailing_rates(records(spark, sf_dir), "log_id", at("2024-01-30 20:00:00"), seconds)
    return rates.select("log_id", *[F.round(F.col(f"rate_{s}") * s).cast("long").alias(f"{n}_{s}") for n, levels in LEVELS.items() for s in levels])


@query(f"WITH {COMPACT} SELECT p, (sum(n * CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE ** bucket END) * 0.75::DOUBLE)::BIGINT AS estimate FROM h GROUP BY p")
def hist_compact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.compact_sum(order_histogram(spark, sf_dir), ["p"])


@query("""WITH r AS (SELECT p_partkey % 40 AS shard, CASE WHEN p_partkey % 9 = 0 THEN 'FAILED' ELSE 'OK' END AS status, p_size * 1000 AS size, p_partkey AS arrival FROM part), f AS (SELECT shard, arg_min(size, arrival) AS size FROM r WHERE status = 'OK' GROUP BY shard)
SELECT (sum(size) // 3 // count(*) * 60)::BIGINT AS estimate FROM f""")
def log_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return stats.estimated_log_size(read(spark, sf_dir, "part").select((k % 40).alias("shard"), F.when(k % 9 == 0, "FAILED").otherwise("OK").alias("status"), (F.col("p_size") * 1000).alias("size"), k.alias("arrival")), 60, 3)


# --- scalars ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_size::BIGINT * 1000000000 AS ns, CASE WHEN p_size % 60 = 0 THEN (p_size // 60) || 'min' ELSE p_size || 's' END AS text, p_size::BIGINT * 1500000000 AS half_more, NULL::BIGINT AS bad FROM part""")
def duration_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    rows = read(spark, sf_dir, "part").select("p_partkey", scalars.duration_ns(F.concat(size, F.lit("s"))).alias("ns"), scalars.duration_ns(F.concat((F.col("p_size") * 1.5).cast("string"), F.lit(" s"))).alias("half_more"), scalars.duration_ns(F.concat(size, F.lit("x"))).alias("bad"))
    return rows.select("p_partkey", "ns", scalars.duration_text(F.col("ns")).alias("text"), "half_more", "bad")


@query("""SELECT p_partkey, p_size + 3 AS merged, p_size - 3 AS less, greatest(p_size, 3) AS most, p_size * 2 AS scaled, 5 AS other FROM part""")
def offset_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets by counter: 246 counts bytes; 1 is in one map alone."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit(246), F.col("p_size"), F.lit(1), F.lit(5)).alias("a"), F.create_map(F.lit(246), F.lit(3)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("p_partkey", scalars.offsets_merged(a, b)[246].alias("merged"), scalars.offsets_difference(a, b)[246].alias("less"), scalars.offsets_greatest(a, b)[246].alias("most"), scalars.offsets_scaled(a, F.lit(2))[246].alias("scaled"), scalars.offsets_merged(a, b)[1].alias("other"))


FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(t) + 1), lambda i: ascii(substr(t, i::INTEGER, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(f"WITH e AS (SELECT event_id, event_type AS t FROM events) SELECT event_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS sum FROM (SELECT event_id, {FNV} AS h FROM e)")
def payload_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalars.fnv1a_64(F.col("event_type")).alias("sum"))


@query("SELECT event_id, hex(props) AS payload, 'e' || (1 + event_id // 2500) || 'n' || (event_id % 2500) AS lsn, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') AS time, user_id = 7 AS metadata FROM events WHERE event_id > 0")
def pretty_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in hexadecimal, numbers as eXnY, times as text, and which logs are metadata logs, by their negated ids."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").filter(e > 0).select(
        "event_id", scalars.hex_payload(F.col("props")).alias("payload"), L.lsn_to_string(L.compose_lsn(F.floor(e / 2500) + 1, e % 2500)).alias("lsn"),
        scalars.pretty_time(F.unix_millis(F.col("ts").cast("timestamp"))).alias("time"), L.is_metadata_log(F.when(F.col("user_id") == 7, -F.col("user_id")).otherwise(F.col("user_id"))).alias("metadata"),
    )


# --- catalog ---------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT n_nationkey AS k, n_name AS name, 'r' || n_regionkey AS dir FROM nation), g AS (SELECT CASE WHEN dir = 'r1' THEN '/moved/' || name ELSE '/' || dir || '/' || name END AS name, k, dir FROM n WHERE k <> 3)
SELECT name, k * 100 + 1 AS logid_lo, k * 100 + CASE WHEN k = 4 THEN 50 ELSE 100 END AS logid_hi, CASE WHEN k = 5 THEN '4' WHEN dir = 'r2' THEN '2' ELSE '3' END AS replication, CASE WHEN k % 2 = 0 THEN '60' ELSE '3600' END AS backlog FROM g WHERE dir <> 'r0'""")
def catalog_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories and groups made, removed, renamed and changed, and the attributes that groups inherit."""
    tree = LogsTree({"replication_factor": "3", "backlog_seconds": "3600"})
    for r in read(spark, sf_dir, "region").collect():
        tree.make_directory(f"/r{r['r_regionkey']}")
    for n in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        k = n["n_nationkey"]
        tree.make_log_group(f"/r{n['n_regionkey']}/{n['n_name']}", k * 100 + 1, k * 100 + 100, {"backlog_seconds": "60"} if k % 2 == 0 else {})
    for refused in (lambda: tree.make_log_group("/clash", 50, 60), lambda: tree.remove_directory("/r2"), lambda: tree.make_directory("/r3"), lambda: tree.rename("/none", "/x")):
        try:
            refused()
        except CatalogError:
            continue
        raise AssertionError("a change that must be refused happened")
    names = {n["n_nationkey"]: f"/r{n['n_regionkey']}/{n['n_name']}" for n in read(spark, sf_dir, "nation").collect()}
    tree.remove_log_group(names[3])
    tree.set_log_group_range(names[4], 401, 450)
    tree.set_attributes("/r2", {"replication_factor": "2"})
    tree.set_attributes(names[5], {"replication_factor": "4"})
    tree.rename("/r1", "/moved")
    tree.remove_directory("/r0", recursive=True)
    rows = LogsTree.from_json(tree.to_json()).groups(spark)
    return rows.select("name", "logid_lo", "logid_hi", F.col("attributes")["replication_factor"].alias("replication"), F.col("attributes")["backlog_seconds"].alias("backlog"))


@query("SELECT 25::BIGINT AS num_groups, 2500::BIGINT AS num_logs, 3600::BIGINT AS max_backlog_seconds, 2::BIGINT AS least_replication")
def catalog_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = LogsTree({"replication_factor": "3", "backlog_seconds": "3600"})
    for n in read(spark, sf_dir, "nation").collect():
        tree.make_log_group(f"/g/{n['n_name']}", n["n_nationkey"] * 100 + 1, n["n_nationkey"] * 100 + 100, {"replication_factor": "2"} if n["n_nationkey"] == 1 else {}, parents=True)
    info = tree.info()
    return spark.createDataFrame([tuple(info.values())], ", ".join(f"{k} long" for k in info))
