"""Registered queries of the log engine, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import lsn as L
from logweir.functions import scalars
from logweir.operators import integrity, log, outliers, ranges, stats
from logweir.plans.engine import Engine
from logweir.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NAMES = "region nation customer supplier part orders lineitem events".split()

# The events as records of logs, in both languages.
REC = "rec AS (SELECT user_id AS log_id, event_id + 1 AS lsn, ts, event_type AS filter_key, props AS payload, strlen(props)::BIGINT AS payload_size, value AS counter FROM events)"
TRIMS = "trims AS (SELECT DISTINCT log_id, 1000 + (log_id % 7) * 500 AS trim_point FROM rec)"
EPOCHS = "er AS (SELECT log_id, ((1 + (lsn - 1) // 2500) << 32) | (1 + (lsn - 1) % 2500) AS lsn, ts, payload_size FROM rec)"
COPIES = """copies AS (
  SELECT l_suppkey AS log_id, l_orderkey * 8 + l_linenumber AS lsn, (l_partkey + k) % 9 AS node, 1 + (l_linenumber + k) % 2 AS wave,
    CASE WHEN l_orderkey % 103 = 0 THEN [l_partkey % 9, (l_partkey + 1) % 9] ELSE [l_partkey % 9, (l_partkey + 1) % 9, (l_partkey + 2) % 9] END AS copyset,
    CASE WHEN l_orderkey % 97 = 0 AND k = 2 THEN 1 ELSE 0 END AS payload_hash, CASE WHEN l_orderkey % 101 = 0 AND k = 1 THEN 'HOLE' ELSE 'RECORD' END AS kind,
    (l_partkey + k) % 9 % 3 AS domain, (l_linenumber + k) % 5 = 0 AS recovery
  FROM lineitem, range(3) AS r(k))"""


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_records(read(spark, sf_dir, "events"))


def trims(rec: DataFrame) -> DataFrame:
    return rec.select("log_id").distinct().withColumn("trim_point", F.lit(1000) + F.col("log_id") % 7 * 500)


def epoch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("lsn") - 1
    return records(spark, sf_dir).withColumn("lsn", L.compose_lsn(F.floor(at / 2500) + 1, at % 2500 + 1))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, o = F.col("l_partkey"), F.col("k"), F.col("l_orderkey")
    node = lambda i: (p + i) % 9
    few, many = F.array(node(0), node(1)), F.array(node(0), node(1), node(2))
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
    return rows.select(
        F.col("l_suppkey").alias("log_id"), (o * 8 + F.col("l_linenumber")).alias("lsn"), node(k).alias("node"), (1 + (F.col("l_linenumber") + k) % 2).cast("long").alias("wave"),
        F.when(o % 103 == 0, few).otherwise(many).alias("copyset"), F.when((o % 97 == 0) & (k == 2), 1).otherwise(0).alias("payload_hash"),
        F.when((o % 101 == 0) & (k == 1), "HOLE").otherwise("RECORD").alias("kind"), (node(k) % 3).alias("domain"), ((F.col("l_linenumber") + k) % 5 == 0).alias("recovery"),
    )


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# --- joins and SQL -------------------------------------------------------------------------------------

GROUPS = "groups AS (SELECT n_name AS name, n_nationkey * 600 AS logid_lo, n_nationkey * 600 + 599 AS logid_hi FROM nation)"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("n_nationkey") * 600
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), lo.alias("logid_lo"), (lo + 599).alias("logid_hi"))


@query(f"""WITH {REC}, {GROUPS}
SELECT name, logid_lo, logid_hi, sum(payload_size)::BIGINT AS bytes, count(*) AS records FROM rec JOIN groups ON log_id * 100 BETWEEN logid_lo AND logid_hi
GROUP BY name, logid_lo, logid_hi ORDER BY bytes DESC, name LIMIT 5""")
def flagship_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir).groupBy("log_id").agg(F.sum("payload_size").alias("b"), F.count(F.lit(1)).alias("n")).withColumn("scaled", F.col("log_id") * 100)
    joined = ranges.range_join(rec, groups(spark, sf_dir), "scaled", "logid_lo", "logid_hi", 600)
    return joined.groupBy("name", "logid_lo", "logid_hi").agg(F.sum("b").alias("bytes"), F.sum("n").alias("records")).orderBy(F.desc("bytes"), "name").limit(5)


def sql_query(name: str, spark_text: str, duck_text: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.register_parquet(sf_dir, NAMES)
        return engine.sql(spark_text)

    run.__name__ = name
    query(duck_text or spark_text)(run)


sql_query("sql_left_join_group", "SELECT c_mktsegment, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
sql_query("sql_anti_join", "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
sql_query("sql_semi_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
sql_query("sql_text_key_join", "SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey = n_regionkey")
sql_query("sql_self_join", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("sql_full_join", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, n_customers, n_suppliers FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY c_nationkey) FULL JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey")
sql_query("sql_correlated_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 3)")
sql_query("sql_having_filter", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
sql_query("sql_distinct_aggregate", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag")
sql_query("sql_window_rank", "SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(lag(o_orderkey) OVER w AS BIGINT) AS previous, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
sql_query("sql_window_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
sql_query("sql_cte_union", "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT k, 'customer' AS who FROM a UNION SELECT k, 'supplier' AS who FROM b")
sql_query("sql_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10, 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
sql_query("sql_glob_like", "SELECT p_partkey, p_name FROM part WHERE p_type GLOB '*[A-M]*' AND p_brand LIKE 'brand#1%'", "SELECT p_partkey, p_name FROM part WHERE p_type GLOB '*[A-M]*' AND p_brand ILIKE 'brand#1%'")
sql_query("sql_total_of_none", "SELECT total(o_totalprice) AS t, count(*) AS n FROM orders WHERE o_orderkey < 0", "SELECT coalesce(sum(o_totalprice), 0)::DOUBLE AS t, count(*) AS n FROM orders WHERE o_orderkey < 0")
sql_query("rollup_groups", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
sql_query("except_logs", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
sql_query("intersect_logs", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")


@query(f"WITH {REC} SELECT log_id, count(*) AS n, NULL::BIGINT AS high FROM rec WHERE log_id % 2 = 0 GROUP BY log_id UNION ALL SELECT log_id, NULL, max(lsn) FROM rec WHERE log_id % 2 = 1 GROUP BY log_id")
def union_by_name_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    even = rec.filter("log_id % 2 = 0").groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    odd = rec.filter("log_id % 2 = 1").groupBy("log_id").agg(F.max("lsn").alias("high"))
    return tables.union_partials([even, odd])


@query(f"""WITH {REC}, md AS (SELECT DISTINCT log_id, since, log_id * 100 + since AS nodeset FROM rec, (VALUES (2), (3), (7)) AS v(since)), ep AS (SELECT DISTINCT log_id, 1 + lsn // 1000 AS epoch FROM rec)
SELECT ep.log_id, epoch, coalesce(max(nodeset) FILTER (WHERE since <= epoch), min(nodeset)) AS nodeset, coalesce(max(since) FILTER (WHERE since <= epoch), min(since))::BIGINT AS since
FROM ep JOIN md USING (log_id) GROUP BY ep.log_id, epoch""")
def epoch_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    since = F.explode(F.array(*[F.lit(x).cast("long") for x in (2, 3, 7)])).alias("since")
    metadata = rec.select("log_id").distinct().select("log_id", since).withColumn("nodeset", F.col("log_id") * 100 + F.col("since"))
    return integrity.epoch_metadata(rec.select("log_id", (F.floor(F.col("lsn") / 1000) + 1).alias("epoch")).distinct(), metadata)


# --- log algebra ---------------------------------------------------------------------------------------


@query(f"WITH {REC} SELECT log_id, lsn, filter_key FROM rec WHERE lsn BETWEEN 2000 AND 2600")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.range_read(records(spark, sf_dir), 2000, 2600).select("log_id", "lsn", "filter_key")


@query(f"WITH {REC} SELECT log_id, lsn FROM rec WHERE filter_key IS NULL OR filter_key = 'purchase'")
def filter_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter(log.passes("equality", "purchase")).select("log_id", "lsn")


@query(f"WITH {REC} SELECT log_id, lsn, filter_key FROM rec WHERE filter_key IS NULL OR filter_key BETWEEN 'click' AND 'purchase'")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter(log.passes("range", "click", "purchase")).select("log_id", "lsn", "filter_key")


@query(f"WITH {REC}, f AS (SELECT 0 AS log_id, lsn FROM rec WHERE filter_key <> 'view'), r AS (SELECT *, lsn - row_number() OVER (ORDER BY lsn) AS run FROM f) SELECT log_id::BIGINT AS log_id, min(lsn) AS lo, max(lsn) AS hi FROM r GROUP BY log_id, run")
def filtered_out_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.filtered_out_gaps(records(spark, sf_dir).withColumn("log_id", F.lit(0).cast("long")), log.passes("equality", "view"))


@query(f"WITH {REC}, n AS (SELECT log_id, lsn, lead(lsn) OVER (PARTITION BY log_id ORDER BY lsn) AS nx FROM rec) SELECT log_id, lsn + 1 AS lo, nx - 1 AS hi FROM n WHERE nx > lsn + 1")
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.gaps(records(spark, sf_dir))


@query(f"""WITH {REC}, {EPOCHS}, t AS (SELECT DISTINCT log_id, CASE WHEN log_id % 3 = 0 THEN (2::BIGINT << 32) | 500 ELSE 0 END AS tp FROM rec),
g AS (SELECT er.log_id, lsn AS g, coalesce(lag(lsn) OVER w, 0) + 1 AS n, lag(lsn) OVER w IS NULL AS fresh, tp FROM er JOIN t USING (log_id) WINDOW w AS (PARTITION BY er.log_id ORDER BY lsn)),
p AS (SELECT *, n AS lo, CASE WHEN n <= tp AND tp + 1 < g THEN tp ELSE g - 1 END AS hi FROM g WHERE n < g
      UNION ALL SELECT *, tp + 1, g - 1 FROM g WHERE n < g AND n <= tp AND tp + 1 < g)
SELECT log_id, CASE WHEN hi <= tp THEN 'TRIM' WHEN (g & 4294967295) <= 1 AND (fresh OR ((lo - 1) >> 32) < (g >> 32)) THEN 'BRIDGE' WHEN (g >> 32) = (lo >> 32) THEN 'DATALOSS' ELSE 'BRIDGE' END AS type, lo, hi FROM p""")
def gap_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = epoch_records(spark, sf_dir)
    t = rec.select("log_id").distinct().withColumn("trim_point", F.when(F.col("log_id") % 3 == 0, F.lit((2 << 32) | 500)).otherwise(F.lit(0)))
    return log.typed_gaps(rec, t)


def find_time_sql(at: str) -> str:
    """First record at or after a time; none: the next number; time before all records: behind the trim point; no records: the oldest number."""
    return f"""WITH {REC}, {TRIMS}, alive AS (SELECT rec.* FROM rec LEFT JOIN trims USING (log_id) WHERE lsn > coalesce(trim_point, 0)), logs AS (SELECT range AS log_id FROM range(200))
    SELECT logs.log_id, CASE WHEN count(lsn) = 0 THEN 1 WHEN arg_min(ts, lsn) > TIMESTAMP '{at}' THEN coalesce(max(trim_point), 0) + 1 ELSE coalesce(min(lsn) FILTER (WHERE ts >= TIMESTAMP '{at}'), max(lsn) + 1) END::BIGINT AS lsn
    FROM logs LEFT JOIN alive USING (log_id) LEFT JOIN trims USING (log_id) GROUP BY logs.log_id"""


def found_times(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return log.find_time(rec, at(text), trims(rec), spark.range(200).select(F.col("id").alias("log_id")))


@query(find_time_sql("2024-01-15 12:00:00"))
def find_time_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_times(spark, sf_dir, "2024-01-15 12:00:00")


@query(find_time_sql("2023-12-01 00:00:00"))
def find_time_before_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_times(spark, sf_dir, "2023-12-01 00:00:00")


@query(find_time_sql("2024-03-01 00:00:00"))
def find_time_after_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_times(spark, sf_dir, "2024-03-01 00:00:00")


@query(f"""WITH {REC}, d AS (SELECT log_id, date_trunc('day', ts) AS s, min(lsn) AS f FROM rec GROUP BY ALL)
SELECT log_id, coalesce(arg_max(f, s) FILTER (WHERE s <= TIMESTAMP '2024-01-15 12:00:00'), min(f)) AS lsn FROM d GROUP BY log_id""")
def find_time_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.find_time_approximate(log.partition_directory(records(spark, sf_dir)), at("2024-01-15 12:00:00"))


@query(f"WITH {REC} SELECT log_id, max(lsn) FILTER (WHERE k < '004000') AS lo, min(lsn) FILTER (WHERE k >= '004000') AS hi FROM (SELECT *, lpad(lsn::VARCHAR, 6, '0') AS k FROM rec) GROUP BY log_id")
def find_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.find_key(records(spark, sf_dir).withColumn("find_key", F.lpad(F.col("lsn").cast("string"), 6, "0")), "004000")


@query(f"WITH {REC} SELECT log_id, max(lsn) AS last_released, arg_max(ts, lsn) AS last_timestamp, sum(payload_size)::BIGINT AS byte_offset FROM rec GROUP BY log_id")
def tail_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.tail_attributes(records(spark, sf_dir))


@query(f"WITH {REC}, {TRIMS} SELECT log_id, trim_point, (SELECT arg_min(ts, lsn) FROM rec r WHERE r.log_id = t.log_id AND r.lsn > t.trim_point) AS trim_point_timestamp FROM trims t")
def head_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return log.head_attributes(rec, trims(rec))


@query(f"WITH {REC}, logs AS (SELECT range AS log_id FROM range(200)) SELECT log_id FROM logs WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.log_id = logs.log_id AND lsn > 900)")
def log_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return log.empty_logs(spark.range(200).select(F.col("id").alias("log_id")), rec, rec.select("log_id").distinct().withColumn("trim_point", F.lit(900)))


@query(f"WITH {REC}, {TRIMS} SELECT log_id, lsn FROM rec JOIN trims USING (log_id) WHERE lsn > trim_point")
def trimmed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return log.trimmed(rec, trims(rec)).select("log_id", "lsn")


@query(f"WITH {REC} SELECT log_id, coalesce(max(lsn) FILTER (WHERE epoch_ms(TIMESTAMP '2024-01-31') // 1000 - epoch_ms(ts) // 1000 > 86400 * (1 + log_id % 20)), 0)::BIGINT AS trim_point FROM rec GROUP BY log_id")
def retention_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    backlog = rec.select("log_id").distinct().withColumn("backlog_sec", F.lit(86400) * (F.col("log_id") % 20 + 1))
    return log.retention_trims(rec, backlog, at("2024-01-31 00:00:00"))


@query(f"""WITH {REC}, d AS (SELECT log_id, date_trunc('day', ts) AS s, sum(payload_size) AS b FROM rec GROUP BY ALL), e AS (SELECT s, lead(s) OVER (ORDER BY s) AS e FROM (SELECT DISTINCT s FROM d)),
x AS (SELECT log_id, b, epoch(s)::BIGINT AS s, epoch(coalesce(e, TIMESTAMP '2024-01-31'))::BIGINT AS e, epoch(TIMESTAMP '2024-01-10 06:00:00')::BIGINT AS lo, epoch(TIMESTAMP '2024-01-20 18:30:00')::BIGINT AS hi FROM d JOIN e USING (s))
SELECT log_id, sum(CASE WHEN lo <= s AND e <= hi THEN b ELSE round(b * (least(hi, e) - greatest(lo, s)) / (e - s)) END::BIGINT)::BIGINT AS bytes FROM x WHERE e >= lo AND s <= hi GROUP BY log_id""")
def data_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.data_size(log.partition_directory(records(spark, sf_dir)), at("2024-01-10 06:00:00"), at("2024-01-20 18:30:00"), at("2024-01-31 00:00:00"))


@query(f"WITH {REC}, d AS (SELECT date_trunc('day', ts) AS start, max(lsn) AS m FROM rec GROUP BY ALL) SELECT start FROM d WHERE start < coalesce((SELECT min(start) FROM d WHERE m > 3000), TIMESTAMP '9999-01-01')")
def obsolete_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return log.obsolete_partitions(log.partition_directory(rec), rec.select("log_id").distinct().withColumn("trim_point", F.lit(3000)))


@query(f"WITH {REC} SELECT log_id, lsn, (sum(payload_size) OVER (PARTITION BY log_id ORDER BY lsn))::BIGINT AS byte_offset FROM rec")
def byte_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.byte_offsets(records(spark, sf_dir))


BATCHED = "b AS (SELECT *, ((sum(payload_size) OVER (PARTITION BY log_id ORDER BY lsn) - payload_size) // 64)::BIGINT AS batch FROM rec)"


@query(f"WITH {REC}, {BATCHED} SELECT log_id, batch, min(lsn) AS first_lsn, count(*) AS n, sum(payload_size)::BIGINT AS bytes, string_agg(payload, '|' ORDER BY lsn) AS joined FROM b GROUP BY log_id, batch")
def batch_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.batches(records(spark, sf_dir), 64).withColumn("joined", F.array_join("payloads", "|")).drop("payloads")


@query(f"WITH {REC}, {BATCHED} SELECT log_id, min(lsn) OVER (PARTITION BY log_id, batch) AS lsn, (row_number() OVER (PARTITION BY log_id, batch ORDER BY lsn) - 1)::INTEGER AS batch_offset, payload FROM b")
def batch_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.unbatched(log.batches(records(spark, sf_dir), 64))


@query(f"WITH {REC} SELECT log_id, lsn // 4096 AS part, string_agg(lsn::VARCHAR, ',' ORDER BY lsn) AS lsns, count(*) AS n FROM rec GROUP BY ALL")
def log_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.log_digest(records(spark, sf_dir), width=4096).withColumn("lsns", F.array_join(F.transform("lsns", lambda x: x.cast("string")), ","))


@query(f"WITH {REC}, n AS (SELECT log_id, lsn AS seq FROM rec WHERE lsn % 3 = 0), t AS (SELECT log_id, max(lsn) AS m FROM rec WHERE lsn % 3 <> 0 GROUP BY log_id) SELECT n.log_id, seq, coalesce(m, 0) + row_number() OVER (PARTITION BY n.log_id ORDER BY seq) AS lsn FROM n LEFT JOIN t USING (log_id)")
def append_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    new = rec.filter("lsn % 3 = 0").select("log_id", F.col("lsn").alias("seq"))
    return log.append(new, log.tail_attributes(rec.filter("lsn % 3 <> 0")))


@query("SELECT o_custkey AS customer, o_orderkey % 5 AS log_id, max(o_orderkey) AS lsn FROM orders GROUP BY ALL HAVING max(o_orderkey) % 11 <> 0")
def checkpoint_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 5).alias("log_id")).agg(F.max("o_orderkey").alias("lsn"))
    removed = last.filter("lsn % 11 = 0").withColumn("lsn", F.lit(None).cast("long"))
    return log.update_checkpoints(last, removed)


@query("""SELECT l, CASE WHEN l = 0 THEN 'LSN_INVALID' ELSE 'e' || (l >> 32) || 'n' || (l & 4294967295) END AS pretty, l AS back, (l >> 32)::BIGINT AS epoch, round(log2(l + 1), 9) AS lg
FROM (SELECT CASE WHEN event_id = 0 THEN 0 ELSE ((1 + event_id // 2500) << 32) | event_id END AS l FROM events)""")
def lsn_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.when(e == 0, F.lit(0)).otherwise(L.compose_lsn(F.floor(e / 2500) + 1, e)).alias("l"))
    rows = rows.withColumn("pretty", L.lsn_to_string(F.col("l")))
    return rows.select("l", "pretty", L.string_to_lsn(F.col("pretty")).alias("back"), L.lsn_to_epoch(F.col("l")).alias("epoch"), F.round(scalars.log2((F.col("l") + 1).cast("double")), 9).alias("lg"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", scalars.column_name(F.concat_ws(" ", "p_name", "p_type")).alias("name"))


# --- telemetry -----------------------------------------------------------------------------------------

AGE = "(epoch_ms(TIMESTAMP '2024-01-30 00:00:00') // 1000 - epoch_ms(ts) // 1000)"
RATES = ", ".join(f"round(sum(CASE WHEN {AGE} >= 0 AND {AGE} < {s} THEN payload_size ELSE 0 END) / {s}.0, 9)::DOUBLE AS rate_{s}" for s in (3600, 86400, 604800))


@query(f"WITH {REC} SELECT log_id, {RATES} FROM rec GROUP BY log_id")
def throughput_multi_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.trailing_rates(records(spark, sf_dir), "log_id", at("2024-01-30 00:00:00"), (3600, 86400, 604800))
    return out.select("log_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(f"WITH {REC}, r AS (SELECT log_id, {RATES} FROM rec GROUP BY log_id) SELECT * FROM r ORDER BY greatest(rate_3600, rate_86400, rate_604800) DESC, log_id LIMIT 10")
def topk_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_rates(throughput_multi_interval(spark, sf_dir), "log_id", ["rate_3600", "rate_86400", "rate_604800"], 10)


COMPACT = "h AS (SELECT o_orderpriority AS p, CASE WHEN v <= 0 THEN 0 ELSE length(bin(v)) END::INTEGER AS bucket, count(*) AS n FROM (SELECT o_orderpriority, (o_totalprice - 5000)::BIGINT AS v FROM orders) GROUP BY ALL)"


def order_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.rint(F.col("o_totalprice") - 5000).cast("long").alias("v"))
    return stats.compact_histogram(rows, ["p"], F.col("v"))


@query(f"WITH {COMPACT} SELECT p, bucket, n FROM h")
def hist_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_histogram(spark, sf_dir)


@query(f"WITH {COMPACT} SELECT p, bucket, (sum(n) OVER (PARTITION BY p ORDER BY bucket DESC))::BIGINT AS n_at_least FROM h")
def cum_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.at_least(order_histogram(spark, sf_dir), ["p"])


@query(f"WITH {COMPACT} SELECT p, string_agg(bucket || ':' || n, ',' ORDER BY bucket) AS text FROM h GROUP BY p")
def hist_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram_text(order_histogram(spark, sf_dir), ["p"])


@query(f"""WITH {COMPACT}, c AS (SELECT *, sum(n) OVER (PARTITION BY p ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY p) AS total FROM h), s AS (SELECT *, share FROM c, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) AS v(share))
SELECT p, share, CASE WHEN bucket = 0 THEN floor((share * total - (upto - n)) / n + 0.5) ELSE (2 ** (bucket - 1)) + floor((share * total - (upto - n)) / n * (2 ** (bucket - 1)) + 0.5) END::BIGINT AS estimate
FROM s WHERE share * total <= upto AND (share * total > upto - n OR upto = n)""")
def hist_compact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.compact_percentiles(order_histogram(spark, sf_dir), ["p"], [0.5, 0.95])


MULTI = """m AS (SELECT l_returnflag AS f, v, 10 ** (length(floor(v)::BIGINT::VARCHAR) - 1) AS w FROM (SELECT l_returnflag, greatest(l_extendedprice, 1) AS v FROM lineitem)),
mh AS (SELECT f, (floor(v / w) * w)::BIGINT AS low, (floor(v / w) * w + w)::BIGINT AS high, count(*) AS n, sum(v) AS total FROM m GROUP BY ALL)"""


@query(f"WITH {MULTI} SELECT f, low, high, n, round(total, 2) AS total FROM mh")
def hist_multiscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), "l_extendedprice")
    return stats.multiscale_histogram(rows, ["f"], F.col("l_extendedprice")).withColumn("total", F.round("total", 2))


@query(f"""WITH {MULTI}, c AS (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY low) AS upto, sum(n) OVER (PARTITION BY f) AS total_n FROM mh),
s AS (SELECT *, (share * total_n - (upto - n)) / n AS part, total / n AS mean FROM c, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.99::DOUBLE)) AS v(share) WHERE share * total_n <= upto AND share * total_n > upto - n)
SELECT f, share, round(CASE WHEN part <= 0.5 THEN low + (mean - low) * part * 2 ELSE mean + (high - mean) * (part * 2 - 1) END, 3) AS estimate FROM s""")
def hist_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), "l_extendedprice")
    h = stats.multiscale_histogram(rows, ["f"], F.col("l_extendedprice"))
    return stats.histogram_percentiles(h, ["f"], [0.5, 0.75, 0.99]).withColumn("estimate", F.round("estimate", 3))


@query(f"WITH {REC} SELECT filter_key, count(counter) AS n, " + ", ".join(f"round({e}, 6) AS {n}" for e, n in [("min(counter)", "low"), *[(f"quantile_cont(counter, {s})", n) for s, n in ((0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99"), (0.9999, "p9999"))], ("max(counter)", "high"), ("avg(counter)", "mean")]) + " FROM rec GROUP BY filter_key")
def hist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.summaries(records(spark, sf_dir), "filter_key", "counter")
    return out.select("filter_key", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("SELECT l_returnflag || l_linestatus AS name, CASE WHEN l_linestatus = 'F' THEN max(l_partkey) ELSE sum(l_partkey) END::BIGINT AS value FROM lineitem GROUP BY l_returnflag, l_linestatus")
def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_partkey").alias("value"))
    return stats.merged_counters(samples, {"RF": "max", "AF": "max", "NF": "max"})


@query(f"WITH {REC} SELECT filter_key, '1' AS key, sum(json_extract(payload, '$.k')::BIGINT)::BIGINT AS total FROM rec GROUP BY filter_key UNION ALL SELECT filter_key, '2', count(*) FROM rec GROUP BY filter_key")
def custom_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = F.create_map(F.lit("1"), F.get_json_object("payload", "$.k").cast("long"), F.lit("2"), F.lit(1).cast("long"))
    return stats.custom_counters(records(spark, sf_dir), "filter_key", counters)


@query("""WITH s AS (SELECT n_regionkey AS g, s_suppkey AS node, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey), t AS (SELECT g, count(v) - 1 AS n, sum(v) AS s, sum(v * v) AS q, max(struct_pack(v := v, k := node)) AS top FROM s GROUP BY g),
m AS (SELECT g, top.k AS node, top.v AS v, (s - top.v) / n AS mean, sqrt(greatest((q - top.v * top.v) / n - ((s - top.v) / n) * ((s - top.v) / n), 0)) AS dev FROM t WHERE n > 0)
SELECT g, node, round(v, 4) AS v, round(mean + 1.5 * dev, 4) AS "limit" FROM m WHERE v >= mean + 1.5 * dev""")
def outlier_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("v"))
    return outliers.largest_beyond(s, "g", "node", "v", 1.5).select("g", "node", F.round("v", 4).alias("v"), F.round("limit", 4).alias("limit"))


def spend_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    return orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("node"), F.col("spent").alias("v"))


@query(None)
def outlier_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outliers_by(spend_by_customer(spark, sf_dir), "g", "node", "v", "rmsd", 3.0, 3)


@query(None)
def outlier_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outliers_by(spend_by_customer(spark, sf_dir), "g", "node", "v", "mad", 3.0, 3)


# --- integrity and placement ---------------------------------------------------------------------------


@query(f"""WITH {COPIES}, w AS (SELECT *, CASE WHEN NOT recovery AND wave = 0 THEN 4294967295 ELSE wave END AS pw FROM copies)
SELECT log_id, lsn, node, wave FROM (SELECT *, row_number() OVER (PARTITION BY log_id, lsn ORDER BY recovery DESC, pw DESC, node) AS r FROM w) WHERE r = 1""")
def record_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.winning_copies(copies(spark, sf_dir)).select("log_id", "lsn", "node", "wave")


# Errors of records by their copies: the latest wave is 0 or the greatest; one of its copysets is accurate if enough of its nodes hold the record with it.
REPLICA = f"""{COPIES}, c AS (SELECT *, list_sort(copyset) AS st, CASE WHEN min(wave) OVER p = 0 THEN 0 ELSE max(wave) OVER p END AS lw FROM copies WINDOW p AS (PARTITION BY log_id, lsn)),
s AS (SELECT log_id, lsn, st, count(DISTINCT node) >= least(len(st), 3) AS accurate, count(DISTINCT domain) >= 2 AS spread FROM c WHERE wave = lw GROUP BY log_id, lsn, st),
a AS (SELECT log_id, lsn, count(*) AS sets, bool_or(accurate) AS accurate, bool_or(accurate AND spread) AS good FROM s GROUP BY ALL),
g AS (SELECT log_id, lsn, count(*) AS n_copies, (CASE WHEN max(sets) > 1 THEN 2 ELSE 0 END + CASE WHEN bool_or(NOT list_contains(copyset, node)) THEN 4 ELSE 0 END
  + CASE WHEN log_id % 10 = 0 AND bool_or(len(list_filter(copyset, lambda x: x > 6)) > 0) THEN 8 ELSE 0 END
  + CASE WHEN bool_or(len(copyset) < 3) THEN 16 ELSE 0 END + CASE WHEN bool_or(len(copyset) > len(list_distinct(copyset))) THEN 2048 ELSE 0 END
  + CASE WHEN NOT bool_or(accurate) THEN 32 ELSE 0 END + CASE WHEN bool_or(kind = 'HOLE') AND bool_or(kind = 'RECORD') THEN 512 ELSE 0 END
  + CASE WHEN NOT (bool_or(kind = 'HOLE') AND bool_or(kind = 'RECORD')) AND count(DISTINCT CASE WHEN kind = 'RECORD' THEN payload_hash END) > 1 THEN 64 ELSE 0 END
  + CASE WHEN NOT bool_or(good) THEN 128 ELSE 0 END + CASE WHEN NOT bool_or(good) AND count(DISTINCT domain) < 2 THEN 256 ELSE 0 END)::BIGINT AS errors
  FROM c JOIN a USING (log_id, lsn) GROUP BY log_id, lsn)"""


@query(f"WITH {REPLICA} SELECT log_id, lsn, n_copies, errors FROM g WHERE errors > 0")
def replica_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies(spark, sf_dir)
    few = rows.filter("log_id % 10 = 0").select("log_id").distinct().withColumn("nodeset", F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")))
    return integrity.replica_errors(rows, 3, nodesets=few)


@query(f"""WITH {REC}, n AS (SELECT log_id, lsn, lead(lsn) OVER (PARTITION BY log_id ORDER BY lsn) AS nx FROM rec)
SELECT log_id, lsn + 1 AS lsn, 0::BIGINT AS n_copies, 1::BIGINT AS errors FROM n WHERE nx > lsn + 1 UNION ALL SELECT log_id, 1, 0, 1 FROM rec GROUP BY log_id HAVING min(lsn) > 1""")
def replica_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    dead = rec.select("log_id").distinct().withColumn("epoch", F.lit(0).cast("long"))
    none = rec.select("log_id").distinct().withColumn("trim_point", F.lit(0))
    return integrity.lost_numbers(log.typed_gaps(rec, none, lost=dead))


@query(f"""WITH {COPIES}, w AS (SELECT log_id, lsn * 9 + copyset[1] AS lsn, node, recovery, CASE WHEN node % 4 = 0 THEN NULL ELSE node * 10 END AS payload, (node + 1) % 3 AS wave, list_sort(copyset) AS copyset FROM copies),
p AS (SELECT *, (CASE WHEN recovery THEN 1 ELSE 0 END)::HUGEINT * 100000000000 + CASE WHEN NOT recovery AND wave = 0 THEN 4294967295 ELSE wave END AS pr FROM w)
SELECT log_id, lsn, arg_max(payload, pr) FILTER (WHERE payload IS NOT NULL) AS payload, array_to_string(arg_max(copyset, pr), ',') AS copyset, bit_or(node)::BIGINT AS flags FROM p GROUP BY log_id, lsn""")
def storage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.col("node")
    writes = copies(spark, sf_dir).select("log_id", (F.col("lsn") * 9 + F.col("copyset")[0]).alias("lsn"), "recovery", ((node + 1) % 3).alias("wave"), F.when(node % 4 != 0, node * 10).alias("payload"), F.array_sort("copyset").alias("copyset"), node.alias("flags"))
    merged = integrity.merged_writes(writes)
    return merged.select("log_id", "lsn", "payload", F.array_join(F.transform("copyset", lambda x: x.cast("string")), ",").alias("copyset"), "flags")


READS = """reads AS (SELECT user_id AS log_id, event_id % 4 AS writer_id, event_id AS read_pos, event_id + 1 AS lsn, CASE WHEN event_id % 17 = 0 THEN event_id - 40 WHEN event_id % 23 = 0 THEN event_id - 23 * 8 ELSE event_id END AS seq, event_id % 101 <> 0 AS good FROM events)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    seq = F.when(e % 17 == 0, e - 40).when(e % 23 == 0, e - 23 * 8).otherwise(e)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), (e % 4).alias("writer_id"), e.alias("read_pos"), (e + 1).alias("lsn"), seq.alias("seq"), (e % 101 != 0).alias("good"))


@query(f"""WITH {READS}, t AS (SELECT *, row_number() OVER (PARTITION BY log_id, writer_id, seq, good ORDER BY read_pos) AS times, max(CASE WHEN good THEN seq END) OVER (PARTITION BY log_id, writer_id ORDER BY read_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM reads)
SELECT log_id, writer_id, read_pos, CASE WHEN NOT good THEN 'CHECKSUM_MISMATCH' WHEN times > 1 THEN 'DUPLICATE' ELSE 'REORDERING' END AS error FROM t WHERE NOT good OR times > 1 OR seq < high""")
def verify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.delivery_errors(reads(spark, sf_dir))


@query(f"""WITH {READS}, seen AS (SELECT log_id, writer_id, seq, min(lsn) AS l FROM reads GROUP BY ALL)
SELECT a.log_id, a.writer_id, a.read_pos AS seq, CASE WHEN l IS NULL THEN 'DATALOSS' ELSE 'LSN_MISMATCH' END AS error FROM reads a LEFT JOIN seen s ON a.log_id = s.log_id AND a.writer_id = s.writer_id AND a.read_pos = s.seq WHERE l IS NULL OR l <> a.lsn""")
def verify_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    return integrity.lost_records(r.select("log_id", "writer_id", F.col("read_pos").alias("seq"), "lsn"), r)


@query("""WITH r AS (SELECT user_id AS log_id, event_id % 4 AS writer_id, event_id AS read_pos, event_id AS seq, event_id - 300 AS oldest FROM events), a AS (SELECT log_id, writer_id, seq, seq + CASE WHEN seq % 7 = 0 THEN 5000 ELSE 200 END AS read_pos FROM r WHERE seq % 5 <> 0),
d AS (SELECT r.log_id, r.writer_id, r.seq, r.read_pos, (SELECT min(q.read_pos) FROM r q WHERE q.log_id = r.log_id AND q.writer_id = r.writer_id AND q.oldest > r.seq) AS due FROM r)
SELECT d.log_id, d.writer_id, d.seq, 'LOST_ACK' AS error FROM d LEFT JOIN a ON a.log_id = d.log_id AND a.writer_id = d.writer_id AND a.seq = d.seq WHERE due IS NOT NULL AND (a.read_pos IS NULL OR a.read_pos > greatest(due, d.read_pos))""")
def verify_lost_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    r = read(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), (e % 4).alias("writer_id"), e.alias("read_pos"), e.alias("seq"), (e - 300).alias("oldest_in_flight"))
    acks = r.filter("seq % 5 <> 0").select("log_id", "writer_id", "seq", (F.col("seq") + F.when(F.col("seq") % 7 == 0, 5000).otherwise(200)).alias("read_pos"))
    return integrity.lost_acks(r, acks)


@query("""WITH s AS (SELECT c_custkey % 40 AS log_id, 'rack' || c_nationkey AS rack, 'region' || c_nationkey % 4 AS region, c_acctbal > -900 AS present,
  CASE WHEN c_custkey % 13 = 0 THEN 'AUTHORITATIVE_EMPTY' WHEN c_custkey % 211 = 0 THEN 'UNDERREPLICATION' WHEN c_custkey % 307 = 0 THEN 'UNAVAILABLE' ELSE 'FULLY_AUTHORITATIVE' END AS status FROM customer),
e AS (SELECT log_id, 'RACK' AS scope, 3 AS r, rack AS domain, status, present FROM s UNION ALL SELECT log_id, 'REGION', 2, region, status, present FROM s),
d AS (SELECT log_id, scope, r, domain, count(*) AS n, sum((status = 'FULLY_AUTHORITATIVE' AND present)::INTEGER) AS here, sum((status = 'AUTHORITATIVE_EMPTY')::INTEGER) AS none FROM e GROUP BY ALL),
c AS (SELECT log_id, scope, sum((here > 0 AND here + none = n)::INTEGER) >= greatest(sum((none < n)::INTEGER) - r + 1, 0) AS enough FROM d GROUP BY log_id, scope, r),
m AS (SELECT log_id, bool_or(enough) AS m FROM c GROUP BY log_id), w AS (SELECT log_id, bool_and(present OR status <> 'FULLY_AUTHORITATIVE') AS a FROM s GROUP BY log_id)
SELECT log_id, CASE WHEN m AND a THEN 'AUTHORITATIVE_COMPLETE' WHEN m THEN 'AUTHORITATIVE_INCOMPLETE' WHEN a THEN 'NON_AUTHORITATIVE' ELSE 'NONE' END AS outcome FROM m JOIN w USING (log_id)""")
def f_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    status = F.when(k % 13 == 0, "AUTHORITATIVE_EMPTY").when(k % 211 == 0, "UNDERREPLICATION").when(k % 307 == 0, "UNAVAILABLE").otherwise("FULLY_AUTHORITATIVE")
    domains = F.create_map(F.lit("RACK"), F.concat(F.lit("rack"), n), F.lit("REGION"), F.concat(F.lit("region"), n % 4))
    shards = read(spark, sf_dir, "customer").select((k % 40).alias("log_id"), k.alias("shard"), status.alias("status"), (F.col("c_acctbal") > -900).alias("present"), domains.alias("domains"))
    return integrity.f_majority(shards, {"RACK": 3, "REGION": 2})


@query("SELECT sum(p_size)::BIGINT AS total, sum(CASE WHEN p_partkey % 10 = 0 OR p_partkey % 15 = 1 THEN p_size ELSE 0 END)::DOUBLE AS lost, sum(CASE WHEN p_partkey % 10 = 0 OR p_partkey % 15 = 1 THEN p_size ELSE 0 END) > 0.15 * sum(p_size) AS loss FROM part")
def capacity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return integrity.capacity_loss(read(spark, sf_dir, "part").select(F.col("p_size").alias("weight"), (k % 10 != 0).alias("alive"), (k % 15 == 1).alias("to_disable")), 15)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS log_id, l_linenumber::BIGINT AS epoch, unnest([l_suppkey % 20, (l_suppkey + 3) % 20, (l_suppkey + 7) % 20, (l_suppkey + l_linenumber) % 20]) AS shard FROM lineitem)
SELECT log_id, epoch, sum((shard % 5 <> 0)::INTEGER)::BIGINT AS n_left, sum((shard % 4 <> 0)::INTEGER) < 2 AS writes_lost, sum((shard % 5 <> 0)::INTEGER) < count(*) - 2 + 1 AS reads_lost,
sum((shard % 5 <> 0)::INTEGER) = 0 OR sum((shard % 5 <> 0 AND shard % 4 <> 0)::INTEGER) < 2 AS rebuild_lost FROM e GROUP BY ALL""")
def impact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    shards = F.array_distinct(F.array(s % 20, (s + 3) % 20, (s + 7) % 20, (s + n) % 20))
    epochs = read(spark, sf_dir, "lineitem").select(s.alias("log_id"), n.cast("long").alias("epoch"), shards.alias("shards")).distinct()
    status = spark.range(20).select(F.col("id").alias("shard"), (F.col("id") % 4 != 0).alias("writable"), (F.col("id") % 5 != 0).alias("readable"))
    return integrity.impact(epochs, status, 2)


@query("""WITH r AS (SELECT o_custkey AS log_id, epoch_ms(o_orderdate) // 86400000 AS lo, epoch_ms(o_orderdate) // 86400000 + 45 AS hi FROM orders),
n AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY log_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY lo, hi) AS k FROM n) SELECT log_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY log_id, k""")
def rebuilding_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    return integrity.merged_ranges(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log_id"), day.alias("lo"), (day + 45).alias("hi")), ["log_id"])


@query(None)
def nodeset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(24).select(F.col("id").alias("node"), (F.col("id") % 4).cast("double").alias("weight"))
    return integrity.nodesets(records(spark, sf_dir).select("log_id").distinct(), nodes, 5)


@query("""WITH s AS (SELECT user_id::VARCHAR AS key, min(event_id) AS lsn, arg_min(event_type, event_id) AS value FROM events WHERE event_id <= 3000 GROUP BY ALL), d AS (SELECT user_id::VARCHAR AS key, event_id AS lsn, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS value FROM events WHERE event_id > 3000),
a AS (SELECT key, -1 AS lsn, value FROM s UNION ALL SELECT * FROM d), t AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM a) SELECT key, value FROM t WHERE r = 1 AND value IS NOT NULL""")
def rsm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweir.streaming.reader import folded_state

    e = read(spark, sf_dir, "events").withColumn("key", F.col("user_id").cast("string"))
    snapshot = e.filter("event_id <= 3000").groupBy("key").agg(F.min_by("event_type", "event_id").alias("value"))
    deltas = e.select("key", F.col("event_id").alias("lsn"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("value"))
    return folded_state(snapshot, deltas, 3000)


@query("SELECT n_regionkey::BIGINT AS node_id, n_nationkey AS shard, n_name AS name, (n_nationkey % 2 = 0) AS is_failing FROM nation")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes' JSON answers, made from the nations, read back as a typed table."""
    cell = lambda c: c.cast("string")
    row = F.array(cell(F.col("n_nationkey")), cell(F.col("n_name")), F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"))
    answers = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("node_id")).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"), F.array(F.lit("Shard"), F.lit(" Name "), F.lit("Is Failing")).alias("headers"))).alias("answer"))
    return tables.typed(tables.json_tables(answers)[0], {"shard": "INTEGER", "name": "TEXT", "is_failing": "BOOL"})


@query(f"WITH {COPIES} SELECT log_id, lsn, node FROM copies WHERE kind = 'HOLE' OR (list_has_any(copyset, [1, 5]) AND NOT recovery)")
def copyset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.copyset_filter(copies(spark, sf_dir).withColumn("drained", F.col("recovery")), [1, 5]).select("log_id", "lsn", "node")


@query(f"WITH {REPLICA}, e AS (SELECT unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 2048]) AS b, unnest(['DIFFERENT_COPYSET_IN_LATEST_WAVE', 'COPYSET_WITHOUT_SELF', 'COPYSET_NOT_IN_NODESET', 'SMALL_COPYSET', 'NO_ACCURATE_COPYSET', 'DATA_MISMATCH', 'BAD_REPLICATION_LAST_WAVE', 'BAD_REPLICATION', 'HOLE_RECORD_CONFLICT', 'DUPLICATES_IN_COPYSET']) AS error) SELECT error, count(*) AS n, array_to_string(list(log_id || ':' || lsn ORDER BY log_id, lsn)[1:3], ',') AS examples FROM g JOIN e ON errors & b > 0 GROUP BY error")
def replica_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = integrity.error_counts(replica_check(spark, sf_dir))
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda x: F.concat_ws(":", x["log_id"].cast("string"), x["lsn"].cast("string"))), ","))


PEERS = ", ".join(
    f"coalesce(string_agg(DISTINCT CASE WHEN {test} THEN peer END, ',' ORDER BY CASE WHEN {test} THEN peer END), '') AS {name}"
    for name, test in (("dead_nodes", "NOT alive"), ("boycotted_nodes", "peer_k % 19 = 0"), ("unhealthy_nodes", "peer_k % 17 = 3"), ("overloaded_nodes", "peer_k % 17 = 5"))
)


@query(f"""WITH r AS (SELECT c_nationkey AS node_id, (c_custkey % 25)::VARCHAR AS peer, c_custkey AS peer_k, c_acctbal > -500 AS alive FROM customer)
SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'SUSPECT' WHEN node_id % 7 = 0 THEN 'DEAD' ELSE 'ALIVE' END AS status, {PEERS} FROM r GROUP BY node_id""")
def cluster_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    health = F.when(k % 17 == 3, "UNHEALTHY").when(k % 17 == 5, "OVERLOADED").otherwise("HEALTHY")
    replies = read(spark, sf_dir, "customer").select(
        n.alias("node_id"), F.when(n % 5 == 0, "TIMEOUT").when(n % 7 == 0, "DOWN").otherwise("OK").alias("reply"), (k % 25).cast("string").alias("peer"),
        (F.col("c_acctbal") > -500).alias("peer_alive"), (k % 19 == 0).alias("peer_boycotted"), health.alias("peer_health"),
    )
    return integrity.cluster_state(replies)


@query("""WITH e AS (SELECT user_id % 50 AS shard, event_id AS version, (['NEEDS_REBUILD', 'REBUILT', 'LOST', 'ACK', 'OTHER'])[event_id * 7 % 5 + 1] AS kind FROM events),
l AS (SELECT shard, max(version) AS version, arg_max(kind, version) FILTER (WHERE kind IN ('NEEDS_REBUILD', 'LOST', 'ACK')) AS k, max(version) FILTER (WHERE kind IN ('NEEDS_REBUILD', 'LOST', 'ACK')) AS since, max(version) FILTER (WHERE kind = 'REBUILT') AS done FROM e GROUP BY shard)
SELECT shard, CASE WHEN k = 'NEEDS_REBUILD' AND done > since THEN 'AUTHORITATIVE_EMPTY' WHEN k = 'NEEDS_REBUILD' THEN 'UNDERREPLICATION' WHEN k = 'LOST' THEN 'UNAVAILABLE' ELSE 'FULLY_AUTHORITATIVE' END AS status, version FROM l""")
def shard_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("NEEDS_REBUILD", "REBUILT", "LOST", "ACK", "OTHER")]), (F.col("event_id") * 7 % 5 + 1).cast("int"))
    return integrity.shard_status(read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("shard"), F.col("event_id").alias("version"), kind.alias("kind")))


@query(None)
def boycott_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = read(spark, sf_dir, "events").filter("event_type = 'error'").select((F.col("user_id") % 6).alias("cluster"), F.col("user_id").alias("node"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return integrity.boycotts(reports, 2, 3600.0, 60.0, 86400.0, 43200.0)


@query("""WITH p AS (SELECT user_id AS node, epoch_ms(ts) // 1000 // 86400 AS p, sum((event_type = 'error')::INTEGER)::DOUBLE / count(*) AS share FROM events GROUP BY ALL),
t AS (SELECT p, count(*) - 1 AS n, sum(share) AS s, sum(share * share) AS q, max(struct_pack(v := share, k := node)) FILTER (WHERE share > 0.2) AS top FROM p GROUP BY p),
m AS (SELECT p, top.k AS node, top.v AS share, (s - top.v) / n AS mean, sqrt(greatest((q - top.v * top.v) / n - ((s - top.v) / n) * ((s - top.v) / n), 0)) AS dev FROM t WHERE n > 0 AND top IS NOT NULL),
f AS (SELECT *, p - row_number() OVER (PARTITION BY node ORDER BY p) AS run FROM m WHERE share >= mean + 1.5 * dev)
SELECT node, min(p)::BIGINT AS since, count(*) AS periods, round(max(share), 9) AS worst FROM f GROUP BY node, run""")
def append_outlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("event_type") == "error").cast("long")
    samples = read(spark, sf_dir, "events").select(F.col("user_id").alias("node"), "ts", (1 - failed).alias("successes"), failed.alias("fails"))
    return outliers.append_outliers(samples, 86400, 0.2, 0, 1.5).withColumn("worst", F.round("worst", 9))


@query(f"WITH {REC}, a AS (SELECT filter_key AS name, count(*) AS v FROM rec GROUP BY ALL), b AS (SELECT filter_key AS name, count(*) AS v FROM rec WHERE lsn <= 500 GROUP BY ALL) SELECT a.name, a.v - coalesce(b.v, 0) AS value FROM a LEFT JOIN b USING (name)")
def counter_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    count = lambda r: r.groupBy(F.col("filter_key").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return stats.counter_difference(count(rec), count(rec.filter("lsn <= 500")))


@query(f"WITH {COMPACT}, o AS (SELECT bucket, n FROM h WHERE p = '1-URGENT'), a AS (SELECT bucket, sum(n)::BIGINT AS n FROM h GROUP BY bucket) SELECT 'all' AS k, a.bucket, greatest(a.n - coalesce(o.n, 0), 0) AS n FROM a LEFT JOIN o USING (bucket)")
def hist_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = order_histogram(spark, sf_dir)
    all_ = h.groupBy(F.lit("all").alias("k"), "bucket").agg(F.sum("n").alias("n"))
    return stats.histogram_subtracted(all_, h.filter("p = '1-URGENT'").select(F.lit("all").alias("k"), "bucket", "n"), ["k"])


@query("WITH v AS (SELECT (c_custkey * c_custkey * 37)::BIGINT AS v FROM customer), u AS (SELECT v, CASE WHEN v >= 1099511627776 THEN 1099511627776 WHEN v >= 1073741824 THEN 1073741824 WHEN v >= 1048576 THEN 1048576 WHEN v >= 1024 THEN 1024 ELSE 1 END AS u FROM v), w AS (SELECT v, u, CASE WHEN v // u < 10 THEN u WHEN v // u < 100 THEN u * 10 WHEN v // u < 900 THEN u * 100 ELSE u * 124 END AS w FROM u WHERE v > 0) SELECT CASE WHEN v // u < 900 THEN v // w * w ELSE u * 900 END::BIGINT AS low, (CASE WHEN v // u < 900 THEN v // w * w ELSE u * 900 END + w)::BIGINT AS high, count(*) AS n FROM w GROUP BY ALL")
def hist_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("c_custkey") * F.col("c_custkey") * 37).cast("long")
    low, high = stats.size_bounds(F.col("v"))
    return read(spark, sf_dir, "customer").select(v.alias("v")).filter("v > 0").groupBy(low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT scope, max(factor)::INTEGER AS factor FROM (SELECT 'NODE' AS scope, 1 + p_size % 4 AS factor FROM part UNION ALL SELECT 'RACK', 1 + p_size % 3 FROM part WHERE p_partkey % 2 = 0) GROUP BY scope")
def narrowest_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, rack = (F.col("p_size") % 4 + 1).cast("int"), (F.col("p_size") % 3 + 1).cast("int")
    both = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("NODE"), node, F.lit("RACK"), rack)).otherwise(F.create_map(F.lit("NODE"), node))
    return integrity.narrowest_replication(read(spark, sf_dir, "part").select(both.alias("replication")))


@query(None)
def record_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.bounded_sample(records(spark, sf_dir), "filter_key", 20)


@query(f"WITH {GROUPS}, g AS (SELECT '/ns' || (logid_lo // 600 % 12) || '/' || name AS name, logid_lo, logid_hi FROM groups) SELECT name, logid_lo, logid_hi FROM g WHERE name = '/ns1' OR starts_with(name, '/ns1/')")
def groups_in_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = groups(spark, sf_dir).withColumn("name", F.concat(F.lit("/ns"), (F.col("logid_lo") / 600 % 12).cast("int").cast("string"), F.lit("/"), F.col("name")))
    return log.groups_by_name(named, "/ns1")


@query(f"WITH {GROUPS} SELECT name, logid_lo, logid_hi FROM groups WHERE 4321 BETWEEN logid_lo AND logid_hi")
def group_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.group_of_log(groups(spark, sf_dir), 4321)


def _all() -> None:
    """The other modules' queries register themselves."""
    from logweir.plans import log_queries, sql_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_top_groups(spark, sf_dir)

