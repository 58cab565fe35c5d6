"""Registered queries of the SQL surface: functions, dialect, node tables and the catalog's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.plans import catalog
from logweir.plans.engine import Engine
from logweir.plans.queries import query, read, sql_query
from logweir.sources import tables
from logweir.sources.nodes import holding

# --- functions of the reference surface ------------------------------------------------------------------

LSNS = "(SELECT event_id, CASE WHEN event_id = 0 THEN 0 ELSE (1 + event_id / 2500) * 4294967296 + event_id END AS l FROM events)"
DUCK_LSNS = LSNS.replace("/", "//")
DUCK_TEXT = "CASE WHEN l = 0 THEN 'LSN_INVALID' ELSE 'e' || (l >> 32) || 'n' || (l & 4294967295) END"

sql_query("sql_lsn_to_string", f"SELECT event_id, lsn_to_string(l) AS s FROM {LSNS}", f"SELECT event_id, {DUCK_TEXT} AS s FROM {DUCK_LSNS}")
sql_query("sql_string_to_lsn", f"SELECT event_id, string_to_lsn(upper(lsn_to_string(l))) AS l, string_to_lsn('17x') AS leading, string_to_lsn('lsn_oldest') AS oldest, string_to_lsn('nonsense') AS none FROM {LSNS}", f"SELECT event_id, l, 17::BIGINT AS leading, 1::BIGINT AS oldest, NULL::BIGINT AS none FROM {DUCK_LSNS}")
sql_query("sql_lsn_to_epoch", f"SELECT event_id, lsn_to_epoch(l) AS epoch FROM {LSNS}", f"SELECT event_id, (l >> 32)::BIGINT AS epoch FROM {DUCK_LSNS}")
sql_query("sql_log2", "SELECT event_id, round(log2(event_id + 1), 9) AS lg, log2(event_id * 0) < -1000000 AS of_zero FROM events", "SELECT event_id, round(log2(event_id + 1), 9) AS lg, true AS of_zero FROM events")
sql_query("sql_get_cache_ttl", "SELECT get_cache_ttl() AS ttl, count(*) AS n FROM nation", "SELECT 60 AS ttl, count(*) AS n FROM nation")
sql_query("sql_set_cache_ttl", "SELECT set_cache_ttl(90) AS was_set, count(*) AS n FROM nation", "SELECT 90 AS was_set, count(*) AS n FROM nation")

# --- dialect ---------------------------------------------------------------------------------------------

sql_query("sql_integer_division", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, 7/2 AS three, o_totalprice / 2 AS half FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, 3 AS three, o_totalprice / 2 AS half FROM orders")
sql_query("sql_division_by_zero", "SELECT n_nationkey, 10 / n_regionkey AS q, 10.0 / n_regionkey AS x, 10 % n_regionkey AS r FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 10 // n_regionkey END AS q, CASE WHEN n_regionkey <> 0 THEN 10.0::DOUBLE / n_regionkey END AS x, CASE WHEN n_regionkey <> 0 THEN 10 % n_regionkey END AS r FROM nation")
sql_query("sql_text_number", "SELECT n_nationkey, n_nationkey = '7' AS seven, n_nationkey = 'x' AS never, n_name = 10 AS also_never, n_nationkey < 'a' AS always FROM nation", "SELECT n_nationkey, n_nationkey = 7 AS seven, false AS never, n_name = '10' AS also_never, true AS always FROM nation")
sql_query("sql_overflow", "SELECT n_nationkey, 9223372036854775807 + n_nationkey AS x FROM nation WHERE n_nationkey > 0", "SELECT n_nationkey, NULL::BIGINT AS x FROM nation WHERE n_nationkey > 0")
sql_query("sql_bare_column", "SELECT c_nationkey, c_mktsegment, max(c_custkey) AS top FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_mktsegment, c_custkey) AS c_mktsegment, max(c_custkey) AS top FROM customer GROUP BY c_nationkey")
sql_query("sql_bare_key_column", "SELECT nation.n_name, sum(c_acctbal) > 0 AS rich, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey", "SELECT any_value(n_name) AS n_name, sum(c_acctbal) > 0 AS rich, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey")
sql_query("sql_scalar_max", "SELECT n_nationkey, max(n_nationkey, n_regionkey, 3) AS hi, min(n_nationkey, 4) AS lo, max(n_nationkey, NULL) AS none FROM nation", "SELECT n_nationkey, greatest(n_nationkey, n_regionkey, 3) AS hi, least(n_nationkey, 4) AS lo, NULL::INTEGER AS none FROM nation")
sql_query("sql_math", "SELECT p_partkey, log(p_size) AS l10, round(ln(p_size), 6) AS l, trunc(p_retailprice / 7) AS t, mod(p_size, 7) AS m, ceil(p_retailprice / 3) AS c, sign(-p_size) AS s, round(sqrt(p_size), 6) AS q, abs(-p_size) AS a, sqrt(-p_size) AS no_root FROM part",
          "SELECT p_partkey, log10(p_size) AS l10, round(ln(p_size), 6) AS l, trunc(p_retailprice / 7) AS t, (p_size % 7)::DOUBLE AS m, ceil(p_retailprice / 3) AS c, sign(-p_size)::INTEGER AS s, round(sqrt(p_size), 6) AS q, p_size AS a, NULL::DOUBLE AS no_root FROM part")
sql_query("sql_strings", "SELECT p_partkey, trim('xxaxx', 'x') AS t, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '1234567890') AS r, substr('abc', 0, 2) AS s0, substr(p_brand, 7) AS s7, substr(p_name, -3, 2) AS sn, quote('it''s') AS q, unicode(p_type) AS u, hex(p_size) AS h, instr(p_name, 'a') AS i, char(72, 105) AS c, p_brand || '-' || p_size AS both FROM part",
          "SELECT p_partkey, 'a' AS t, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '1234567890') AS r, 'a' AS s0, substr(p_brand, 7) AS s7, substr(p_name, length(p_name) - 2, 2) AS sn, '''it''''s''' AS q, unicode(p_type) AS u, hex(p_size::VARCHAR) AS h, instr(p_name, 'a')::INTEGER AS i, 'Hi' AS c, p_brand || '-' || p_size AS both FROM part")
sql_query("sql_conditionals", "SELECT n_nationkey, ifnull(NULL, n_name) AS a, iif(n_nationkey > 5, 'big', 'small') AS b, nullif(n_regionkey, 1) AS c, coalesce(NULL, n_regionkey) AS d FROM nation WHERE likely(n_nationkey < 20) AND unlikely(n_regionkey <> 3)",
          "SELECT n_nationkey, n_name AS a, CASE WHEN n_nationkey > 5 THEN 'big' ELSE 'small' END AS b, nullif(n_regionkey, 1) AS c, n_regionkey AS d FROM nation WHERE n_nationkey < 20 AND n_regionkey <> 3")
sql_query("sql_dates", "SELECT event_id, date(ts) AS d, time(ts) AS t, datetime(ts) AS dt, strftime('%Y/%m/%d %H', ts) AS f, unixepoch(ts) AS u, round(julianday(ts), 3) AS j, date(ts, 'start of month', '+1 month', '-1 day') AS last_day, datetime(86400, 'unixepoch') AS day_two FROM events",
          "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, strftime(ts, '%Y/%m/%d %H') AS f, epoch_ms(date_trunc('second', ts)) // 1000 AS u, round(epoch_us(ts) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE, 3) AS j, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day, '1970-01-02 00:00:00' AS day_two FROM events")
sql_query("sql_types", "SELECT p_partkey, typeof(p_partkey) AS a, typeof(p_retailprice) AS b, typeof(p_name) AS c, typeof(NULL) AS d, CAST('12abc' AS INTEGER) AS twelve, CAST(p_name AS INTEGER) AS zero, CAST(p_retailprice AS INTEGER) AS whole, CAST('3.5x' AS REAL) AS r, CAST(p_size AS TEXT) AS t FROM part",
          "SELECT p_partkey, 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d, 12::BIGINT AS twelve, 0::BIGINT AS zero, trunc(p_retailprice)::BIGINT AS whole, 3.5::DOUBLE AS r, p_size::VARCHAR AS t FROM part")
sql_query("sql_blobs", "SELECT length(zeroblob(n_regionkey)) AS n, typeof(random()) AS a, typeof(zeroblob(2)) AS b, length(randomblob(8)) AS r FROM nation", "SELECT n_regionkey AS n, 'integer' AS a, 'blob' AS b, 8 AS r FROM nation")
sql_query("sql_json", "SELECT event_id, json_extract(props, '$.k') AS a, props -> '$.k' AS b, props ->> 'k' AS c, json_valid(props) AS ok, json_valid('{') AS bad, json_array(event_id, event_type) AS arr, json_object('t', event_type, 'n', event_id) AS obj, json_array_length('[1,2,3]') AS n, json_type(props) AS t, json_quote(event_type) AS q FROM events",
          "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b, json_extract_string(props, '$.k') AS c, 1 AS ok, 0 AS bad, '[' || event_id || ',\"' || event_type || '\"]' AS arr, '{\"t\":\"' || event_type || '\",\"n\":' || event_id || '}' AS obj, 3 AS n, 'object' AS t, '\"' || event_type || '\"' AS q FROM events")
sql_query("sql_aggregates", "SELECT c_nationkey, round(total(coalesce(c_acctbal, 0)), 2) AS t, total(c_acctbal) FILTER (WHERE c_custkey < 0) AS none, group_concat(DISTINCT c_mktsegment) IS NOT NULL AS g, json_array_length(json_group_array(c_custkey)) AS n, avg(c_custkey) AS a FROM customer GROUP BY c_nationkey",
          "SELECT c_nationkey, round(sum(c_acctbal), 2) AS t, 0.0::DOUBLE AS none, true AS g, count(*)::INTEGER AS n, avg(c_custkey) AS a FROM customer GROUP BY c_nationkey")
sql_query("sql_nested_integers", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT k, n / 2 AS half, (k + n) / 3 AS third, sum(n) OVER (ORDER BY k) / 2 AS upto FROM t", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT k, n // 2 AS half, (k + n) // 3 AS third, (sum(n) OVER (ORDER BY k))::BIGINT // 2 AS upto FROM t")

# --- nodes' tables ---------------------------------------------------------------------------------------

CELLS = {"INTEGER": ("k * 3 + {j}", "k * 3 + {j}"), "BIGINT": ("k * 1000000007 + {j}", "k::BIGINT * 1000000007 + {j}"), "LSN": ("(k + 1) * 4294967296 + {j}", "(k::BIGINT + 1) * 4294967296 + {j}"), "LOGID": ("k * 100 + {j}", "k::BIGINT * 100 + {j}"),
         "TIME": ("1700000000000 + k * 1000 + {j}", "1700000000000 + k::BIGINT * 1000 + {j}"), "REAL": ("CAST(k AS DOUBLE) / 4 + {j}", "k::DOUBLE / 4 + {j}"), "TEXT": ("concat(name, '-{j}')", "name || '-{j}'"), "BOOL": ("if((k + {j}) % 3 = 0, 'true', 'false')", "(k + {j}) % 3 = 0")}
DUCK_TYPES = {"INTEGER": "INTEGER", "REAL": "DOUBLE", "TEXT": "VARCHAR", "BOOL": "BOOLEAN"}


def table_answers(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    """(node_id, answer): JSON answers in the columns of a table, one node for each region, a row for each nation; node 3 is down."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("node_id"))
    others = [c for c in columns if c != "node_id"]
    cells = [F.expr(CELLS[columns[c]][0].format(j=j)).cast("string") for j, c in enumerate(others)]
    headers = F.array(*[F.lit(c.replace("_", " ").title()) for c in others])
    answer = F.to_json(F.struct(headers.alias("headers"), F.collect_list(F.array(*cells)).alias("rows")))
    return nations.groupBy("node_id").agg(answer.alias("_a")).select("node_id", F.when(F.col("node_id") == 3, "connection refused").otherwise(F.col("_a")).alias("answer"))


def table_query(name: str, columns: dict[str, str]) -> None:
    own = "node_id" in columns
    where = " AND ".join(f"{c} >= 0" for c in catalog.REQUIRED.get(name, ()))
    chosen = list(columns)
    cell = lambda j, c: f"({CELLS[columns[c]][1].format(j=j)})::{DUCK_TYPES.get(columns[c], 'BIGINT')} AS {c}"
    others = [c for c in columns if c != "node_id"]
    duck = ", ".join([*["n_regionkey AS node_id"] * own, *[cell(j, c) for j, c in enumerate(others)]])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.register_answers(name, table_answers(spark, sf_dir, columns), keep=False)
        return engine.sql(f"SELECT {', '.join(chosen)} FROM {name}" + (f" WHERE {where}" if where else ""))

    run.__name__ = f"table_{name}"
    run.__doc__ = f"The table {name} from nodes' answers, typed by the catalog."
    query(f"SELECT {duck} FROM (SELECT n_nationkey AS k, n_name AS name, n_regionkey FROM nation WHERE n_regionkey <> 3)")(run)


for _name, _columns in catalog.declared().items():
    table_query(_name, _columns)

EXAMPLES = {
    "example_top_log_groups": "SELECT log_groups.name, sum(append_throughput.throughput_10min) AS total_throughput, log_groups.logid_lo, log_groups.logid_hi FROM append_throughput LEFT JOIN log_groups ON log_groups.name = append_throughput.log_group_name GROUP BY log_group_name ORDER BY total_throughput DESC LIMIT 0, 5",
    "example_most_readers": "SELECT count(*) as num_readers, log_id, log_groups.name FROM readers LEFT JOIN log_groups ON readers.log_id >= log_groups.logid_lo AND readers.log_id <= log_groups.logid_hi group by log_id ORDER BY num_readers desc, log_id LIMIT 0, 5",
    "example_readers_sockets": "SELECT log_id, lsn_to_string(until_lsn) as until_lsn, lsn_to_string(read_pointer) as read_pointer, sockets.read_cnt, sockets.write_cnt FROM readers LEFT JOIN sockets ON readers.client = sockets.name ORDER BY log_id LIMIT 0, 5",
    "example_partition_sizes": "SELECT node_id, shard, id, min_time, max_time, approx_size / 1024.0 / 1024.0 as size_mb FROM partitions ORDER BY approx_size DESC LIMIT 0, 5",
    "example_idle_groups": "SELECT count(log_groups.name) as num_log_groups_no_throughput FROM log_groups LEFT JOIN append_throughput ON log_groups.name = append_throughput.log_group_name WHERE throughput_10min IS NULL",
}


def duck_table(name: str) -> str:
    columns = catalog.declared()[name]
    others = [c for c in columns if c != "node_id"]
    cells = [f"({CELLS[columns[c]][1].format(j=j)})::{DUCK_TYPES.get(columns[c], 'BIGINT')} AS {c}" for j, c in enumerate(others)]
    return f"{name} AS (SELECT {', '.join([*['n_regionkey AS node_id'] * ('node_id' in columns), *cells])} FROM (SELECT n_nationkey AS k, n_name AS name, n_regionkey FROM nation WHERE n_regionkey <> 3))"


def example_query(name: str, text: str) -> None:
    used = [t for t in catalog.declared() if f" {t} " in f"{text} ".replace(".", " ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for t in used:
            engine.register_answers(t, table_answers(spark, sf_dir, catalog.declared()[t]), keep=False)
        return engine.sql(text)

    run.__name__ = name
    duck = text.replace("LIMIT 0, 5", "LIMIT 5").replace("SELECT log_groups.name, sum(append_throughput.throughput_10min)", "SELECT any_value(log_groups.name) AS name, sum(append_throughput.throughput_10min)::BIGINT")
    duck = duck.replace("log_groups.logid_lo, log_groups.logid_hi FROM", "any_value(log_groups.logid_lo) AS logid_lo, any_value(log_groups.logid_hi) AS logid_hi FROM").replace("log_id, log_groups.name FROM", "log_id, any_value(log_groups.name) AS name FROM")
    for c in ("until_lsn", "read_pointer"):
        duck = duck.replace(f"lsn_to_string({c})", f"'e' || ({c} >> 32) || 'n' || ({c} & 4294967295)")
    duck = duck.replace("/ 1024.0 / 1024.0", "/ 1024.0::DOUBLE / 1024.0::DOUBLE")
    query(f"WITH {', '.join(duck_table(t) for t in used)} {duck}")(run)


for _name, _text in EXAMPLES.items():
    example_query(_name, _text)


def node_files(spark: SparkSession, sf_dir: str) -> dict[int, str]:
    """Addresses of nodes whose answers lie in files, one for each region, and one of which there is none."""
    rows = table_answers(spark, sf_dir, catalog.declared()["stats"]).collect()  # a row for each node
    return holding({r["node_id"]: r["answer"] for r in rows}) | {99: "127.0.0.1:1"}


@query("SELECT n_regionkey AS node_id, n_name || '-0' AS name, n_nationkey::BIGINT * 1000000007 + 1 AS value FROM nation WHERE n_regionkey <> 3")
def node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from a source with a partition for each node; two nodes fail without harm."""
    engine = Engine(spark)
    engine.register_nodes("stats", node_files(spark, sf_dir))
    return engine.sql("SELECT node_id, name, value FROM stats")


@query("SELECT n_regionkey AS node_id, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2) GROUP BY n_regionkey")
def node_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the nodes that the statement asks for are contacted."""
    engine = Engine(spark)
    engine.register_nodes("stats", node_files(spark, sf_dir))
    return engine.sql("SELECT node_id, count(*) AS n FROM stats WHERE node_id >= 1 AND node_id < 3 GROUP BY node_id")


@query("SELECT * FROM (VALUES (3, true), (99, true)) AS t(node_id, has_reason)")
def partial_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that failed, with why, beside the rows of the others."""
    engine = Engine(spark)
    engine.register_nodes("stats", node_files(spark, sf_dir), keep=True)
    engine.sql("SELECT * FROM stats")
    return engine.status.failures[0].select("node_id", (F.length("reason") > 0).alias("has_reason"))


@query("SELECT n_regionkey::BIGINT AS node_id, 'append.' || n_name AS name, n_nationkey::VARCHAR AS value FROM nation")
def stat_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text answers, line by line; lines of another form or length are skipped."""
    lines = F.array(F.concat_ws(" ", F.lit("STAT"), F.concat(F.lit("append."), "n_name"), "n_nationkey"), F.lit("END"), F.lit("STAT x 1 2"))
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("node_id"), F.explode(lines).alias("value"))
    return tables.stat_lines(rows, 1).select("node_id", "name", F.col("values")[0].alias("value"))


@query("SELECT t.name AS table_name, t.n AS n_columns FROM (VALUES " + ", ".join(f"('{t}', {len(c)})" for t, c in catalog.declared().items()) + ") AS t(name, n)")
def catalog_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables and their numbers of columns, read back from the generated documentation."""
    engine = Engine(spark)
    for t in catalog.declared():
        engine.register_answers(t, spark.createDataFrame([], "node_id int, answer string"), keep=False)
    rows, name = {}, ""
    for line in engine.markdown().splitlines():
        if line.startswith("## "):
            name = line[3:]
            rows[name] = 0
        elif line.startswith("| ") and line != "| column | type |":
            rows[name] += 1
    return spark.createDataFrame(list(rows.items()), "table_name string, n_columns int")


@query("SELECT n_nationkey AS k, json_object('headers', ['n_nationkey', 'n_name'], 'rows', [[n_nationkey::VARCHAR, n_name]])::VARCHAR AS answer FROM nation WHERE n_nationkey < 5")
def rendered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows rendered as the JSON that nodes answer with."""
    from logweir.plans.engine import rendered

    nations = read(spark, sf_dir, "nation")
    rows = [(k, rendered(nations.filter(F.col("n_nationkey") == k).select("n_nationkey", "n_name"), "json")) for k in range(5)]
    return spark.createDataFrame([(k, json.dumps(json.loads(a), separators=(",", ":"))) for k, a in rows], "k int, answer string")


