"""The SQL engine, the catalog, streaming readers and the registered queries."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from logweir.plans import catalog
from logweir.plans.engine import Engine, StatementError, rendered
from logweir.streaming import reader

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")


def test_engine(spark):
    engine = Engine(spark)
    engine.register("numbers", lambda s: s.range(10).withColumnRenamed("id", "n"), "ten numbers")
    assert [r[0] for r in engine.sql("SELECT n FROM numbers ORDER BY n LIMIT 2, 3").collect()] == [2, 3, 4]
    assert engine.set_cache_ttl(5) == engine.get_cache_ttl() == 5
    assert len(engine.script("SELECT 'a;b' AS x FROM numbers; SELECT n FROM numbers")) == 2
    assert "| n | bigint |" in engine.markdown()
    answers = spark.createDataFrame([(7, '{"headers": ["log_id", "lsn", "payload"], "rows": [["1", "5", "x"]]}'), (8, "down")], "node_id long, answer string")
    engine.register_answers("record", answers)
    with pytest.raises(StatementError):
        engine.sql("SELECT * FROM record WHERE log_id = 1")
    assert engine.sql("SELECT node_id, payload FROM record WHERE log_id = 1 AND lsn >= 5").collect() == [(7, "x")]
    assert engine.status.contacted == 2 and list(engine.status.failed) == [8]
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    assert rendered(df, "csv") == 'k,v\n1,"a,b"\n2,'
    assert rendered(df, "list", header=False) == "1|a,b\n2|"
    assert rendered(df.select("k", "k"), "csv").startswith("k[0],k[1]")
    assert rendered(df, "line").startswith("k = 1")


def test_required_predicates_are_found_in_the_plan(spark):
    engine = Engine(spark)
    answers = spark.createDataFrame([(7, '{"headers": ["log_id", "lsn", "payload"], "rows": [["1", "5", "x"]]}')], "node_id long, answer string")
    engine.register_answers("record", answers)
    engine.register("other", lambda s: s.range(3).selectExpr("id AS log_id", "id AS lsn"))
    for refused in ("SELECT * FROM record", "SELECT * FROM record, other WHERE other.log_id = 1 AND other.lsn = 5", "SELECT * FROM other WHERE log_id IN (SELECT log_id FROM record)", "SELECT 'log_id = 1 AND lsn = 5' AS t, r.* FROM record r"):
        with pytest.raises(StatementError):
            engine.sql(refused)
    for fine in ("SELECT r.payload FROM record r WHERE r.log_id = 1 AND r.lsn BETWEEN 2 AND 9", "SELECT payload FROM (SELECT * FROM record) WHERE log_id IN (1, 2) AND lsn <= 5"):
        assert engine.sql(fine).collect() == [("x",)]


def test_catalog():
    declared = catalog.declared()
    assert len(declared) == 42
    assert declared["stats"] == {"node_id": "INTEGER", "name": "TEXT", "value": "BIGINT"}
    assert len(declared["sockets"]) == 16 and declared["shard_authoritative_status_spew"]["ack_lsn"] == "TEXT"


def test_nodes_answer_over_sockets(spark):
    import socketserver
    import threading

    asked = []

    class Node(socketserver.StreamRequestHandler):
        def handle(self):
            asked.append((self.server.server_address[1], self.rfile.readline().decode().strip()))
            self.wfile.write(self.server.answer.encode())

    servers = []
    for answer in ('{"headers": ["Name", "Value"], "rows": [["a", "1"], ["b", null]]}\r\nEND\r\n', '{"headers": ["Name"], "rows": [["a", "1"]]}', '{"headers": ["Value", "Name", "New"], "rows": [["3", "c", "z"]]}'):
        server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Node)
        server.answer = answer
        threading.Thread(target=server.serve_forever, daemon=True).start()
        servers.append(server)
    try:
        nodes = {i: f"127.0.0.1:{s.server_address[1]}" for i, s in enumerate(servers)} | {9: "127.0.0.1:1"}
        engine = Engine(spark)
        engine.register_nodes("stats", nodes, keep=True)
        assert sorted(map(tuple, engine.sql("SELECT node_id, name, value FROM stats").collect())) == [(0, "a", 1), (0, "b", None), (2, "c", 3)]
        assert engine.status.contacted == 4 and sorted(engine.status.failed) == [1, 9] and engine.status.failed_count == 2
        assert [c for _, c in asked] == ["info stats --json"] * 3  # once each, also for the failures
        asked.clear()
        engine.register_nodes("stats", nodes)
        found = engine.sql("SELECT name FROM stats WHERE node_id = 2")
        assert found.rdd.getNumPartitions() == 1 and [r[0] for r in found.collect()] == ["c"] and {p for p, _ in asked} == {servers[2].server_address[1]}
    finally:
        for server in servers:
            server.shutdown()
            server.server_close()


def test_verbs_of_the_shell(spark):
    engine = Engine(spark)
    engine.register("numbers", lambda s: s.range(3).withColumnRenamed("id", "n"))
    assert engine.verb("describe numbers") == "n bigint" and engine.verb(":tables") == "numbers" and engine.verb(":ttl 7") == engine.verb(":ttl") == "7"
    assert engine.verb(":pretty on") == "on" and engine.verb("SELECT n FROM numbers").count() == 3 and engine.verb(":last_query") == "SELECT n FROM numbers"
    assert engine.shown(spark.createDataFrame([((5 << 32) + 7,)], "last_released long"), "sequencers").collect() == [("e5n7",)]
    assert rendered(spark.range(5), "list", rows=2).endswith("there are more)") and '"more": true' in rendered(spark.range(5), "json", rows=2)
    with pytest.raises(StatementError):
        engine.verb(":nothing")
    with pytest.raises(StatementError):
        engine.sql("SELECT (1")


def test_streaming_over_restarts(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [[(1, 1, "a"), (1, 2, "a"), (2, 5, "b")], [(1, 5, "a"), (1, 5, "a"), (2, 6, "b")], [(1, 6, "a"), (2, 9, "b"), (1, 4, "late")]]
    schema = spark.createDataFrame(batches[0], "log_id long, lsn long, payload string").schema
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = reader.stream_gaps(reader.read_files(spark, source, schema))
        reader.run_to_end(stream, sink, checkpoint)
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [(1, 3, 4), (2, 7, 8)]


def test_stream_of_copies(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "log_id long, lsn long")
    df.write.parquet(source)
    reader.run_to_end(reader.without_copies(reader.read_files(spark, source, df.schema)), sink, checkpoint)
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [(1, 1), (1, 2)]


def test_replicated_state(spark):
    snapshot = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    deltas = spark.createDataFrame([("a", 3, "old"), ("a", 12, "new"), ("b", 11, None), ("c", 13, "3")], "key string, lsn long, value string")
    assert sorted(map(tuple, reader.folded_state(snapshot, deltas, 10).collect())) == [("a", "new"), ("c", "3")]


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_registered_queries_agree_with_sql(spark):
    import duckdb
    from logweir.plans import queries

    con = duckdb.connect()
    for t in queries.NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    different = []
    for name, sql in queries.oracle_sql().items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = queries.queries()[name](spark, SMALL)
        same = sorted(got.columns) == sorted(columns) and sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
        if not same:
            different.append(name)
    assert not different


def agrees_with_sql(spark, name, folder, tables):
    """Whether a registered query gives its SQL's rows over a folder of these tables."""
    import duckdb
    from logweir.plans import queries

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted(map(repr, map(tuple, queries.queries()[name](spark, folder).select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_compact_histograms_round_as_sql(spark, tmp_path):
    prices = [("a", 5001.0), ("b", 5001.0), ("b", 5000.5), ("b", 5001.4), ("b", 5001.0), ("c", 5000.5), ("d", 5002.5), ("d", 4000.0), ("d", 5001.0)]
    spark.createDataFrame(prices, "o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert agrees_with_sql(spark, "hist_compact_sum", str(tmp_path), ["orders"]) and agrees_with_sql(spark, "hist_compact", str(tmp_path), ["orders"])


def test_all_failures_are_counted(spark):
    engine = Engine(spark)
    rows = [(0, '{"headers": ["x"], "rows": [["1"]]}')] + [(i, "down") for i in range(1, 1301)]
    engine.register_answers("narrow", spark.createDataFrame(rows, "node_id long, answer string"), {"x": "TEXT"})
    engine.sql("SELECT x FROM narrow")
    assert engine.status.contacted == 1301 and engine.status.failed_count == 1300
    assert sum(f.count() for f in engine.status.failures) == 1300


def test_tables_that_are_not_declared_are_refused(spark):
    with pytest.raises(StatementError):
        Engine(spark).register_answers("unknown", spark.createDataFrame([], "node_id long, answer string"))


def test_delivery_again_after_a_refusal(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    df = spark.createDataFrame([(1, 1), (1, 2)], "log_id long, lsn long")
    df.coalesce(1).write.parquet(source)
    seen = []

    def once_refused(batch, batch_id):
        seen.append((batch_id, batch.count()))
        return len(seen) > 1

    reader.deliver(reader.read_files(spark, source, df.schema), checkpoint, once_refused)
    assert seen == [(0, 2), (0, 2)]
    with pytest.raises(Exception, match="refused"):
        reader.deliver(reader.read_files(spark, source, df.schema), str(tmp_path / "other"), lambda b, i: False, attempts=2)


def test_copies_over_restarts(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in ([(1, 1), (1, 2), (1, 2)], [(1, 2), (1, 3), (2, 9)], [(2, 9), (1, 4)]):
        df = spark.createDataFrame(part, "log_id long, lsn long")
        df.coalesce(1).write.mode("append").parquet(source)
        reader.run_to_end(reader.without_copies(reader.read_files(spark, source, df.schema)), sink, checkpoint)
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 9)]


def test_key_values_as_a_stream(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    schema = "key string, lsn long, value string"
    for part in ([("a", 1, "x"), ("b", 2, "y")], [("a", 5, "z"), ("b", 1, "old")]):
        df = spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(source)
    found: dict = {}
    stream = reader.stream_key_values(reader.read_files(spark, source, df.schema, 1))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: found.update({r["key"]: r["value"] for r in b.orderBy("lsn").collect()})).trigger(availableNow=True).start()
    query.awaitTermination()
    assert found == {"a": "z", "b": "y"}


def test_released_records(spark):
    records = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "log_id long, lsn long")
    pointers = spark.createDataFrame([(1, 1)], "log_id long, last_released long")
    assert [tuple(r) for r in reader.released(records, pointers).collect()] == [(1, 1)]


def test_state_stalls_before_a_gap(spark):
    snapshot = spark.createDataFrame([("a", "1")], "key string, value string")
    deltas = spark.createDataFrame([("a", 11, "2"), ("a", 14, "3")], "key string, lsn long, value string")
    stops = spark.createDataFrame([(2, 3), (12, 13)], "lo long, hi long")
    assert [tuple(r) for r in reader.folded_state(snapshot, deltas, 10, stops).collect()] == [("a", "2")]
    assert [tuple(r) for r in reader.folded_state(snapshot, deltas, 10, stops.limit(0)).collect()] == [("a", "3")]
