"""Cells, boycotts, outliers, samples, node sets and the client's verbs, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions import dialect, scalars
from logweir.operators import cells, integrity, log, outliers
from logweir.operators.logframe import LogFrame, time_at, time_of_ms
from logweir.plans.logs_tree import CatalogError, LogsTree


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def numbers(seed=0):
    rng = random.Random(seed)
    return [(k, n, rng.choice([None, 1, 5, 9])) for k in (1, 2, None) for n in sorted(rng.sample(range(60), 25))]


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_cells(spark, bits):
    data = numbers()
    df = spark.createDataFrame(data, "k int, n long, v int")
    for how, f in (("sum", lambda xs: sum(xs)), ("max", lambda xs: max(xs, default=None)), ("count", len)):
        for before in (False, True):
            got = rows(cells.running(df, ["k"], "n", F.col("v"), how, "out", before, bits).select("k", "n", "out"))
            want = [(k, n, f([x for a, b, x in data if a == k and x is not None and (b < n or (b == n and not before))])) for k, n, _ in data]
            assert got == sorted(want, key=repr)
    got = rows(cells.steps(df, ["k"], "n", bits))
    want = []
    for k in (1, 2, None):
        mine = [n for a, n, _ in data if a == k]
        want += [(k, a, b) for a, b in zip(mine, mine[1:], strict=False) if b > a + 1]
    assert got == sorted(want, key=repr)
    runs = []
    for k in (1, 2, None):
        mine = [n for a, n, _ in data if a == k]
        start = mine[0]
        for a, b in zip(mine, [*mine[1:], None], strict=True):
            if b != a + 1:
                runs.append((k, start, a))
                start = b
    assert rows(cells.runs(df, ["k"], "n", bits)) == sorted(runs, key=repr)


def test_boycotts(spark):
    reports = [(0, 1, 0.0), (0, 1, 5.0), (0, 2, 6.0), (0, 3, 7.0), (0, 1, 20.0), (0, 1, 45.0), (0, 1, 500.0), (1, 3, 7.0)]
    got = rows(integrity.boycotts(spark.createDataFrame(reports, "cluster long, node long, at double"), 2, 10.0))
    assert got == [(0, 1, 0.0, 10.0), (0, 1, 20.0, 30.0), (0, 1, 45.0, 55.0), (0, 1, 500.0, 510.0), (0, 2, 6.0, 16.0), (1, 3, 7.0, 17.0)]
    got = rows(integrity.boycotts(spark.createDataFrame(reports, "cluster long, node long, at double"), 2, 10.0, 1.0, 40.0, 100.0))
    # doubled at 20, and again at 45 (until 46 + 40); at 500 four calm stretches have halved it back
    assert [r for r in got if r[1] == 1] == [(0, 1, 1.0, 11.0), (0, 1, 21.0, 41.0), (0, 1, 46.0, 86.0), (0, 1, 501.0, 511.0)]


def test_append_outliers_are_those_that_stand_out(spark):
    samples = []
    for p in range(6):
        for node in range(12):
            fails = 80 if node == 3 and p in (1, 2, 3) else 90 if node == 5 and p == 2 else 30 if p == 5 else node % 2
            samples.append((node, f"2024-01-0{p + 1} 03:00:00", 100 - fails, fails))
    df = spark.createDataFrame(samples, "node long, ts string, successes long, fails long").withColumn("ts", F.col("ts").cast("timestamp"))
    day = 19723  # 2024-01-01
    assert [tuple(r) for r in outliers.append_outliers(df, 86400, 0.2, 0, 2.0, 0.0, 2).collect()] == [(5, day + 2, 1, 0.9), (3, day + 1, 3, 0.8)]
    assert [tuple(r) for r in outliers.append_outliers(df, 86400, 0.2, 1, 2.0, 0.0, 2).collect()] == [(3, day + 1, 3, 0.8)]


@pytest.mark.parametrize("method", ["rmsd", "mad"])
def test_outliers_of_a_table(spark, method):
    rng = np.random.default_rng(1)
    data = [(g, n, float(v)) for g in range(4) for n, v in enumerate(rng.normal(10, 1 + g, 40) + (rng.random(40) < 0.05) * 60)]
    got = rows(outliers.outliers_by(spark.createDataFrame(data, "g int, n int, v double"), "g", "n", "v", method, 3.0, 3))
    want = []
    for g in range(4):
        mine = sorted([(v, n) for a, n, v in data if a == g], reverse=True)
        for k in (3, 2, 1):
            rest = np.array([v for v, _ in mine[k:]])
            centre = rest.mean() if method == "rmsd" else np.median(rest)
            spread = np.sqrt(((rest - centre) ** 2).mean()) if method == "rmsd" else np.median(abs(rest - centre))
            if mine[k - 1][0] >= centre + 3 * spread > mine[k][0]:
                want += [(g, n, v, i) for i, (v, n) in enumerate(mine[:k])]
                break
    assert got == sorted(want, key=repr)


def test_bounded_sample(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("log_id"), F.col("id").alias("lsn"))
    hashed = df.withColumn("h", F.xxhash64(F.lit(0), "log_id", "lsn")).collect()
    want = sorted(tuple(r)[:2] for k in range(3) for r in sorted((r for r in hashed if r["log_id"] == k), key=lambda r: r["h"])[:20])
    assert sorted(map(tuple, log.bounded_sample(df, "log_id", 20).collect())) == want


def test_node_sets_stay_when_nodes_come_and_go(spark):
    logs = spark.range(200).select(F.col("id").alias("log_id"))
    make = lambda n: spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") == 0, 0.0).otherwise(1.0 + F.col("id") % 3).alias("weight"))
    sets = lambda n: {r["log_id"]: set(r["s"]) for r in integrity.nodesets(logs, make(n), 4).groupBy("log_id").agg(F.collect_set("node").alias("s")).collect()}
    before, after = sets(20), sets(21)
    assert all(len(s) == 4 and 0 not in s for s in before.values()) and all(len(before[k] - after[k]) <= 1 for k in before)
    assert 10 < sum(before[k] != after[k] for k in before) < 100
    weights = {n: 1 + n % 3 for n in range(1, 20)}
    share = {w: sum(n in s for s in before.values() for n, x in weights.items() if x == w) for w in (1, 2, 3)}
    assert share[1] < share[2] < share[3]


def test_batches_as_bytes(spark):
    df = spark.createDataFrame([(1, [b"", b"abc", b"\x00\xff"]), (2, []), (3, None)], "k int, p array<binary>").withColumn("b", scalars.encoded_batch(F.col("p")))
    assert [r[0] and [bytes(x) for x in r[0]] for r in df.orderBy("k").select(scalars.decoded_batch(F.col("b"))).collect()] == [[b"", b"abc", b"\x00\xff"], [], None]
    cut = df.filter("k = 1").select(F.explode(F.array(F.expr("substring(b, 1, length(b) - 1)"), F.expr("concat(b, X'00')"), F.lit(b"").cast("binary"), F.expr("overlay(b PLACING X'07' FROM 12)"))).alias("b"))
    assert [r[0] for r in cut.select(scalars.decoded_batch(F.col("b"))).collect()] == [None] * 4


def test_batches_are_coded_once(spark):
    """The plan holds a batch's code a few times, not once for each number in it, whatever the batch is made from."""
    df = spark.createDataFrame([(1, 1, [b"a", b""]), (1, 2, []), (1, 3, None), (2, 1, [b"x", None])], "log_id long, first_lsn long, p array<binary>")
    made = df.withColumn("b", scalars.encoded_batch(F.transform("p", lambda x: x))).withColumn("b", F.when(F.col("log_id") < 9, F.col("b")).otherwise(F.concat("b", "b")))
    assert [r["b"] and bytes(r["b"]).hex() for r in made.orderBy("log_id", "first_lsn").select("b").collect()][1:] == ["2144df1c00000000", None, None]
    read = made.withColumn("payloads", scalars.decoded_batch(F.col("b")))
    found = log.unbatched(read)
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in found.collect()) == [(1, 1, 0, b"a"), (1, 1, 1, b"")]
    assert max(map(len, found._jdf.queryExecution().executedPlan().toString().splitlines())) < 6000
    assert sorted(r["lo"] for r in log.undecodable(read).collect()) == [1, 3]


def test_log_frame(spark):
    records = spark.createDataFrame([(1, n, f"2024-01-0{n} 00:00:00", f"p{n}", 2, f"{n:02d}") for n in (2, 3, 5)], "log_id long, lsn long, ts string, payload string, payload_size long, find_key string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    tree = LogsTree({"replication_factor": "3"})
    tree.make_log_group("/a/b", 1, 10, parents=True)
    frame = LogFrame(records, spark.createDataFrame([(1, 0)], "log_id long, trim_point long"), tree)
    assert frame.find_time(1, time_at("2024-01-03 00:00:00")) == 3 and frame.find_time(1, time_at("2025-01-01 00:00:00")) == 6 and frame.find_time(9, time_at("2025-01-01 00:00:00")) == 1
    assert frame.find_time(1, time_of_ms(0)) == 1 and frame.find_time(1, time_at("2024-01-03 12:00:00"), approximate=True) == 3
    assert frame.find_key(1, "03") == (2, 3) and frame.get_tail_lsn(1) == 5 and not frame.is_log_empty(1) and frame.is_log_empty(2)
    trimmed, status = frame.trim(1, 3)
    assert status == "OK" and frame.trim(1, 9)[1] == "TOOBIG" and trimmed.get_head_attributes(1)["trim_point"] == 3 and trimmed.find_time(1, time_of_ms(0)) == 4
    assert [tuple(r) for r in trimmed.create_reader(1).collect()] == [("TRIM", 1, 3, None), ("DATALOSS", 4, 4, None), ("RECORD", 5, 5, "p5")]
    new = spark.createDataFrame([(1, 0, "q", 1), (1, 1, "r", 1)], "log_id long, seq long, payload string, payload_size long")
    assert frame.append(new).get_tail_lsn(1) == 7 and frame.data_size(1, time_of_ms(0), time_at("2024-02-01 00:00:00"), time_at("2024-02-01 00:00:00")) == 6
    assert frame.get_tail_attributes(1)["byte_offset"] == 6 and tree.group_of(4) == "/a/b"


def test_catalog_refuses(spark):
    tree = LogsTree()
    tree.make_directory("/d")
    version = tree.make_log_group("/d/g", 5, 9, {"replication_factor": "2"})
    for code, change in {
        "EXISTS": lambda: tree.make_log_group("/d/g", 20, 21), "NOTFOUND": lambda: tree.remove_log_group("/d/x"), "NOTEMPTY": lambda: tree.remove_directory("/d"),
        "ID_CLASH": lambda: tree.make_log_group("/h", 9, 12), "INVALID_ATTRIBUTES": lambda: tree.set_attributes("/d/g", {"replication_factor": "0"}),
    }.items():
        with pytest.raises(CatalogError) as e:
            change()
        assert e.value.code == code
    with pytest.raises(CatalogError):
        tree.rename("/d", "/d/e")
    assert tree.version == version and tree.set_log_group_range("/d/g", 6, 12) == version + 1 and tree.group_of(5) is None
    assert [tuple(r) for r in tree.groups(spark).select("name", "logid_lo", "logid_hi").collect()] == [("/d/g", 6, 12)]


def test_statements_of_both_kinds():
    assert dialect.to_spark("SELECT a / b FROM t", {"a": "int", "b": "bigint"}) == "SELECT (a DIV nullif(b, 0)) FROM t"
    assert dialect.to_spark("SELECT a / b FROM t", {"a": "int", "b": "double"}) == "SELECT try_divide(a, b) FROM t"
    assert dialect.to_spark("SELECT max(a), b FROM t GROUP BY c") == "SELECT max(a), max_by(b, a) AS b FROM t GROUP BY c"
    assert dialect.to_spark("SELECT total(f(x, (1))) FROM t") == "SELECT coalesce(sum(CAST(f(x, (1)) AS DOUBLE)), 0D) FROM t"
    assert dialect.to_spark("-- note\nSELECT 1 /* two */ FROM t LIMIT 1, 2;").strip(" ;") == "SELECT 1 FROM t LIMIT 2 OFFSET 1"
    for broken in ("SELECT (1", "SELECT 1)", "SELECT 'x"):
        with pytest.raises(ValueError, match="bracket|read"):
            dialect.to_spark(broken)


def test_tools(spark, tmp_path):
    from logweir import tools

    folder = str(tmp_path / "logs")
    assert tools.write(spark, folder, 3, ["a", "b"]) == [1, 2] and tools.write(spark, folder, 3, ["c"]) == [3] and tools.write(spark, folder, 4, ["x"]) == [1]
    assert [tuple(r) for r in tools.cat(spark, folder, 3).collect()] == [("RECORD", 1, 1, "a"), ("RECORD", 2, 2, "b"), ("RECORD", 3, 3, "c")]
    assert tools.trim(spark, folder, 3, 2) == "OK" and tools.trim(spark, folder, 3, 9) == "TOOBIG"
    assert [tuple(r) for r in tools.cat(spark, folder, 3).collect()] == [("TRIM", 1, 2, None), ("RECORD", 3, 3, "c")]
    assert [r["payload"] for r in tools.tail(spark, folder, 3, 5).collect()] == ["c"]
    tools.keep_stats(spark.createDataFrame([(1.0, "sent", 5.0), (2.0, "sent", 7.0)], "time double, name string, value double"), folder)
    tools.keep_events(spark.createDataFrame([("started", 1)], "what string, at int"), folder)
    assert [tuple(r) for r in tools.kept_stats(spark, folder).collect()] == [("sent", 2, 5.0, 7.0, 12.0)]


def test_synthetic_appends(spark):
    from logweir.sources import tables

    rows = tables.poisson_appends(spark, 4000, 2.0, seed=1, logs=2).collect()
    last = {k: max(r["at_seconds"] for r in rows if r["log_id"] == k) for k in (0, 1)}
    assert len(rows) == 8000 and all(1800 < t < 2200 for t in last.values()) and last[0] != last[1]
    rates = [r["rate"] for r in tables.log2_rates(spark, 4000, [1, 2, 1]).collect()]
    assert all(1 <= r < 8 for r in rates) and 0.45 < sum(2 <= r < 4 for r in rates) / 4000 < 0.55
    moved = tables.spiky(spark.range(1000).select((F.col("id") / 10).alias("at_seconds")), 10.0, 0.2, 0.8).collect()
    assert sum(r["at_seconds"] % 10 < 2 for r in moved) == pytest.approx(800, abs=12)


def test_commands_of_nodes(spark):
    import json

    from logweir.plans.engine import Engine, StatementError

    engine = Engine(spark)
    engine.register("shards", lambda s: s.createDataFrame([(1, 0, "ok"), (2, 0, "bad")], "node_id int, shard long, dirty_state string"))
    assert json.loads(engine.command("info shards node_id=2 --json"))["rows"] == [["2", "0", "bad"]]
    assert engine.command("info shards dirty_state=ok").splitlines()[-1].split() == ["1", "0", "ok"]
    for wrong in ("info nothing", "info shards x=1", "halt"):
        with pytest.raises(StatementError):
            engine.command(wrong)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["outlier_rmsd", "outlier_mad", "boycott_window", "record_sample", "nodeset_selection"])
def test_queries_without_sql(spark, name):
    """The registered queries that SQL can't express, over the smallest tables, against plain Python."""
    from logweir.plans import queries

    got = sorted(map(tuple, queries.queries()[name](spark, SMALL).collect()), key=repr)
    if name.startswith("outlier"):
        samples = {}
        for r in queries.spend_by_customer(spark, SMALL).collect():
            samples.setdefault(r["g"], []).append((r["v"], r["node"]))
        want = []
        for g, mine in samples.items():
            mine.sort(reverse=True)
            for k in range(min(3, len(mine) - 1), 0, -1):
                rest = np.array([v for v, _ in mine[k:]])
                centre = rest.mean() if name == "outlier_rmsd" else np.median(rest)
                spread = np.sqrt(((rest - centre) ** 2).mean()) if name == "outlier_rmsd" else np.median(abs(rest - centre))
                limit = centre + 3 * spread + outliers.EPSILON
                if mine[k - 1][0] >= limit > mine[k][0]:
                    want += [(g, n, v, i) for i, (v, n) in enumerate(mine[:k])]
                    break
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want, key=repr)] and np.allclose([x[2] for x in got], [x[2] for x in sorted(want, key=repr)])
    elif name == "boycott_window":
        events = sorted((r["ts"].replace(tzinfo=None), r["user_id"]) for r in queries.read(spark, SMALL, "events").filter("event_type = 'error'").collect())
        import datetime

        seconds = lambda t: float((t - datetime.datetime(1970, 1, 1)).total_seconds() // 1)
        until, length, want = {}, {}, []
        for at, node in sorted((seconds(t), n) for t, n in events):
            cluster = node % 6
            active = [n for n, t in until.items() if n % 6 == cluster and t >= at]
            if len(active) >= 2 or node in active:
                continue
            span = 3600.0 if node not in length else min(86400.0, max(3600.0, length[node] * 2 / 2 ** int((at - until[node]) // 43200.0)))
            length[node], until[node] = span, at + 60.0 + span
            want.append((cluster, node, at + 60.0, until[node]))
        assert got == sorted(want, key=repr)
    elif name == "record_sample":
        rows = queries.records(spark, SMALL).withColumn("_h", F.xxhash64(F.lit(0), "log_id", "lsn"))
        every = rows.collect()
        want = []
        for key in {r["filter_key"] for r in every}:
            want += sorted((r for r in every if r["filter_key"] == key), key=lambda r: (r["_h"], r["log_id"], r["lsn"]))[:20]
        assert got == sorted([tuple(r)[:-1] for r in want], key=repr)
    else:
        by_log = {}
        for log_id, node, place in got:
            by_log.setdefault(log_id, []).append((place, node))
        assert all(len(v) == 5 and sorted(p for p, _ in v) == [1, 2, 3, 4, 5] and len({n for _, n in v}) == 5 and all(n % 4 for _, n in v) for v in by_log.values())
