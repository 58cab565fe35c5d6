"""Log algebra, telemetry, outliers, integrity and scalars on hand-checked rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweir.functions import dialect, lsn, scalars
from logweir.operators import integrity, log, outliers, ranges, stats
from logweir.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at(e, n):
    return (e << 32) | n


def test_lsn_codec(spark):
    high = at(2**31, 7) - 2**64  # as a signed long
    values = [0, 1, -1, at(5, 42), high, None]
    df = spark.createDataFrame([(v,) for v in values], "l long")
    out = df.select("l", lsn.lsn_to_string(F.col("l")).alias("s")).withColumn("back", lsn.string_to_lsn(F.col("s")))
    want = [("LSN_INVALID", 0), ("e0n1", 1), ("LSN_MAX", -1), ("e5n42", at(5, 42)), (f"e{2**31}n7", high), (None, None)]
    assert [(r["s"], r["back"]) for r in out.collect()] == want
    texts = spark.createDataFrame([("E2N3",), ("17x",), ("lsn_oldest",), ("18446744073709551615",), ("nonsense",), ("e5000000000n1",), (None,)], "t string")
    assert [r[0] for r in texts.select(lsn.string_to_lsn(F.col("t"))).collect()] == [at(2, 3), 17, 1, -1, None, None, None]


def test_scalars(spark):
    df = spark.createDataFrame([("p99.99 (us)",), ("  A--b  ",)], "h string")
    assert [r[0] for r in df.select(scalars.column_name(F.col("h"))).collect()] == ["p99_99_us", "a_b"]
    d = spark.createDataFrame([("1.5s",), ("2min",), ("1day",), ("max",), ("0.1ns",), ("x",)], "d string")
    assert [r[0] for r in d.select(scalars.duration_ns(F.col("d"))).collect()] == [1_500_000_000, 120_000_000_000, 86_400_000_000_000, 2**63 - 1, None, None]
    m = spark.createDataFrame([({246: 4}, {246: 4, 1: 1})], "a map<int,long>, b map<int,long>")
    got = m.select(scalars.offsets_merged(F.col("a"), F.col("b")), scalars.offsets_difference(F.col("b"), F.col("a")), scalars.offsets_greatest(F.col("a"), F.col("b"))).first()
    assert dict(got[0]) == {246: 8, 1: 1} and dict(got[1]) == {246: 0, 1: 1} and dict(got[2]) == {246: 4, 1: 1}

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    texts = ["", "a", "foobar", "é"]
    f = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.fnv1a_64(F.col("t")))
    assert [r[0] for r in f.collect()] == [fnv(t.encode()) for t in texts]


def test_dialect(spark):
    assert dialect.to_spark("SELECT * FROM t LIMIT 5, 10") == "SELECT * FROM t LIMIT 10 OFFSET 5"
    spark.createDataFrame([("Abc", 1), ("xbc", 2), ("it's limit 1, 2", 3)], "s string, n int").createOrReplaceTempView("t_dialect")
    run = lambda q: rows(spark.sql(dialect.to_spark(q)))
    assert run("SELECT n FROM t_dialect WHERE s LIKE 'abc'") == [(1,)]
    assert run("SELECT n FROM t_dialect WHERE s GLOB '[a-z]bc'") == [(2,)]
    assert run("SELECT n FROM t_dialect WHERE s == 'it''s limit 1, 2'") == [(3,)]
    assert run("SELECT total(n) FROM t_dialect WHERE n > 9") == [(0.0,)]
    assert len(run("SELECT group_concat(s) FROM t_dialect")[0][0].split(",")) == 4


def records(spark, numbers, log_id=1):
    return spark.createDataFrame([(log_id, n, f"k{n % 3}", n) for n in numbers], "log_id long, lsn long, filter_key string, payload_size long")


def test_gap_types(spark):
    rec = records(spark, [at(1, 1), at(1, 2), at(1, 5), at(2, 1), at(3, 4)])
    none = spark.createDataFrame([(1, 0)], "log_id long, trim_point long")
    assert rows(log.typed_gaps(rec, none)) == sorted([(1, "BRIDGE", 1, at(1, 1) - 1), (1, "DATALOSS", at(1, 3), at(1, 4)), (1, "BRIDGE", at(1, 6), at(2, 1) - 1), (1, "BRIDGE", at(2, 2), at(3, 4) - 1)], key=repr)
    trimmed = spark.createDataFrame([(1, at(1, 3))], "log_id long, trim_point long")
    got = rows(log.typed_gaps(records(spark, [at(1, 6)]), trimmed))
    assert got == sorted([(1, "TRIM", 1, at(1, 3)), (1, "DATALOSS", at(1, 4), at(1, 5))], key=repr)
    assert rows(log.typed_gaps(rec, none, until=at(1, 3))) == sorted([(1, "BRIDGE", 1, at(1, 1) - 1), (1, "DATALOSS", at(1, 3), at(1, 3))], key=repr)


@pytest.mark.parametrize(
    ("replies", "want"),
    [
        ([(1, 4), (2, 5), (3, 6)], ("OK", 3, 4)),
        ([(1, 3), (1, 3), (1, 3)], ("OK", 1, 3)),
        ([(1, 3), (1, 2)], ("OK", 1, 2)),
        ([(1, 5), (2, 4), (2, 5)], ("OK", 2, 4)),
        ([(1, 5), (2, 4), (3, 2), (2, 5)], ("PARTIAL", 2, 4)),
        ([(3, 2)], ("FAILED", None, None)),
    ],
)
def test_find_replies(spark, replies, want):
    df = spark.createDataFrame([("r", f"N{i}", "OK", lo, hi) for i, (lo, hi) in enumerate(replies)], "req string, shard string, status string, lo long, hi long")
    assert rows(log.merge_find_replies(df)) == [("r", *want)]


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        ([(2, "OK", 0), (1, "OK", 777000), (3, "OK", 10100100100), (7, "OK", 777000), (5, "OK", 10122122122), (2, "OK", 5), (4, "OK", 8055055055)], (12.4e9, 12.6e9)),
        ([(2, "OK", 0), (1, "REBUILDING", 0), (3, "OK", 10100100100), (5, "OK", 10122122122), (4, "OK", 8055055055), (6, "OK", 10122122122), (0, "OK", 1337)], (16.9e9, 17.1e9)),
    ],
)
def test_log_size(spark, sizes, want):
    df = spark.createDataFrame([(s, st, n, k) for k, (s, st, n) in enumerate(sizes)], "shard int, status string, size long, arrival int")
    got = stats.estimated_log_size(df, 8, 3).first()[0]
    assert want[0] <= got <= want[1]


# Samples with a known outlier, as described in FIXTURES.md.
BASE = [52, 49, 54, 47, 52, 55, 48, 50, 52, 50, 51, 48, 53, 54, 130]


@pytest.mark.parametrize("method", ["mad", "rmsd"])
def test_outliers(method):
    names = [f"N{i}" for i in range(15)]
    find = lambda v, d, m, g=0.0, ok=None: outliers.outliers(names, v, method, d, m, g, ok)
    assert find(BASE, 3, 1) == ["N14"]
    two = BASE[:5] + [110] + BASE[6:]
    assert find(two, 3, 2) == find(two, 3, 3) == ["N14", "N5"]
    groups = [52, 49, 113, 315, 52, 110, 48, 50, 120, 50, 51, 48, 53, 54, 330]
    assert find(groups, 3, 2) == (["N14", "N3"] if method == "rmsd" else [])
    assert find([50] * 8 + [51] + [50] * 6, 5, 2, 0.1) == []
    assert find([10 * (i + 1) for i in range(15)], 5, 1) == []
    assert outliers.outliers([], [], method, 3, 1) == [] and outliers.outliers(["a"], [1.0], method, 3, 1) == []


def test_outliers_in_groups_agree_with_the_closed_form(spark):
    df = spark.createDataFrame([(g, i, float(v)) for g in (1, 2) for i, v in enumerate(BASE if g == 1 else BASE[:-1])], "g int, node int, v double")
    assert rows(outliers.outliers_by(df, "g", "node", "v", "rmsd", 3.0, 1)) == [(1, 14, 130.0, 0)]
    assert [r[:3] for r in rows(outliers.largest_beyond(df, "g", "node", "v", 3.0))] == [(1, 14, 130.0)]


def test_histograms(spark):
    df = spark.createDataFrame([(v,) for v in [0, -3, 1, 2, 3, 4, 85, 1 << 58, 1 << 60]], "v long")
    assert sorted(rows(stats.compact_histogram(df, [], F.col("v")))) == [(0, 2), (1, 1), (2, 2), (3, 1), (7, 1), (59, 2)]
    one = stats.compact_histogram(spark.createDataFrame([("m", 85)], "m string, v long"), ["m"], F.col("v"))
    assert 64 <= rows(stats.compact_percentiles(one, ["m"], [0.5]))[0][2] <= 128
    text = stats.histogram_text(stats.compact_histogram(df.withColumn("m", F.lit("x")), ["m"], F.col("v")), ["m"])
    assert text.first()["text"] == "0:2,1:1,2:2,3:1,7:1,59:2"
    assert sorted(r[1:] for r in rows(stats.histogram_from_text(text, ["m"]))) == [(0, 2), (1, 1), (2, 2), (3, 1), (7, 1), (59, 2)]
    sizes = spark.createDataFrame([(v,) for v in [0, 5, 55, 555, 950, 1024, 20 * 1024]], "v long")
    low, high = stats.size_bounds(F.col("v"))
    assert [tuple(r) for r in sizes.select(low, high).collect()] == [(1, 2), (5, 6), (50, 60), (500, 600), (900, 1024), (1024, 2048), (20 * 1024, 30 * 1024)]
    assert rows(stats.histogram_subtracted(one, one, ["m"])) == [("m", 7, 0)]


# Copies of a digest with known winners, as described in FIXTURES.md.
DIGEST = [
    (1, 0, "NORMAL", 1), (1, 2, "NORMAL", 4), (1, 3, "NORMAL", 3), (2, 1, "NORMAL", 1), (3, 1, "HOLE", 45), (3, 3, "HOLE", 50), (4, 0, "NORMAL", 99),
    (4, 1, "HOLE", 27), (4, 2, "MUTATED", 49), (4, 3, "HOLE", 45), (5, 0, "MUTATED", 50), (5, 1, "MUTATED", 50), (5, 2, "MUTATED", 50),
]


def test_digest(spark):
    got = {r["esn"]: r for r in integrity.digest_mutations(spark.createDataFrame(DIGEST, "esn long, node int, type string, epoch long"), 50).collect()}
    want = {1: ("NORMAL", 4, [0, 2, 3], [], [], True), 2: ("NORMAL", 1, [1], [], [], True), 3: ("HOLE", 50, [1], [3], [], True), 4: ("MUTATED", 49, [0, 2], [], [1, 3], True), 5: ("MUTATED", 50, [], [0, 1, 2], [], False)}
    for esn, (winner, epoch, amend, success, conflict, needs) in want.items():
        r = got[esn]
        assert (r["winner"], r["winner_epoch"], r["amend"], r["success"], r["conflict"], r["needs_mutation"]) == (winner, epoch, amend, success, conflict, needs)


def test_ranges(spark):
    points = spark.createDataFrame([(i,) for i in range(0, 100, 7)], "p long")
    spans = spark.createDataFrame([(0, 10, "a"), (5, 60, "b"), (90, 95, "c")], "lo long, hi long, n string")
    got = rows(ranges.range_join(points, spans, "p", "lo", "hi", 10).select("p", "n"))
    assert got == sorted([(p, n) for p in range(0, 100, 7) for lo, hi, n in [(0, 10, "a"), (5, 60, "b"), (90, 95, "c")] if lo <= p <= hi], key=repr)
    merged = integrity.merged_ranges(spark.createDataFrame([(1, 0, 5), (1, 6, 8), (1, 3, 4), (1, 20, 30), (2, 1, 1)], "k int, lo long, hi long"), ["k"])
    assert sorted(rows(merged)) == [(1, 0, 8), (1, 20, 30), (2, 1, 1)]


def test_trims_and_checkpoints(spark):
    rec = records(spark, range(1, 11))
    tails = log.tail_attributes(rec.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")))
    now = spark.createDataFrame([(1, 3)], "log_id long, trim_point long")
    asked = lambda n: rows(log.trim_request(now, spark.createDataFrame([(1, n)], "log_id long, upto long"), tails))
    assert asked(5) == [(1, 5, "OK")] and asked(2) == [(1, 3, "OK")] and asked(11) == [(1, 3, "TOOBIG")]
    c = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "customer string, log_id long, lsn long")
    u = spark.createDataFrame([("a", 1, 9), ("b", 1, None), ("c", 2, 1)], "customer string, log_id long, lsn long")
    assert rows(log.update_checkpoints(c, u)) == [("a", 1, 9), ("c", 2, 1)]
    assert log.filtered_out_gaps(rec, log.passes("range", "z", "a")).count() == 0


def test_answers_and_configuration(spark):
    answers = spark.createDataFrame([(0, '{"rows": [["1", null], ["x", "b"]], "headers": ["Shard", "Log Name"]}'), (1, '{"headers": ["a"], "rows": [["1", "2"]]}'), (2, "nonsense"), (3, '{"headers": ["other"], "rows": [["1"]]}')], "node_id long, answer string")
    good, failed = tables.json_tables(answers)
    assert rows(tables.typed(good, {"shard": "INTEGER", "log_name": "TEXT"})) == sorted([(0, 1, None), (0, None, "b"), (3, None, None)], key=repr)
    assert [r[0] for r in rows(failed)] == [1, 2]
    lines = spark.createDataFrame([(0, "STAT a.b 1 2"), (0, "STAT c 1"), (1, "END")], "node_id long, value string")
    assert rows(tables.stat_lines(lines, 2)) == [(0, "a.b", ["1", "2"])]
    conf = '{"defaults": {"replication_factor": 2,}, "logs": [{"name": "x", "id": "1..9",}, {"name": "y", "id": 10, "replication_factor": 3}]}'
    assert [(r["name"], r["logid_lo"], r["logid_hi"], r["attributes"]["replication_factor"]) for r in tables.log_groups_of_config(spark, conf).orderBy("logid_lo").collect()] == [("x", 1, 9, "2"), ("y", 10, 10, "3")]
    for bad in ('{"logs": [{"name": "x"}]}', '{"logs": [{"id": "1..5"}, {"id": "5..6"}]}', '{"logs": [{"id": 1, "replication_factor": -1}]}'):
        with pytest.raises(ValueError):
            tables.log_groups_of_config(spark, bad)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicas_are_judged_by_aggregates_of_fixed_width(spark):
    """Nothing is listed a record, and the condition on the errors doesn't repeat what they are made from."""
    schema = "log_id long, lsn long, node long, wave long, copyset array<long>, payload_hash long, kind string, domain long"
    copies = [
        (1, 1, 1, 1, [1, 2, 3], 0, "RECORD", 1), (1, 1, 2, 1, [3, 2, 1], 0, "RECORD", 2), (1, 1, 3, 1, [2, 1, 3], 0, "RECORD", 3),
        (1, 2, 1, 1, [1, 2, 3], 0, "RECORD", 1), (1, 2, 2, 1, [1, 2, 3], 5, "RECORD", 1), (1, 2, 4, 2, [1, 4, 5], 0, "RECORD", 1), (1, 2, 4, 2, [1, 4, 6], 0, "HOLE", 1),
        (2, 1, 1, 1, [1, 1], 0, "RECORD", 1), (2, 1, 1, 0, [1, 1], 7, "RECORD", 2), (2, 1, 9, 2, [1, 2, 9], 0, "RECORD", 2),
        (2, 2, 1, 3, [1, 2, 3], 0, "RECORD", 1), (2, 2, 2, 3, [1, 2, 3], 0, "RECORD", 2), (2, 2, 3, 3, [1, 2, 3], 0, "RECORD", 2),
    ]
    nodesets = spark.createDataFrame([(2, [1, 2, 3])], "log_id long, nodeset array<long>")
    found = integrity.replica_errors(spark.createDataFrame(copies, schema), 3, nodesets=nodesets)
    assert rows(found) == [(1, 2, 4, 2 + 32 + 128 + 256 + 512), (2, 1, 3, 8 + 16 + 2048 + 64 + 32 + 128)]
    three = integrity.replica_errors(spark.createDataFrame(copies, schema), 3, domains=3, nodesets=nodesets)
    assert rows(three) == [(1, 2, 4, 2 + 32 + 128 + 256 + 512), (2, 1, 3, 8 + 16 + 2048 + 64 + 32 + 128 + 256), (2, 2, 3, 128 + 256)]
    plan = plan_of(found)
    assert "collect_list" not in plan and "exists(" not in plan and max(map(len, plan.splitlines())) < 5000


def test_error_counts_in_one_pass(spark):
    """Findings are read once; the first records of a kind are kept when many tasks have some."""
    found = spark.range(1000, numPartitions=7).select((F.col("id") * 37 % 10).alias("log_id"), (F.lit(1000) - F.col("id")).alias("lsn"), F.when(F.col("id") % 2 == 0, 5).otherwise(64).cast("long").alias("errors"))
    found = found.unionByName(spark.createDataFrame([(3, 5000, 2048), (3, 5001, 0)], "log_id long, lsn long, errors long"))
    counts = integrity.error_counts(found)
    every = [(i * 37 % 10, 1000 - i, i % 2) for i in range(1000)]
    even, odd = (sorted(r[:2] for r in every if r[2] == k)[:3] for k in (0, 1))
    assert [(r["error"], r["n"], [tuple(x) for x in r["examples"]]) for r in counts.orderBy("error").select("error", "n", "examples").collect()] == [
        ("COPYSET_WITHOUT_SELF", 500, even), ("DATALOSS", 500, even), ("DATA_MISMATCH", 500, odd), ("DUPLICATES_IN_COPYSET", 1, [(3, 5000)]),
    ]
    assert plan_of(counts).count("Range (") == 1
    assert integrity.error_counts(found.filter("errors < 0")).count() == 0
