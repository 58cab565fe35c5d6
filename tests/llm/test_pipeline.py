"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from logweir.llm import queries
from tests.llm.fixtures import awkward_documents, edited, prose


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Tables with good and bad texts, near-copies, personal data, and the awkward rows."""
    at = tmp_path_factory.mktemp("tables")
    good = [(i, prose(i, 80) + (f" mail a.{i}@example.com now" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(100, 220)]
    bad = [(i, " ".join(f"{w.upper()}!!" for w in prose(i, 60).split()), "en", "s1", 0) for i in range(300, 380)]
    near = [(i, edited(good[i - 400][1], 41, "near"), "en", "s2", 0) for i in range(400, 410)]
    docs = good + bad + near + [r[:5] for r in awkward_documents()]
    columns = list(zip(*docs, strict=True))
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text", "lang", "source", "n_chars"]), at / "documents.parquet")
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad]
    pq.write_table(pa.table([pa.array(c) for c in zip(*labels, strict=True)], ["doc_id", "quality", "toxic"]), at / "labels.parquet")
    return str(at), {"good": good, "bad": bad, "near": near}


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/out-{len(kept)}")
        docs_after = spark.read.parquet(f"{path}/out-{len(kept)}")
        kept[name] = docs_after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs_after.columns == docs.columns
        docs = docs_after
    ids = {n: Counter(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in kept.items()}
    first, second, third, fourth, last = ids.values()
    assert not any(i in first for i, *_ in rows["bad"]) and all(first[i] == 1 for i, *_ in rows["good"])
    assert not any(i in second for i, *_ in rows["near"]) and all(second[i] == 1 for i, *_ in rows["good"])
    assert third == second
    texts = {r["doc_id"]: r["text"] for r in kept["PII pseudonyms"].collect()}
    assert not any(f"a.{i}@example.com" in texts[i] for i, *_ in rows["good"]) and all("@" in texts[i] for i, *_ in rows["good"] if i % 5 == 0)
    assert set(fourth) <= set(third) and max(v for i, v in fourth.items() if i is not None) <= 3
    assert {i for i in last} == {i for i in fourth}
    fill = defaultdict(int)
    for r in kept["best-fit packing"].collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_run(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 50 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_queries_have_the_agreed_columns(spark, folder):
    path, _ = folder
    want = {
        "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op3_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op5_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op6_jaccard_join": ["doc_id", "n_shingles", "component_id"],
        "op7_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op9_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    }
    registered = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in registered) == list(range(1, 11))
    for name, columns in want.items():
        assert registered[name](spark, path).columns == columns
    assert set(queries.oracle_sql()) <= set(registered)


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op7_source_mixing"])
def test_sql_gives_the_same(spark, folder, name):
    import duckdb

    path, _ = folder
    rows = [r for r in pq.read_table(f"{path}/documents.parquet").to_pylist() if r["doc_id"] is not None]
    unique = list({r["doc_id"]: r for r in rows}.values())
    import os

    os.makedirs(f"{path}/{name}", exist_ok=True)
    pq.write_table(pa.Table.from_pylist(unique, pq.read_schema(f"{path}/documents.parquet")), f"{path}/{name}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/{name}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, f"{path}/{name}").select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_run_on_empty_tables(spark, folder, tmp_path):
    from logweir.llm import storage

    path, _ = folder
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{path}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    before = storage.written()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert len(storage.written()) == len(before) + 1


def test_stages_by_hand_are_the_run(spark, folder):
    """The rows of ``run`` are those of the stages applied one after the other."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = Counter(map(tuple, docs.select(columns).collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).select(columns).collect())) == want
