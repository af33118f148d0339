"""Registered queries on the given tables: SQL where there is one, plain versions, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from plain import shingles

import __spark_entry__ as entry
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return connection


def test_names():
    assert "pipeline" in entry.queries() and {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", ["op1_revisits", "op3_ngram_join", "op4_line_dedup", "op5_decontamination", "op6_substring_dedup", "op9_secrets", "op11_divergence", "op12_search"])
def test_query_equals_its_sql(spark, tables, name):
    wanted = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = entry.queries()[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(str, wanted.fetchall()))


def test_quality_on_held_out_documents(spark, tables):
    found = {r.doc_id: r for r in entry.queries()["op2_quality"](spark, FOLDER).collect()}
    rows = tables.execute("select doc_id, quality from labels").fetchall()
    held = [(found[i].predicted, q) for i, q in rows if found[i].held_out]
    assert len(held) > 5 and sum(p == q for p, q in held) / len(held) > 0.9


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after and set(after) <= set(before), name
        if name == "near_duplicates":
            sets = {i: shingles(t) for i, t in before.items()}
            for i in set(before) - set(after):  # what goes has a link to something
                assert any(100 * len(sets[i] & s) >= 75 * len(sets[i] | s) for j, s in sets.items() if j != i)
            kept = [sets[i] for i in after if sets[i]]
            assert not any(100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(kept) for b in kept[:k])
    last = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    assert last == {r.doc_id for r in docs.collect()}
