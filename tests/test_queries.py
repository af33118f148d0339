"""The registered queries keep their contract; a sample of them is compared with its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row.n_evaluated > 0 and 0 <= row.ci <= 1


@pytest.mark.parametrize("name", [
    "pairs_load_aliased", "marginal_means", "split_random", "split_cold_b", "env_assign", "metric_concordance", "evaluate_binary",
    "grid_densify_null", "ngram_hash_features", "char_hash_features", "topk_neighbors", "predict_simple", "predict_mf",
    "predict_char_encoder", "predict_dual_view_stored", "score_top", "score_top_mf", "env_risk_variance", "counterfactual_swap", "report_markdown",
    "mixhop_predict", "predict_cross_attention", "irm_cf_score", "report_aggregate", "char_encode", "masked_reconstruction", "unified_score",
])
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    wanted = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = entry.queries()[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key(tuple(r[c] for c in columns) for r in found.collect()) == key(wanted.fetchall())
