"""Registered queries against their SQL on the smallest tables; ``oracle_check.py`` runs all of them."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "assemble_body", "read_feature_rows", "news_to_documents", "read_topics", "build_link_graph", "entity_degrees",
    "spot_titles", "golden_table", "light_features", "tf_features", "sentiment_features", "propagated_sentiment",
    "salience_ndcg", "evaluation_report", "join_features", "kfold", "select_candidates", "information_gain",
    "chi2_select", "paired_t_matrix", "most_similar", "induced_graph_v0", "shortest_paths",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    out = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert out.startswith("ok"), out


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
