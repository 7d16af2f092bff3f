"""Plans that keep the large side of a join where it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from standout.operators import graph, sentiment, spotting
from standout.plans import text_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def test_ngrams_are_not_shuffled_for_a_dictionary_of_entities(spark, tmp_path):
    text = "Title here. " + "harbour lantern window " * 20
    spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = text_queries.inputs.docs(spark, str(tmp_path))
    hits = spotting.spot_dictionary(found, text_queries._anchor_words(spark, str(tmp_path)))
    assert "SortMergeJoin" not in plan(hits) and "BroadcastHashJoin" in plan(hits)
    assert hits.where("surface = 'lantern window'").count() == 40 * 20


def test_expanded_graph_stays_with_its_documents(spark):
    nodes = spark.range(60).select((F.col("id") % 7).alias("doc_id"), (F.col("id") % 11).alias("entity_id")).repartition(4, "doc_id")
    links = spark.range(200).select((F.col("id") % 13).alias("src"), (F.col("id") % 10).alias("dst"))
    edges = graph.expand_graph_v1(nodes, links)
    assert "SortMergeJoin" not in plan(edges) and "SortMergeJoin" not in plan(graph.induced_graph_v0(nodes, links))
    chosen, pairs = set(rows(nodes)), set(rows(links))
    want: dict[tuple, int] = {}
    for doc, entity in chosen:
        for src, dst in pairs:
            for end in (src, dst):
                if end == entity:
                    want[doc, dst, src] = want.get((doc, dst, src), 0) + 1
    assert rows(edges.select("doc_id", "src", "dst", "w")) == sorted((*k, n) for k, n in want.items())


def test_many_links_are_joined_in_slices(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "doc_id long, entity_id long")
    links = spark.createDataFrame([(5, 6), (6, 5), (5, 5), (7, 6)], "src long, dst long")
    whole = rows(graph.expand_graph_v1(nodes, links))
    both = rows(graph.induced_graph_v0(nodes, links))
    assert [r[2:4] for r in both] == [(5, 5), (5, 5), (5, 6), (6, 5)]
    monkeypatch.setattr(graph, "MOST_SENT", 2)
    assert rows(graph.expand_graph_v1(nodes, links)) == whole
    assert rows(graph.induced_graph_v0(nodes, links)) == both


def test_tokens_are_neither_sorted_nor_shuffled(spark):
    docs = spark.createDataFrame([(i, "Title", "harbour lanterns running " * 9) for i in range(20)], "doc_id long, title string, body string")
    docs = docs.repartition(4, "doc_id")
    mentions = spark.createDataFrame([(i, "body", 1, 8, 16) for i in range(20)], "doc_id long, field string, entity_id long, start int, end int")
    lexicon = spark.createDataFrame([("harbour", 3), ("title", -2)], "term string, score long")
    sums = sentiment.window_sums(docs, mentions.repartition(4, "doc_id"), lexicon, [1, 2])
    assert "Window" not in plan(sums) and plan(sums).count("hashpartitioning") <= 6
    assert {tuple(r)[2:] for r in sums.collect()} == {("body", 8, 1, 3, 3, 1, 0), ("body", 8, 2, 4, 6, 2, 0)}
    stems = sentiment.stem_tokens(docs.select("doc_id", "body").withColumnRenamed("body", "text"), ["doc_id"])
    assert "SortMergeJoin" not in plan(stems) and plan(stems).count("hashpartitioning") <= 2
