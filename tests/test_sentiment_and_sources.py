"""Sentiment values worked out by hand, and the file formats."""

import json

import pytest
from pyspark.sql import functions as F

from standout.operators import kb, matrix, models, sentiment
from standout.sources import documents, tables


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "text_id long, text string")


def lexicon(spark):
    return spark.createDataFrame([("abhor", -3, 1), ("abandoned", -2, 2), ("happy", 3, 3)], "term string, score long, line_no long")


@pytest.mark.parametrize("stem", [False, True])
def test_propagation(spark, stem):
    words = sentiment.prepare_lexicon(lexicon(spark), stem=stem)
    corpus = texts(spark, "abhor abandoned archaeological", " happy apple archaeological ")
    weights = sentiment.propagate_term_weights(corpus, words, ["text_id"], stem=stem)
    totals = sorted(r["total"] for r in weights.collect())
    assert totals == [-5, -5, -2, 3, 3]
    assert sentiment.propagation_ratio(weights, words).first()["ratio"] == pytest.approx(3.5)
    out = sentiment.propagated_sentiment(texts(spark, "happy", "archaeological", "a"), weights, words, ["text_id"], stem=stem)
    got = {r["text_id"]: r["sentiment"] for r in out.collect()}
    assert got[0] == pytest.approx(0.857142857) and got[1] < 0 and got[2] is None


def test_last_line_of_equal_terms_wins(spark):
    rows = spark.createDataFrame([("Abhor!", 1, 1), ("abhor", -4, 2), ("no fun", 2, 3)], "term string, score long, line_no long")
    got = {r["term"]: r["score"] for r in sentiment.prepare_lexicon(rows, stem=False).collect()}
    assert got == {"abhor": -4, "fun": 2}


def test_text_without_words_scores_zero(spark):
    row = sentiment.lexicon_sentiment(texts(spark, "a b"), lexicon(spark), ["text_id"]).first()
    assert (row["sentiment"], row["pos"], row["neg"]) == (0.0, 0.0, 0.0)


def test_absent_field_is_neutral(spark):
    docs = spark.createDataFrame([(1, "happy days", "none here")], "doc_id long, title string, body string")
    mentions = spark.createDataFrame([(1, "title", 9, 0, 5, "happy")], "doc_id long, field string, entity_id long, start long, end long, surface string")
    row = sentiment.sentiment_features(docs, mentions, lexicon(spark)).first()
    assert (row["body_sentiment"], row["body_pos"], row["body_neg"]) == (0.5, 0.0, 0.0)
    assert (row["title_sentiment"], row["title_pos"]) == (pytest.approx(0.65), 0.5)


def test_corpus_files(spark, tmp_path):
    doc = {"docId": "d1", "title": "T", "document": [{"name": "body_par_000", "value": "one"}, {"name": "headline", "value": "x"}, {"name": "body_par_001", "value": "two"}],
           "saliency": [{"entityid": 5, "score": 2.0}, {"entityid": 6}]}
    (tmp_path / "docs.json").write_text(json.dumps(doc) + "\n")
    docs = documents.read_corpus(spark, str(tmp_path / "docs.json"))
    assert documents.assemble_body(docs).first()["body"] == "onetwo"
    assert documents.assemble_body(docs, " ").first()["body"] == "one two"


def test_feature_row_files(spark, tmp_path):
    names = ["a", "b"]
    rows = spark.createDataFrame([(1, 2, 3.0, 0.5, 1.0, None), (1, 3, 0.0, 0.1, 2.0, 4.0)], "doc_id long, entity_id long, golden double, estimate double, a double, b double")
    for part in ("p1", "p2"):
        tables.write_feature_rows(rows, str(tmp_path / part), names)
    (tmp_path / "p2" / "part-header.txt").write_text("docid,entity,golden,estimate\n1,9,0,0,[nan, None]\n")
    got = sorted(map(tuple, tables.parse_feature_rows(documents.collect_partials(spark, str(tmp_path / "p*")), names).collect()))
    assert got == [(1, 2, 3.0, 0.5, 1.0, 0.0)] * 2 + [(1, 3, 0.0, 0.1, 2.0, 4.0)] * 2 + [(1, 9, 0.0, 0.0, 0.0, 0.0)]


def test_ranking_files(spark, tmp_path):
    golden = spark.createDataFrame([(1, 2, 1.5), (1, 3, 3.0)], "doc_id long, entity_id long, grade double")
    tables.write_qrels(golden, str(tmp_path / "qrels"))
    assert sorted(map(tuple, tables.parse_qrels(spark.read.text(str(tmp_path / "qrels"))).collect())) == [(1, 2, 0.0), (1, 3, 3.0)]
    tables.write_run(golden.select("doc_id", "entity_id", F.col("grade").alias("score")), str(tmp_path / "run"))
    assert tables.parse_run(spark.read.text(str(tmp_path / "run"))).count() == 2


def test_lexicon_dump_and_topics(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("abhor\t-3\nno fun\t-3\nbroken\n")
    got = sorted(map(tuple, tables.read_lexicon(spark, str(tmp_path / "lex.tsv")).collect()))
    assert got == [("abhor", -3, 0), ("no fun", -3, 1)]
    pages = [{"wid": 1, "wikiTitle": "Paris", "links": [{"id": "London", "anchor": "the city", "type": "A"}]}, {"wid": 2, "wikiTitle": "paris", "links": []}, {"wid": 3, "wikiTitle": "London"}]
    (tmp_path / "dump.json").write_text("\n".join(map(json.dumps, pages)) + "\n{broken\n")
    dump = kb.read_dump(spark, str(tmp_path / "dump.json"))
    titles = kb.build_title_dictionary(dump)
    ids = kb.build_canonical_ids(dump, titles)
    assert {r[0]: r[1] for r in titles.collect()} == {"paris": 1, "london": 3}
    assert {r[0]: r[1] for r in ids.collect()} == {1: 1, 2: 1, 3: 3}
    assert [tuple(r) for r in kb.build_link_graph(dump, titles, ids).collect()] == [(1, 3, 1)]
    xml = "<top>\n<docid>a1</docid>\n<entities><entity><id> 1 </id><mention>P</mention><link>enwiki:PARIS</link></entity><entity><id>2</id><mention>Q</mention><link>enwiki:No One</link></entity></entities>\n</top>\n"
    (tmp_path / "topics.xml").write_text(f"<all>{xml}</all>")
    rows = documents.read_topics_xml(spark, str(tmp_path / "topics.xml"), titles, ids).collect()
    assert sorted((r["mention"], r["title_key"], r["entityid"]) for r in rows) == [("P", "paris", 1), ("Q", "no_one", None)]


def test_news(spark):
    news = {"id": "n1", "title": "T", "contents": [{"subtype": "paragraph", "content": "a b"}, {"subtype": "image", "content": "x"}, {"subtype": "paragraph", "content": "c"}]}
    lines = spark.createDataFrame([("part-1:" + json.dumps(news, ensure_ascii=False),)], "value string")
    doc = documents.assemble_body(documents.news_to_documents(lines)).first()
    assert (doc["docId"], doc["body"], doc["saliency"]) == ("n1", "a b c ", [])


def test_feature_index_and_absent_features(spark):
    names = spark.createDataFrame([("degree",), ("in degree",), ("none",)], "name string")
    got = {r["name"]: r["position"] for r in matrix.feature_index(names, matrix.LIGHT).collect()}
    assert got == {"degree": 21, "in degree": 19, "none": -1}
    assert [len(matrix.FEATURE_SETS[k]) for k in ("light", "heavy", "light_heavy", "joined", "all")] == [23, 36, 59, 65, 68]
    with pytest.raises(ValueError):
        matrix.select_features(names, ["absent"])


def test_models_train_save_and_load(spark, tmp_path):
    rows = [(d, e, float((d * 3 + e) % 5), float(e % 3), float((d * 3 + e) % 5) / 2) for d in range(40) for e in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, entity_id long, a double, b double, grade double")
    model = models.train_forest(df, ["a", "b"], numTrees=5, maxDepth=4)
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    one, two = (sorted(map(tuple, models.score(m, df, ["a", "b"], golden=df.where("doc_id < 10")).collect())) for m in (model, again))
    assert one == two and len(one) == 50
    importance = models.feature_importance(model, ["a", "b"]).collect()
    assert (importance[0]["name"], importance[0]["rank"]) == ("a", 1)
    worse = {r["name"]: r["increase"] for r in models.permutation_importance(model, df, ["a", "b"]).collect()}
    assert worse["a"] > worse["b"]


def test_broken_lines_are_dropped_and_counted(spark):
    lines = spark.createDataFrame([('{"docId": "1", "title": "a"}',), ("{broken",), ("",), (None,)], "value string")
    parsed = documents.parse_corpus(lines)
    assert [r["docId"] for r in parsed.collect()] == ["1"]
    assert tuple(documents.broken_lines(lines, parsed).first()) == (4, 1, 3)
    run = spark.createDataFrame([("1 0 2 0 0.5 STANDARD",), ("1 0 x 0 0.5 STANDARD",), ("short",), (None,)], "value string")
    assert [tuple(r) for r in tables.parse_run(run).collect()] == [(1, 2, 0.5)]
    qrels = spark.createDataFrame([("1 0 2 3.0",), ("1 0 2",), ("a b c d",)], "value string")
    assert [tuple(r) for r in tables.parse_qrels(qrels).collect()] == [(1, 2, 3.0)]


def test_a_text_that_is_null_keeps_a_row(spark):
    texts = spark.createDataFrame([(1, None), (2, "good good day")], "doc_id long, text string")
    rows = {(r["doc_id"], r["stem"]): r["n"] for r in sentiment.text_tokens(texts, ["doc_id"]).collect()}
    assert rows == {(1, None): 1, (2, "good"): 2, (2, "day"): 1}
