"""Many needles and many hits in one text: the search against plain scans, and work that grows with the text only."""

import random
import time

import pytest

from standout.functions.needles import Needles
from standout.operators import light, ranking, sentiment, spotting

TEXTS = ["", "aa", "abcdab", "aaaaaaa aaaa", "naïve 😀😀😀😀 naïve", "one two one two one", "ends with one tw"]


@pytest.mark.parametrize("text", TEXTS)
def test_places_and_counts_against_scans(text):
    draw = random.Random(len(text))
    wanted = {"", "a", "aa", "aaaa", "aaaaa", "one two", "one two one", "one", "one tw", "😀😀😀😀", "zzzz"}
    wanted |= {text[i : i + draw.randint(1, 8)] for i in range(len(text))}
    got = Needles(wanted).places(text, wanted)
    assert got == {w: [i for i in range(len(text)) if w and text.startswith(w, i)] for w in wanted}
    assert Needles(wanted).counts(text, wanted) == {w: text.count(w) for w in wanted}


def test_a_long_text_with_many_mentions(spark):
    """Cutting each surface out from the start of the text took time with the square of its length."""
    body = "Israel says. " * 60_000
    docs = spark.createDataFrame([(1, "", body)], "doc_id long, title string, body string")
    wanted = spark.createDataFrame([(1, 7, "israel")], "doc_id long, entity_id long, title string")
    start = time.time()
    mentions = spotting.spot_titles(docs, wanted)
    row = light.text_features(light.mention_facts(docs, mentions)).first()
    assert time.time() - start < 40
    assert (row["surface_frequency"], row["sentence_position"], row["document_length"]) == (60_000, pytest.approx(59_999 / 60_000 / 12), len(body))


def test_weights_of_words_without_a_row_for_each_text_and_word(spark):
    texts = spark.createDataFrame([(1, "good good bad thing"), (1, "good"), (2, "thing of"), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("good", 3), ("bad", -2)], "term string, score long")
    rows = sentiment.propagate_term_weights(texts, lexicon, ["id"])
    assert {tuple(r) for r in rows.collect()} == {("good", 3, 21), ("bad", 1, 7), ("thing", 2, 7)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" in plan and "token#" not in "".join(line.split("],")[0] for line in plan.splitlines() if "Aggregate [" in line)
    assert sentiment.corpus_extremes(texts, lexicon, "id").first()[0] == 7


def test_report_has_no_row_of_a_measure_in_a_shuffle(spark):
    run = spark.createDataFrame([(d, e, 1.0 / e) for d in range(5) for e in range(1, 4)], "doc_id long, entity_id long, score double")
    golden = run.selectExpr("doc_id", "entity_id", "CAST(entity_id AS DOUBLE) AS grade")
    report = ranking.evaluation_report(run, golden)
    assert "grouping_id" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.where("qid = 'all' AND measure = 'num_q'").first()["value"] == 5.0
    assert ranking.evaluation_report(run.limit(0), golden).count() == 0
