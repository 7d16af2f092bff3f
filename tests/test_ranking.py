"""Ranking measures, and the paths for groups too large for one task."""

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from standout.functions.ordering import ordinal, running
from standout.operators import models, ranking, scoring, splits, stats


def pairs(spark, rows, last):
    return spark.createDataFrame(rows, f"doc_id long, entity_id long, {last} double")


def test_salience_ndcg_uses_the_models_scores(spark):
    golden = pairs(spark, [(1, 3, 3.0), (1, 2, 3.0)], "grade")
    assert ranking.salience_ndcg(pairs(spark, [(1, 3, 3.0), (1, 2, 3.0)], "score"), golden).first()["ndcg"] == 1.0
    low = ranking.salience_ndcg(pairs(spark, [(1, 3, 2.0), (1, 2, 2.0)], "score"), golden).first()["ndcg"]
    assert low == pytest.approx(3 / 7)


def test_missing_scores_rank_last(spark):
    ranked = ranking.rank_entities(pairs(spark, [(1, 1, None), (1, 2, 0.5)], "score"))
    assert {r["entity_id"]: r["rank"] for r in ranked.collect()} == {2: 1, 1: 2}


def test_perfect_run_beats_all(spark):
    rows = [(d, e, float((d * 7 + e * 5) % 4)) for d in range(1, 20) for e in range(6)]
    golden = pairs(spark, rows, "grade")
    perfect = golden.withColumnRenamed("grade", "score")
    out = ranking.document_measures(perfect, golden).where("num_rel > 0")
    for measure in ("map", "Rprec", "bpref", "recip_rank", "ndcg", "iprec_at_recall_1_00"):
        assert out.agg(F.min(measure)).first()[0] == pytest.approx(1.0)
    report = {r["measure"]: r["value"] for r in ranking.evaluation_report(perfect, golden).where("qid = 'all'").collect()}
    assert report["num_q"] == 19 and report["num_ret"] == 114
    weak = ranking.document_measures(scoring.baseline_random(golden), golden)
    assert weak.agg(F.avg("map")).first()[0] < ranking.document_measures(perfect, golden).agg(F.avg("map")).first()[0]


def test_ranks_and_sums_of_uneven_groups(spark):
    rows = [(None if i % 5 == 0 else 1 if i % 3 else i, i, float(i % 7)) for i in range(3000)]
    df = pairs(spark, rows, "score")
    got = ordinal(df, ["doc_id"], F.col("score"), F.col("entity_id"), "rank")
    plain = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "entity_id")
    want = df.withColumn("rank", F.row_number().over(plain).cast("long"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    named = got.where("doc_id IS NOT NULL")
    sums = {"total": F.col("score")}
    a = running(named, ["doc_id"], "rank", sums)
    b = running(named, ["doc_id"], "rank", sums, chunk=64)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_report_of_one_large_document(spark):
    rows = [(1, i, float(i % 11) / 4) for i in range(500)]
    golden = [(1, i, float(i % 4)) for i in range(0, 500, 2)]
    report = ranking.evaluation_report(pairs(spark, rows, "score"), pairs(spark, golden, "grade"))
    got = {r["measure"]: r["value"] for r in report.where("qid = '1'").collect()}
    grade = dict((e, g) for _, e, g in golden)
    hits = [grade.get(e, 0.0) >= 2 for _, e, s in sorted(rows, key=lambda r: (-r[2], r[1]))]
    relevant = sum(hits)
    assert got["num_rel_ret"] == relevant and got["P_10"] == sum(hits[:10]) / 10 and got["Rprec"] == sum(hits[:relevant]) / relevant
    assert got["map"] == pytest.approx(sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h) / relevant)


def test_folds_are_even_and_contiguous(spark):
    df = pairs(spark, [(d, e, 0.0) for d in range(10) for e in range(3)], "score")
    folds = splits.kfold(df, 4).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [8, 8, 7, 7]


def test_permuted_column_is_one_order_of_the_whole(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("entity_id"), (F.col("id") * 3).cast("double").alias("f"), F.lit(1.0).alias("g"))
    rows = models.permuted(df, "f", seed=3).collect()
    assert sorted(r["f"] for r in rows) == [3.0 * i for i in range(2000)] and len({r["entity_id"] for r in rows}) == 2000
    moved = [abs(r["f"] / 3 - r["entity_id"]) for r in rows]
    assert 500 < sum(moved) / 2000 < 850 and max(moved) > 1700  # a third of the length on average, reaching over all of it
    assert sorted(map(tuple, models.permuted(df, "f", seed=3).collect())) == sorted(map(tuple, rows))


def test_information_gain(spark):
    rows = [(0, 1.0)] * 4 + [(0, 0.0)] * 10 + [(1, 1.0)] * 12 + [(1, 0.0)] * 4
    df = spark.createDataFrame(rows, "y int, f double")
    assert stats.information_gain(df, ["f"], "y").first()["gain"] == pytest.approx(0.1118187575)


def test_p_values(spark):
    rows = spark.createDataFrame([("a", "b", 11, 2.228139), ("a", "c", 31, 2.042272), ("b", "c", 11, 0.0)], "a string, b string, n long, t double")
    p = [r["p"] for r in stats.with_p_values(rows).collect()]
    assert p == pytest.approx([0.05, 0.05, 1.0], abs=1e-6)


def test_candidates_of_a_document_without_survivors(spark):
    df = pairs(spark, [(1, 1, 0.9), (1, 2, 0.1), (2, 5, 0.1), (2, 4, 0.2), (2, 6, 0.3)], "score")
    got = sorted((r["doc_id"], r["entity_id"]) for r in scoring.select_candidates(df, 0.5, 2).collect())
    assert got == [(1, 1), (2, 4), (2, 5)]
