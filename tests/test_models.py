"""Models on made data."""

import math

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from standout.operators import models, sentiment
from standout.operators.matrix import SENTIMENT
from standout.plans import inputs, model_queries
from standout.plans.catalog import QUERIES


def _hits(model, rows):
    return model.transform(rows).agg(F.avg((F.col("estimate") == F.col("y")).cast("double"))).first()[0]


def test_fourier_features_separate_rings(spark, tmp_path):
    points = []
    for i in range(600):
        radius = 1.0 if i % 2 else 3.0
        points.append((radius * math.cos(i), radius * math.sin(i), 5.0, i % 2))
    rows = spark.createDataFrame(points, "a double, b double, same double, y int")
    names = ["a", "b", "same"]
    waves = models.train_candidate_classifier(rows, names, components=48, negative_weight=1.0, maxIter=30)
    line = models.train_candidate_classifier(rows, names, negative_weight=1.0, maxIter=30)
    assert _hits(waves, rows) > 0.97 > 0.7 > _hits(line, rows)
    waves.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert _hits(again, rows) == _hits(waves, rows)


def test_waves_are_one_vector_and_a_null_gives_no_number(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i * i % 11), 2.0, i % 2) for i in range(40)], "a double, b double, same double, y int")
    model = models.train_candidate_classifier(rows, ["a", "b", "same"], components=4, negative_weight=1.0, maxIter=1)
    stage = model.stages[0]
    out = model.transform(rows)
    assert set(out.columns) - set(rows.columns) == {"features", "rawPrediction", "estimate"}  # no column for each wave
    table = rows.collect()
    means = [sum(r[n] for r in table) / 40 for n in "ab"]
    stds = [math.sqrt(sum((r[n] - m) ** 2 for r in table) / 40) for n, m in zip("ab", means)]
    values = stage.getOrDefault("rows")
    for r in out.collect():
        turns = [values[k] + sum(values[4 * (i + 1) + k] * (r[n] - means[i]) / stds[i] for i, n in enumerate("ab")) for k in range(4)]
        assert max(abs(math.sqrt(0.5) * math.cos(t) - v) for t, v in zip(turns, r["features"])) < 1e-9
    empty = spark.createDataFrame([(None, 1.0, 2.0)], "a double, b double, same double")
    assert all(math.isnan(v) for v in stage.transform(empty).first()["features"])


def test_window_sweep_has_all_sizes_and_a_fit_for_each_half(spark, monkeypatch):
    rows = [(d, e, float(d * e % 4)) for d in range(1, 13) for e in range(4)]
    golden = spark.createDataFrame(rows, "doc_id long, entity_id long, grade double")
    made, trained = [], []

    def features(docs, mentions, lexicon, halves):
        made.append(list(halves))
        cells = [(F.col("entity_id") * F.col("length") % (k + 2)).cast("double").alias(n) for k, n in enumerate(SENTIMENT)]
        return golden.select("doc_id", "entity_id").crossJoin(spark.createDataFrame([(h,) for h in halves], "length int")).select("*", *cells)

    def fit(df, names, **settings):
        trained.append(settings)
        return models._fit(models.RandomForestRegressor(labelCol="grade", predictionCol="estimate", numTrees=1, maxDepth=1), df, names)

    monkeypatch.setattr(sentiment, "sentiment_features_by_length", features)
    given = {}

    def sweep(docs, mentions, lexicon, golden_rows, *, was=models.window_size_sweep, **settings):
        given.update(settings)
        return was(docs, mentions, lexicon, golden_rows, fit=fit, **settings)

    monkeypatch.setattr(model_queries.models, "window_size_sweep", sweep)
    for name in ("docs", "mentions", "lexicon"):
        monkeypatch.setattr(inputs, name, lambda *x: golden)
    monkeypatch.setattr(inputs, "golden", lambda *x: golden)
    out = QUERIES["window_size_sweep"](spark, "").orderBy("size").collect()
    assert given == {} and trained == [{}] * 49 and made == [list(range(1, 50))]
    assert [r["size"] for r in out] == list(range(2, 100))
    assert tuple(out[0])[1:] == tuple(out[1])[1:] and all(r["p3"] is not None and 0 <= r["trec_ndcg"] <= 1 for r in out)


def test_a_forest_of_a_table_of_one_part_is_grown_by_all_tasks(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "id % 3 AS entity_id", "id % 17 / 1.0 AS a", "id % 5 * 1.0 AS b", "id % 17 * 0.5 AS grade").coalesce(1)
    assert models._dealt(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert models._dealt(rows.repartition(9)).rdd.getNumPartitions() == 9
    model = models.train_forest(rows, ["a", "b"], numTrees=2)
    assert model.transform(rows).agg(F.avg(F.pow(F.col("estimate") - F.col("grade"), 2))).first()[0] < 0.5
    assert model.stages[-1].getOrDefault("cacheNodeIds")
    assert not models.train_forest(rows, ["a", "b"], numTrees=2, maxDepth=4).stages[-1].getOrDefault("cacheNodeIds")
