"""Models over the order lines (features f1..f4, graded by quantity and price) and the judged documents."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from standout.operators import models, splits
from standout.plans import inputs
from standout.plans.catalog import query
from standout.plans.inputs import with_inputs
from standout.session import cut_lineage

NAMES = ["f1", "f2", "f3", "f4"]
SMALL = {"maxDepth": 4, "numTrees": 5}


def _graded(spark, sf):
    """A grade that depends on the features: dear lines with a discount are salient."""
    rows = inputs.matrix(spark, sf)
    grade = F.least(F.lit(3.0), F.col("f2") / 30 + F.col("f3") * 5)
    return splits.split_by_group(rows.withColumn("grade", grade), "doc_id", 0.7, seed=2)


def _sides(spark, sf):
    rows = cut_lineage(_graded(spark, sf))
    return rows.where("side = 'train'").drop("side"), rows.where("side = 'test'").drop("side")


def _scored(name, fit):
    @query(name)
    def _(spark, sf):
        train, test = _sides(spark, sf)
        return models.score(fit(train), test, NAMES)


_scored("train_gbrt", lambda train: models.train_gbrt(train, NAMES, maxIter=5, maxDepth=4))
_scored("train_forest", lambda train: models.train_forest(train, NAMES))
_scored("train_extra_trees", lambda train: models.train_extra_trees(train, NAMES))
_scored("train_candidate_classifier", lambda train: models.train_candidate_classifier(train, NAMES, maxIter=10))


@query("kernel_classifier_facts", with_inputs("matrix", "SELECT count(*) AS rows, true AS inside_found, true AS beats_line FROM matrix"))
def _(spark, sf):
    """Lines inside an ellipse of quantity and discount, which no straight line separates."""
    inside = F.pow((F.col("f1") - 25.5) / 25, 2) + F.pow((F.col("f3") - 0.05) / 0.05, 2) < 0.6
    rows = cut_lineage(inputs.matrix(spark, sf).select("f1", "f3", F.when(inside, 1).otherwise(0).alias("y")))
    names = ["f1", "f3"]
    waves = models.train_candidate_classifier(rows, names, negative_weight=1.0, components=64, maxIter=50)
    line = models.train_candidate_classifier(rows, names, negative_weight=1.0, maxIter=50)
    hit = F.avg((F.col("estimate") == F.col("y")).cast("double"))
    curved = waves.transform(rows).agg(F.count("*").alias("rows"), hit.alias("curved"))
    straight = line.transform(rows).agg(hit.alias("straight"))
    both = curved.crossJoin(straight)  # one row each
    return both.select("rows", (F.col("curved") > 0.9).alias("inside_found"), (F.col("curved") > F.col("straight") + 0.1).alias("beats_line"))


@query("extra_trees_facts", with_inputs("matrix", "SELECT count(*) AS rows, CAST(50 AS BIGINT) AS trees, true AS in_range, "
       "true AS beats_mean, 'f2,f3' AS leading FROM matrix"))
def _(spark, sf):
    """The grade comes from f2 and f3 alone, f2 with the larger spread."""
    rows = cut_lineage(_graded(spark, sf))
    model = models.train_extra_trees(rows.where("side = 'train'"), NAMES, maxDepth=6)
    grade, estimate, is_test = F.col("grade"), F.col("estimate"), F.col("side") == "test"
    mean = rows.where("side = 'train'").agg(F.avg("grade")).scalar()
    trees = model.nodes.agg(F.count_distinct("tree")).scalar()
    leading = model.importances().where("rank <= 2").agg(F.array_join(F.array_sort(F.collect_list("name")), ",")).scalar()
    return model.transform(rows).agg(
        F.count("*").alias("rows"),
        trees.alias("trees"),
        F.bool_and((estimate >= 0) & (estimate <= 3)).alias("in_range"),
        (F.avg(F.when(is_test, F.pow(estimate - grade, 2))) < F.avg(F.when(is_test, F.pow(grade - mean, 2))) / 4).alias("beats_mean"),
        leading.alias("leading"),
    )


@query("grid_search")
def _(spark, sf):
    train, _test = _sides(spark, sf)
    stage = GBTRegressor(labelCol="grade", predictionCol="estimate", seed=0, maxIter=3)
    return models.grid_search(train, NAMES, stage, {"maxDepth": [2, 4]}, folds=2)[1]


@query("class_weight_sweep")
def _(spark, sf):
    train, test = _sides(spark, sf)
    return models.class_weight_sweep(train, test, NAMES, maxIter=5)


@query("tree_count_sweep")
def _(spark, sf):
    train, test = _sides(spark, sf)
    return models.tree_count_sweep(train, test, NAMES, [2, 5], maxDepth=4)


@query("learning_curve")
def _(spark, sf):
    train, test = _sides(spark, sf)
    return models.learning_curve(train, test, NAMES, **SMALL)


@query("feature_importance")
def _(spark, sf):
    train, _test = _sides(spark, sf)
    return models.feature_importance(models.train_forest(train, NAMES, **SMALL), NAMES)


@query("permutation_importance")
def _(spark, sf):
    train, test = _sides(spark, sf)
    return models.permutation_importance(models.train_forest(train, NAMES, **SMALL), test, NAMES)


@query("backward_elimination")
def _(spark, sf):
    train, test = _sides(spark, sf)
    golden = test.select("doc_id", "entity_id", "grade")
    return models.backward_elimination(train, test, golden, NAMES, **SMALL)


@query("leaf_assignment")
def _(spark, sf):
    train, test = _sides(spark, sf)
    stage = RandomForestRegressor(labelCol="grade", predictionCol="estimate", leafCol="leaves", seed=0, numTrees=3, maxDepth=3)
    model = models._fit(stage, train, NAMES)
    return models.shared_leaves(models.leaf_assignment(model, test, NAMES))


@query("window_size_sweep")
def _(spark, sf):
    docs, mentions = inputs.docs(spark, sf), inputs.mentions(spark, sf)
    return models.window_size_sweep(docs, mentions, inputs.lexicon(spark, sf), inputs.golden(spark, sf))
