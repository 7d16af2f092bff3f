"""Training, tuning and applying models with ``pyspark.ml``.

Tables have ``doc_id, entity_id``, feature columns and a target. Loops over fits run on the driver;
every fit, prediction and metric is a distributed job.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standout.functions.ordering import numbered, union_all
from standout.operators import ranking, scoring, sentiment
from standout.operators.extra_trees import train_extra_trees  # noqa: F401  (beside the other kinds of models)
from standout.operators.golden import attach_golden, only_golden, only_varying
from standout.operators.matrix import KEYS, clean_features, vector
from standout.operators.splits import unit_hash
from standout.session import cut_lineage, shared_folder

# Fixed training settings.
BOOSTED = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6, "minInstancesPerNode": 9}
FOREST = {"numTrees": 50, "maxDepth": 16, "featureSubsetStrategy": "0.5"}
NEGATIVE_WEIGHT = 0.325
DEEP = 8  # levels of a forest's trees above which rows are dealt out and their nodes are kept


def _fit(stage, df: DataFrame, names: Sequence[str]) -> PipelineModel:
    return Pipeline(stages=[vector(names), stage]).fit(clean_features(df, names))


def train_gbrt(df: DataFrame, names: Sequence[str], target: str = "grade", seed: int = 0, **settings) -> PipelineModel:
    """Gradient-boosted regression trees."""
    stage = GBTRegressor(labelCol=target, predictionCol="estimate", seed=seed, checkpointInterval=10, **{**BOOSTED, **settings})
    return _fit(stage, df, names)


def _dealt(df: DataFrame) -> DataFrame:
    """A table of fewer parts than tasks run at once, such as a file of one row group, is dealt out: one task would do all the work."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks, *[c for c in KEYS if c in df.columns])


def train_forest(df: DataFrame, names: Sequence[str], target: str = "grade", seed: int = 0, **settings) -> PipelineModel:
    """A random forest. For deep trees rows are dealt to all tasks, and their nodes are kept instead of walking all levels again."""
    settings = {**FOREST, **settings}
    if settings["maxDepth"] > DEEP:
        shared_folder(df.sparkSession)
        df, settings = _dealt(df), {"cacheNodeIds": True, **settings}
    stage = RandomForestRegressor(labelCol=target, predictionCol="estimate", seed=seed, **settings)
    return _fit(stage, df, names)


class FourierFeatures(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector of ``scale * cos(sum of weight * column + phase)``; a NULL column gives NaN.

    One small function over Arrow batches: the same as SQL is a method of so many instructions that the JVM never compiles it.
    """

    rows = Param(Params._dummy(), "rows", "phases, then the weights of each column", typeConverter=TypeConverters.toListFloat)
    centres = Param(Params._dummy(), "centres", "mean of each column", typeConverter=TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "deviation of each column", typeConverter=TypeConverters.toListFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCols=[], outputCol="features", centres=[], spreads=[])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, centres, spreads = self.getInputCols(), self.getOrDefault("centres"), self.getOrDefault("spreads")
        weights = np.array(self.getOrDefault("rows")).reshape(len(names) + 1, -1)
        scale, width = math.sqrt(2 / weights.shape[1]), weights.shape[1]

        @F.arrow_udf("array<double>")
        def waves(ones: pa.Array, *columns: pa.Array) -> pa.Array:
            turns = np.repeat(weights[:1], len(ones), axis=0)
            for column, centre, spread, weight in zip(columns, centres, spreads, weights[1:]):
                turns += np.outer((column.to_numpy(zero_copy_only=False) - centre) / spread, weight)
            with np.errstate(invalid="ignore"):
                values = np.cos(turns, out=turns)
            values *= scale
            return pa.ListArray.from_arrays(pa.array(np.arange(len(ones) + 1) * width, pa.int32()), pa.array(values.ravel()))

        cells = [F.col(f"`{n}`").cast("double") for n in names]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(waves(F.lit(1.0), *cells)))


def _fourier_stage(df: DataFrame, names: Sequence[str], components: int, gamma: float | None, seed: int) -> FourierFeatures:
    """Random Fourier features of the standardised columns: their inner products approach ``exp(-gamma * distance ** 2)``.

    One aggregate gives means and deviations; weights and phases are drawn from the seed and saved with the model.
    A column without spread takes no part.
    """
    ends = df.agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).alias(f"_{i}") for i, n in enumerate(names)]).first()
    usable = [(n, e["mean"], e["std"]) for n, e in zip(names, ends) if e["std"]]
    draw = random.Random(seed)
    spread = math.sqrt(2 * (gamma or 1 / max(len(usable), 1)))
    weights, phases = [], []
    for _ in range(components):
        weights.append([draw.gauss(0, spread) for _ in usable])
        phases.append(draw.uniform(0, 2 * math.pi))
    rows = [*phases, *(weight for column in zip(*weights) for weight in column)]
    stage = FourierFeatures()
    return stage._set(inputCols=[u[0] for u in usable], centres=[u[1] for u in usable], spreads=[u[2] for u in usable], rows=rows)


def train_candidate_classifier(
    df: DataFrame,
    names: Sequence[str],
    label: str = "y",
    negative_weight: float = NEGATIVE_WEIGHT,
    linear: bool = True,
    components: int = 0,
    gamma: float | None = None,
    seed: int = 0,
    **settings,
) -> PipelineModel:
    """Weighted two-class model: linear, boosted (``linear=False``), or a linear machine over ``components`` random
    Fourier features, which approaches the one with a Gaussian kernel (``gamma``: 1 / number of columns)."""
    weighted = df.withColumn("_weight", F.when(F.col(label) == 1, 1.0).otherwise(negative_weight))
    kind = LinearSVC if linear or components else GBTClassifier
    stage = kind(labelCol=label, predictionCol="estimate", weightCol="_weight", **settings)
    if not components:
        return _fit(stage, weighted, names)
    rows = clean_features(weighted, names)
    return Pipeline(stages=[_fourier_stage(rows, names, components, gamma, seed), stage]).fit(rows)


def score(
    model: PipelineModel,
    features: DataFrame,
    names: Sequence[str],
    golden: DataFrame | None = None,
    varying: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, entity_id, score``; only judged rows, and only varying entities, where those are given."""
    rows = clean_features(features, names)
    if golden is not None:
        rows = only_golden(rows, golden)
    if varying is not None:
        rows = only_varying(rows, varying)
    return model.transform(rows).select(*KEYS, F.col("estimate").alias("score"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def grid_search(
    df: DataFrame, names: Sequence[str], stage, grid: dict[str, Sequence], evaluator=None, folds: int = 3, parallelism: int = 4, seed: int = 0
):
    """Cross-validated grid; returns the best pipeline and one (settings, metric) row per grid point."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(stage.getParam(name), list(values))
    points = builder.build()
    evaluator = evaluator or RegressionEvaluator(labelCol=stage.getLabelCol(), predictionCol=stage.getPredictionCol())
    search = CrossValidator(
        estimator=Pipeline(stages=[vector(names), stage]), estimatorParamMaps=points, evaluator=evaluator,
        numFolds=folds, parallelism=parallelism, seed=seed,
    ).fit(clean_features(df, names))
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in point.items()), float(metric)) for point, metric in zip(points, search.avgMetrics)
    ]
    return search.bestModel, df.sparkSession.createDataFrame(rows, "settings string, metric double")


def class_weight_sweep(
    train: DataFrame, test: DataFrame, names: Sequence[str], label: str = "y", weights: Sequence[float] | None = None, **settings
) -> DataFrame:
    """Metrics of the positive class by weight of the negative class."""
    weights = weights or [0.25 + 0.025 * i for i in range(13)]
    parts = []
    for w in weights:
        model = train_candidate_classifier(train, names, label, w, **settings)
        scored = model.transform(clean_features(test, names))
        metrics = scoring.classification_metrics(scored, F.col(label) == 1, F.col("estimate") == 1).where("label = 1")
        parts.append(metrics.select(F.lit(w).alias("weight"), "f1", "precision", "recall", "fbeta", "support"))
    return union_all(parts)


def _quality(model: PipelineModel, test: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    return scoring.regression_metrics(model.transform(clean_features(test, names)), target, "estimate")


def tree_count_sweep(
    train: DataFrame, test: DataFrame, names: Sequence[str], counts: Sequence[int], target: str = "grade", fit: Callable = train_forest, **settings
) -> DataFrame:
    key = "maxIter" if fit is train_gbrt else "numTrees"
    parts = [
        _quality(fit(train, names, target, **{**settings, key: n}), test, names, target).withColumn("trees", F.lit(n)) for n in counts
    ]
    return union_all(parts)


def learning_curve(
    train: DataFrame,
    test: DataFrame,
    names: Sequence[str],
    fractions: Sequence[float] = tuple(i / 10 for i in range(1, 11)),
    target: str = "grade",
    fit: Callable = train_forest,
    seed: int = 0,
    **settings,
) -> DataFrame:
    """Hold-out quality by share of the training documents; larger shares contain the smaller ones."""
    place = unit_hash("doc_id", seed)
    parts = [
        _quality(fit(train.where(place < f), names, target, **settings), test, names, target).withColumn("fraction", F.lit(f))
        for f in fractions
    ]
    return union_all(parts)


def feature_importance(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """``rank, index, name, importance, std`` with the deviation over the trees of the model."""
    from pyspark.sql import SparkSession

    trees = model.stages[-1]
    total = trees.featureImportances.toArray()
    each = [t.featureImportances.toArray() for t in trees.trees]
    rows = []
    for i, name in enumerate(names):
        values = [float(t[i]) for t in each]
        mean = sum(values) / len(values)
        rows.append((i, name, float(total[i]), (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5))
    rows.sort(key=lambda r: (-r[2], r[0]))
    ranked = [(n + 1, *r) for n, r in enumerate(rows)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(ranked, "rank int, index int, name string, importance double, std double")


def permuted(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """The column's values dealt anew among all rows in one random order; all other columns stay.

    The rows in the order of their keys and the values in the order of a hash are numbered over all partitions, at any size of
    the table, and rows take the value of their number.
    """
    rows = df.withColumn("_all", F.lit(0))
    kept = numbered(rows.drop(name), ["_all"], [F.col(k) for k in KEYS], "_n")
    mixed = [F.xxhash64(*KEYS, F.lit(seed)), *[F.col(k) for k in KEYS]]
    dealt = numbered(rows.select("_all", name, *KEYS), ["_all"], mixed, "_n").select("_n", name)
    return kept.join(dealt, "_n").select(*df.columns)


def permutation_importance(
    model: PipelineModel, df: DataFrame, names: Sequence[str], target: str = "grade", seed: int = 0
) -> DataFrame:
    """Root mean square error after permuting one feature at a time, and the increase over the intact one."""
    whole = _quality(model, df, names, target).select(F.lit("").alias("name"), "rmse")
    parts = [
        _quality(model, permuted(df, n, seed), names, target).select(F.lit(n).alias("name"), "rmse") for n in names
    ]
    base = whole.agg(F.first("rmse")).scalar()
    return union_all(parts).withColumn("increase", F.col("rmse") - base)


def backward_elimination(
    train: DataFrame,
    test: DataFrame,
    golden: DataFrame,
    names: Sequence[str],
    metric: str = "P_5",
    target: str = "grade",
    keep: int = 1,
    fit: Callable = train_forest,
    **settings,
) -> DataFrame:
    """Drop, one after another, the feature without which the ranking measure stays best."""
    left, rows = list(names), []
    totals = cut_lineage(ranking.qrels_totals(golden))  # the same for all trials

    def measure(chosen: list[str]) -> float:
        scores = score(fit(train, chosen, target, **settings), test, chosen)
        per_document = ranking.document_measures(scores, golden, totals=totals)
        return float(per_document.agg(F.avg(metric).alias("m")).first()["m"] or 0.0)

    while len(left) > keep:
        trials = sorted(((measure([n for n in left if n != out]), out) for out in left), key=lambda r: (-r[0], r[1]))
        value, out = trials[0]
        left.remove(out)
        rows.append((len(rows) + 1, out, value, len(left)))
    return train.sparkSession.createDataFrame(rows, "round int, removed string, metric double, features int")


def leaf_assignment(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``doc_id, entity_id, tree, leaf`` for each tree of a model trained with ``leafCol='leaves'``."""
    rows = model.transform(clean_features(df, names))
    leaves = rows.select(*KEYS, F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    return leaves.withColumn("leaf", F.col("leaf").cast("long"))


def shared_leaves(leaves: DataFrame) -> DataFrame:
    """Rows per leaf of each tree."""
    return leaves.groupBy("tree", "leaf").agg(F.count("*").alias("rows"))


def tree_dump(model: PipelineModel) -> str:
    return model.stages[-1].toDebugString


def window_size_sweep(
    docs: DataFrame,
    mentions: DataFrame,
    lexicon: DataFrame,
    golden: DataFrame,
    train_share: float = 0.5,
    sizes: Sequence[int] = tuple(range(2, 100)),
    fit: Callable = train_forest,
    store: Callable[[DataFrame], DataFrame] | None = None,
    parallelism: int = 4,
    **settings,
) -> DataFrame:
    """Ranking quality by sentiment window: features of all sizes come from one job, only fits are looped.

    Sizes of the same half have the same features, so they share a fit. ``parallelism`` fits run at once, as in a grid search.
    """
    from standout.operators.matrix import SENTIMENT

    halves = sorted({n // 2 for n in sizes})
    features = sentiment.sentiment_features_by_length(docs, mentions, lexicon, halves)
    features = (store or cut_lineage)(attach_golden(only_golden(features, golden), golden))
    golden = cut_lineage(golden)
    totals = cut_lineage(ranking.qrels_totals(golden))  # the same for all sizes
    is_train: Column = unit_hash("doc_id", 1) < train_share
    spark = docs.sparkSession

    def quality(half: int) -> tuple:
        rows = features.where(F.col("length") == half)
        scores = cut_lineage(score(fit(rows.where(is_train), SENTIMENT, **settings), rows.where(~is_train), SENTIMENT))
        ndcg = ranking.salience_ndcg(scores, golden).agg(F.avg("ndcg")).first()
        per_document = ranking.document_measures(scores, golden, totals=totals)
        return (*ndcg, *per_document.agg(F.avg("ndcg"), F.avg("P_3"), F.avg("P_5")).first())

    with ThreadPoolExecutor(parallelism) as pool:
        found = dict(zip(halves, pool.map(inheritable_thread_target(spark)(quality), halves)))
    rows = [(n, *found[n // 2]) for n in sizes]
    return spark.createDataFrame(rows, "size int, ndcg double, trec_ndcg double, p3 double, p5 double")
