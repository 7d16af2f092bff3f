"""Statistics of features, judgements, collections and systems."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from standout.functions.ordering import ordinal
from standout.functions.text import count_in
from standout.operators.matrix import clean

# Fixed cost model: graph features cost three seconds per node, shared by sixteen features.
SMALL_GRAPH_COST = 3 * 20 / 16
LARGE_GRAPH_COST = 3 * 600 / 16


def information_gain(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per feature the entropy of the label minus its entropy given that the feature is set, in nats.

    One map-side combined count per (feature, set, label); the rest works on that small table.
    """
    flags = df.select(F.col(label).alias("y"), *[(clean(f) != 0).alias(f) for f in features])
    cells = flags.unpivot(["y"], list(features), "feature", "is_set").groupBy("feature", "is_set", "y").agg(
        F.count("*").cast("double").alias("n")
    )
    of_set, of_y, of_all = (Window.partitionBy("feature", *k) for k in (["is_set"], ["y"], []))
    cells = cells.select(
        "feature", "n", F.sum("n").over(of_set).alias("s"), F.sum("n").over(of_y).alias("c"), F.sum("n").over(of_all).alias("t")
    )
    # n (ln n/s - ln c/t) / t summed over cells is H(y) - H(y | set)
    term = F.col("n") / F.col("t") * (F.log(F.col("n") / F.col("s")) - F.log(F.col("c") / F.col("t")))
    return cells.groupBy("feature").agg(F.sum(term).alias("gain"))


def feature_cost(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.startswith("v0"), SMALL_GRAPH_COST).when(name.startswith("v1"), LARGE_GRAPH_COST).otherwise(1.0)


def gain_over_cost(gain: DataFrame) -> DataFrame:
    rows = gain.withColumn("cost", feature_cost("feature"))
    return rows.withColumn("gain_over_cost", F.col("gain") / F.col("cost")).orderBy(F.desc("gain_over_cost"), "feature")


def chi2_select(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-squared of non-negative features against the class, and the order in which they enter."""
    rows = df.select(F.col(label).alias("y"), *[clean(f).alias(f) for f in features])
    sums = rows.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in features])
    cells = sums.unpivot(["y", "n"], list(features), "feature", "observed")
    every = Window.partitionBy("feature")
    cells = cells.withColumn("expected", F.sum("observed").over(every) * F.col("n") / F.sum("n").over(every))
    gap = F.col("observed") - F.col("expected")
    out = cells.groupBy("feature").agg(F.sum(F.when(F.col("expected") > 0, gap * gap / F.col("expected")).otherwise(0.0)).alias("chi2"))
    best = Window.orderBy(F.desc("chi2"), "feature")  # one row per feature
    return out.withColumn("enters", F.row_number().over(best).cast("long"))


def _p_value_udf():
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function.

    Defined inside a function, so workers get it by value and need no installed package.
    """

    def tail(t: float, dof: float) -> float:
        if t is None or dof is None or dof <= 0 or math.isnan(t):
            return float("nan")
        a, b, x = dof / 2, 0.5, dof / (dof + t * t)
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            a, b, x = b, a, 1 - x
        if x <= 0:
            return 1.0 if flip else 0.0
        log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
        front, tiny = math.exp(log_front) / a, 1e-300
        c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
        h = d
        for m in range(1, 500):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for term in (even, odd):
                d = 1 / ((1 + term * d) or tiny)
                c = (1 + term / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - front * h if flip else front * h

    def column(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([tail(x, y) for x, y in zip(t, dof)], dtype="float64")

    return F.pandas_udf(column, DoubleType())


def paired_t_matrix(series: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Paired t of each two systems over all documents; a missing value is 0.

    ``series`` is ``system, doc_id, value``. One aggregate brings the systems of a document together,
    a second one sums the differences of the named pairs.
    """
    wide = series.groupBy("doc_id").agg(
        *[F.coalesce(F.max(F.when(F.col("system") == s, F.col("value"))), F.lit(0.0)).alias(f"_{i}") for i, s in enumerate(systems)]
    )
    pairs = list(combinations(range(len(systems)), 2))
    facts = []
    for i, j in pairs:
        gap = F.col(f"_{i}") - F.col(f"_{j}")
        facts.append(
            F.struct(
                F.lit(systems[i]).alias("a"), F.lit(systems[j]).alias("b"), F.count("*").alias("n"),
                F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("sd"),
            )
        )
    rows = wide.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    return rows.select("a", "b", "n", t.alias("t"))


def with_p_values(t_rows: DataFrame) -> DataFrame:
    return t_rows.withColumn("p", _p_value_udf()("t", (F.col("n") - 1).cast("double")))


def golden_statistics(golden: DataFrame, salient: float = 2.0) -> DataFrame:
    """Judged and salient entities per document, and the distribution of the grades."""
    docs = golden.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("grade") >= salient).alias("high"),
        F.sum("grade").alias("s"), F.sum(F.col("grade") * F.col("grade")).alias("q"),
        F.min("grade").alias("low"), F.max("grade").alias("top"),
    )
    out = docs.agg(
        *[f(c).alias(f"{name}_{what}") for c, what in (("n", "entities"), ("high", "salient"))
          for f, name in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"), (F.sum, "sum"))],
        (F.sum("s") / F.sum("n")).alias("mean_grade"),
        (F.sum("q") / F.sum("n")).alias("_q"),
        F.min("low").alias("min_grade"),
        F.max("top").alias("max_grade"),
    )
    spread = F.sqrt(F.greatest(F.col("_q") - F.col("mean_grade") * F.col("mean_grade"), F.lit(0.0)))
    return out.withColumn("std_grade", spread).drop("_q")


def length_statistics(docs: DataFrame) -> DataFrame:
    """Words (split on blank) and characters per body."""
    rows = docs.select((count_in("body", F.lit(" ")) + 1).alias("words"), F.length("body").cast("long").alias("chars"))
    return rows.agg(
        *[f(c).alias(f"{name}_{c}") for c in ("words", "chars") for f, name in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    )


def system_overlap(a: DataFrame, b: DataFrame, bound: float = 0.8) -> DataFrame:
    """Documents that both systems score below, or both at or above, the bound."""
    rows = a.select("doc_id", F.col("value").alias("a")).join(b.select("doc_id", F.col("value").alias("b")), "doc_id")
    both = F.when((F.col("a") < bound) & (F.col("b") < bound), "below").when(
        (F.col("a") >= bound) & (F.col("b") >= bound), "above"
    )
    return rows.withColumn("agreement", both).where("agreement IS NOT NULL")


def scores_with_entity(scores: DataFrame, mentions: DataFrame, entity_id: int) -> DataFrame:
    """Scores of the documents that contain the entity."""
    return scores.join(mentions.where(F.col("entity_id") == entity_id).select("doc_id"), "doc_id", "left_semi")


def salience_distribution(golden: DataFrame) -> DataFrame:
    """Per entity mean, deviation and documents, with its place by each of them (largest first)."""
    rows = golden.groupBy("entity_id").agg(
        F.avg("grade").alias("mean_grade"), F.stddev_pop("grade").alias("std_grade"), F.count("*").alias("documents")
    ).withColumn("_all", F.lit(0))
    for value, name in (("mean_grade", "place_by_mean"), ("std_grade", "place_by_std"), ("documents", "place_by_documents")):
        # places compare rounded values, so that equal means are ties whatever order they were summed in
        rows = ordinal(rows, ["_all"], F.round(F.col(value).cast("double"), 9), F.col("entity_id"), name)
    return rows.drop("_all")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Density histogram between minimum and maximum; the last bin is closed."""
    value = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))).scalar()
    rows = df.where(value.isNotNull()).select(value.alias("v"), ends.alias("e"))
    low, high = F.col("e.low"), F.col("e.high")
    place = F.when(high > low, F.floor((F.col("v") - low) / (high - low) * bins)).otherwise(0)
    bin_no = F.least(place, F.lit(bins - 1)).cast("long")
    out = rows.groupBy(bin_no.alias("bin"), "e").agg(F.count("*").alias("count"))
    width = (high - low) / bins
    return out.select(
        "bin",
        (low + width * F.col("bin")).alias("low"),
        "count",
        F.when(width > 0, F.col("count") / (F.col("e.n") * width)).alias("density"),
    )


def salient_entity_listing(docs: DataFrame, golden: DataFrame, ids: DataFrame, titles: DataFrame, salient: float = 2.0) -> DataFrame:
    """Per document its salient and other entity names under raw and canonical ids.

    The judged entities of one document are few, so their names are collected per document.
    """
    from standout.operators.kb import canonical

    rows = canonical(golden, ids)
    raw = titles.select("entity_id", F.col("title").alias("raw_name"))
    known = titles.select(F.col("entity_id").alias("canonical_id"), F.col("title").alias("canonical_name"))
    rows = rows.join(raw, "entity_id", "left").join(known, "canonical_id", "left")
    high = F.col("grade") >= salient

    def names(flag: Column, name: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col(name)))), "|")

    listed = rows.groupBy("doc_id").agg(
        names(high, "raw_name").alias("salient"), names(~high, "raw_name").alias("other"),
        names(high, "canonical_name").alias("salient_canonical"), names(~high, "canonical_name").alias("other_canonical"),
    )
    return docs.select("doc_id", "title", "body").join(listed, "doc_id")


def reconcile_ids(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of one set that the other lacks."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    missing = left.join(right, key, "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(right.join(left, key, "left_anti").withColumn("status", F.lit("extra")))
