"""Baselines, candidate selection and score metrics that need no trained model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standout.functions.ordering import ordinal
from standout.operators.splits import unit_hash


def baseline_first_value(features: DataFrame, first: str) -> DataFrame:
    return features.select("doc_id", "entity_id", F.col(first).cast("double").alias("score"))


def baseline_perfect(mentions: DataFrame, golden: DataFrame) -> DataFrame:
    """Golden grade of each mentioned entity, 0 where it has none."""
    pairs = mentions.select("doc_id", "entity_id").distinct()
    out = pairs.join(golden.select("doc_id", "entity_id", "grade"), ["doc_id", "entity_id"], "left")
    return out.select("doc_id", "entity_id", F.coalesce("grade", F.lit(0.0)).alias("score"))


def baseline_random(mentions: DataFrame, seed: int = 0) -> DataFrame:
    """Reproducible number in [0, 1) for each mentioned entity."""
    pairs = mentions.select("doc_id", "entity_id").distinct()
    key = F.pmod(F.col("doc_id"), F.lit(1_000_003)) * 1009 + F.pmod(F.col("entity_id"), F.lit(1_000_003))
    return pairs.withColumn("score", unit_hash(key, seed))


def select_candidates(
    scored: DataFrame, threshold: float = 0.5, min_pass: int = 3
) -> DataFrame:
    """Entities above the threshold; a document without any passes its first ``min_pass`` entities."""
    above = F.col("score") > threshold
    empty = scored.groupBy("doc_id").agg(F.coalesce(F.bool_or(above), F.lit(False)).alias("_any")).where("NOT _any").select("doc_id")
    rest = scored.join(empty, "doc_id", "left_semi")
    rest = ordinal(rest, ["doc_id"], -F.col("entity_id"), F.col("entity_id"), "_n")
    return scored.where(above).unionByName(rest.where(F.col("_n") <= min_pass).drop("_n"))


def regression_metrics(df: DataFrame, target: str = "grade", estimate: str = "estimate") -> DataFrame:
    """Root mean square error and R2 from one aggregate."""
    y, e = F.col(target).cast("double"), F.col(estimate).cast("double")
    out = df.agg(F.count("*").alias("n"), F.avg((y - e) * (y - e)).alias("mse"), F.var_pop(y).alias("variance"))
    return out.select("n", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.col("variance")).alias("r2"))


def classification_metrics(df: DataFrame, truth: Column, guess: Column, beta: float = 1.0) -> DataFrame:
    """Confusion counts and precision, recall, F1, F-beta and support of both classes."""
    truth, guess = truth.cast("int"), guess.cast("int")
    cells = df.agg(
        *[
            F.count_if((truth == t) & (guess == g)).alias(n)
            for n, t, g in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
        ]
    )

    def of(label: int, right: str, wrong: str, missed: str) -> Column:
        return F.struct(
            F.lit(label).cast("long").alias("label"),
            F.col(right).alias("right"), F.col(wrong).alias("wrong"), F.col(missed).alias("missed"),
        )

    rows = cells.select("tp", "fp", "fn", "tn", F.explode(F.array(of(1, "tp", "fp", "fn"), of(0, "tn", "fn", "fp"))).alias("c"))
    rows = rows.select("tp", "fp", "fn", "tn", "c.*")
    right, wrong, missed = F.col("right"), F.col("wrong"), F.col("missed")
    b = beta * beta

    def ratio(a: Column, c: Column) -> Column:
        return F.when(c > 0, a / c).otherwise(0.0)

    return rows.select(
        "label", "tp", "fp", "fn", "tn",
        ratio(right, right + wrong).alias("precision"),
        ratio(right, right + missed).alias("recall"),
        ratio(right * 2, right * 2 + wrong + missed).alias("f1"),
        ratio(right * (1 + b), right * (1 + b) + missed * b + wrong).alias("fbeta"),
        (right + missed).alias("support"),
    )
