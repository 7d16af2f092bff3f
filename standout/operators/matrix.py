"""Feature-matrix algebra: wide tables keyed by ``doc_id, entity_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standout.operators.light import LIGHT

KEYS = ["doc_id", "entity_id"]
VARIANTS = ["v1", "v1_minus_low_relatedness", "v0", "v0_minus_low_relatedness"]
GRAPH_MEASURES = [
    "graph_size", "graph_diameter", "node_degree", "in_degree_mean_median_ratio", "out_degree_mean_median_ratio",
    "degree_mean_median_ratio", "farness", "closeness", "centrality",
]
HEAVY = [f"{v}_{m}" for v in VARIANTS for m in GRAPH_MEASURES]
SENTIMENT = ["title_sentiment", "title_pos", "title_neg", "body_sentiment", "body_pos", "body_neg"]
TF = ["doc_freq", "title_freq", "body_freq"]
FEATURE_SETS = {
    "light": LIGHT,
    "heavy": HEAVY,
    "light_heavy": LIGHT + HEAVY,
    "sentiment": SENTIMENT,
    "tf": TF,
    "joined": LIGHT + HEAVY + SENTIMENT,
    "all": LIGHT + HEAVY + SENTIMENT + TF,
}


def clean(c: Column | str) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def _check(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"features not in the table: {absent}")


def clean_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """NaN and NULL to 0; an absent feature is an error."""
    _check(df, names)
    return df.withColumns({n: clean(n) for n in names})


def last_rows(df: DataFrame, order: str) -> DataFrame:
    """One row per key: the last by the order column."""
    rest = [c for c in df.columns if c not in KEYS]
    kept = df.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return kept.select(*KEYS, "_r.*")


def join_features(a: DataFrame, b: DataFrame, order: str | None = None, target: str = "y") -> DataFrame:
    """Rows of both tables side by side; the target is the mean of both.

    With an order column the last of duplicate rows is taken first; without, keys are taken as unique.
    """
    if order is not None:
        a, b = last_rows(a, order).drop(order), last_rows(b, order).drop(order)
    right = b.withColumnRenamed(target, "_other")
    out = a.join(right, KEYS)
    return out.withColumn(target, (F.col(target) + F.col("_other")) / 2.0).drop("_other")


def select_features(df: DataFrame, names: Sequence[str], golden: DataFrame | None = None) -> DataFrame:
    """Project by name; an absent name is an error. Grades are attached again where given."""
    from standout.operators.golden import attach_golden

    _check(df, names)
    out = df.select(*KEYS, *names)
    return out if golden is None else attach_golden(out, golden)


def mask_features(df: DataFrame, names: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Set the features at the given positions of the name list to 0."""
    return df.withColumns({n: F.lit(0.0) for i, n in enumerate(names) if i in set(positions)})


def combine_light_heavy(light: DataFrame, heavy: DataFrame) -> DataFrame:
    """Light and heavy columns for each entity of the graphs; zeros where there is no light row."""
    names = [c for c in light.columns if c not in KEYS]
    out = light.join(heavy, KEYS, "right")
    return out.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


def feature_index(names: DataFrame, features: Sequence[str]) -> DataFrame:
    """Position of each ``name``: exact, else with blanks as underscores, else -1."""
    flat = [x for i, n in enumerate(features) for x in (F.lit(n), F.lit(i))]
    table = F.create_map(*flat)
    position = F.coalesce(
        F.try_element_at(table, F.col("name")),
        F.try_element_at(table, F.replace(F.col("name"), F.lit(" "), F.lit("_"))),
        F.lit(-1),
    )
    return names.withColumn("position", position.cast("long"))


def vector(names: Sequence[str], output: str = "features"):
    """Assembler of the named columns for ``pyspark.ml``."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol=output, handleInvalid="keep")
