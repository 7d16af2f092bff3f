"""Splits. Each adds a ``side`` (train, test) or ``fold`` column and needs no shuffle where it can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standout.functions.ordering import ordinal, running

PRIME = 1_000_003


def unit_hash(key: Column | str, seed: int | Column) -> Column:
    """Reproducible number in [0, 1) from an integer key by plain arithmetic."""
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    mixed = F.pmod(F.pmod(key.cast("long"), F.lit(PRIME)) * 7919 + seed * 104_729 + 13, F.lit(PRIME))
    return F.pmod(mixed * mixed + mixed * 31, F.lit(PRIME)) / PRIME


def _side(train: Column) -> Column:
    return F.when(train, "train").otherwise("test")


def split_by_group(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """All rows of a key on one side."""
    return df.withColumn("side", _side(unit_hash(key, seed) < share))


def split_by_list(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Listed keys train, the rest test."""
    listed = ids.select(key).distinct().withColumn("_listed", F.lit(True))
    out = df.join(listed, key, "left")
    return out.withColumn("side", _side(F.coalesce("_listed", F.lit(False)))).drop("_listed")


def split_varying(df: DataFrame, varying: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Rows of varying entities only, each row on its own side."""
    rows = df.join(varying.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")
    return rows.withColumn("side", _side(unit_hash(F.pmod(F.col("doc_id"), F.lit(PRIME)) * 1009 + F.pmod(F.col("entity_id"), F.lit(PRIME)), seed) < share))


def kfold(df: DataFrame, k: int) -> DataFrame:
    """k contiguous folds of equal size in (doc_id, entity_id) order, numbered from 1.

    Rows are numbered without ever sorting the whole table in one task.
    """
    per_doc = df.groupBy("doc_id").agg(F.count("*").alias("_rows")).withColumn("_all", F.lit(0))
    placed = ordinal(per_doc, ["_all"], -F.col("doc_id"), F.col("doc_id"), "_place")
    starts = running(placed, ["_all"], "_place", {"_upto": F.col("_rows")})
    starts = starts.select("doc_id", (F.col("_upto") - F.col("_rows")).alias("_before"))
    inside = ordinal(df, ["doc_id"], -F.col("entity_id"), F.col("entity_id"), "_inside")
    rows = inside.join(starts, "doc_id").withColumn("_n", F.col("_before") + F.col("_inside"))
    total = df.agg(F.count("*")).scalar()
    size, extra = F.floor(total / k), total % k
    wide = extra * (size + 1)
    fold = F.when(F.col("_n") <= wide, F.ceil(F.col("_n") / (size + 1))).otherwise(
        extra + F.ceil((F.col("_n") - wide) / F.greatest(size, F.lit(1)))
    )
    return rows.withColumn("fold", fold.cast("long")).drop("_inside", "_before", "_n")


def shuffle_split(df: DataFrame, repeats: int, test: float, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Every row once per repetition with its side in that repetition."""
    rows = df.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return rows.withColumn("side", _side(unit_hash(key, F.col("repetition") * 17 + seed) >= test))
