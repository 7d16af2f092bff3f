"""Cosine similarity over ``vectors(vec_id, embedding)``.

The few asked-for vectors are scalar subqueries, so the table is scanned in place without a join,
and a top-k report keeps k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("u"))


def _asked(rows: DataFrame, units: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The asked-for unit vectors as columns ``q0, q1, ...``, looked up together in one scan."""
    wanted = F.map_from_entries(F.collect_list(F.struct("vec_id", "u")))
    found = units.where(F.col("vec_id").isin(list(ids))).dropDuplicates(["vec_id"]).agg(wanted).scalar()
    rows = rows.select("vec_id", "u", found.alias("_found"))
    return rows.select("vec_id", "u", *[F.col("_found")[F.lit(i)].alias(f"q{n}") for n, i in enumerate(ids)])


def _sum(signs: Sequence[float]) -> Column:
    def signed(n: int, sign: float) -> Column:
        return F.transform(F.col(f"q{n}"), lambda x: x * sign)

    parts = [signed(n, sign) for n, sign in enumerate(signs)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def _top(rows: DataFrame, topn: int) -> DataFrame:
    return rows.orderBy(F.desc(F.round("similarity", 9)), "vec_id").limit(topn)


def most_similar(vectors: DataFrame, vec_id: int, topn: int = 10) -> DataFrame:
    units = unit_vectors(vectors)
    rows = _asked(units.where(F.col("vec_id") != vec_id), units, [vec_id])
    return _top(rows.select("vec_id", dot(F.col("u"), F.col("q0")).alias("similarity")), topn)


def analogy(vectors: DataFrame, positive: Sequence[int], negative: Sequence[int], topn: int = 10) -> DataFrame:
    """Cosine to the mean of the signed unit vectors; the given ids are left out."""
    units = unit_vectors(vectors)
    asked = [*positive, *negative]
    rows = _asked(units.where(~F.col("vec_id").isin(asked)), units, asked)
    rows = rows.select("vec_id", "u", _sum([1.0] * len(positive) + [-1.0] * len(negative)).alias("m"))
    rows = rows.select("vec_id", "u", unit(F.col("m")).alias("m"))
    return _top(rows.select("vec_id", dot(F.col("u"), F.col("m")).alias("similarity")), topn)


def analogy_multiplicative(
    vectors: DataFrame, positive: Sequence[int], negative: Sequence[int], topn: int = 10
) -> DataFrame:
    """Products of shifted cosines: positives over negatives."""
    units = unit_vectors(vectors)
    asked = [*positive, *negative]
    rows = _asked(units.where(~F.col("vec_id").isin(asked)), units, asked)

    def product(places: range) -> Column:
        return reduce(lambda a, b: a * b, [(1 + dot(F.col("u"), F.col(f"q{n}"))) / 2 for n in places], F.lit(1.0))

    up, down = product(range(len(positive))), product(range(len(positive), len(asked)))
    return _top(rows.select("vec_id", (up / (down + 0.000001)).alias("similarity")), topn)


def odd_one_out(vectors: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The vector least similar to the mean unit vector of the group."""
    units = unit_vectors(vectors)
    rows = _asked(units.where(F.col("vec_id").isin(list(ids))), units, ids)
    rows = rows.select("vec_id", "u", _sum([1.0] * len(ids)).alias("m"))
    rows = rows.select("vec_id", dot(F.col("u"), unit(F.col("m"))).alias("similarity"))
    return rows.agg(F.min_by(F.struct("vec_id", "similarity"), F.struct(F.round("similarity", 9), "vec_id")).alias("r")).select("r.*")


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each pair ``a, b`` of ids."""
    units = unit_vectors(vectors)
    left = units.select(F.col("vec_id").alias("a"), F.col("u").alias("ua"))
    right = units.select(F.col("vec_id").alias("b"), F.col("u").alias("ub"))
    rows = pairs.join(left, "a").join(right, "b")
    return rows.select("a", "b", dot(F.col("ua"), F.col("ub")).alias("similarity"))
