"""Row numbers and running sums over groups of any size, by one method.

Rows are sorted over all partitions by group and order and numbered inside their partition; what a group has in
earlier partitions, a table of one row for each partition and group, is added. So a group with a third of all rows is
spread over a third of the tasks. Running sums carry totals from chunk to chunk of the ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standout.session import cut_lineage

#: Ranks that one window of a running sum covers.
CHUNK = 100_000


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact ``row_number`` per group (NULL is a group) in ascending order, NULLs first.

    The sorted rows are stored once, because the places that tasks give must not change when one runs again.
    """
    named = {f"_o{i}": c for i, c in enumerate(order)}
    by = [F.col(c).asc_nulls_first() for c in (*keys, *named)]
    rows = df.withColumns(named).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()).drop(*named))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), shift.alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    return rows.join(parts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def ordinal(df: DataFrame, keys: Sequence[str], value: Column, tie: Column, name: str) -> DataFrame:
    """Exact ``row_number`` per group by value descending, then tie ascending."""
    return numbered(df, keys, [-value.cast("double"), tie], name)


def running(df: DataFrame, keys: Sequence[str], rank: str, sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Running sums in the order of ``rank``, which numbers the rows of a group from 1."""
    keys = list(keys)
    parts = df.withColumn("_c", F.floor((F.col(rank) - 1) / chunk)).withColumns({f"_x_{n}": c for n, c in sums.items()})
    totals = parts.groupBy(*keys, "_c").agg(*[F.sum(f"_x_{n}").alias(f"_b_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_c", *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    upto = Window.partitionBy(*keys, "_c").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(totals, [*keys, "_c"])
    out = out.withColumns({n: F.sum(f"_x_{n}").over(upto) + F.col(f"_b_{n}") for n in sums})
    return out.select(*df.columns, *sums)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
