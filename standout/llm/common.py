"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standout.session import shared_folder

#: Words as all contracts define them; Python's ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Hashes that are unpacked to bits at once.
_HASHES = 65536


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: the 64 bits that are set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        part = np.ascontiguousarray(hashes[at : at + _HASHES])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/standout-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd", folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and later reads take only their columns."""
    path = folder or new_folder(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def made(spark: SparkSession, folder: str) -> None:
    """Make a folder, so that it is there even if no task writes to it."""
    store, path = _place(spark, folder)
    store.mkdirs(path)


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for folder in folders:
        store, path = _place(spark, folder)
        store.delete(path, True)


def unsigned_share(hashed: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def bounded_sample(df: DataFrame, key: str | Sequence[str], rows: int, group: str | None = None) -> DataFrame:
    """At most ``rows`` rows, or rows of each value of ``group`` (few values), those with the smallest hash of ``key``.

    ``key`` is one column or several that together tell most rows apart: rows of one key come in or stay out together.
    Counts fix a hash threshold that about three times as many rows pass, so that the exact choice by row number sees few
    rows from every task whatever the table's size.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = F.xxhash64(*keys)
    if group is None:
        size = F.lit(df.count())
    else:
        sizes = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
        size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col(group)] if sizes else F.lit(0)
    near = df.where(unsigned_share(order) * size <= 3.0 * rows)
    place = Window.partitionBy(F.lit(0) if group is None else group).orderBy(order, *keys)
    return near.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= rows).drop("_r")


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of a document's id as text, modulo ``divisor``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], place: str, size: str) -> DataFrame:
    """``df``, stored, with each row's place in its group from 0 and the number of the group's rows, both long.

    Rows are sorted over all partitions by group and order (ascending, NULLs of ``order`` first; values of ``group`` are not
    NULL), so a group of any size spreads over as many tasks as its rows need. A place is the row's place in its partition
    plus the rows of the group in earlier partitions; that table has a row for each partition and each group.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    rows = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    parts = parts.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias(size))
    rows = rows.join(stored(parts, "numbered-parts"), [*group, "_part"]).withColumn(place, F.col("_at") + F.col("_shift"))
    return rows.select(*df.columns, place, size)
