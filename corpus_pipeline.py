"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and gives a table, which is written and read again as the next stage's ``docs``. All but
the last keep the columns of documents. Tests compare the stages with brute force; SQL cannot express them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standout.llm import language as languages
from standout.llm import mixing, packing, pii, simhash
from standout.llm.catalog import workers_import
from standout.llm.common import stored, table

#: A document is rejected if no language gets this share.
LEAST_SHARE = 0.4
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of no clear language.

    Where no document has a language to learn from, only the first rule holds.
    """
    workers_import(spark)
    net = languages.fit(docs)
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if net is None:
        return lettered
    found = lettered.select(F.struct(*docs.columns).alias("row"), languages.language(net, F.col("text")).alias("found"))
    return found.where(F.col("found.score") >= LEAST_SHARE).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the least doc_id; of repeated rows one."""
    workers_import(spark)
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; the number of characters follows the text."""
    workers_import(spark)
    text = pii.redacted(pii.fit(docs), F.col("text"))
    changed = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does, in the order of the curriculum."""
    workers_import(spark)
    own = ["doc_id", "source", "text"]
    more = F.struct(F.lit(0).alias("-"), *[c for c in docs.columns if c not in own]).alias("more")  # out of the mix's own names' way
    rows = mixing.mixed(docs.select(*own, more))
    return rows.select(*[F.col(c if c in own else f"more.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences with their ids."""
    workers_import(spark)
    return packing.pack(docs, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
