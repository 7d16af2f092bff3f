"""Golden salience judgements: ``golden(doc_id, entity_id, grade)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standout.operators.kb import canonical

SALIENT = 2.0


def golden_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Judgements under the raw and the canonical id; the later entry of a document wins."""
    rows = docs.select(F.col("docId").alias("doc_id"), F.posexplode("saliency").alias("pos", "s")).select(
        "doc_id",
        "pos",
        F.col("s.entityid").alias("entity_id"),
        F.coalesce("s.score", F.lit(-1.0)).alias("grade"),
    )
    both = canonical(rows, ids).select(
        "doc_id",
        "grade",
        F.explode(
            F.array(
                F.struct(F.col("entity_id").alias("id"), (F.col("pos") * 2).alias("at")),
                F.struct(F.col("canonical_id").alias("id"), (F.col("pos") * 2 + 1).alias("at")),
            )
        ).alias("e"),
    )
    return both.groupBy("doc_id", F.col("e.id").alias("entity_id")).agg(F.max_by("grade", "e.at").alias("grade"))


def attach_golden(features: DataFrame, golden: DataFrame) -> DataFrame:
    """Grade of each row, 0 where it is not judged."""
    rows = features.drop("grade").join(golden.select("doc_id", "entity_id", "grade"), ["doc_id", "entity_id"], "left")
    return rows.withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def only_golden(features: DataFrame, golden: DataFrame) -> DataFrame:
    return features.join(golden.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")


def entity_spread(golden: DataFrame) -> DataFrame:
    """Entities in more than one document: mean, deviation and whether their grade varies."""
    out = golden.groupBy("entity_id").agg(
        F.count("*").alias("documents"),
        F.avg("grade").alias("mean_grade"),
        F.stddev_pop("grade").alias("std_grade"),
        (F.min("grade") < F.max("grade")).alias("varies"),
    )
    return out.where("documents > 1")


def varying_entities(golden: DataFrame, varies: bool = True) -> DataFrame:
    """(entity, document) pairs of entities whose grade varies, or of those graded the same everywhere."""
    chosen = entity_spread(golden).where(F.col("varies") == varies).select("entity_id")
    return golden.join(chosen, "entity_id", "left_semi").select("entity_id", "doc_id")


def only_varying(features: DataFrame, varying: DataFrame) -> DataFrame:
    return features.join(varying.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")


def binarise(grade: Column | str, at: float = SALIENT, inclusive: bool = True) -> Column:
    grade = F.col(grade) if isinstance(grade, str) else grade
    return F.when(grade >= at if inclusive else grade > at, 1).otherwise(0)
