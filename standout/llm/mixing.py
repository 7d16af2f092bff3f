"""Mixing sources to target weights along a curriculum whose weights change over the training run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standout.llm.catalog import query
from standout.llm.common import WORD, partitions, table

#: A weight schedule: straight lines between points (part of the run from 0 to 1, weight).
Schedule = Sequence[tuple[float, float]]
#: Schedules of the sources in turn. Their integrals are the weights 5, 2 and 1: the first source of every three is
#: taken early, the third late.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 7.0), (1.0, 3.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
#: No document is taken more often.
REPEATS = 3
#: Digits of the order key that cut a source into slabs of equal expected size (16 ** 3 of them).
SLAB_DIGITS = 3


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def inverse_integral(schedule: Schedule, share: Column) -> Column:
    """Part of the run after which ``share`` (0 to 1) of the schedule's integral has been used."""
    whole, before = integral(schedule), 0.0
    at: Column | None = None
    wanted = share * F.lit(whole)
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = F.least(F.greatest(wanted - F.lit(before), F.lit(0.0)), F.lit(area))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        step = F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(w0) + root))
        here = F.lit(t0) + F.least(step, F.lit(t1 - t0))
        at = here if at is None else F.when(wanted > F.lit(before), here).otherwise(at)
        before += area
    if at is None:
        raise ValueError("a schedule needs two points")
    return at


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, turn, target)`` of a small table ``(source, source_size)`` with a row for each source.

    Sources in code-point order, NULL last, take the schedules in turn and share the size of all by the integrals. A target
    stops at ``repeats`` times its source's size and the rest is shared again by weight until none is above. That is one
    common level per unit of weight: in the order of (limit / weight) a source is capped if its limit is not above the level
    that the sources from it onward would get.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules)
    weight = F.element_at(F.array(*[F.lit(float(integral(s))) for s in schedules]), F.col("turn") + 1)
    rows = sizes.withColumn("turn", turn).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    rest = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", rest / weights)
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    rows = rows.withColumn("common", F.max(F.when(~capped, F.col("level"))).over(every))
    target = F.when(capped, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight")))
    return rows.select("source", "source_size", "turn", target.alias("target"))


def allot(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies`` and ``mix_positions``.

    Each source is a stream of whole documents in the order of a hash of doc_id, taken over and over until its target is
    reached; of the last round those documents are taken whose middle lies before it. The position of a copy is the part
    of the run at which the source's schedule has asked for the words before it.

    NULL texts have no words and are taken zero times or more without adding any. NULL is a source of its own, a NULL doc_id
    hashes like an empty one, and repeated rows are documents of their own. Running sums are made slab by slab, so a
    source with most of the rows spreads over as many tasks. An empty table gives no rows. Columns of docs are kept.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumns({"mix_size": size, "_mix_key": key})
    rows = rows.withColumn("_mix_slab", F.substring("_mix_key", 1, SLAB_DIGITS))
    slabs = rows.groupBy(F.col("source").alias("s"), F.col("_mix_slab").alias("slab")).agg(F.sum("mix_size").alias("n"))
    totals = slabs.groupBy("s").agg(F.sum("n").alias("source_size")).withColumnRenamed("s", "source")
    goals = targets(totals, schedules, repeats)
    earlier = Window.partitionBy("s").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.select("s", "slab", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_mix_before"))
    slabs = slabs.join(goals, F.col("s").eqNullSafe(F.col("source"))).select(
        F.col("s").alias("_mix_s"),
        F.col("slab").alias("_mix_slab2"),
        "_mix_before",
        F.col("source_size").alias("mix_source_size"),
        F.col("turn").alias("_mix_turn"),
        F.col("target").alias("mix_target"),
    )
    inside = Window.partitionBy("source", "_mix_slab").orderBy("_mix_key", "doc_id", "mix_size")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_mix_upto", F.sum("mix_size").over(inside))
    rows = rows.join(slabs, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_slab") == F.col("_mix_slab2")))
    rows = rows.withColumn("_mix_from", F.col("_mix_before") + F.col("_mix_upto") - F.col("mix_size"))
    whole = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0)
    rows = rows.withColumn("_mix_whole", F.least(whole, F.lit(repeats)).cast("int"))
    rest = F.col("mix_target") - F.col("_mix_whole") * F.col("mix_source_size")
    last = (rest > 0) & (F.col("_mix_from") + F.col("mix_size") / F.lit(2.0) <= rest)
    rows = rows.withColumn("mix_copies", F.col("_mix_whole") + last.cast("int"))

    def position(copy: Column) -> Column:
        share = (F.col("_mix_from") + copy * F.col("mix_source_size")) / F.col("mix_target")
        at = F.lit(None).cast("double")
        for turn, schedule in enumerate(schedules):
            at = F.when(F.col("_mix_turn") == turn, inverse_integral(schedule, share)).otherwise(at)
        return F.when(F.col("mix_target") > 0, at).otherwise(F.lit(0.0))

    copies = F.sequence(F.lit(0), F.col("mix_copies") - 1)
    places = F.when(F.col("mix_copies") > 0, F.transform(copies, position)).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("mix_positions", places)
    return rows.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_positions")


def mixed(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """The training stream: a row for each copy with its ``mix_position``, sorted over all partitions by it."""
    rows = allot(docs, schedules, repeats).withColumn("mix_position", F.explode("mix_positions"))
    order = ["mix_position", "doc_id"]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return rows.select(*docs.columns, "mix_position")


ALLOT_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][turn + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER before, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, turn,
         CASE WHEN cap <= level * weight THEN cap
              ELSE least(cap, max(CASE WHEN cap > level * weight THEN level END) OVER () * weight) END AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.turn,
         CASE WHEN g.source_size > 0 THEN least(floor(g.target / g.source_size), 3) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, CAST(whole + CASE WHEN target - whole * source_size > 0
                               AND start + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies,
         start / target AS share
  FROM r
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, copies * size AS taken, copies,
       CASE WHEN copies = 0 THEN NULL WHEN target <= 0 THEN 0.0::DOUBLE
            WHEN share <= 0 THEN 0.0::DOUBLE
            ELSE round(CASE turn WHEN 0 THEN 2.0 * share * 5 / (7.0 + sqrt(49.0 - 8.0 * share * 5))
                      WHEN 1 THEN 2.0 * share * 2 / (2.0 + sqrt(4.0::DOUBLE))
                      ELSE 2.0 * share / (0.5 + sqrt(0.25 + 2.0 * share)) END, 6) END AS first_position
FROM c
"""


@query("op5_curriculum_mix", ALLOT_SQL)
def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = allot(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
        F.col("mix_copies").cast("long").alias("copies"),
        F.round(F.when(F.col("mix_copies") > 0, F.element_at("mix_positions", 1)), 6).alias("first_position"),
    )
