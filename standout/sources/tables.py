"""Feature rows, lexicons and ranking files as text, and the parquet forms of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRADE_FLOOR = 2.0


def _kept(rows: DataFrame, sound: Column, corrupt: str | None) -> DataFrame:
    """Rows of sound lines; with ``corrupt`` also the others, NULL but for that column, which holds the line."""
    fields = [c for c in rows.columns if c not in ("p", "_line")]
    if corrupt is None:
        return rows.where(sound).select(*fields)
    if corrupt in fields:
        raise ValueError(f"{corrupt} is a field of the lines")
    sound = F.coalesce(sound, F.lit(False))
    return rows.select(*[F.when(sound, F.col(c)).alias(c) for c in fields], F.when(~sound, F.col("_line")).alias(corrupt))


def parse_feature_rows(lines: DataFrame, names: Sequence[str], column: str = "value", corrupt: str | None = None) -> DataFrame:
    """``doc,entity,golden,estimate,[f1, f2, ...]`` to one column per feature; None and NaN become 0.

    Lines of another width (headers too) or without numeric ids are dropped, or kept as they are in the column ``corrupt``.
    """
    parts = F.split(F.translate(F.col(column), "[] \n", ""), ",")
    rows = lines.select(parts.alias("p"), F.col(column).alias("_line"))

    def number(i: int):
        value = F.try_element_at("p", F.lit(i)).try_cast("double")
        return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))

    out = rows.select(
        "p",
        "_line",
        F.try_element_at("p", F.lit(1)).try_cast("long").alias("doc_id"),
        F.try_element_at("p", F.lit(2)).try_cast("long").alias("entity_id"),
        number(3).alias("golden"),
        number(4).alias("estimate"),
        *[number(5 + i).alias(n) for i, n in enumerate(names)],
    )
    return _kept(out, (F.size("p") == 4 + len(names)) & F.col("doc_id").isNotNull() & F.col("entity_id").isNotNull(), corrupt)


def read_feature_rows(spark: SparkSession, path: str, names: Sequence[str], corrupt: str | None = None) -> DataFrame:
    return parse_feature_rows(spark.read.text(path), names, corrupt=corrupt)


def format_feature_rows(df: DataFrame, names: Sequence[str], golden: str = "golden", estimate: str = "estimate") -> DataFrame:
    values = F.concat_ws(", ", *[F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in names])
    line = F.concat_ws(
        ",",
        F.col("doc_id").cast("string"),
        F.col("entity_id").cast("string"),
        F.coalesce(F.col(golden), F.lit(0)).cast("string"),
        F.coalesce(F.col(estimate), F.lit(0)).cast("string"),
        F.concat(F.lit("["), values, F.lit("]")),
    )
    return df.select(line.alias("value"))


def write_feature_rows(df: DataFrame, path: str, names: Sequence[str]) -> None:
    format_feature_rows(df, names).write.mode("overwrite").text(path)


def format_qrels(golden: DataFrame, zero_below: float | None = GRADE_FLOOR) -> DataFrame:
    """Judgement lines ``doc 0 entity grade``; grades under the floor count as 0."""
    grade = F.col("grade").cast("double")
    if zero_below is not None:
        grade = F.when(grade < zero_below, F.lit(0.0)).otherwise(grade)
    shown = golden.select("doc_id", "entity_id", grade.alias("grade"))
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("0"), F.col("entity_id").cast("string"),
                       F.format_string("%.4f", "grade"))
    return shown.withColumn("value", line)


def write_qrels(golden: DataFrame, path: str, zero_below: float | None = GRADE_FLOOR) -> None:
    out = format_qrels(golden, zero_below)
    out.sort("doc_id", F.desc("grade"), "entity_id").select("value").write.mode("overwrite").text(path)


def format_run(scores: DataFrame) -> DataFrame:
    """Run lines ``doc 0 entity 0 score STANDARD``; a missing score is 0."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    shown = scores.select("doc_id", "entity_id", score.alias("score"))
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("0"), F.col("entity_id").cast("string"), F.lit("0"),
                       F.format_string("%.9f", "score"), F.lit("STANDARD"))
    return shown.withColumn("value", line)


def write_run(scores: DataFrame, path: str) -> None:
    out = format_run(scores)
    out.sort("doc_id", F.desc("score"), "entity_id").select("value").write.mode("overwrite").text(path)


def _parsed(lines: DataFrame, column: str, places: dict[str, tuple[int, str]], corrupt: str | None) -> DataFrame:
    """Blank-separated fields by place and type; lines with a missing or wrong field are dropped or kept as corrupt."""
    parts = lines.select(F.split(column, " ").alias("p"), F.col(column).alias("_line"))
    fields = {n: F.try_element_at("p", F.lit(i)).try_cast(kind) for n, (i, kind) in places.items()}
    rows = parts.select("p", "_line", *[c.alias(n) for n, c in fields.items()])
    sound = F.lit(True)
    for name in fields:
        sound &= F.col(name).isNotNull()
    return _kept(rows, sound, corrupt)


def parse_run(lines: DataFrame, column: str = "value", corrupt: str | None = None) -> DataFrame:
    return _parsed(lines, column, {"doc_id": (1, "long"), "entity_id": (3, "long"), "score": (5, "double")}, corrupt)


def read_run(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    return parse_run(spark.read.text(path), corrupt=corrupt)


def parse_qrels(lines: DataFrame, column: str = "value", corrupt: str | None = None) -> DataFrame:
    return _parsed(lines, column, {"doc_id": (1, "long"), "entity_id": (3, "long"), "grade": (4, "double")}, corrupt)


def read_qrels(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    return parse_qrels(spark.read.text(path), corrupt=corrupt)


def parse_lexicon(lines: DataFrame, column: str = "value") -> DataFrame:
    """``term<TAB>score`` lines; ``line_no`` is kept where the input has it."""
    p = F.split(column, "\t")
    more = [c for c in lines.columns if c != column]
    return lines.where(F.size(p) == 2).select(p[0].alias("term"), p[1].try_cast("int").cast("long").alias("score"), *more)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    from standout.sources.documents import with_line_numbers

    return parse_lexicon(with_line_numbers(spark.read.text(path)))
