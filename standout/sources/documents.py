"""Document collections: JSON lines in, document rows out, and the news and topic formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = (
    "docId STRING, title STRING, document ARRAY<STRUCT<name: STRING, value: STRING>>, "
    "saliency ARRAY<STRUCT<entityid: BIGINT, score: DOUBLE>>"
)
NEWS = "id STRING, title STRING, contents ARRAY<STRUCT<subtype: STRING, content: STRING>>"
TOPIC = "docid STRING, entities STRUCT<entity: ARRAY<STRUCT<id: STRING, mention: STRING, link: STRING>>>"
TOPIC_LINK_PREFIX = "enwiki:"  # fixed value of the format


def parse_corpus(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON document per row of a text column; lines that are no document are dropped (``broken_lines`` counts them)."""
    return lines.select(F.from_json(column, DOCUMENT).alias("d")).where("d.docId IS NOT NULL").select("d.*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path).where("docId IS NOT NULL")


def broken_lines(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Number of lines that a parser left out: ``lines, kept, broken``."""
    kept = parsed.agg(F.count("*")).scalar()
    counts = lines.agg(F.count("*").alias("lines")).withColumn("kept", kept)
    return counts.withColumn("broken", F.col("lines") - F.col("kept"))


def assemble_body(docs: DataFrame, sep: str = "") -> DataFrame:
    """Text of the body paragraphs in their order as column ``body``."""
    paragraphs = F.filter("document", lambda p: p["name"].startswith("body_par_"))
    body = F.array_join(F.transform(paragraphs, lambda p: p["value"]), sep)
    return docs.withColumn("body", F.coalesce(body, F.lit("")))


def news_to_documents(raw: DataFrame, entities: DataFrame | None = None, column: str = "value") -> DataFrame:
    """News lines ``file:{json}`` to documents; only listed ids when entities are given.

    ``entities`` has ``docId, entityid``; the entities of one article are few, so they are collected.
    """
    text = F.replace(F.col(column), F.lit(" "), F.lit(" "))
    payload = F.substring(text, F.locate(":", text) + 1, F.length(text))
    news = raw.select(F.from_json(payload, NEWS).alias("n")).where("n IS NOT NULL").select("n.*")
    paragraphs = F.filter("contents", lambda c: c["subtype"] == "paragraph")
    body = F.array_join(F.transform(paragraphs, lambda c: F.concat(c["content"], F.lit(" "))), "")
    docs = news.select(
        F.col("id").alias("docId"),
        "title",
        F.array(F.struct(F.lit("body_par_000").alias("name"), body.alias("value"))).alias("document"),
    )
    empty = F.array().cast("array<struct<entityid:bigint,score:double>>")
    if entities is None:
        return docs.withColumn("saliency", empty)
    item = F.struct(F.col("entityid").cast("long").alias("entityid"), F.lit(None).cast("double").alias("score"))
    per_doc = entities.groupBy("docId").agg(
        F.filter(F.array_sort(F.collect_set(item)), lambda e: e["entityid"].isNotNull()).alias("saliency")
    )
    return docs.join(per_doc, "docId")


def _topic_rows(topics: DataFrame, titles: DataFrame, canonical: DataFrame) -> DataFrame:
    """Resolve topic links; ``titles(title_key, entity_id)``, ``canonical(entity_id, canonical_id)``."""
    link = F.replace(F.col("e.link"), F.lit(TOPIC_LINK_PREFIX), F.lit(""))
    rows = topics.select("docid", F.explode_outer("entities.entity").alias("e")).select(
        F.trim("docid").alias("docId"),
        F.trim("e.mention").alias("mention"),
        F.lower(F.replace(F.trim(link), F.lit(" "), F.lit("_"))).alias("title_key"),
    )
    raw = rows.join(titles.select("title_key", "entity_id"), "title_key", "left")
    out = raw.join(canonical.select("entity_id", "canonical_id"), "entity_id", "left")
    return out.select("docId", "mention", "title_key", F.coalesce("canonical_id", "entity_id").alias("entityid"))


def parse_topics(lines: DataFrame, titles: DataFrame, canonical: DataFrame, column: str = "value") -> DataFrame:
    """One ``<top>`` element per row of a text column."""
    topics = lines.select(F.from_xml(F.col(column), TOPIC).alias("t")).select("t.*")
    return _topic_rows(topics, titles, canonical)


def read_topics_xml(spark: SparkSession, path: str, titles: DataFrame, canonical: DataFrame) -> DataFrame:
    topics = spark.read.format("xml").option("rowTag", "top").schema(TOPIC).load(path)
    return _topic_rows(topics, titles, canonical)


def filter_by_ids(corpus: DataFrame, ids: DataFrame, id_column: str = "docId") -> DataFrame:
    """Records whose id is listed."""
    return corpus.join(ids.select(id_column).distinct(), id_column, "left_semi")


def remap_ids(df: DataFrame, ids: DataFrame, base: int = 99_000_000, id_column: str = "docId") -> DataFrame:
    """Replace string ids by base + place in the list; ``ids`` has ``docId, position``."""
    places = ids.select(id_column, (F.col("position") + base).cast("long").alias("_new"))
    return df.join(places, id_column).withColumn(id_column, F.col("_new")).drop("_new")


def slice_corpus(df: DataFrame, low: int, high: int, by: str | Column) -> DataFrame:
    """Inclusive range on a numeric id or a line number column."""
    by = F.col(by) if isinstance(by, str) else by
    return df.where(by.cast("long").between(low, high))


def with_line_numbers(lines: DataFrame, file: Column | None = None) -> DataFrame:
    """0-based line number in each file.

    Row ids grow with the place in a file, so counts per task give each task's offset and only the
    rows of one task are ever numbered together.
    """
    name = file if file is not None else F.input_file_name()
    rows = lines.withColumn("_file", name).withColumn("_id", F.monotonically_increasing_id())
    task = F.shiftright("_id", 33)
    rows = rows.withColumn("_task", task)
    sizes = rows.groupBy("_file", "_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = rows.join(starts, ["_file", "_task"])
    line = F.col("_before") + F.col("_id") - F.col("_first")
    return out.withColumn("line_no", line).drop("_file", "_id", "_task", "_first", "_before")


def collect_partials(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of all partial outputs whose path matches the pattern."""
    return spark.read.text(pattern)


def count_lines_per_query(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines per query of an SVM-rank text."""
    token = F.element_at(F.split(column, " "), 2)
    qid = F.regexp_extract(token, "^qid:(.+)$", 1)
    return lines.where(F.size(F.split(column, " ")) > 1).select(qid.alias("qid")).groupBy("qid").agg(
        F.count("*").alias("lines")
    )
