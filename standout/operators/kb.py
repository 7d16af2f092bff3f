"""Knowledge base: title and anchor dictionaries, canonical ids, link graph, degrees.

A dump row is ``wid, wiki_title, line_no, links array<struct<id, anchor, type>>``. No join side is
hinted: the optimizer broadcasts a side only below its size threshold, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DUMP = "wid BIGINT, wikiTitle STRING, links ARRAY<STRUCT<id: STRING, anchor: STRING, type: STRING>>"


def parse_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to dump rows; malformed lines are dropped. ``line_no`` is kept if present."""
    more = [c for c in lines.columns if c != column]
    rows = lines.select(F.from_json(column, DUMP).alias("d"), *more).where("d.wid IS NOT NULL")
    return rows.select("d.wid", F.col("d.wikiTitle").alias("wiki_title"), "d.links", *more)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    from standout.sources.documents import with_line_numbers

    return parse_dump(with_line_numbers(spark.read.text(path)))


def title_key(title: Column | str, case_insensitive: bool = True) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    return F.lower(title) if case_insensitive else title


def build_title_dictionary(dump: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """title key -> first id in file order."""
    keyed = dump.select(title_key("wiki_title", case_insensitive).alias("title_key"), "wid", "line_no")
    return keyed.groupBy("title_key").agg(F.min_by("wid", "line_no").alias("entity_id"))


def build_canonical_ids(dump: DataFrame, titles: DataFrame) -> DataFrame:
    """id -> dictionary id of its title."""
    keyed = dump.select("wid", title_key("wiki_title").alias("title_key"))
    return keyed.join(titles, "title_key").select(F.col("wid").alias("entity_id"), F.col("entity_id").alias("canonical_id"))


def canonical(df: DataFrame, ids: DataFrame, column: str = "entity_id", name: str = "canonical_id") -> DataFrame:
    """Add the canonical id of a column; an unknown id stands for itself."""
    pairs = ids.select(F.col("entity_id").alias("_id"), F.col("canonical_id").alias("_canonical"))
    out = df.join(pairs, df[column] == F.col("_id"), "left")
    return out.withColumn(name, F.coalesce("_canonical", column)).drop("_id", "_canonical")


def build_title_by_id(titles: DataFrame) -> DataFrame:
    """id -> title; the last title wins if one id has several."""
    return titles.groupBy("entity_id").agg(F.max("title_key").alias("title"))


def link_rows(dump: DataFrame, link_type: str | None = None) -> DataFrame:
    rows = dump.select("wid", F.explode("links").alias("l"))
    if link_type is not None:
        rows = rows.where(F.col("l.type") == link_type)
    return rows.select("wid", title_key("l.id").alias("title_key"), F.lower("l.anchor").alias("anchor_key"))


def build_anchor_dictionary(dump: DataFrame, titles: DataFrame, link_type: str | None = None) -> DataFrame:
    """(anchor, id) -> number of links; every resolvable target is kept."""
    rows = link_rows(dump, link_type).groupBy("anchor_key", "title_key").agg(F.count("*").alias("_n"))
    hits = rows.join(titles, "title_key")
    return hits.groupBy("anchor_key", "entity_id").agg(F.sum("_n").alias("n"))


def best_anchor_target(anchors: DataFrame) -> DataFrame:
    """The most frequent target of an anchor, the smaller id on a tie."""
    best = F.max_by("entity_id", F.struct("n", (-F.col("entity_id")).alias("low")))
    return anchors.groupBy("anchor_key").agg(best.alias("entity_id"), F.sum("n").alias("n"))


def anchor_hits(dump: DataFrame, titles: DataFrame, link_type: str | None = None) -> DataFrame:
    """Number of links with and without a known target."""
    rows = link_rows(dump, link_type).groupBy("title_key").agg(F.count("*").alias("_n"))
    found = rows.join(titles, "title_key", "left")
    hit = F.col("entity_id").isNotNull()
    return found.agg(
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(~hit, F.col("_n"))), F.lit(0)).alias("misses"),
    )


def build_link_graph(
    dump: DataFrame, titles: DataFrame, ids: DataFrame, lower_keys: bool = True
) -> DataFrame:
    """``links(src, dst, n)`` with canonical sources; parallel links add up.

    Links are counted per (source, key) before the joins, so repeated and popular targets shrink first.
    """
    key = title_key("l.id", lower_keys).alias("title_key")
    rows = dump.select("wid", F.explode("links").alias("l")).select("wid", key)
    rows = rows.groupBy("wid", "title_key").agg(F.count("*").alias("_n"))
    resolved = rows.join(titles, "title_key").select("wid", F.col("entity_id").alias("dst"), "_n")
    out = canonical(resolved, ids, "wid", "src")
    return out.groupBy("src", "dst").agg(F.sum("_n").alias("n"))


def entity_degrees(links: DataFrame) -> DataFrame:
    """In, out and total degree with parallel links; both directions in one aggregate."""
    ends = links.select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("entity_id"), F.col("n").alias("i"), F.lit(0).cast("long").alias("o")),
                F.struct(F.col("src").alias("entity_id"), F.lit(0).cast("long").alias("i"), F.col("n").alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("entity_id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree")
    )


def links_to(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct neighbours that link to the given entities."""
    wanted = ids.select(F.col("entity_id").alias("dst")).distinct()
    return links.join(wanted, "dst", "left_semi").select(F.col("dst").alias("entity_id"), F.col("src").alias("neighbour")).distinct()


def links_from(links: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select(F.col("entity_id").alias("src")).distinct()
    return links.join(wanted, "src", "left_semi").select(F.col("src").alias("entity_id"), F.col("dst").alias("neighbour")).distinct()


def id_from_title(named: DataFrame, titles: DataFrame, ids: DataFrame) -> DataFrame:
    """Canonical id of each title of a column ``title``."""
    hits = named.withColumn("title_key", title_key("title")).join(titles, "title_key", "left")
    return canonical(hits, ids).drop("title_key", "entity_id").withColumnRenamed("canonical_id", "entity_id")


def validate_golden(golden: DataFrame, ids: DataFrame, title_by_id: DataFrame) -> DataFrame:
    """Judged entities: all, without any title, and with another canonical id."""
    rows = canonical(golden.select("entity_id").groupBy("entity_id").agg(F.count("*").alias("n")), ids)
    raw = title_by_id.select("entity_id", F.lit(1).alias("_raw"))
    other = title_by_id.select(F.col("entity_id").alias("canonical_id"), F.lit(1).alias("_other"))
    rows = rows.join(raw, "entity_id", "left").join(other, "canonical_id", "left")

    def total(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))

    return rows.agg(
        total(F.lit(True)).alias("entities"),
        total(F.col("_raw").isNull() & F.col("_other").isNull()).alias("untitled"),
        total(F.col("entity_id") != F.col("canonical_id")).alias("renamed"),
    )
