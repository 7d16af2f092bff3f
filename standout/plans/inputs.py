"""Collections that Spark derives from the given tables, and the same derivations as SQL.

Documents: every row of ``documents``; the title is the text before the first full stop.
Entities: words of six letters or more in at least 2 % of the documents; an entity's id is its
earliest place in the collection. Links: adjacent entity words. Judgements: entities of the
labelled documents with a grade from the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standout.session import stored

MIN_LETTERS = 6
MIN_SHARE = 0.02


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a table over the tasks of a shuffle.

    What is counted or joined by the key afterwards stays where it is: of a large table the texts are shuffled once, and
    neither their words nor their mentions.
    """
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, key)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    title = F.split_part("text", F.lit("."), F.lit(1))
    body = F.substring(F.col("text"), F.length(title) + 2, F.length("text"))
    rows = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", title.alias("title"), body.alias("body"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("body"), F.lit(r"(\p{L}+)"), 1)
    rows = docs(spark, sf).select("doc_id", F.posexplode(words).alias("pos", "w"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("i"), "w")


def word_documents(spark: SparkSession, sf: str, letters: int = MIN_LETTERS) -> DataFrame:
    """(document, word) with the first place; words of a document are made distinct by one aggregate."""
    rows = tokens(spark, sf).where(F.length("w") >= letters)
    return rows.groupBy("doc_id", "w").agg(F.min("i").alias("i"), F.count("*").alias("n"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Stored: at most 50 times as many as a document has different words, so joins with them need no shuffle."""
    total = table(spark, sf, "documents").agg(F.count("*")).scalar()
    words = word_documents(spark, sf).groupBy("w").agg(
        F.count("*").alias("df"), F.min(F.col("doc_id") * 1_000_000 + F.col("i")).alias("entity_id")
    )
    words = words.where(F.col("df") >= MIN_SHARE * total).select("entity_id", F.col("w").alias("title"), "df")
    return stored(words, "entities")


def doc_entities(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """``known`` are the entities, where they have been made already."""
    known = entities(spark, sf) if known is None else known
    # a run of letters is as long as it can be, so only those of enough letters are cut out; each text is one list of different ones
    words = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"\p{L}{%d,}" % MIN_LETTERS), 0))
    words = docs(spark, sf).select("doc_id", F.explode_outer(words).alias("title"))
    return words.join(known.select("entity_id", "title"), "title").select("doc_id", "entity_id", "title").distinct()


def links(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """Stored: no more than pairs of entities."""
    words = F.regexp_extract_all(F.lower("body"), F.lit(r"(\p{L}+)"), 1)
    rows = docs(spark, sf).select(words.alias("a"))
    pairs = F.arrays_zip(F.col("a").alias("w"), F.slice("a", F.lit(2), F.greatest(F.size("a"), F.lit(1))).alias("v"))
    rows = rows.select(F.explode(pairs).alias("p")).select("p.w", "p.v")
    rows = rows.where((F.length("w") >= MIN_LETTERS) & (F.length("v") >= MIN_LETTERS) & (F.col("w") != F.col("v")))
    known = (entities(spark, sf) if known is None else known).select("entity_id", "title")
    src = known.select(F.col("entity_id").alias("src"), F.col("title").alias("w"))
    dst = known.select(F.col("entity_id").alias("dst"), F.col("title").alias("v"))
    return stored(rows.join(src, "w").join(dst, "v").groupBy("src", "dst").agg(F.count("*").alias("n")), "links")


def golden(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    judged = table(spark, sf, "labels").select("doc_id").distinct()
    grade = F.round(((F.col("doc_id") * 31 + F.col("entity_id") * 17) % 10) / 3.0, 2)
    rows = doc_entities(spark, sf, known).join(judged, "doc_id", "left_semi")
    return rows.select("doc_id", "entity_id", grade.alias("grade"))


def mentions(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    from standout.operators.spotting import spot_titles

    return spot_titles(docs(spark, sf), doc_entities(spark, sf, known), fallback=False)


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of three letters or more in at least 2 % of the documents, scored -5..5; stored."""
    total = table(spark, sf, "documents").agg(F.count("*")).scalar()
    words = word_documents(spark, sf, 3).groupBy("w").agg(F.count("*").alias("df"))
    score = (F.col("df") + F.length("w") * 7 + F.ascii("w") * 3) % 11 - 5
    words = words.where(F.col("df") >= MIN_SHARE * total)
    words = words.select(F.col("w").alias("term"), score.cast("long").alias("score"), F.col("df").alias("line_no"))
    return stored(words, "lexicon")


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        (F.max("l_extendedprice") * 3 / 100000).alias("score"),
        (F.sum("l_quantity").cast("long") % 4).cast("double").alias("grade"),
    )
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity_id"), "score", "grade")


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").cast("long").alias("entity_id"),
        F.col("l_quantity").alias("f1"),
        (F.col("l_extendedprice") / 1000).alias("f2"),
        F.col("l_discount").alias("f3"),
        F.col("l_tax").alias("f4"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
    )


def dump(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as a knowledge dump; titles collide by their nature."""
    pages = table(spark, sf, "pages")
    ids = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">[^<]*</a>'), 1)
    anchors = F.regexp_extract_all("html", F.lit('<a href="/[^"]*">([^<]*)</a>'), 1)
    items = F.transform(
        F.arrays_zip(ids.alias("id"), anchors.alias("anchor")),
        lambda p: F.struct(p["id"].alias("id"), p["anchor"].alias("anchor"), F.lit("INTERNAL").alias("type")),
    )
    return pages.select(
        F.col("page_id").alias("wid"),
        F.regexp_extract("html", "<title>([^ <]+)", 1).alias("wiki_title"),
        F.col("page_id").alias("line_no"),
        items.alias("links"),
    )


SQL = {
    "docs": "SELECT doc_id, split_part(text, '.', 1) AS title, "
    "substr(text, length(split_part(text, '.', 1)) + 2) AS body FROM documents",
    "tok": "SELECT doc_id, i, a[i] AS w FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM "
    "(SELECT doc_id, regexp_extract_all(lower(body), '(\\p{L}+)', 1) AS a FROM docs))",
    "entity": "SELECT min(doc_id * 1000000 + i) AS entity_id, w AS title, count(DISTINCT doc_id) AS df FROM tok "
    "WHERE length(w) >= 6 GROUP BY w HAVING count(DISTINCT doc_id) >= 0.02 * (SELECT count(*) FROM documents)",
    "doc_entity": "SELECT DISTINCT t.doc_id, e.entity_id, e.title FROM tok t JOIN entity e ON e.title = t.w",
    "links": "SELECT a.entity_id AS src, b.entity_id AS dst, count(*) AS n FROM "
    "(SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM tok) t "
    "JOIN entity a ON a.title = t.w JOIN entity b ON b.title = t.w2 WHERE a.entity_id <> b.entity_id GROUP BY ALL",
    "golden": "SELECT doc_id, entity_id, round(CAST((doc_id * 31 + entity_id * 17) % 10 AS DOUBLE) / 3, 2) AS grade "
    "FROM doc_entity WHERE doc_id IN (SELECT doc_id FROM labels)",
    # every place of a field whose first six characters open a wanted title, then the whole title
    "chars": "SELECT doc_id, field, p, c || lead(c, 1) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o || lead(c, 4) OVER o "
    "|| lead(c, 5) OVER o AS head FROM (SELECT doc_id, field, unnest(range(1, length(text) + 1)) AS p, "
    "unnest(string_split(lower(text), '')) AS c FROM "
    "(SELECT doc_id, 'title' AS field, title AS text FROM docs UNION ALL SELECT doc_id, 'body', body FROM docs)) "
    "WINDOW o AS (PARTITION BY doc_id, field ORDER BY p)",
    "mentions": "SELECT k.doc_id, k.field, k.entity_id, k.p - 1 AS start, k.p - 1 + length(k.title) AS \"end\", "
    "substr(f.text, k.p, length(k.title)) AS surface FROM (SELECT c.doc_id, c.field, c.p, e.entity_id, e.title FROM chars c "
    "JOIN doc_entity e ON e.doc_id = c.doc_id AND left(e.title, 6) = c.head) k "
    "JOIN (SELECT doc_id, 'title' AS field, title AS text FROM docs UNION ALL SELECT doc_id, 'body', body FROM docs) f "
    "ON f.doc_id = k.doc_id AND f.field = k.field WHERE lower(substr(f.text, k.p, length(k.title))) = k.title",
    "lexicon": "SELECT w AS term, CAST((count(DISTINCT doc_id) + length(w) * 7 + ascii(w) * 3) % 11 - 5 AS BIGINT) AS score, "
    "count(DISTINCT doc_id) AS line_no FROM tok WHERE length(w) >= 3 GROUP BY w "
    "HAVING count(DISTINCT doc_id) >= 0.02 * (SELECT count(*) FROM documents)",
    "ranking": "SELECT l_orderkey AS doc_id, l_partkey AS entity_id, max(l_extendedprice) * 3 / 100000 AS score, "
    "CAST(CAST(sum(l_quantity) AS BIGINT) % 4 AS DOUBLE) AS grade FROM lineitem GROUP BY l_orderkey, l_partkey",
    "matrix": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS entity_id, l_quantity AS f1, "
    "l_extendedprice / 1000 AS f2, l_discount AS f3, l_tax AS f4, "
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem",
    "dump": "SELECT page_id AS wid, regexp_extract(html, '<title>([^ <]+)', 1) AS wiki_title, page_id AS line_no, "
    "regexp_extract_all(html, '<a href=\"/([^\"]*)\">[^<]*</a>', 1) AS ids, "
    "regexp_extract_all(html, '<a href=\"/[^\"]*\">([^<]*)</a>', 1) AS anchors FROM pages",
    "kb_title": "SELECT lower(wiki_title) AS title_key, arg_min(wid, line_no) AS entity_id FROM dump GROUP BY 1",
    "kb_canonical": "SELECT d.wid AS entity_id, t.entity_id AS canonical_id FROM dump d "
    "JOIN kb_title t ON t.title_key = lower(d.wiki_title)",
    "kb_link": "SELECT wid, lower(unnest(ids)) AS title_key, lower(unnest(anchors)) AS anchor_key FROM dump",
    "kb_graph": "SELECT coalesce(c.canonical_id, l.wid) AS src, t.entity_id AS dst, count(*) AS n FROM kb_link l "
    "JOIN kb_title t USING (title_key) LEFT JOIN kb_canonical c ON c.entity_id = l.wid GROUP BY ALL",
}
NEEDS = {
    "tok": ["docs"], "entity": ["tok"], "doc_entity": ["tok", "entity"], "links": ["tok", "entity"],
    "golden": ["doc_entity"], "chars": ["docs"], "mentions": ["chars", "doc_entity"], "lexicon": ["tok"],
    "kb_title": ["dump"], "kb_canonical": ["dump", "kb_title"], "kb_link": ["dump"],
    "kb_graph": ["kb_link", "kb_title", "kb_canonical"],
}


def with_inputs(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """SQL with the named derivations, and what they need, in front as common tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in order]
    if extra:
        parts.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
