"""Sources and sinks: each format is rendered from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from standout.plans import inputs
from standout.plans.catalog import query
from standout.plans.inputs import with_inputs
from standout.session import shared_folder
from standout.sources import documents, tables


def _new_folder(spark, name):
    """An own folder for one run's files, where driver and executors see it; the result reads them, so they stay."""
    return f"{shared_folder(spark).rstrip('/')}/files-{name}-{uuid.uuid4().hex}"


def _corpus_lines(spark, sf):
    """Documents as JSON lines: one paragraph per line of text, plus a caption that is not body."""
    docs = inputs.docs(spark, sf)
    paragraphs = F.transform(
        F.split("body", "\n", -1),
        lambda x, i: F.struct(F.concat(F.lit("body_par_"), F.lpad(i.cast("string"), 6, "0")).alias("name"), x.alias("value")),
    )
    caption = F.array(F.struct(F.lit("caption").alias("name"), F.col("title").alias("value")))
    return docs.select(
        F.to_json(
            F.struct(
                F.col("doc_id").alias("docId"),
                "title",
                F.concat(caption, paragraphs).alias("document"),
            )
        ).alias("value")
    )


@query("read_corpus", with_inputs("docs", "SELECT CAST(doc_id AS VARCHAR) AS \"docId\", title, "
       "CAST(length(body) - length(replace(body, chr(10), '')) + 2 AS BIGINT) AS parts FROM docs"))
def _(spark, sf):
    docs = documents.parse_corpus(_corpus_lines(spark, sf))
    return docs.select("docId", "title", F.size("document").cast("long").alias("parts"))


@query("assemble_body", with_inputs("docs", "SELECT CAST(doc_id AS VARCHAR) AS \"docId\", "
       "replace(body, chr(10), ' ') AS body FROM docs"))
def _(spark, sf):
    return documents.assemble_body(documents.parse_corpus(_corpus_lines(spark, sf)), " ").select("docId", "body")


def _feature_lines(spark, sf):
    rows = inputs.matrix(spark, sf).withColumns(
        {"golden": F.col("y").cast("double"), "estimate": F.lit(0.5), "f2": F.when(F.col("f1") > 25, F.col("f2")),
         "f4": F.when(F.col("f3") == 0.05, F.lit(float("nan"))).otherwise(F.col("f4"))}
    )
    header = spark.range(1).select(F.lit("docid,entity,golden,estimate").alias("value"))
    return tables.format_feature_rows(rows, ["f1", "f2", "f3", "f4"]).unionByName(header)


@query("read_feature_rows", with_inputs("matrix", "SELECT doc_id, entity_id, CAST(y AS DOUBLE) AS golden, "
       "CAST(0.5 AS DOUBLE) AS estimate, f1, CASE WHEN f1 > 25 THEN f2 ELSE 0 END AS f2, f3, "
       "CASE WHEN f3 = 0.05 THEN 0 ELSE f4 END AS f4 FROM matrix"))
def _(spark, sf):
    return tables.parse_feature_rows(_feature_lines(spark, sf), ["f1", "f2", "f3", "f4"])


@query("write_feature_rows", with_inputs("matrix", "SELECT doc_id || ',' || entity_id || ',' || y || ',0,[' || f1 || "
       "', ' || f3 || ', ' || f4 || ']' AS value FROM matrix"))
def _(spark, sf):
    return tables.format_feature_rows(
        inputs.matrix(spark, sf).withColumn("zero", F.lit(0)), ["f1", "f3", "f4"], golden="y", estimate="zero"
    )


@query("write_qrels", with_inputs("ranking", "SELECT doc_id, entity_id, CASE WHEN grade < 2 THEN 0 ELSE grade END AS grade, "
       "doc_id || ' 0 ' || entity_id || ' ' || printf('%.4f', CASE WHEN grade < 2 THEN 0 ELSE grade END) AS value FROM ranking"))
def _(spark, sf):
    return tables.format_qrels(inputs.ranking(spark, sf))


@query("write_run", with_inputs("ranking", "SELECT doc_id, entity_id, CASE WHEN grade = 1 THEN 0 ELSE score END AS score, "
       "doc_id || ' 0 ' || entity_id || ' 0 ' || printf('%.9f', CASE WHEN grade = 1 THEN 0 ELSE score END) || ' STANDARD' AS value "
       "FROM ranking"))
def _(spark, sf):
    rows = inputs.ranking(spark, sf)
    return tables.format_run(rows.withColumn("score", F.when(F.col("grade") != 1, F.col("score"))))


@query("feature_rows_files", with_inputs("matrix", "SELECT doc_id, entity_id, CAST(y AS DOUBLE) AS golden, CAST(0 AS DOUBLE) AS estimate, "
       "f1, f3, f4, CAST(NULL AS VARCHAR) AS wrong FROM matrix UNION ALL "
       "SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, l_returnflag || ',' || l_orderkey FROM lineitem WHERE l_linenumber = 7"))
def _(spark, sf):
    """Two partial outputs by a range of documents, one with short lines, found by their names and read as one."""
    folder, names = _new_folder(spark, "features"), ["f1", "f3", "f4"]
    rows = inputs.matrix(spark, sf).withColumn("zero", F.lit(0))
    for part, side in (("part-low", F.col("doc_id") < 5000), ("part-high", F.col("doc_id") >= 5000)):
        tables.write_feature_rows(rows.where(side).withColumnsRenamed({"y": "golden", "zero": "estimate"}),
                                  f"{folder}/{part}", names)
    short = inputs.table(spark, sf, "lineitem").where("l_linenumber = 7")
    short.select(F.concat_ws(",", "l_returnflag", F.col("l_orderkey").cast("string")).alias("value")).write.mode("append").text(f"{folder}/part-high")
    rows.select(F.lit("no part").alias("value")).write.text(f"{folder}/other")
    return tables.parse_feature_rows(documents.collect_partials(spark, f"{folder}/part-*"), names, corrupt="wrong")


@query("qrels_file", with_inputs("ranking", "SELECT doc_id, entity_id, CAST(CASE WHEN grade < 2 THEN 0 ELSE grade END AS DOUBLE) AS grade, "
       "CAST(NULL AS VARCHAR) AS wrong FROM ranking UNION ALL SELECT NULL, NULL, NULL, doc_id || ' 0 ' || entity_id FROM ranking WHERE grade = 3"))
def _(spark, sf):
    """Judgements written and read back, with lines that lack the grade."""
    folder, rows = _new_folder(spark, "qrels"), inputs.ranking(spark, sf)
    tables.write_qrels(rows, folder)
    cut = F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("0"), F.col("entity_id").cast("string"))
    rows.where("grade = 3").select(cut.alias("value")).write.mode("append").text(folder)
    return tables.read_qrels(spark, folder, corrupt="wrong")


@query("run_file", with_inputs("ranking", "SELECT doc_id, entity_id, CAST(printf('%.9f', CASE WHEN grade = 1 THEN 0 ELSE score END) AS DOUBLE) AS score "
       "FROM ranking"))
def _(spark, sf):
    """A run written and read back; missing scores come back as 0."""
    folder, rows = _new_folder(spark, "run"), inputs.ranking(spark, sf)
    tables.write_run(rows.withColumn("score", F.when(F.col("grade") != 1, F.col("score"))), folder)
    return tables.read_run(spark, folder)


@query("read_run", with_inputs("ranking", "SELECT doc_id, entity_id, round(score, 9) AS score FROM ranking"))
def _(spark, sf):
    return tables.parse_run(tables.format_run(inputs.ranking(spark, sf)))


@query("read_qrels", with_inputs("ranking", "SELECT doc_id, entity_id, grade FROM ranking"))
def _(spark, sf):
    return tables.parse_qrels(tables.format_qrels(inputs.ranking(spark, sf), zero_below=None))


@query("read_lexicon", with_inputs("lexicon", "SELECT term, score, line_no FROM lexicon"))
def _(spark, sf):
    lines = inputs.lexicon(spark, sf).select(
        F.concat("term", F.lit("\t"), F.col("score").cast("string")).alias("value"), "line_no"
    )
    return tables.parse_lexicon(lines)


def _news_lines(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    item = F.struct(
        "turn",
        F.when(F.col("role") == "assistant", "paragraph").otherwise("image").alias("subtype"),
        F.concat(F.lit(" "), F.col("text")).alias("content"),
    )
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("contents"))
    article = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"),
        F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("title"),
        F.transform("contents", lambda c: F.struct(c["subtype"], c["content"])).alias("contents"),
    )
    return chats.select(F.concat(F.lit("part-0.txt:"), F.to_json(article)).alias("value"))


@query("news_to_documents", "SELECT 'c' || c.conv_id AS \"docId\", 'chat ' || c.conv_id AS title, "
       "coalesce(string_agg(CASE WHEN role = 'assistant' THEN ' ' || replace(text, chr(160), ' ') || ' ' END, '' ORDER BY turn), '') AS body, "
       "any_value(k.entities) AS entities FROM conversations c "
       "JOIN (SELECT doc_id, string_agg(CAST(quality * 10 + toxic AS VARCHAR), ',') AS entities FROM labels GROUP BY doc_id) k "
       "ON k.doc_id = c.conv_id GROUP BY c.conv_id")
def _(spark, sf):
    listed = inputs.table(spark, sf, "labels").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("docId"),
        (F.col("quality") * 10 + F.col("toxic")).alias("entityid"),
    )
    docs = documents.news_to_documents(_news_lines(spark, sf), listed)
    return documents.assemble_body(docs).select(
        "docId", "title", "body",
        F.array_join(F.transform("saliency", lambda s: s["entityid"].cast("string")), ",").alias("entities"),
    )


def _topic_lines(spark, sf):
    from standout.operators import kb

    key = F.replace(F.replace(F.col("title_key"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    loud = F.translate(key, "etaoinrs", "ETAOINRS")
    rows = kb.link_rows(inputs.dump(spark, sf)).groupBy("wid").agg(
        F.concat_ws("", F.sort_array(F.collect_set(F.concat(
            F.lit("<entity><id>"), key, F.lit("</id><mention> "), key,
            F.lit(" </mention><link>enwiki:"), loud, F.lit("</link></entity>"))))).alias("items")
    )
    return rows.select(F.concat(
        F.lit("<top><docid> "), F.col("wid").cast("string"), F.lit(" </docid><entities>"), F.col("items"),
        F.lit("</entities></top>")).alias("value"))


@query("read_topics", with_inputs("kb_link kb_title kb_canonical",
       "SELECT DISTINCT CAST(l.wid AS VARCHAR) AS \"docId\", l.title_key AS mention, l.title_key, "
       "coalesce(c.canonical_id, t.entity_id) AS entityid FROM kb_link l LEFT JOIN kb_title t USING (title_key) "
       "LEFT JOIN kb_canonical c ON c.entity_id = t.entity_id"))
def _(spark, sf):
    from standout.operators import kb

    dump = inputs.dump(spark, sf)
    titles = kb.build_title_dictionary(dump)
    return documents.parse_topics(_topic_lines(spark, sf), titles, kb.build_canonical_ids(dump, titles))


@query("count_lines_per_query", "SELECT CAST(l_suppkey AS VARCHAR) AS qid, count(*) AS lines FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = inputs.table(spark, sf, "lineitem")
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.concat(F.lit("qid:"), F.col("l_suppkey").cast("string")),
                       F.concat(F.lit("1:"), F.col("l_quantity").cast("string")))
    return documents.count_lines_per_query(rows.select(line.alias("value")))


@query("filter_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    ids = inputs.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return documents.filter_by_ids(inputs.table(spark, sf, "documents").select("doc_id", "n_chars"), ids, "doc_id")


@query("remap_ids", "SELECT 99000000 + item_id AS \"docId\", text FROM benchmark")
def _(spark, sf):
    rows = inputs.table(spark, sf, "benchmark").select(F.concat(F.lit("x"), F.col("item_id").cast("string")).alias("docId"), "text", "item_id")
    places = rows.select("docId", F.col("item_id").alias("position"))
    return documents.remap_ids(rows.drop("item_id"), places)


@query("slice_corpus", "SELECT doc_id, lang FROM documents WHERE doc_id BETWEEN 100 AND 499")
def _(spark, sf):
    return documents.slice_corpus(inputs.table(spark, sf, "documents"), 100, 499, "doc_id").select("doc_id", "lang")
