"""Knowledge-base jobs over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from standout.operators import kb
from standout.plans import inputs
from standout.plans.catalog import query
from standout.plans.inputs import with_inputs


def _kb(spark, sf):
    dump = inputs.dump(spark, sf)
    titles = kb.build_title_dictionary(dump)
    return dump, titles, kb.build_canonical_ids(dump, titles)


def kb_graph(spark, sf):
    return kb.build_link_graph(*_kb(spark, sf))


@query("read_dump", with_inputs("dump", "SELECT wid, wiki_title, CAST(len(ids) AS BIGINT) AS links FROM dump"))
def _(spark, sf):
    rows = inputs.dump(spark, sf)
    line = F.to_json(F.struct("wid", F.col("wiki_title").alias("wikiTitle"), "links"))
    broken = spark.range(1).select(F.lit("{\"wid\": 1, broken").alias("value"))
    lines = rows.select(line.alias("value")).unionByName(broken)
    return kb.parse_dump(lines).select("wid", "wiki_title", F.size("links").cast("long").alias("links"))


@query("build_title_dictionary", with_inputs("kb_title", "SELECT title_key, entity_id FROM kb_title"))
def _(spark, sf):
    return _kb(spark, sf)[1]


@query("build_title_dictionary_cased", with_inputs("dump",
       "SELECT wiki_title AS title_key, arg_min(wid, line_no) AS entity_id FROM dump GROUP BY 1"))
def _(spark, sf):
    return kb.build_title_dictionary(inputs.dump(spark, sf), case_insensitive=False)


@query("build_canonical_ids", with_inputs("kb_canonical", "SELECT entity_id, canonical_id FROM kb_canonical"))
def _(spark, sf):
    return _kb(spark, sf)[2]


@query("build_title_by_id", with_inputs("kb_title", "SELECT entity_id, max(title_key) AS title FROM kb_title GROUP BY 1"))
def _(spark, sf):
    return kb.build_title_by_id(_kb(spark, sf)[1])


ANCHORS = "anchors_all AS (SELECT l.anchor_key, t.entity_id, count(*) AS n FROM kb_link l JOIN kb_title t USING (title_key) GROUP BY ALL)"


@query("build_anchor_dictionary", with_inputs("kb_link kb_title", "SELECT * FROM anchors_all", ANCHORS))
def _(spark, sf):
    dump, titles, _ids = _kb(spark, sf)
    return kb.build_anchor_dictionary(dump, titles)


@query("best_anchor_target", with_inputs("kb_link kb_title",
       "SELECT anchor_key, first(entity_id ORDER BY n DESC, entity_id) AS entity_id, CAST(sum(n) AS BIGINT) AS n "
       "FROM anchors_all GROUP BY anchor_key", ANCHORS))
def _(spark, sf):
    dump, titles, _ids = _kb(spark, sf)
    return kb.best_anchor_target(kb.build_anchor_dictionary(dump, titles))


@query("anchor_hits", with_inputs("kb_link kb_title",
       "SELECT count(t.entity_id) AS hits, count(*) - count(t.entity_id) AS misses FROM kb_link l LEFT JOIN kb_title t USING (title_key)"))
def _(spark, sf):
    dump, titles, _ids = _kb(spark, sf)
    return kb.anchor_hits(dump, titles, "INTERNAL")


@query("build_link_graph", with_inputs("kb_graph", "SELECT src, dst, n FROM kb_graph"))
def _(spark, sf):
    return kb_graph(spark, sf)


@query("entity_degrees", with_inputs("links", "SELECT e.entity_id, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, "
       "CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS BIGINT) AS degree "
       "FROM (SELECT src AS entity_id FROM links UNION SELECT dst FROM links) e "
       "LEFT JOIN (SELECT dst, sum(n) AS n FROM links GROUP BY 1) i ON i.dst = e.entity_id "
       "LEFT JOIN (SELECT src, sum(n) AS n FROM links GROUP BY 1) o ON o.src = e.entity_id"))
def _(spark, sf):
    return kb.entity_degrees(inputs.links(spark, sf))


@query("links_to", with_inputs("links golden", "SELECT DISTINCT dst AS entity_id, src AS neighbour FROM links "
       "WHERE dst IN (SELECT entity_id FROM golden)"))
def _(spark, sf):
    return kb.links_to(inputs.links(spark, sf), inputs.golden(spark, sf))


@query("links_from", with_inputs("links golden", "SELECT DISTINCT src AS entity_id, dst AS neighbour FROM links "
       "WHERE src IN (SELECT entity_id FROM golden)"))
def _(spark, sf):
    return kb.links_from(inputs.links(spark, sf), inputs.golden(spark, sf))


@query("id_from_title", with_inputs("dump kb_title kb_canonical",
       "SELECT d.wid, d.wiki_title AS title, coalesce(c.canonical_id, t.entity_id) AS entity_id FROM dump d "
       "LEFT JOIN kb_title t ON t.title_key = lower(d.wiki_title) LEFT JOIN kb_canonical c ON c.entity_id = t.entity_id"))
def _(spark, sf):
    dump, titles, ids = _kb(spark, sf)
    return kb.id_from_title(dump.select("wid", F.col("wiki_title").alias("title")), titles, ids)


@query("validate_golden", with_inputs("kb_canonical kb_title",
       "SELECT count(*) AS entities, "
       "count(*) FILTER (WHERE a.entity_id IS NULL AND b.entity_id IS NULL) AS untitled, "
       "count(*) FILTER (WHERE coalesce(c.canonical_id, l.doc_id) <> l.doc_id) AS renamed FROM labels l "
       "LEFT JOIN kb_canonical c ON c.entity_id = l.doc_id LEFT JOIN kb_title a ON a.entity_id = l.doc_id "
       "LEFT JOIN kb_title b ON b.entity_id = coalesce(c.canonical_id, l.doc_id)"))
def _(spark, sf):
    _dump, titles, ids = _kb(spark, sf)
    judged = inputs.table(spark, sf, "labels").select(F.col("doc_id").alias("entity_id"))
    return kb.validate_golden(judged, ids, kb.build_title_by_id(titles))
