"""Per-document graphs of the judged entities over the word link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from standout.functions.text import round9
from standout.operators import graph, kb, light, matrix
from standout.plans import inputs
from standout.plans.catalog import query
from standout.plans.inputs import with_inputs
from standout.session import cut_lineage

V1 = (
    "v1 AS MATERIALIZED (SELECT doc_id, 'v1' AS variant, a AS src, b AS dst, CAST(count(*) AS BIGINT) AS w FROM ("
    "SELECT g.doc_id, l.dst AS a, l.src AS b FROM golden g JOIN links l ON l.dst = g.entity_id UNION ALL "
    "SELECT g.doc_id, l.dst, l.src FROM golden g JOIN links l ON l.src = g.entity_id) GROUP BY ALL), "
    "v0 AS MATERIALIZED (SELECT g.doc_id, 'v0' AS variant, l.src, l.dst, CAST(1 AS BIGINT) AS w FROM golden g JOIN links l ON l.src = g.entity_id "
    "JOIN golden h ON h.doc_id = g.doc_id AND h.entity_id = l.dst)"
)
REL = (
    "indeg AS MATERIALIZED (SELECT dst, count(*) AS n FROM links GROUP BY 1), "
    "pr AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM v1 UNION SELECT src, dst FROM v0), "
    "common AS MATERIALIZED (SELECT pr.a, pr.b, count(*) AS c FROM pr JOIN links x ON x.dst = pr.a JOIN links y ON y.dst = pr.b AND y.src = x.src GROUP BY ALL), "
    "rel AS MATERIALIZED (SELECT a, b, CASE WHEN greatest(x, y) > 0 THEN (log2(greatest(x, y)) - log2(greatest(c, 1))) / "
    "CASE WHEN greatest(1, least(x, y)) = 5 THEN 0.001 ELSE log2(5) - log2(greatest(1, least(x, y))) END END AS r FROM ("
    "SELECT pr.a, pr.b, coalesce(i.n, 0) AS x, coalesce(j.n, 0) AS y, coalesce(c, 0) AS c FROM pr LEFT JOIN indeg i ON i.dst = pr.a LEFT JOIN indeg j ON j.dst = pr.b "
    "LEFT JOIN common USING (a, b)))"
)
LOW = (
    "edges AS MATERIALIZED (SELECT * FROM v1 UNION ALL SELECT * FROM v0 UNION ALL SELECT doc_id, variant || '_minus_low_relatedness', src, dst, w FROM "
    "(SELECT * FROM v1 UNION ALL SELECT * FROM v0) e JOIN rel ON rel.a = e.src AND rel.b = e.dst WHERE r > 0)"
)
NODES = (
    "nd AS MATERIALIZED (SELECT doc_id, variant, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM ("
    "SELECT doc_id, variant, src AS node, 0 AS i, w AS o FROM edges UNION ALL SELECT doc_id, variant, dst, w, 0 FROM edges) GROUP BY ALL)"
)
EDGES = ", ".join([V1, REL, LOW])
PATHS = (
    "arc AS MATERIALIZED (SELECT doc_id, variant, src, dst, w FROM {edges} WHERE src <> dst), "
    "sp(doc_id, variant, src, dst, d) USING KEY (doc_id, variant, src, dst) AS (SELECT doc_id, variant, src, dst, w FROM arc UNION "
    "SELECT n.doc_id, n.variant, n.src, n.dst, n.d FROM (SELECT f.doc_id, f.variant, f.src, e.dst, min(f.d + e.w) AS d FROM sp f JOIN arc e ON e.doc_id = f.doc_id AND e.variant = f.variant "
    "AND e.src = f.dst WHERE e.dst <> f.src GROUP BY ALL) n LEFT JOIN recurring.sp k ON k.doc_id = n.doc_id AND k.variant = n.variant AND k.src = n.src AND k.dst = n.dst WHERE k.d IS NULL OR n.d < k.d)"
)


def _inputs(spark, sf):
    """Judgements and links, stored once: every graph operator reads them several times. A document's are in one task, so its edges are too."""
    known = inputs.entities(spark, sf)
    return inputs.spread(cut_lineage(inputs.golden(spark, sf, known)), "doc_id"), inputs.links(spark, sf, known)


@query("expand_graph_v1", with_inputs("golden links", "SELECT * FROM v1", V1))
def _(spark, sf):
    return graph.expand_graph_v1(*_inputs(spark, sf))


@query("induced_graph_v0", with_inputs("golden links", "SELECT * FROM v0", V1))
def _(spark, sf):
    return graph.induced_graph_v0(*_inputs(spark, sf))


@query("relatedness", with_inputs("golden links", "SELECT a, b, round(r, 6) AS relatedness FROM rel", V1 + ", " + REL))
def _(spark, sf):
    golden, links = _inputs(spark, sf)
    return graph.relatedness(graph.document_pairs(golden, links), links).withColumn("relatedness", round9("relatedness", 6))


@query("drop_low_relatedness", with_inputs("golden links", "SELECT * FROM edges WHERE variant LIKE '%low%'", EDGES))
def _(spark, sf):
    return graph.document_edges(*_inputs(spark, sf), [v for v in matrix.VARIANTS if "low" in v])


@query("graph_size", with_inputs("golden links", "SELECT doc_id, variant, count(*) AS graph_size FROM nd GROUP BY ALL", EDGES + ", " + NODES))
def _(spark, sf):
    return graph.document_sizes(*_inputs(spark, sf))


RATIOS = ", ".join(f"round(coalesce(avg({c}) / nullif(median({c}), 0), 0), 9) AS {c}_mean_median_ratio" for c in ("in_degree", "out_degree", "degree"))


@query("degree_ratios", with_inputs("golden links", f"SELECT doc_id, variant, count(*) AS graph_size, {RATIOS} FROM nd GROUP BY ALL", EDGES + ", " + NODES))
def _(spark, sf):
    out = graph.document_ratios(*_inputs(spark, sf))
    return out.select("doc_id", "variant", "graph_size", *[round9(c).alias(c) for c in out.columns if c.endswith("ratio")])


@query("node_degree", with_inputs("golden links", "SELECT * FROM nd", EDGES + ", " + NODES))
def _(spark, sf):
    return graph.document_degrees(*_inputs(spark, sf))


ALL_PATHS = EDGES + ", " + PATHS.format(edges="edges")


@query("shortest_paths", with_inputs("golden links", "SELECT doc_id, variant, src, dst, CAST(d AS BIGINT) AS d FROM sp", ALL_PATHS, recursive=True))
def _(spark, sf):
    return graph.document_paths(*_inputs(spark, sf))


@query("diameter", with_inputs("golden links", "SELECT doc_id, variant, CAST(max(d) AS BIGINT) AS graph_diameter FROM sp GROUP BY ALL", ALL_PATHS, recursive=True))
def _(spark, sf):
    return graph.document_diameters(*_inputs(spark, sf))


FAR = (
    "SELECT n.doc_id, n.variant, n.node, CAST(coalesce(f, 0) AS BIGINT) AS farness, round(CASE WHEN coalesce(f, 0) = 0 THEN 100 ELSE 1 / f END, 9) AS closeness FROM "
    "(SELECT doc_id, variant, src AS node FROM {edges} UNION SELECT doc_id, variant, dst FROM {edges}) n LEFT JOIN "
    "(SELECT doc_id, variant, node, sum(d) AS f FROM (SELECT doc_id, variant, src AS node, d FROM sp UNION ALL SELECT doc_id, variant, dst, d FROM sp) GROUP BY ALL) s "
    "ON s.doc_id = n.doc_id AND s.variant = n.variant AND s.node = n.node"
)


@query("farness_closeness", with_inputs("golden links", FAR.format(edges="edges"), ALL_PATHS, recursive=True))
def _(spark, sf):
    return graph.document_farness(*_inputs(spark, sf)).withColumn("closeness", round9("closeness"))


@query("eigenvector_centrality")
def _(spark, sf):
    return graph.document_eigenvectors(*_inputs(spark, sf)).withColumn("centrality", round9("centrality", 6))


NEAR = "near AS MATERIALIZED (SELECT doc_id, variant, src AS node, dst AS other FROM edges UNION SELECT doc_id, variant, dst, src FROM edges)"


@query("eigenvector_facts", with_inputs("golden links",
       "SELECT doc_id, variant, count(DISTINCT node) AS nodes, 1.0::DOUBLE AS norm, true AS all_positive, true AS solves_its_equation FROM near GROUP BY ALL", EDGES + ", " + NEAR))
def _(spark, sf):
    """What an eigenvector must satisfy: length one, no negative part, and neighbours that add up to the value times itself."""
    facts = graph.document_eigenvector_facts(*_inputs(spark, sf))
    return facts.select(
        "doc_id", "variant", "nodes", round9("norm").alias("norm"), (F.col("least") > -1e-9).alias("all_positive"), (F.col("rest") < 1e-6).alias("solves_its_equation")
    )


@query("heavy_features")
def _(spark, sf):
    return graph.heavy_features(*_inputs(spark, sf))


MEASURES = {
    "node_degree": ("n", "degree"), "farness": ("far", "farness"), "closeness": ("far", "closeness"), "graph_size": ("g", "graph_size"), "graph_diameter": ("g", "graph_diameter"),
    **{f"{c}_mean_median_ratio": ("g", f"{c}_mean_median_ratio") for c in ("in_degree", "out_degree", "degree")},
}


@query("heavy_feature_measures", with_inputs("golden links",
       "SELECT b.doc_id, b.node AS entity_id, " + ", ".join(
           f"coalesce(max({t}.{c}) FILTER (WHERE g.variant = '{v}'), 0)::DOUBLE AS {v}_{m}" for v in matrix.VARIANTS for m, (t, c) in MEASURES.items())
       + " FROM (SELECT DISTINCT doc_id, node FROM nd) b LEFT JOIN g ON g.doc_id = b.doc_id "
       "LEFT JOIN nd n ON n.doc_id = b.doc_id AND n.node = b.node AND n.variant = g.variant LEFT JOIN far ON far.doc_id = n.doc_id AND far.variant = n.variant AND far.node = n.node GROUP BY b.doc_id, b.node",
       EDGES + ", " + NODES + ", " + PATHS.format(edges="edges") + ", far AS MATERIALIZED (" + FAR.format(edges="edges") + "), "
       f"g AS MATERIALIZED (SELECT a.*, b.graph_diameter FROM (SELECT doc_id, variant, count(*) AS graph_size, {RATIOS} FROM nd GROUP BY ALL) a "
       "LEFT JOIN (SELECT doc_id, variant, max(d) AS graph_diameter FROM sp GROUP BY ALL) b USING (doc_id, variant))", recursive=True))
def _(spark, sf):
    """All columns but the eigenvector's, which eigenvector_facts checks."""
    out = graph.heavy_features(*_inputs(spark, sf))
    return out.select("doc_id", "entity_id", *[round9(f"{v}_{m}").alias(f"{v}_{m}") for v in matrix.VARIANTS for m in MEASURES])


CLASSED = (
    "kind AS (SELECT doc_id, entity_id AS node, CASE WHEN max(g) = 1 AND max(s) = 1 THEN 'both' WHEN max(g) = 1 THEN 'golden' ELSE 'spotted' END AS class FROM ("
    "SELECT doc_id, entity_id, 1 AS g, 0 AS s FROM golden UNION ALL SELECT doc_id, entity_id, 0, 1 FROM doc_entity WHERE length(title) > 6) GROUP BY ALL), "
    "knd AS MATERIALIZED (SELECT * FROM kind{more}), "
    "deg_edges AS MATERIALIZED (SELECT a.doc_id, l.src, l.dst, a.class AS src_class, b.class AS dst_class FROM knd a JOIN links l ON l.src = a.node JOIN knd b ON b.doc_id = a.doc_id AND b.node = l.dst)"
)
NEIGHBOURS = (
    " UNION ALL SELECT doc_id, node, 'neighbour' FROM (SELECT k.doc_id, l.dst AS node FROM kind k JOIN links l ON l.src = k.node UNION SELECT k.doc_id, l.src FROM kind k JOIN links l ON l.dst = k.node) n "
    "WHERE NOT EXISTS (SELECT 1 FROM kind k WHERE k.doc_id = n.doc_id AND k.node = n.node)"
)
GRAPHED = (
    "SELECT * FROM deg_edges UNION ALL SELECT doc_id, node, node, class, class FROM knd WHERE NOT EXISTS (SELECT 1 FROM deg_edges d WHERE d.doc_id = knd.doc_id AND (d.src = knd.node OR d.dst = knd.node))"
).replace("NOT EXISTS (SELECT 1 FROM deg_edges d WHERE d.doc_id = knd.doc_id AND (d.src = knd.node OR d.dst = knd.node))",
          "(doc_id, node) NOT IN (SELECT (doc_id, src) FROM deg_edges UNION SELECT (doc_id, dst) FROM deg_edges)")


def _spotted(spark, sf):
    return inputs.doc_entities(spark, sf).where(F.length("title") > 6)


@query("document_entity_graph", with_inputs("golden links doc_entity", GRAPHED, CLASSED.format(more="")))
def _(spark, sf):
    golden, links = _inputs(spark, sf)
    return graph.document_entity_graph(golden, _spotted(spark, sf), links)


@query("document_entity_graph_neighbours", with_inputs("golden links doc_entity", GRAPHED, CLASSED.format(more=NEIGHBOURS)))
def _(spark, sf):
    golden, links = _inputs(spark, sf)
    return graph.document_entity_graph(golden, _spotted(spark, sf), links, with_neighbours=True)


@query("centrality_report")
def _(spark, sf):
    out = graph.document_report(*_inputs(spark, sf))
    return out.select("doc_id", "variant", "node", *[round9(c, 6).alias(c) for c in out.columns[3:]])


UNDIRECTED = (
    "step AS MATERIALIZED (SELECT * FROM near WHERE node <> other), "
    "hop(doc_id, variant, src, dst, d) USING KEY (doc_id, variant, src, dst) AS (SELECT DISTINCT doc_id, variant, node, node, 0 FROM near UNION "
    "SELECT DISTINCT h.doc_id, h.variant, h.src, e.other, h.d + 1 FROM hop h JOIN step e ON e.doc_id = h.doc_id AND e.variant = h.variant AND e.node = h.dst "
    "LEFT JOIN recurring.hop k ON k.doc_id = h.doc_id AND k.variant = h.variant AND k.src = h.src AND k.dst = e.other WHERE k.d IS NULL), "
    "ways(doc_id, variant, src, dst, d, n) AS (SELECT doc_id, variant, src, dst, d, 1.0::DOUBLE FROM hop WHERE d = 0 UNION ALL "
    "SELECT w.doc_id, w.variant, w.src, e.other, w.d + 1, sum(w.n) FROM ways w JOIN step e ON e.doc_id = w.doc_id AND e.variant = w.variant AND e.node = w.dst "
    "JOIN hop h ON h.doc_id = w.doc_id AND h.variant = w.variant AND h.src = w.src AND h.dst = e.other AND h.d = w.d + 1 GROUP BY ALL), "
    "way AS MATERIALIZED (SELECT * FROM ways), "
    "between AS MATERIALIZED (SELECT a.doc_id, a.variant, a.dst AS node, sum(a.n * b.n / c.n) AS x FROM way a JOIN way b ON b.doc_id = a.doc_id AND b.variant = a.variant AND b.src = a.dst AND b.d > 0 "
    "JOIN way c ON c.doc_id = a.doc_id AND c.variant = a.variant AND c.src = a.src AND c.dst = b.dst AND c.d = a.d + b.d WHERE a.d > 0 GROUP BY ALL), "
    "deg AS MATERIALIZED (SELECT doc_id, variant, node, sum(CASE WHEN node = other THEN 2 ELSE 1 END) AS links FROM near GROUP BY ALL), "
    "num AS MATERIALIZED (SELECT doc_id, variant, count(*) AS n FROM deg GROUP BY ALL), "
    "rch AS MATERIALIZED (SELECT doc_id, variant, src AS node, sum(d) AS far, count(*) AS reached FROM way WHERE d > 0 GROUP BY ALL)"
)


@query("centrality_measures", with_inputs("golden links",
       "SELECT deg.doc_id, deg.variant, deg.node, round(CASE WHEN n > 1 THEN links / (n - 1) ELSE 1 END, 6) AS degree_centrality, "
       "round(coalesce(reached / far * reached / (n - 1), 0), 6) AS closeness_centrality, round(CASE WHEN n > 2 THEN coalesce(x, 0) / ((n - 1) * (n - 2)) ELSE 0 END, 6) AS betweenness_centrality "
       "FROM deg JOIN num USING (doc_id, variant) LEFT JOIN rch USING (doc_id, variant, node) LEFT JOIN between USING (doc_id, variant, node)",
       EDGES + ", " + NEAR + ", " + UNDIRECTED, recursive=True))
def _(spark, sf):
    """Degree, closeness and betweenness of all variants; eigenvector_facts checks the eigenvector."""
    out = graph.document_centralities(*_inputs(spark, sf))
    return out.select("doc_id", "variant", "node", *[round9(c, 6).alias(c) for c in out.columns[3:]])


@query("light_heavy_features")
def _(spark, sf):
    """Both feature groups of the judged documents' entities, joined per entity of the expanded graph."""
    golden, links = _inputs(spark, sf)
    light_rows = light.light_features(inputs.docs(spark, sf), inputs.mentions(spark, sf), kb.entity_degrees(links))
    return matrix.combine_light_heavy(light_rows, graph.heavy_features(golden, links))
