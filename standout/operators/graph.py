"""Per-document link graphs and their measures.

Edges are ``doc_id, variant, src, dst, w``: the graphs of all documents and variants are one table, so
each measure is one plan for the whole collection. Measures of paths solve a graph in the task that holds
it; those named ``document_...`` make the graphs of a document there too, from its candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standout.functions import paths
from standout.functions.ordering import union_all
from standout.operators.matrix import GRAPH_MEASURES, HEAVY, VARIANTS
from standout.session import stored

cloudpickle.register_pickle_by_value(paths)  # workers need not have the package

GRAPH = ["doc_id", "variant"]
UNIVERSE = 5  # fixed size of the link universe in the relatedness formula
TINY_DENOMINATOR = 0.001
ISOLATED_CLOSENESS = 100.0
BLOCK = 64  # neighbouring ids of a row of packed in-links
MOST_PER_KEY = 4096  # rows a side of a key that one slice of a split join holds
MOST_SENT = 1 << 20  # links that are sent to all tasks; more are joined in slices
ROUNDS = {"tolerance": 1e-12, "max_rounds": 1_000_000}  # of a power iteration
CENTRALITIES = "node long, degree_centrality double, closeness_centrality double, betweenness_centrality double"
CLASSES = ["both", "golden", "spotted", "neighbour"]
EDGE = ["doc_id", "variant", "src", "dst", "w"]
NODES = ["src", "dst", "node", "entity_id"]  # columns that measures give as nodes


def split_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, most: int = MOST_PER_KEY) -> DataFrame:
    """Inner join on ``key`` in which a key with many rows is split over tasks.

    Where a side has more than ``most`` rows of a key, they are dealt by a hash of the side's own id into slices of about
    that size, and each row of the other side goes to every slice: the same rows come out, and no task meets more than about
    ``most`` rows a side of one key and slice. Rows of a NULL key take no part. Only the keys above ``most`` are listed.
    """

    def slices(side: DataFrame, name: str) -> DataFrame:
        large = side.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        return large.select(key, F.ceil(F.col("_n") / most).cast("int").alias(name))

    parts = slices(left, "_lefts").join(slices(right, "_rights"), key, "full")

    def dealt(side: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(own_id), F.coalesce(own, F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        return side.join(parts, key, "left").select(*side.columns, place.alias(own), F.explode(every).alias(other))

    first, second = dealt(left, "_lefts", left_id, "_rights"), dealt(right, "_rights", right_id, "_lefts")
    return first.join(second, [key, "_lefts", "_rights"]).drop("_lefts", "_rights")


def link_join(nodes: DataFrame, arcs: DataFrame, key: str, node_id: str, arc_id: str) -> DataFrame:
    """Inner join of documents' nodes with link rows on ``key``.

    Up to ``MOST_SENT`` link rows go to every task, so a document's rows stay where they are and no hub of the graph gathers
    them; more are joined by ``split_join``.
    """
    if _sent(arcs):
        return nodes.join(F.broadcast(arcs), key)
    return split_join(nodes, arcs, key, node_id, arc_id)


def _sent(arcs: DataFrame) -> bool:
    return arcs.limit(MOST_SENT + 1).count() <= MOST_SENT


def _chosen(candidates: DataFrame) -> DataFrame:
    """``doc_id, own, entity_id``: a document's different candidates one after the other, each with the list of all."""
    rows = candidates.groupBy("doc_id").agg(F.collect_set("entity_id").alias("own"))
    return rows.select("doc_id", "own", F.explode("own").alias("entity_id"))


def _linked(candidates: DataFrame, arcs: DataFrame) -> DataFrame:
    """``doc_id, both`` and the columns of each link (distinct ``src, dst``) with one end, or both, among the candidates.

    A link of two candidates is met at both and kept at its source, so nothing is grouped.
    """
    ends = arcs.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id"), "*", F.hash("src", "dst").alias("_arc"))
    rows = link_join(_chosen(candidates), ends, "entity_id", "doc_id", "_arc")
    at_source = F.col("src") == F.col("entity_id")
    both = F.coalesce(F.array_contains("own", F.when(at_source, F.col("dst")).otherwise(F.col("src"))), F.lit(False))
    return rows.withColumn("both", both).where(~F.col("both") | at_source).select("doc_id", "both", *arcs.columns)


def expand_graph_v1(candidates: DataFrame, links: DataFrame, unit_weights: bool = False) -> DataFrame:
    """Candidates and one hop: against the link direction, weight 2 where both ends are candidates."""
    found = _linked(candidates, links.select("src", "dst").distinct())
    weight = F.lit(1) if unit_weights else F.when(F.col("both"), 2).otherwise(1)
    return found.select(
        "doc_id", F.lit("v1").alias("variant"), F.col("dst").alias("src"), F.col("src").alias("dst"), weight.cast("long").alias("w")
    )


def induced_graph_v0(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Links with both ends among the candidates, in link direction, weight 1."""
    both = _linked(candidates, links.select("src", "dst").distinct()).where("both")
    return both.select("doc_id", F.lit("v0").alias("variant"), "src", "dst", F.lit(1).cast("long").alias("w"))


def relatedness(pairs: DataFrame, links: DataFrame, total: int = UNIVERSE) -> DataFrame:
    """Link relatedness of distinct pairs ``a, b``; NULL where one end has no in-links at all.

    Common sources are looked up from the end with fewer in-links, so a hub is never unfolded for the sake of a small
    partner. Sources are packed, 64 neighbouring ids a row, and common ones are the set bits of both; the rows of an end
    that is looked up often, or has many sources, are split.
    """
    arcs = links.select("src", "dst").distinct()
    sizes = arcs.groupBy("dst").agg(F.count("*").alias("n"))
    rows = pairs.select("a", "b").distinct()
    rows = rows.join(sizes.select(F.col("dst").alias("a"), F.col("n").alias("na")), "a", "left")
    rows = rows.join(sizes.select(F.col("dst").alias("b"), F.col("n").alias("nb")), "b", "left")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    rows = rows.select(
        "a", "b", na.alias("na"), nb.alias("nb"),
        F.when(na <= nb, F.col("a")).otherwise(F.col("b")).alias("few"),
        F.when(na <= nb, F.col("b")).otherwise(F.col("a")).alias("many"),
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("src").bitwiseAND(BLOCK - 1).cast("int"))
    packed = arcs.groupBy("dst", F.floor(F.col("src") / F.lit(BLOCK)).alias("block")).agg(F.bit_or(bit).alias("bits"))
    few = packed.withColumnsRenamed({"dst": "few", "bits": "few_bits"})
    shared = split_join(rows.select("a", "b", "few", "many"), few, "few", "many", "block")
    shared = shared.join(packed.withColumnsRenamed({"dst": "many", "bits": "many_bits"}), ["many", "block"])
    both = F.bit_count(F.col("few_bits").bitwiseAND(F.col("many_bits")))
    shared = shared.groupBy("a", "b").agg(F.sum(both).alias("common"))
    rows = rows.join(shared, ["a", "b"], "left")

    def bits(c: Column) -> Column:
        return F.log2(c.cast("double"))

    one = F.lit(1)
    top = F.when(F.greatest("na", "nb") > 0, bits(F.greatest("na", "nb")) - bits(F.greatest(F.coalesce("common", F.lit(0)), one)))
    smaller = F.greatest(one, F.least("na", "nb"))
    bottom = F.when(smaller == total, TINY_DENOMINATOR).otherwise(bits(F.lit(total)) - bits(smaller))
    return rows.select("a", "b", (top / bottom).alias("relatedness"))


def drop_low_relatedness(edges: DataFrame, links: DataFrame, total: int = UNIVERSE) -> DataFrame:
    """Edges of positive relatedness, as their own variant. Each pair is computed once for all documents."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    kept = relatedness(pairs, links, total).where("relatedness > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    kept = stored(kept, "related")  # its size is known, so the edges are not shuffled for a small one
    out = edges.join(kept, ["src", "dst"], "left_semi")
    return out.withColumn("variant", F.concat("variant", F.lit("_minus_low_relatedness"))).select(*EDGE)


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge with the weight going out and coming in."""
    zero = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("src").alias("node"), F.col("w").alias("o"), zero.alias("i")),
        F.struct(F.col("dst").alias("node"), zero.alias("o"), F.col("w").alias("i")),
    )
    return edges.select(*GRAPH, F.explode(both).alias("e")).select(*GRAPH, "e.*")


def node_degree(edges: DataFrame) -> DataFrame:
    """Weighted in, out and total degree of each node, zeros filled."""
    return ends(edges).groupBy(*GRAPH, "node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree")
    )


def degree_ratios(edges: DataFrame) -> DataFrame:
    """Nodes, and mean over median of the in, out and total degree; 0 where the median is 0."""

    def ratio(c: str) -> Column:
        return F.when(F.median(c) != 0, F.avg(c) / F.median(c)).otherwise(0.0)

    return node_degree(edges).groupBy(*GRAPH).agg(
        F.count("*").alias("graph_size"),
        ratio("in_degree").alias("in_degree_mean_median_ratio"),
        ratio("out_degree").alias("out_degree_mean_median_ratio"),
        ratio("degree").alias("degree_mean_median_ratio"),
    )


def graph_size(edges: DataFrame) -> DataFrame:
    return node_degree(edges).groupBy(*GRAPH).agg(F.count("*").alias("graph_size"))


def _typed(columns: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "byte": pa.int8(), "string": pa.string()}
    pairs = [c.split() for c in columns.split(", ")]
    return [n for n, _ in pairs], [kinds[k] for _, k in pairs]


def of_graphs(edges: DataFrame, measure: Callable, columns: str) -> DataFrame:
    """``doc_id, variant`` and the columns of a measure of each graph, solved in one task."""
    schema = f"doc_id long, variant string, {columns}"
    names, kinds = _typed(schema)
    solve = partial(paths.of_graph, measure=measure, names=names, kinds=kinds)

    def solved(table: pa.Table) -> pa.Table:
        return solve(table)

    return edges.select(*EDGE).groupBy(*GRAPH).applyInArrow(solved, schema)


def by_document(rows: DataFrame, solve: Callable, columns: str) -> DataFrame:
    """``doc_id`` and the columns that ``solve`` makes of each document's rows; these follow each other."""
    schema = f"doc_id long, {columns}"
    names, kinds = _typed(schema)
    run = partial(paths.by_document, solve=solve, names=names, kinds=kinds)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    return rows.mapInArrow(solved, schema)


def _arcs(links: DataFrame) -> DataFrame:
    """Distinct ``src, dst, kept``: each link, and whether its ends are related. Stored."""
    pairs = links.select("src", "dst").distinct()
    low, high = F.least("src", "dst"), F.greatest("src", "dst")  # relatedness is the same in both directions
    related = relatedness(pairs.select(low.alias("a"), high.alias("b")), links).where("relatedness > 0")
    related = related.select("a", "b", F.lit(True).alias("kept"))
    arcs = pairs.join(related, (low == F.col("a")) & (high == F.col("b")), "left")
    return stored(arcs.select("src", "dst", F.coalesce("kept", F.lit(False)).alias("kept")), "arcs")


def document_links(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, src, dst, both, kept``: each link of a document's candidates, whether both ends are, and whether they are related.

    The four graphs of ``all_variants`` in one row a link. A document's rows follow each other: candidates are gathered per
    document and meet the links in their own task, so no edge is shuffled, sorted or stored.
    """
    return _document_links(candidates, _arcs(links))


def _document_links(candidates: DataFrame, arcs: DataFrame) -> DataFrame:
    rows = _linked(candidates.where("doc_id IS NOT NULL"), arcs)
    return _gathered(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "src", "dst", "both", "kept"), arcs)


def of_documents(candidates: DataFrame, links: DataFrame, solve: Callable, columns: str) -> DataFrame:
    """``doc_id`` and the columns that ``solve`` makes of each document's ``src, dst, both, kept``; see ``document_links``.

    Up to ``MOST_SENT`` links are sent to the tasks as arrays and a document's are looked up from its candidates there, so no row is made
    for a link of a document; with more, or with ends that are NULL, documents and links are joined.
    """
    arcs = _arcs(links)
    index = _index(arcs)
    if index is None:
        return by_document(_document_links(candidates, arcs), solve, columns)
    ends = [k for k, c in enumerate(_typed(columns)[0]) if c in NODES]
    return by_document(_own(candidates), partial(paths.of_candidates, index=index, solve=solve, ends=ends), columns)


def _own(candidates: DataFrame) -> DataFrame:
    """``doc_id, own``: a document's different candidates one after the other."""
    rows = _chosen(candidates.where("doc_id IS NOT NULL"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("entity_id").cast("long").alias("own"))


def _index(arcs: DataFrame) -> Callable | None:
    """What gives tasks the ``link_index`` of ``src, dst, kept``; None for more than ``MOST_SENT`` links, or ends that are NULL."""
    table = arcs.limit(MOST_SENT + 1).toArrow()
    if table.num_rows > MOST_SENT or any(table.column(c).null_count for c in ("src", "dst")):
        return None
    index = paths.link_index(*(table.column(c).to_numpy() for c in ("src", "dst", "kept")))
    return partial(getattr, arcs.sparkSession.sparkContext.broadcast(index), "value")


def _gathered(rows: DataFrame, arcs: DataFrame) -> DataFrame:
    """Rows joined with links, a document's one after the other: they are, if the links were sent to the tasks."""
    return rows if _sent(arcs) else rows.repartition("doc_id").sortWithinPartitions("doc_id")


def _measured(candidates: DataFrame, links: DataFrame, measure: Callable, columns: str) -> DataFrame:
    """``doc_id, variant`` and the columns of a measure of the four graphs of each document."""
    solve = paths.measured(paths.variants, partial(paths.each, measure=measure))
    rows = of_documents(candidates, links, solve, f"code byte, {columns}")
    return _named(rows)


def _named(rows: DataFrame) -> DataFrame:
    """The name of the variant instead of its number ``code``."""
    variant = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), F.col("code") + 1).alias("variant")
    return rows.select("doc_id", variant, *rows.columns[2:])


def document_edges(candidates: DataFrame, links: DataFrame, wanted: Sequence[str] = tuple(VARIANTS)) -> DataFrame:
    """The wanted graphs of ``all_variants`` as one edge table."""
    solve = paths.measured(paths.some([VARIANTS.index(v) for v in wanted]), partial(paths.each, measure=paths.edges))
    return _named(of_documents(candidates, links, solve, "code byte, src long, dst long, w long"))


def document_pairs(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b`` of the edges of all expanded and induced graphs, for ``relatedness``. A task gives each pair that its documents have once."""
    index = _index(links.select("src", "dst").distinct().withColumn("kept", F.lit(False)))
    if index is None:
        both = expand_graph_v1(candidates, links).unionByName(induced_graph_v0(candidates, links))
        return both.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    run = partial(paths.pairs_met, index=index)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    return _own(candidates).mapInArrow(met, "a long, b long")


def document_degrees(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``node_degree`` of the four graphs of each document."""
    return _measured(candidates, links, paths.degrees, "node long, in_degree long, out_degree long, degree long")


def document_sizes(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``graph_size`` of the four graphs of each document."""
    return _measured(candidates, links, paths.size, "graph_size long")


def document_ratios(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``degree_ratios`` of the four graphs of each document."""
    kinds = [f"{c}_mean_median_ratio double" for c in ("in_degree", "out_degree", "degree")]
    return _measured(candidates, links, paths.ratios, ", ".join(["graph_size long", *kinds]))


def document_paths(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``shortest_paths`` of the four graphs of each document."""
    return _measured(candidates, links, paths.shortest_paths, "src long, dst long, d long")


def document_diameters(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``diameter`` of the four graphs of each document."""
    return _measured(candidates, links, paths.diameter, "graph_diameter long")


def document_farness(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``farness`` of the four graphs of each document."""
    return _measured(candidates, links, paths.farness, "node long, farness long").withColumn("closeness", _closeness())


def document_eigenvectors(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``eigenvector_centrality`` of the four graphs of each document."""
    return _measured(candidates, links, partial(paths.eigenvector, **ROUNDS), "node long, centrality double")


def document_eigenvector_facts(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes, norm, least, rest`` of the eigenvectors of each document's graphs; see ``paths.eigenvector_facts``."""
    return _measured(candidates, links, partial(paths.eigenvector_facts, **ROUNDS), "nodes long, norm double, least double, rest double")


def document_centralities(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``undirected_measures`` of the four graphs of each document."""
    return _measured(candidates, links, paths.centralities, CENTRALITIES)


def document_report(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``centrality_report`` of the four graphs of each document."""
    return _measured(candidates, links, partial(paths.report, **ROUNDS), f"{CENTRALITIES}, eigenvector_centrality double")


def shortest_paths(edges: DataFrame) -> DataFrame:
    """All finite directed distances between different nodes of each graph: ``src, dst, d``."""
    return of_graphs(edges, paths.shortest_paths, "src long, dst long, d long")


def diameter(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*GRAPH).agg(F.max("d").alias("graph_diameter"))


def farness(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Per node the distances from it and to it, and the reciprocal; an unreached node counts 100."""
    both = F.explode(F.array("src", "dst"))
    sums = paths.select(*GRAPH, "d", both.alias("node")).groupBy(*GRAPH, "node").agg(F.sum("d").alias("farness"))
    nodes = ends(edges).select(*GRAPH, "node").distinct()
    rows = nodes.join(sums, [*GRAPH, "node"], "left").withColumn("farness", F.coalesce("farness", F.lit(0)))
    return rows.withColumn("closeness", _closeness())


def _closeness() -> Column:
    return F.when(F.col("farness") != 0, 1.0 / F.col("farness")).otherwise(ISOLATED_CLOSENESS)


def eigenvector_centrality(edges: DataFrame, tolerance: float = 1e-12, max_rounds: int = 1_000_000) -> DataFrame:
    """Leading eigenvector of the undirected unweighted graph, unit length, positive sum.

    Each graph is solved inside one task by power iteration over its edges, from the constant vector and with one added to
    the diagonal, so that graphs of two sides settle too. The limit is the part of the constant vector in the leading
    eigenspace. Reaching the round limit is an error, never an unfinished vector.
    """
    measure = partial(paths.eigenvector, tolerance=tolerance, max_rounds=max_rounds)
    return of_graphs(edges, measure, "node long, centrality double")


def all_variants(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The four graphs of each document as one edge table."""
    v1, v0 = expand_graph_v1(candidates, links), induced_graph_v0(candidates, links)
    whole = v1.unionByName(v0)
    return union_all([whole, drop_low_relatedness(whole, links)])


def heavy_features(candidates: DataFrame, links: DataFrame, zero: Sequence[int] = ()) -> DataFrame:
    """36 columns for each entity of a document's expanded graph; 0 where a variant lacks the entity.

    Positions in ``zero`` (0..8) are set to 0 in each variant. A document's graphs are measured in the task that holds it.
    """
    names = [list(GRAPH_MEASURES) for _ in VARIANTS]
    solve = paths.measured(paths.variants, partial(paths.heavy, names=names, isolated=ISOLATED_CLOSENESS, **ROUNDS))
    rows = of_documents(candidates, links, solve, ", ".join(["entity_id long", *[f"{c} double" for c in HEAVY]]))
    masked = {f"{v}_{m}" for v in VARIANTS for i, m in enumerate(GRAPH_MEASURES) if i in zero}
    columns = [(F.lit(0.0) if c in masked else F.col(c)).alias(c) for c in HEAVY]
    return rows.select("doc_id", "entity_id", *columns)


def document_entity_graph(
    golden: DataFrame, mentions: DataFrame, links: DataFrame, with_neighbours: bool = False
) -> DataFrame:
    """``doc_id, src, dst, src_class, dst_class``: links among a document's entities.

    Classes are golden, spotted, both or neighbour; a node without links points to itself.
    """
    g = golden.select("doc_id", "entity_id", F.lit(1).alias("g"), F.lit(0).alias("s"))
    s = mentions.select("doc_id", "entity_id", F.lit(0).alias("g"), F.lit(1).alias("s"))
    kinds = g.unionByName(s).groupBy("doc_id", "entity_id").agg(F.max("g").alias("g"), F.max("s").alias("s"))
    kind = F.when((F.col("g") == 1) & (F.col("s") == 1), 0).when(F.col("g") == 1, 1).otherwise(2).cast("byte").alias("kind")
    nodes = kinds.select("doc_id", F.col("entity_id").alias("node"), kind)
    label = F.array(*[F.lit(c) for c in CLASSES])
    pairs = stored(links.select("src", "dst").distinct(), "pairs")
    forth = pairs.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    back = pairs.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    fresh = len(CLASSES) - 1
    known = nodes.where("doc_id IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct("node", "kind")).alias("own"))
    known = known.select("doc_id", F.inline("own"))
    lost = nodes.where("doc_id IS NULL")  # rows without a document are linked to nothing
    index = _index(pairs.select("src", "dst", F.lit(False).alias("kept")))
    if with_neighbours and index is None:
        known = by_document(_met(known, forth.unionByName(back)), partial(paths.widened, fresh=fresh), "node long, kind byte")
    if with_neighbours:
        far = link_join(lost, forth.unionByName(back), "node", "kind", "other").select("doc_id", F.col("other").alias("node")).distinct()
        lost = lost.unionByName(far.withColumn("kind", F.lit(fresh).cast("byte")))
    columns = "src long, dst long, src_kind byte, dst_kind byte"
    if index is None:
        edges = by_document(_met(known, forth), paths.classed, columns)
    else:
        own = known.select("doc_id", F.col("node").cast("long").alias("node"), "kind")
        edges = by_document(own, partial(paths.entity_links, index=index, fresh=fresh if with_neighbours else None), columns)
    edges = edges.unionByName(
        lost.select("doc_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.col("kind").alias("src_kind"), F.col("kind").alias("dst_kind"))
    )
    named = [F.element_at(label, F.col(f"{s}_kind") + 1).alias(f"{s}_class") for s in ("src", "dst")]
    return edges.select("doc_id", "src", "dst", *named)


def _met(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``doc_id, node, kind, other, linked``: the nodes, a document's one after the other, with each of their links, or one row without."""
    if _sent(arcs):
        rows = nodes.join(F.broadcast(arcs), "node", "left")
    else:
        rows = link_join(nodes, arcs, "node", "doc_id", "other").unionByName(nodes.withColumn("other", F.lit(None).cast("long")))
    linked = F.col("other").isNotNull()
    return _gathered(rows.select("doc_id", "node", "kind", F.coalesce("other", F.lit(-1)).alias("other"), linked.alias("linked")), arcs)


def undirected_measures(edges: DataFrame) -> DataFrame:
    """Degree, closeness and betweenness centrality of undirected graphs."""
    return of_graphs(edges, paths.centralities, CENTRALITIES)


def centrality_report(edges: DataFrame) -> DataFrame:
    """The undirected measures and eigenvector centrality."""
    return of_graphs(edges, partial(paths.report, **ROUNDS), f"{CENTRALITIES}, eigenvector_centrality double")
