"""Graph measures against brute force on small graphs."""

import itertools
import math
import random

import numpy as np
import pytest

from standout.functions import paths
from standout.operators import graph, kb


def edges_of(spark, arcs, doc=1, variant="v0"):
    rows = [(doc, variant, a, b, w) for a, b, w in arcs]
    return spark.createDataFrame(rows, "doc_id long, variant string, src long, dst long, w long")


def links_of(spark, arcs):
    return spark.createDataFrame([(a, b, 1) for a, b in arcs], "src long, dst long, n long")


def test_induced_graph_keeps_link_direction(spark):
    candidates = spark.createDataFrame([(1, 10), (1, 20)], "doc_id long, entity_id long")
    links = links_of(spark, [(10, 20), (20, 30)])
    assert [(r["src"], r["dst"], r["w"]) for r in graph.induced_graph_v0(candidates, links).collect()] == [(10, 20, 1)]
    v1 = {(r["src"], r["dst"]): r["w"] for r in graph.expand_graph_v1(candidates, links).collect()}
    assert v1 == {(20, 10): 2, (30, 20): 1}


def test_relatedness(spark):
    links = links_of(spark, [(1, 10), (2, 10), (3, 10), (2, 20), (3, 20)])
    pairs = spark.createDataFrame([(10, 20), (10, 99)], "a long, b long")
    got = {r["b"]: r["relatedness"] for r in graph.relatedness(pairs, links).collect()}
    assert got[20] == pytest.approx((math.log2(3) - math.log2(2)) / (math.log2(5) - math.log2(2)))
    assert got[99] == pytest.approx(math.log2(3) / math.log2(5))


def random_arcs(seed, n=12, m=26):
    rnd = random.Random(seed)
    return sorted({(a, b): (a, b, rnd.randint(1, 2)) for a, b in [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] if a != b}.values())


def test_shortest_paths_match_floyd_warshall(spark):
    arcs = random_arcs(3)
    nodes = sorted({x for a, b, _ in arcs for x in (a, b)})
    d = {(a, b): (0 if a == b else math.inf) for a in nodes for b in nodes}
    for a, b, w in arcs:
        d[a, b] = min(d[a, b], w)
    for k, a, b in itertools.product(nodes, nodes, nodes):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    edges = edges_of(spark, arcs)
    paths = graph.shortest_paths(edges)
    assert {(r["src"], r["dst"]): r["d"] for r in paths.collect()} == {k: v for k, v in d.items() if v < math.inf and k[0] != k[1]}
    far = {r["node"]: r["farness"] for r in graph.farness(edges, paths).collect()}
    for x in nodes:
        want = sum(v for (a, b), v in d.items() if v < math.inf and x == a) + sum(v for (a, b), v in d.items() if v < math.inf and x == b)
        assert far[x] == want


def test_eigenvector_solves_its_equation(spark):
    path = [(i, i + 1, 1) for i in range(60)]
    edges = edges_of(spark, random_arcs(5)).unionByName(edges_of(spark, [(1, 2, 1), (2, 3, 1)], doc=2))
    edges = edges.unionByName(edges_of(spark, path, doc=3))
    got = {(r["doc_id"], r["node"]): r["centrality"] for r in graph.eigenvector_centrality(edges).collect()}
    near = {}
    for r in edges.collect():
        near.setdefault((r["doc_id"], r["src"]), set()).add(r["dst"])
        near.setdefault((r["doc_id"], r["dst"]), set()).add(r["src"])
    assert set(got) == set(near)
    for doc in (1, 2, 3):
        x = {n: v for (d, n), v in got.items() if d == doc}
        assert sum(v * v for v in x.values()) == pytest.approx(1.0)
        image = {n: sum(x[m] for m in near[doc, n]) for n in x}
        value = sum(image[n] * x[n] for n in x)
        assert max(abs(image[n] - value * x[n]) for n in x) < 1e-6
    assert got[2, 2] == pytest.approx(math.sqrt(0.5))
    assert got[3, 30] == pytest.approx(math.sqrt(2 / 62), abs=1e-6)


def test_unfinished_eigenvector_is_an_error(spark):
    with pytest.raises(Exception, match="no eigenvector"):
        graph.eigenvector_centrality(edges_of(spark, [(i, i + 1, 1) for i in range(60)]), max_rounds=8).collect()


def test_paths_have_no_round_limit(spark):
    paths = graph.shortest_paths(edges_of(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1)]))
    assert paths.agg({"d": "max"}).first()[0] == 5


def brute_betweenness(nodes, near):
    def dist(s):
        d, todo = {s: 0}, [s]
        for x in todo:
            for y in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    todo.append(y)
        return d

    d = {s: dist(s) for s in nodes}

    def count(s, t):
        if s == t:
            return 1
        return sum(count(s, y) for y in near[t] if d[s].get(y, -1) == d[s][t] - 1)

    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        if t not in d[s]:
            continue
        for v in nodes:
            if v not in (s, t) and v in d[s] and t in d[v] and d[s][v] + d[v][t] == d[s][t]:
                out[v] += count(s, v) * count(v, t) / count(s, t)
    n = len(nodes)
    return {v: b / ((n - 1) * (n - 2)) for v, b in out.items()}


def test_centrality_report(spark):
    arcs = [(a, b, 1) for a, b, _ in random_arcs(8, n=9, m=12)]
    near = {}
    for a, b, _ in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = brute_betweenness(sorted(near), near)
    rows = {r["node"]: r for r in graph.centrality_report(edges_of(spark, arcs)).collect()}
    for node, value in want.items():
        assert rows[node]["betweenness_centrality"] == pytest.approx(value)
        assert rows[node]["degree_centrality"] == pytest.approx(len(near[node]) / (len(near) - 1))
    assert np.isfinite([r["closeness_centrality"] for r in rows.values()]).all()


def test_heavy_features_have_36_columns_and_zero_missing_variants(spark):
    candidates = spark.createDataFrame([(1, 10), (1, 20)], "doc_id long, entity_id long")
    links = links_of(spark, [(10, 20), (20, 30)])
    rows = {r["entity_id"]: r.asDict() for r in graph.heavy_features(candidates, links).collect()}
    assert sorted(rows) == [10, 20, 30] and len(rows[10]) == 38
    assert rows[30]["v0_node_degree"] == 0 and rows[30]["v0_closeness"] == 0 and rows[30]["v0_graph_size"] == 2
    assert rows[20]["v1_node_degree"] == 3 and rows[10]["v1_farness"] == 5
    zeroed = graph.heavy_features(candidates, links, zero=[0]).first()
    assert zeroed["v1_graph_size"] == 0


def test_degrees_count_parallel_links(spark):
    links = spark.createDataFrame([(1, 2, 3), (2, 3, 1)], "src long, dst long, n long")
    got = {r["entity_id"]: tuple(r)[1:] for r in kb.entity_degrees(links).collect()}
    assert got == {1: (0, 3, 3), 2: (3, 1, 4), 3: (1, 0, 1)}


def random_documents(spark, seed=4):
    rnd = random.Random(seed)
    candidates = [(d, rnd.randrange(30)) for d in range(12) for _ in range(rnd.randint(1, 9))] + [(99, 500)]
    links = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(90)]
    return spark.createDataFrame(candidates, "doc_id long, entity_id long").repartition(3), links_of(spark, links + [(5, 5), (7, 8), (8, 7)])


def table_of(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_measures_of_a_documents_graphs_are_those_of_the_edges(spark, monkeypatch):
    candidates, links = random_documents(spark)
    edges = graph.all_variants(candidates, links)
    assert {r["variant"] for r in edges.collect()} == set(graph.VARIANTS)
    paths = graph.shortest_paths(edges)
    assert table_of(graph.document_paths(candidates, links)) == table_of(paths)
    assert table_of(graph.document_diameters(candidates, links)) == table_of(graph.diameter(paths))
    assert table_of(graph.document_farness(candidates, links)) == table_of(graph.farness(edges, paths))
    assert table_of(graph.document_report(candidates, links), 6) == table_of(graph.centrality_report(edges), 6)
    assert table_of(graph.document_centralities(candidates, links)) == table_of(graph.undirected_measures(edges))
    assert table_of(graph.document_eigenvectors(candidates, links), 6) == table_of(graph.eigenvector_centrality(edges), 6)
    heavy = {(r["doc_id"], r["entity_id"]): r for r in graph.heavy_features(candidates, links).collect()}
    wide = {(r["doc_id"], r["variant"]): r for r in graph.degree_ratios(edges).collect()}
    for r in graph.node_degree(edges).join(graph.farness(edges, paths), [*graph.GRAPH, "node"]).collect():
        row, whole = heavy[r["doc_id"], r["node"]], wide[r["doc_id"], r["variant"]]
        assert (row[f"{r['variant']}_node_degree"], row[f"{r['variant']}_farness"]) == (r["degree"], r["farness"])
        assert row[f"{r['variant']}_closeness"] == pytest.approx(r["closeness"])
        assert [row[f"{r['variant']}_{c}"] for c in list(whole.asDict())[2:]] == pytest.approx(list(whole)[2:])
    assert table_of(graph.document_degrees(candidates, links)) == table_of(graph.node_degree(edges))
    assert table_of(graph.document_sizes(candidates, links)) == table_of(graph.graph_size(edges))
    assert table_of(graph.document_ratios(candidates, links)) == table_of(graph.degree_ratios(edges))
    low = [v for v in graph.VARIANTS if "low" in v]
    assert table_of(graph.document_edges(candidates, links)) == table_of(edges)
    assert table_of(graph.document_edges(candidates, links, low)) == table_of(edges.where("variant LIKE '%low%'"))
    together = table_of(graph.document_farness(candidates, links))
    monkeypatch.setattr(graph, "MOST_SENT", 3)  # links that are not sent to the tasks
    assert table_of(graph.document_farness(candidates, links)) == together


def test_links_of_a_document_are_looked_up_in_its_task(spark, monkeypatch):
    candidates, links = random_documents(spark)
    candidates = candidates.unionByName(spark.createDataFrame([(1, None), (None, 3), (200, -4), (201, 10**15)], candidates.schema))
    joined = []
    monkeypatch.setattr(graph, "_document_links", lambda *x, was=graph._document_links: joined.append(1) or was(*x))
    want = table_of(graph.document_links(candidates, links))

    def rows(src, dst, both, kept):
        yield [src, dst, both.astype(np.int8), kept.astype(np.int8)]

    def found():
        got = graph.of_documents(candidates, links, rows, "src long, dst long, both byte, kept byte")
        return sorted((d, a, b, bool(x), bool(y)) for d, a, b, x, y in got.collect())

    joined.clear()
    assert found() == want and not joined
    monkeypatch.setattr(graph, "MOST_SENT", 3)
    assert found() == want and joined


def test_a_task_gives_each_pair_of_its_documents_once(spark, monkeypatch):
    candidates, links = random_documents(spark)
    edges = graph.expand_graph_v1(candidates, links).unionByName(graph.induced_graph_v0(candidates, links))
    want = table_of(edges.select("src", "dst").distinct())
    pairs = graph.document_pairs(candidates.coalesce(1), links.coalesce(1))
    tasks = pairs.rdd.getNumPartitions()
    assert table_of(pairs.distinct()) == want and pairs.count() <= 3 * tasks * links.distinct().count() and pairs.count() < edges.count()
    monkeypatch.setattr(graph, "MOST_SENT", 3)
    assert table_of(graph.document_pairs(candidates, links).distinct()) == want


def test_degrees_of_a_document(spark):
    candidates = spark.createDataFrame([(1, 10), (1, 20)], "doc_id long, entity_id long")
    links = links_of(spark, [(10, 20), (20, 30), (1 << 40, 10)])
    some = {(r["node"], r["variant"]): r["degree"] for r in graph.document_degrees(candidates, links).collect()}
    assert some[20, "v1"] == 3 and some[1 << 40, "v1"] == 1 and some[10, "v0"] == 1
    assert graph.document_sizes(candidates, links.where("src < 0")).count() == 0


@pytest.mark.parametrize("n, m", [(1, 1), (4, 3), (9, 8), (12, 40), (40, 39), (60, 400)])
def test_centralities_from_covering_nodes_are_those_of_the_edges(n, m):
    rng = np.random.default_rng(n + m)
    for _ in range(40):
        _, s, t = paths.indexed(rng.integers(0, n, m), rng.integers(0, n, m) % max(1, n // 3))
        a, b = paths.neighbours(s, t, nodes := max(s.max(), t.max()) + 1)
        a, b = a[a != b], b[a != b]
        cover = paths.covering(a, b, nodes, nodes)
        assert set(a[~np.isin(b, cover)]) <= set(cover.tolist())
        for x, y in zip(paths._by_cover(a, b, nodes, cover), paths._by_edges(a, b, nodes)):
            assert np.allclose(x, y, atol=1e-9)


def test_a_graph_of_two_sides_settles_soon():
    hubs = np.repeat(np.arange(6), 300)
    _, s, t = paths.indexed(hubs, 6 + np.arange(1800) % 301)
    a, b = paths.neighbours(s, t, 307)
    x = paths.leading(a, b, 307, 1e-12, 60)  # without a shift by the degrees it takes hundreds of rounds
    image = np.bincount(a, x[b], 307)
    assert np.abs(image - (image @ x) * x).max() < 1e-9


def test_measures_shuffle_no_edges(spark):
    candidates, links = random_documents(spark)
    rows = graph.document_links(candidates.repartition(4, "doc_id"), links)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 1 and "Sort" not in plan.replace("SortAggregate", "")


@pytest.mark.parametrize("near, sent", [(False, 1 << 20), (True, 1 << 20), (True, 3)])
def test_entities_of_a_document(spark, monkeypatch, near, sent):
    monkeypatch.setattr(graph, "MOST_SENT", sent)
    mentions, links = random_documents(spark)
    golden = mentions.where("(doc_id + entity_id) % 3 = 0").union(spark.createDataFrame([(3, 777), (3, 1)], mentions.schema))
    arcs = {(r["src"], r["dst"]) for r in links.collect()}
    own = {}
    for table, kind in ((golden, "golden"), (mentions, "spotted")):
        for d, e in set(map(tuple, table.collect())):
            own.setdefault(d, {}).setdefault(e, set()).add(kind)
    want = set()
    for d, nodes in own.items():
        kinds = {e: "both" if len(k) == 2 else next(iter(k)) for e, k in nodes.items()}
        if near:
            kinds = {**{x: "neighbour" for a in arcs for x in a if set(a) & set(nodes)}, **kinds}
        edges = {(a, b) for a, b in arcs if a in kinds and b in kinds}
        edges |= {(n, n) for n in kinds if not any(n in a for a in edges)}
        want |= {(d, a, b, kinds[a], kinds[b]) for a, b in edges}
    joined = []
    monkeypatch.setattr(graph, "_met", lambda *x, was=graph._met: joined.append(1) or was(*x))
    got = table_of(graph.document_entity_graph(golden, mentions, links, with_neighbours=near))
    assert got == sorted(want) and bool(joined) == (sent == 3)  # a row for each link of a node only where links are not sent
