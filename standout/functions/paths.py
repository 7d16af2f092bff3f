"""Measures of one graph, given as arrays of its edges, for tasks that hold one document's graphs at a time.

A document's graph has no more edges than the link table. Sources are worked on in blocks, so memory is bounded by its nodes and edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Values of a block of sources that are worked on at once.
CELLS = 1 << 20
#: Rows that a task hands over at once.
ROWS = 1 << 16
#: Values of a matrix of covering nodes by all nodes, as a multiple of the edges and at most, up to which paths go by matrices.
DENSE, MOST_CELLS = 16, 1 << 22
Arrays = list[np.ndarray]


def indexed(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes in ascending order, and the place of each edge's ends among them; small numbers are marked instead of sorted."""
    if len(src) and min(src.min(), dst.min()) >= 0 and max(src.max(), dst.max()) <= 16 * len(src):
        marks = np.zeros(max(src.max(), dst.max()) + 1, bool)
        marks[src] = marks[dst] = True
        place = np.cumsum(marks) - 1
        return np.flatnonzero(marks), place[src], place[dst]
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return nodes, at[: len(src)], at[len(src) :]


def neighbours(s: np.ndarray, t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(node, other)`` in both directions, in the order of nodes."""
    if n * n <= 32 * len(s):
        marks = np.zeros((n, n), bool)
        marks[s, t] = marks[t, s] = True
        return np.nonzero(marks)
    return np.divmod(np.unique(np.concatenate([s * n + t, t * n + s])), n)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))


def levels(s: np.ndarray, t: np.ndarray, w: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first, d, reached)``: for a block of sources from number ``first``, which nodes (rows) they first reach at distance ``d``.

    A node's row packs the sources of a block, 64 to a word. Level ``d`` is made from the levels ``d - w`` along the edges of
    weight ``w``, whole numbers from 1, ORed per node, less what was reached before.
    """
    steps = []
    for weight in np.unique(w[w > 0]).tolist():
        pick = np.flatnonzero(w == weight)
        pick = pick[np.argsort(t[pick], kind="stable")]
        begin = starts_of(t[pick])
        steps.append((weight, s[pick], begin, t[pick][begin]))
    far = max((x[0] for x in steps), default=0)
    size = 64 * max(1, CELLS // max(len(s), 8 * n))
    for first in range(0, n, size):
        own = np.arange(min(size, n - first))
        seen = np.zeros((n, -(-len(own) // 64)), np.uint64)
        seen[first + own, own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
        recent, d = {0: seen.copy()}, 0
        while recent:
            d += 1
            new = np.zeros_like(seen)
            for weight, tails, begin, heads in steps:
                if d - weight in recent:
                    new[heads] |= np.bitwise_or.reduceat(recent[d - weight][tails], begin, axis=0)
            new &= ~seen
            recent = {at: x for at, x in recent.items() if d + 1 - at <= far}
            if new.any():
                seen |= new
                recent[d] = new
                yield first, d, new


def unpacked(reached: np.ndarray, sources: int) -> np.ndarray:
    """A column of 0 and 1 for each source of a level."""
    return np.unpackbits(reached.view(np.uint8), axis=1, bitorder="little")[:, :sources]


def shortest_paths(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """``src, dst, d`` of all finite distances between different nodes."""
    nodes, s, t = indexed(src, dst)
    n = len(nodes)
    for first, d, reached in levels(s, t, w, n):
        node, source = np.nonzero(unpacked(reached, n - first))
        yield [nodes[first + source], nodes[node], np.full(len(node), d, np.int64)]


def _farness(s: np.ndarray, t: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    far, most = np.zeros(n, np.int64), 0
    for first, d, reached in levels(s, t, w, n):
        far += d * np.bitwise_count(reached).sum(axis=1, dtype=np.int64)
        from_source = unpacked(reached, n - first)
        for low in range(0, n, 255):  # sums of bytes that fit a byte
            far[first : first + from_source.shape[1]] += d * from_source[low : low + 255].sum(axis=0, dtype=np.uint8).astype(np.int64)
        most = max(most, d)
    return far, most


def farness(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """``node, farness``: the distances from a node and to it."""
    nodes, s, t = indexed(src, dst)
    yield [nodes, _farness(s, t, w, len(nodes))[0]]


def diameter(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """The largest finite distance; no row for a graph without paths."""
    nodes, s, t = indexed(src, dst)
    most = max((d for _, d, _ in levels(s, t, w, len(nodes))), default=0)
    if most:
        yield [np.array([most], np.int64)]


def leading(a: np.ndarray, b: np.ndarray, n: int, tolerance: float, max_rounds: int) -> np.ndarray:
    """Leading eigenvector of neighbours ``a, b``, in the order of ``a``, by power iteration.

    A third of the root mean square degree, and one at least, is added to the diagonal: a graph of nearly two sides has an eigenvalue
    close to minus its largest, which would die out slowly. The limit is the same.
    """
    begin = starts_of(a)
    shift = max(1.0, np.sqrt(np.square(np.diff(begin, append=len(a)).astype(float)).mean()) / 3)
    x = np.full(n, 1 / np.sqrt(n))
    for _ in range(max_rounds):
        y = shift * x + np.add.reduceat(x[b], begin)
        y /= np.sqrt(y @ y)
        step, x = np.abs(y - x).max(), y
        if step < tolerance:
            return x
    raise RuntimeError(f"no eigenvector after {max_rounds} rounds")


def eigenvector(src: np.ndarray, dst: np.ndarray, w: np.ndarray, tolerance: float, max_rounds: int) -> Iterator[Arrays]:
    """``node, centrality``."""
    nodes, s, t = indexed(src, dst)
    a, b = neighbours(s, t, len(nodes))
    yield [nodes, leading(a, b, len(nodes), tolerance, max_rounds)]


def eigenvector_facts(src: np.ndarray, dst: np.ndarray, w: np.ndarray, tolerance: float, max_rounds: int) -> Iterator[Arrays]:
    """``nodes, norm, least, rest``: the vector's length, its least part, and the most by which neighbours miss the value times a part."""
    nodes, s, t = indexed(src, dst)
    a, b = neighbours(s, t, len(nodes))
    x = leading(a, b, len(nodes), tolerance, max_rounds)
    image = np.bincount(a, x[b], len(nodes))
    rest = np.abs(image - (image @ x) * x).max()
    yield [np.array([len(nodes)]), np.array([np.sqrt(x @ x)]), np.array([x.min()]), np.array([rest])]


def _undirected(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of a node's distances, the number of nodes it reaches and its betweenness over ordered pairs."""
    if n * n <= MOST_CELLS:
        known = covering(a, b, n, DENSE * len(a) // n)
        if known is not None:
            return _by_cover(a, b, n, known)
    return _by_edges(a, b, n)


def _by_edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path counts go out level by level along the edges, dependencies come back from the farthest level, for a block of sources
    at once."""
    begin = starts_of(a)
    far, reached, between = np.zeros(n), np.zeros(n), np.zeros(n)

    def along(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        if len(a):
            out[a[begin]] = np.add.reduceat(x[b], begin, axis=0)
        return out

    size = max(1, CELLS // max(len(a), n))
    for first in range(0, n, size):
        own = np.arange(min(size, n - first))
        depth = np.full((n, len(own)), -1, np.int32)
        depth[first + own, own] = 0
        sigma = (depth == 0).astype(float)
        front, d = sigma, 0
        while True:
            front = along(front)
            front[depth >= 0] = 0
            if not front.any():
                break
            d += 1
            depth[front > 0] = d
            sigma += front
        far += np.where(depth > 0, depth, 0).sum(axis=1)
        reached += (depth > 0).sum(axis=1)
        delta = np.zeros_like(sigma)
        for k in range(d, 1, -1):
            outer = depth == k
            share = np.divide(1 + delta, sigma, out=np.zeros_like(sigma), where=outer)
            delta += np.where(depth == k - 1, along(share) * sigma, 0)
        between += delta.sum(axis=1)
    return far, reached, between


def covering(a: np.ndarray, b: np.ndarray, n: int, most: int) -> np.ndarray | None:
    """Nodes, no more than ``most``, of which each edge has one: those with most edges that are not covered yet, one by one."""
    near = np.zeros((n, n), bool)
    near[a, b] = True
    open_edges = near.sum(axis=1)
    out = []
    while True:
        node = int(open_edges.argmax())
        if not open_edges[node]:
            return np.array(sorted(out), np.int64)
        if len(out) == most:
            return None
        out.append(node)
        open_edges -= near[node]
        open_edges[node] = 0
        near[:, node] = False
        near[node] = False


def _by_cover(a: np.ndarray, b: np.ndarray, n: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``_by_edges`` from a set of nodes of which each edge has one.

    Two other nodes are joined by a step to a covering node, a shortest path between two of these, or none, and a step back. So paths are
    traced from covering nodes only; counts of the others are products of matrices with them, a block of nodes at a time. What the pairs of
    other nodes send over two covering nodes is added to the weight of that pair.
    """
    inside = np.zeros(n, bool)
    inside[cover] = True
    rest, k = np.flatnonzero(~inside), len(cover)
    near = np.zeros((n, k))
    near[a[inside[b]], np.searchsorted(cover, b[inside[b]])] = 1
    arms = near[rest]

    def along(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[:, cover] = x @ near
        out[:, rest] = x[:, cover] @ arms.T
        return out

    depth = np.full((k, n), -1, np.int32)
    depth[np.arange(k), cover] = 0
    sigma = (depth == 0).astype(float)
    front, last = sigma, 0
    while True:
        front = along(front)
        front[depth >= 0] = 0
        if not front.any():
            break
        last += 1
        depth[front > 0] = last
        sigma += front
    far, reached = np.zeros(n), np.zeros(n)
    ahead = np.where(depth > 0, depth, 0)
    far[cover], reached[cover] = ahead.sum(axis=1), (depth > 0).sum(axis=1)
    far[rest], reached[rest] = ahead[:, rest].sum(axis=0), (depth > 0)[:, rest].sum(axis=0)
    inner, inner_sigma, sent = depth[:, cover], sigma[:, cover], np.zeros((k, k))
    ways = [np.where(inner == gap, inner_sigma, 0) for gap in range(inner.max(initial=-1) + 1)]
    size = max(1, CELLS // n)
    for first in range(0, len(rest), size):
        block = arms[first : first + size]
        waiting = np.ones((len(block), len(rest)), bool)
        waiting[np.arange(len(block)), first + np.arange(len(block))] = False
        for gap, way in enumerate(ways):
            counts = (block @ way if gap else block) @ arms.T
            new = (counts > 0) & waiting
            met = new.sum(axis=1)
            if met.any():
                waiting ^= new
                far[rest[first : first + size]] += (gap + 2) * met
                reached[rest[first : first + size]] += met
                share = np.divide(1, counts, out=np.zeros_like(counts), where=new)
                sent += (block.T @ (share @ arms)) * way
    weight = np.where(inside, 1.0, 2.0) + np.zeros((k, 1))
    weight[:, cover] += sent
    delta = np.zeros_like(sigma)
    for d in range(last, 1, -1):
        share = np.divide(weight + delta, sigma, out=np.zeros_like(sigma), where=depth == d)
        delta += np.where(depth == d - 1, along(share) * sigma, 0)
    between = delta.sum(axis=0)
    between[cover] += sent.sum(axis=0) + sent.sum(axis=1) - np.diag(sent)
    return far, reached, between


def centralities(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """``node`` and its degree, closeness and betweenness centrality in the undirected graph of unit distances.

    A self-loop counts twice in the degree.
    """
    nodes, s, t = indexed(src, dst)
    n = len(nodes)
    a, b = neighbours(s, t, n)
    links = np.bincount(a, np.where(a == b, 2.0, 1.0), n)
    a, b = a[a != b], b[a != b]
    far, reached, between = _undirected(a, b, n)
    closeness = np.divide(reached, far, out=np.zeros(n), where=far > 0) * reached / max(n - 1, 1)
    yield [
        nodes,
        links / (n - 1) if n > 1 else np.ones(n),
        closeness,
        between / ((n - 1) * (n - 2)) if n > 2 else np.zeros(n),
    ]


def report(src: np.ndarray, dst: np.ndarray, w: np.ndarray, tolerance: float, max_rounds: int) -> Iterator[Arrays]:
    """The centralities and that of the eigenvector; both go by ascending nodes."""
    for (_, vector), rows in zip(eigenvector(src, dst, w, tolerance, max_rounds), centralities(src, dst, w)):
        yield [*rows, vector]


def _ratio(values: np.ndarray) -> float:
    middle = np.median(values)
    return float(values.mean() / middle) if middle else 0.0


def heavy(graphs: Iterator[tuple], names: list[list[str]], isolated: float, tolerance: float, max_rounds: int) -> Iterator[Arrays]:
    """A row for each node of a document's graphs: the measures ``names`` of each variant, 0 where it lacks the node."""
    found = {}
    for code, src, dst, w in graphs:
        nodes, s, t = indexed(src, dst)
        n = len(nodes)
        out, into = np.bincount(s, w, n), np.bincount(t, w, n)
        far, most = _farness(s, t, w, n)
        found[code] = nodes, {
            "graph_size": n,
            "graph_diameter": most,
            "node_degree": out + into,
            "in_degree_mean_median_ratio": _ratio(into),
            "out_degree_mean_median_ratio": _ratio(out),
            "degree_mean_median_ratio": _ratio(out + into),
            "farness": far,
            "closeness": np.divide(1.0, far, out=np.full(n, isolated), where=far != 0),
            "centrality": leading(*neighbours(s, t, n), n, tolerance, max_rounds),
        }
    every = np.unique(np.concatenate([nodes for nodes, _ in found.values()]))
    columns = [every]
    for code, wanted in enumerate(names):
        for name in wanted:
            column = np.zeros(len(every))
            if code in found:
                nodes, measures = found[code]
                if np.ndim(measures[name]):
                    column[np.searchsorted(every, nodes)] = measures[name]
                else:
                    column[:] = measures[name]
            columns.append(column)
    yield columns


def link_index(src: np.ndarray, dst: np.ndarray, kept: np.ndarray) -> Arrays:
    """The nodes in ascending order, then for the links by source: where each node's begin, the other ends' places and ``kept``;
    then the same by target."""
    nodes, s, t = indexed(src, dst)
    out = [nodes]
    for own, other in ((s, t), (t, s)):
        order = np.argsort(own, kind="stable")
        out += [np.searchsorted(own[order], np.arange(len(nodes) + 1)), other[order], kept[order]]
    return out


def places(own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The place of each node in the index, -1 for one without links."""
    at = np.searchsorted(nodes, own)
    return np.where(np.append(nodes, nodes[-1:])[at] == own, at, -1) if len(nodes) else np.full(len(own), -1)


def links_of(at: np.ndarray, begin: np.ndarray, other: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links in one direction of the nodes at places of the index: the place again, the other end's, and ``kept``."""
    sizes = begin[at + 1] - begin[at]
    place = np.arange(sizes.sum()) + np.repeat(begin[at] - np.cumsum(sizes) + sizes, sizes)
    return np.repeat(at, sizes), other[place], kept[place]


def linked(own: np.ndarray, index: Arrays) -> Arrays:
    """``src, dst, both, kept`` of the links with one end, or both, among different nodes ``own``; ends are places in the index."""
    at = places(own, index[0])
    at = at[at >= 0]
    member = np.zeros(len(index[0]), bool)
    member[at] = True
    (src, dst, out_kept), (into, tail, in_kept) = links_of(at, *index[1:4]), links_of(at, *index[4:])
    new = ~member[tail]  # a link of two candidates is met at both and kept at its source
    none = np.zeros(np.count_nonzero(new), bool)
    return [np.concatenate(x) for x in ((src, tail[new]), (dst, into[new]), (member[dst], none), (out_kept, in_kept[new]))]


def variants(src: np.ndarray, dst: np.ndarray, both: np.ndarray, kept: np.ndarray) -> Iterator[tuple]:
    """``(number, src, dst, w)`` of the graphs that have edges, from a document's links: expanded against the link direction with weight 2
    where both ends are candidates, its related part, induced in link direction, its related part."""
    one = np.ones(len(src), np.int64)
    for code, pick in enumerate((one == 1, kept, both, both & kept)):
        if pick.any():
            tail, head = (dst, src) if code < 2 else (src, dst)
            yield code, tail[pick], head[pick], (one + both if code < 2 else one)[pick]


def some(codes: list[int]) -> Callable[..., Iterator[tuple]]:
    """``variants`` with these numbers only."""

    def chosen(*columns: np.ndarray) -> Iterator[tuple]:
        return (graph for graph in variants(*columns) if graph[0] in codes)

    return chosen


def edges(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """The edges themselves."""
    yield [src, dst, w]


def each(graphs: Iterator[tuple], measure: Callable[..., Iterator[Arrays]]) -> Iterator[Arrays]:
    """The rows of a measure of each graph, with its number in front."""
    for code, src, dst, w in graphs:
        for columns in measure(src, dst, w):
            yield [np.full(len(columns[0]), code, np.int8), *columns]


def degrees(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """``node`` and the weight coming in, going out, and both."""
    nodes, s, t = indexed(src, dst)
    into, out = (np.bincount(x, w, len(nodes)).astype(np.int64) for x in (t, s))
    yield [nodes, into, out, into + out]


def size(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """The number of nodes."""
    yield [np.array([len(indexed(src, dst)[0])])]


def ratios(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[Arrays]:
    """The number of nodes, and mean over median of the degrees coming in, going out, and both."""
    for nodes, *each_way in degrees(src, dst, w):
        yield [np.array([len(nodes)]), *(np.array([_ratio(x)]) for x in each_way)]


def measured(graphs: Callable[..., Iterator[tuple]], solve: Callable[[Iterator[tuple]], Iterator[Arrays]]) -> Callable[..., Iterator[Arrays]]:
    """A function of a document's columns."""

    def found(*columns: np.ndarray) -> Iterator[Arrays]:
        return solve(graphs(*columns))

    return found


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Arrays]]:
    """The other columns of each run of rows with the same first one."""
    current, parts = None, []
    for batch in batches:
        ids, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        begin = starts_of(ids).tolist()
        for low, high in pairwise([*begin, len(ids)]):
            if parts and ids[low] != current:
                yield current, [np.concatenate(x) for x in zip(*parts)]
                parts = []
            current = ids[low]
            parts.append([c[low:high] for c in columns])
    if parts:
        yield current, [np.concatenate(x) for x in zip(*parts)]


def of_candidates(own: np.ndarray, index: Callable[[], Arrays], solve: Callable[..., Iterator[Arrays]], ends: list[int]) -> Iterator[Arrays]:
    """The rows that ``solve`` makes of the links of a document's candidates; columns ``ends`` are nodes."""
    known = index()
    links = linked(own, known)
    if len(links[0]):
        for rows in solve(*links):
            yield [known[0][c] if k in ends else c for k, c in enumerate(rows)]


def by_document(
    batches: Iterator[pa.RecordBatch], solve: Callable[..., Iterator[Arrays]], names: list[str], kinds: list[pa.DataType]
) -> Iterator[pa.RecordBatch]:
    """The rows that ``solve`` makes of each document's columns; documents come one after the other."""
    held, size = [], 0
    for doc_id, columns in documents(batches):
        for rows in solve(*columns):
            held.append([np.full(len(rows[0]), doc_id), *rows])
            size += len(rows[0])
            if size >= ROWS:
                yield _batch(held, names, kinds)
                held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


def _batch(held: list[Arrays], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds)], names)


def of_graph(table: pa.Table, measure: Callable[..., Iterator[Arrays]], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """The rows of a measure of one graph ``doc_id, variant, src, dst, w``."""
    held = list(measure(*(table.column(c).to_numpy() for c in ("src", "dst", "w"))))
    schema = pa.schema(list(zip(names, kinds)))
    if not held:
        return schema.empty_table()
    columns = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds[2:])]
    graph = [pa.repeat(table.column(c)[0], len(columns[0])) for c in names[:2]]
    return pa.Table.from_arrays([*graph, *columns], schema=schema)


def classed(node: np.ndarray, kind: np.ndarray, other: np.ndarray, linked: np.ndarray) -> Iterator[Arrays]:
    """``src, dst, src_kind, dst_kind`` of the links among a document's nodes, and of each node without one to itself.

    Rows are a node with one that it links to, or without (``linked`` is false).
    """
    nodes, first = np.unique(node, return_index=True)
    kinds = kind[first]
    at = np.minimum(np.searchsorted(nodes, other), len(nodes) - 1)
    pick = linked & (nodes[at] == other)
    src, dst = np.searchsorted(nodes, node[pick]), at[pick]
    alone = np.setdiff1d(np.arange(len(nodes)), np.concatenate([src, dst]))
    src, dst = np.concatenate([src, alone]), np.concatenate([dst, alone])
    yield [nodes[src], nodes[dst], kinds[src], kinds[dst]]


def widened(node: np.ndarray, kind: np.ndarray, other: np.ndarray, linked: np.ndarray, fresh: int) -> Iterator[Arrays]:
    """``node, kind`` of a document's nodes, and of their neighbours with the kind ``fresh``."""
    nodes, first = np.unique(node, return_index=True)
    more = np.setdiff1d(other[linked], nodes)
    yield [np.concatenate([nodes, more]), np.concatenate([kind[first], np.full(len(more), fresh, kind.dtype)])]


def entity_links(node: np.ndarray, kind: np.ndarray, index: Callable[[], Arrays], fresh: int | None) -> Iterator[Arrays]:
    """``classed`` of a document's nodes, and of their neighbours too with the kind ``fresh`` where that is given; links come from the index."""
    known = index()
    nodes, first = np.unique(node, return_index=True)
    kinds = kind[first]
    if fresh is not None:
        src, dst, _, _ = linked(nodes, known)
        ends = np.zeros(len(known[0]), bool)
        ends[src] = ends[dst] = True
        more = np.setdiff1d(known[0][ends], nodes)
        nodes, kinds = np.concatenate([nodes, more]), np.concatenate([kinds, np.full(len(more), fresh, kinds.dtype)])
    at = places(nodes, known[0])
    present = np.flatnonzero(at >= 0)
    number = np.full(len(known[0]), -1)
    number[at[present]] = present
    tail, head, _ = links_of(at[present], *known[1:4])
    src, dst = number[tail], number[head]
    src, dst = src[dst >= 0], dst[dst >= 0]
    alone = np.ones(len(nodes), bool)
    alone[src] = alone[dst] = False
    alone = np.flatnonzero(alone)
    src, dst = np.concatenate([src, alone]), np.concatenate([dst, alone])
    yield [nodes[src], nodes[dst], kinds[src], kinds[dst]]


def pairs_met(batches: Iterator[pa.RecordBatch], index: Callable[[], Arrays]) -> Iterator[pa.RecordBatch]:
    """``a, b``: the different edges of the expanded and the induced graphs of a task's documents; rows are a document and a candidate."""
    known = index()
    nodes, out, into = known[0], known[1:4], known[4:]
    left, entered, within = (np.zeros(len(x[1]), bool) for x in (out, into, out))
    for _, (own,) in documents(batches):
        at = places(own, nodes)
        at = at[at >= 0]
        member = np.zeros(len(nodes), bool)
        member[at] = True
        for (begin, other, _), seen, both in ((out, left, within), (into, entered, None)):
            sizes = begin[at + 1] - begin[at]
            place = np.arange(sizes.sum()) + np.repeat(begin[at] - np.cumsum(sizes) + sizes, sizes)
            seen[place] = True
            if both is not None:
                both[place[member[other[place]]]] = True
    ends = [(np.repeat(np.arange(len(nodes)), np.diff(x[0])), x[1]) for x in (out, into)]
    (src, dst), (target, source) = ends
    a = np.concatenate([dst[left], target[entered], src[within]])
    b = np.concatenate([src[left], source[entered], dst[within]])
    yield pa.RecordBatch.from_arrays([pa.array(nodes[a], pa.int64()), pa.array(nodes[b], pa.int64())], ["a", "b"])
