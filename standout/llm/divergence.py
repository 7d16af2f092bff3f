"""How far the words of sources diverge: a quadtree over the counts of groups and terms, traversed jointly for pairs of groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standout.llm.catalog import query
from standout.llm.common import numbered, stored, table

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCUMENTS = 10
#: Probabilities are whole numbers of this many parts; every kept term counts PRIOR more than it occurs.
SCALE, PRIOR = 1_000_000_000, 2
#: Terms listed for a group.
TOP = 10
#: Rows and columns of a block of the matrix, a power of two; a block is one quadtree.
SIDE = 1024
#: (term, group) counts that a task holds before it passes them on.
HELD = 400_000
#: Node pairs that are traversed at once.
STEP = 1 << 17
#: Letters of any alphabet as they are but A-Z in lower case; all other bytes separate terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term, and a row with NULL as term for each group."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    names = [c.split()[0] for c in _COUNTED.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                terms = pa.concat_arrays([terms, pa.nulls(1, pa.string())])
                langs, sources = (pa.array([x] * len(terms), pa.string()) for x in (lang, source))
                sums = [pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[t] for t in n), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays([langs, sources, terms, *sums], names)
            held.clear()

        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                terms = text.translate(_TERMS).split(b" ")
                n.update(terms)
                n.pop(b"", None)
                docs.update(set(terms))
                size += len(n) - before + 1
                if size > HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    rows = docs.select(*empty).mapInArrow(count, _COUNTED)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, whole: Column, terms: Column) -> Column:
    """Smoothed probability in parts of SCALE, exact for counts of any size."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (whole + PRIOR * terms).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """Triangular divergence of one term, rounded down."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class QuadTree:
    """The cells of a square block as a tree of quadrants: a byte of four bits for every quadrant that is not all zero, level by
    level from the whole block to quadrants of four cells, then the values of the cells in the same order.

    A child's place in its level is the number of bits before its own.
    """

    def __init__(self, masks: list[np.ndarray], values: np.ndarray) -> None:
        self.masks, self.values = masks, values
        self.first = [np.cumsum(n) - n for n in (np.bitwise_count(m).astype(np.int64) for m in masks)]

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, side: int = SIDE) -> QuadTree:
        code = np.zeros(len(rows), np.int64)
        for bit in range(side.bit_length() - 1):
            code |= (columns >> bit & 1) << 2 * bit | (rows >> bit & 1) << 2 * bit + 1
        order = np.argsort(code)
        code, values = code[order], values[order]
        masks = []
        while side > 1:
            at, inner = np.unique(code >> 2, return_inverse=True)
            mask = np.zeros(len(at), np.uint8)
            np.bitwise_or.at(mask, inner, (1 << (code & 3)).astype(np.uint8))
            masks.insert(0, mask)
            code, side = at, side >> 1
        return QuadTree(masks, values)

    def to_bytes(self) -> bytes:
        return b"".join(m.tobytes() for m in self.masks)

    @staticmethod
    def from_bytes(data: bytes, values: np.ndarray, side: int = SIDE) -> QuadTree:
        masks, at, nodes = [], 0, 1
        for _ in range(side.bit_length() - 1):
            masks.append(np.frombuffer(data, np.uint8, nodes, at))
            at += nodes
            nodes = int(np.bitwise_count(masks[-1]).sum())
        return QuadTree(masks, values)

    def children(self, depth: int, nodes: np.ndarray, quadrant: int) -> np.ndarray:
        """Places of one child of each node, -1 where the node or the child is all zero."""
        mask = self.masks[depth][nodes]
        there = (nodes >= 0) & (mask >> quadrant & 1 == 1)
        before = np.bitwise_count(mask & np.uint8((1 << quadrant) - 1))
        return np.where(there, self.first[depth][nodes] + before, -1)


def pair_values(
    a: QuadTree | None, b: QuadTree | None, zero_a: np.ndarray, zero_b: np.ndarray, width: int, same: bool, side: int = SIDE
) -> np.ndarray:
    """Divergence of every row of block ``a`` from every row of ``b``, summed over the block's ``width`` columns; exact.

    ``zero_a`` and ``zero_b`` are the probabilities of rows in all-zero columns. Both trees are descended together. Where both
    quadrants are all zero every pair of their rows has one price a column, so only the columns are counted, at the
    corners of the rectangle of pairs. Where ``same``, the block meets itself and only pairs above the diagonal count.
    """
    value = np.zeros((len(zero_a), len(zero_b)), np.int64)
    corners = np.zeros((len(zero_a) + 1, len(zero_b) + 1), np.int64)
    none = np.full(1, -1)
    start = [np.zeros(1, np.int64) if t is not None else none for t in (a, b)]
    stack = [(0, *start, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, in_a, in_b, row_a, row_b, column = stack.pop()
        if len(in_a) > STEP:
            half = len(in_a) // 2
            stack += [(depth, *[x[part] for x in (in_a, in_b, row_a, row_b, column)]) for part in (slice(half), slice(half, None))]
            continue
        size = side >> depth
        fits = (row_a < len(zero_a)) & (row_b < len(zero_b)) & (column < width)
        if same:
            fits &= row_a <= row_b if size > 1 else row_a < row_b
        zero = (in_a < 0) & (in_b < 0)
        top, left, at = (x[fits & zero] for x in (row_a, row_b, column))
        covered = np.minimum(at + size, width) - at
        bottom, right = np.minimum(top + size, len(zero_a)), np.minimum(left + size, len(zero_b))
        for i, j, sign in ((top, left, 1), (bottom, left, -1), (top, right, -1), (bottom, right, 1)):
            np.add.at(corners, (i, j), sign * covered)
        in_a, in_b, row_a, row_b, column = (x[fits & ~zero] for x in (in_a, in_b, row_a, row_b, column))
        if not len(in_a):
            continue
        if size == 1:
            p = zero_a[row_a] if a is None else np.where(in_a >= 0, a.values[in_a], zero_a[row_a])
            q = zero_b[row_b] if b is None else np.where(in_b >= 0, b.values[in_b], zero_b[row_b])
            np.add.at(value, (row_a, row_b), (p - q) ** 2 // (p + q))
            continue
        half, parts = size // 2, []
        for k in (0, 1):
            under_a = [in_a if a is None else a.children(depth, in_a, 2 * i + k) for i in (0, 1)]
            under_b = [in_b if b is None else b.children(depth, in_b, 2 * j + k) for j in (0, 1)]
            for i in (0, 1):
                for j in (0, 1):
                    parts.append((under_a[i], under_b[j], row_a + i * half, row_b + j * half, column + k * half))
        stack.append((depth + 1, *[np.concatenate(x) for x in zip(*parts)]))
    zeros = corners.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
    price = (zero_a[:, None] - zero_b[None, :]) ** 2 // (zero_a[:, None] + zero_b[None, :])
    return value + zeros * price


class Audit:
    """The stored tables of one audit: ``cells`` of the matrix, ``groups`` and, from them, the quadtrees of its blocks.

    ``cells``: ``lang, source, row, term, column, n, p, q`` of every group and kept term that occurs in it. ``groups``: ``lang, source,
    row, rows, terms, zero`` of every group, with its probability of a term that it does not have.
    """

    def __init__(self, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, side: int = SIDE) -> None:
        self.side = side
        counted = stored(term_counts(docs), "divergence-counts")
        kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        kept = kept.where(F.col("docs") >= least_documents).drop("docs")
        kept = stored(numbered(kept, ["lang"], ["term"], "column", "terms"), "divergence-terms")
        langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms"))
        kept = kept.drop("terms")
        cells = stored(counted.where("n > 0").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-joined")
        whole = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = numbered(counted.select("lang", "source").distinct(), ["lang"], ["source"], "row", "rows")
        groups = groups.join(whole, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("group_n", "lang_n", "terms")})
        zero = F.when(F.col("terms") > 0, probability(F.lit(0).cast("long"), F.col("group_n"), F.col("terms")))
        self.groups = stored(groups.withColumn("zero", zero), "divergence-groups")
        own = self.groups.select("lang", "source", "row", "group_n", "lang_n", "terms")
        p, q = (probability(F.col(n), F.col(of), F.col("terms")) for n, of in (("n", "group_n"), ("total", "lang_n")))
        columns = ["lang", "source", "row", "term", "column", "n", p.alias("p"), q.alias("q")]
        self.cells = stored(cells.join(own, ["lang", "source"]).select(*columns), "divergence-cells")

    def trees(self) -> DataFrame:
        """``(lang, across, down, tree, cells)``: a quadtree for each block of the matrix that is not all zero."""

        side = self.side

        def build(block: pd.DataFrame) -> pd.DataFrame:
            rows, columns = (block[c].to_numpy() % side for c in ("row", "column"))
            tree = QuadTree.build(rows, columns, block["p"].to_numpy().astype(np.int32), side)
            first = block.iloc[0]
            values = [first["lang"], first["row"] // side, first["column"] // side, tree.to_bytes(), tree.values.tobytes()]
            return pd.DataFrame([values], columns=["lang", "down", "across", "tree", "cells"])

        blocks = self.cells.select("lang", "row", "column", "p").groupBy("lang", _block("row", side), _block("column", side))
        return blocks.applyInPandas(build, "lang string, down long, across long, tree binary, cells binary")

    def pairs(self) -> DataFrame:
        """``(lang, source, other, value)`` for every two groups of a language, both ways.

        Blocks that lie above one another meet if one of them is not all zero, each pair of blocks in a task of its own, and give a
        sum for each pair of rows. The columns of all other blocks are all zero for both groups and priced at once.
        """
        trees = stored(self.trees(), "divergence-trees")
        down = _block("row", self.side)
        profiles = self.groups.groupBy("lang", down.alias("down")).agg(
            F.array_sort(F.collect_list(F.struct("row", "zero"))).alias("zeros"), F.first("terms").alias("terms")
        )
        profiles = stored(profiles.select("lang", "down", F.col("zeros.zero").alias("zeros"), "terms"), "divergence-profiles")
        meet = trees.select("lang", "across", "down").join(profiles.select("lang", F.col("down").alias("with")), "lang")
        a, b = F.least("down", "with").alias("a"), F.greatest("down", "with").alias("b")
        units = meet.select("lang", "across", a, b).distinct()
        for s in "ab":
            tree = trees.select("lang", "across", F.col("down").alias(s), F.col("tree").alias(f"tree_{s}"), F.col("cells").alias(f"cells_{s}"))
            rows = profiles.select("lang", F.col("down").alias(s), F.col("zeros").alias(f"zeros_{s}"), "terms")
            units = units.join(tree, ["lang", "across", s], "left").join(rows if s == "a" else rows.drop("terms"), ["lang", s])
        sums = units.mapInArrow(_descent(self.side), "lang string, row_a long, row_b long, value long, width long")
        sums = sums.groupBy("lang", "row_a", "row_b").agg(F.sum("value").alias("value"), F.sum("width").alias("width"))
        one, two = (self.groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "row", "zero")], "terms") for s in "ab")
        both = one.join(two.drop("terms"), "lang").where("row_a < row_b").join(sums, ["lang", "row_a", "row_b"], "left")
        price = divergence(F.col("zero_a"), F.col("zero_b"))
        rest = F.col("terms") - F.coalesce("width", F.lit(0))
        value = F.coalesce("value", F.lit(0)) + F.when(F.col("terms") > 0, rest * price).otherwise(0)
        ways = F.array(*[F.struct(F.col(f"source_{s}").alias("source"), F.col(f"source_{o}").alias("other")) for s, o in ("ab", "ba")])
        return both.select("lang", F.explode(ways).alias("way"), value.alias("value")).select("lang", "way.*", "value")

    def terms(self) -> DataFrame:
        """``(lang, source, term, value)`` of the terms that a group uses more than its language."""
        more = self.cells.where("p > q")
        return more.select("lang", "source", "term", divergence(F.col("p"), F.col("q")).alias("value"))


def _block(column: str, side: int) -> Column:
    return F.shiftright(F.col(column), side.bit_length() - 1)


def _descent(side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of each pair of blocks, a row for each pair of their rows."""
    names = ["lang", "row_a", "row_b", "value", "width"]

    def tree(unit: dict, s: str) -> QuadTree | None:
        data, cells = unit[f"tree_{s}"], unit[f"cells_{s}"]
        return None if data is None else QuadTree.from_bytes(data, np.frombuffer(cells, np.int32).astype(np.int64), side)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                width, same = min(side, unit["terms"] - unit["across"] * side), unit["a"] == unit["b"]
                zeros = [np.array(unit[f"zeros_{s}"], np.int64) for s in "ab"]
                value = pair_values(tree(unit, "a"), tree(unit, "b"), *zeros, width, same, side)
                above = np.triu_indices(len(zeros[0]), 1) if same else tuple(x.ravel() for x in np.indices(value.shape))
                for at in range(0, len(above[0]), STEP):
                    rows = [x[at : at + STEP] for x in above]
                    sums = [unit["a"] * side + rows[0], unit["b"] * side + rows[1], value[rows[0], rows[1]], np.full(len(rows[0]), width)]
                    yield pa.RecordBatch.from_arrays([pa.array([unit["lang"]] * len(rows[0])), *map(pa.array, sums)], names)

    return descend


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, side: int = SIDE) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group of language and source how far the others of its language are
    (part ``pair``, all of them) and the terms that set it apart from its language (part ``term``, the first ``top``).

    NULL text, lang and source count as empty. Terms are runs of letters and of all characters beyond ASCII, A-Z lower-cased; a
    language keeps those of at least ``least_documents`` documents. Values are whole numbers, exact: the triangular
    divergence of smoothed probabilities in parts of 10^9, rounded down term by term. Ties go by UTF-8 bytes. Groups without
    terms and languages without kept ones have pairs too; repeated rows count each; an empty table gives no rows. Other
    columns are not read.
    """
    found = Audit(docs, least_documents, side)
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.pairs().select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(place))
    terms = found.terms().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS a
  FROM documents
), t AS MATERIALIZED (SELECT id, lang, source, unnest(a) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(n)::HUGEINT AS whole, count(*) AS v FROM k GROUP BY 1),
w AS (SELECT lang, source, sum(n)::HUGEINT AS whole FROM c GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(w.whole, 0) + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (l.whole + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN w USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM x) WHERE part = 'pair' OR r <= 10
"""


@query("op13_divergence_audit", AUDIT_SQL)
def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
