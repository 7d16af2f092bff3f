"""Approximate nearest neighbours by an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standout.llm.catalog import query
from standout.llm.common import bounded_sample, partitions, stored, table

#: Rows that a cell has on average; with CENTROIDS it fixes the number of centroids of each half.
CELL_ROWS, CENTROIDS = 4, 1024
#: The codebooks are fitted on at most this many rows; every row is indexed.
SAMPLE, ROUNDS = 16_384, 12
#: Share of the rows that a query reranks. Vectors without any structure need this much for a recall above 0.9 also in
#: small tables; where near vectors share cells a few thousandths are enough.
PROBE = 0.6
#: Rows of a block of cells, which one task holds while it streams the queries of the block.
BLOCK_ROWS = 4096
_QUERIES = 256
_TIE = 1e-9


@dataclass
class MultiIndex:
    """Centroids of both halves, rows of each pair of centroids, and the blocks of cells."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    first_block: np.ndarray
    chunks: np.ndarray

    def _distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _squared(vectors[:, :half], self.left), _squared(vectors[:, half:], self.right)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        left, right = self._distances(vectors)
        return left.argmin(1) * len(self.right) + right.argmin(1)

    def probes(self, vectors: np.ndarray, wanted: int) -> Iterator[list[int]]:
        """For each vector the cells in the order of the summed distances, until they hold ``wanted`` rows.

        Centroids of each half are sorted by distance. The heap holds the pairs whose predecessors in both halves are taken.
        """
        for left, right in zip(*self._distances(vectors)):
            a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
            x, y = left[a].tolist(), right[b].tolist()
            a, b = a.tolist(), b.tolist()
            heap, seen, found, held = [(x[0] + y[0], 0, 0)], {(0, 0)}, [], 0
            while heap and held < wanted:
                _, i, j = heapq.heappop(heap)
                cell = a[i] * len(b) + b[j]
                if self.counts[cell]:
                    found.append(cell)
                    held += int(self.counts[cell])
                for k, m in ((i + 1, j), (i, j + 1)):
                    if k < len(a) and m < len(b) and (k, m) not in seen:
                        seen.add((k, m))
                        heapq.heappush(heap, (x[k] + y[m], k, m))
            yield found


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def codebook(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """k-means from random points; a centre without points stays."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(size, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squared(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centres))
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the rows that take part.

    Those have a vec_id and a vector that is neither NULL, empty nor zero, without NULL and non-finite components, of the
    length that most such rows have (the shortest of several).
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & ~wrong & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build(rows: DataFrame) -> tuple[MultiIndex, DataFrame] | None:
    """The index and ``rows`` with their ``cell``; None for no rows."""
    n = rows.count()
    if not n:
        return None
    sample = bounded_sample(rows, "vec_id", SAMPLE).select("vec_id", "embedding").collect()
    sample.sort(key=lambda r: (r["vec_id"], r["embedding"]))
    points = unit(np.array([r["embedding"] for r in sample]))
    size = int(min(CENTROIDS, max(4, round((n / CELL_ROWS) ** 0.5))))
    half = (points.shape[1] + 1) // 2
    left, right = codebook(points[:, :half], size, 1), codebook(points[:, half:], size, 2)
    index = MultiIndex(left, right, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(unit(_matrix(batch.column("embedding"))))
                columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(cells, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "cell"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    placed = stored(rows.mapInArrow(assign, f"vec_id {kind}, embedding array<double>, cell int"), "index")
    counts = np.zeros(len(left) * len(right), np.int64)
    for r in placed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    chunks = np.maximum(1, -(-counts // BLOCK_ROWS))
    first, block, held = np.zeros(len(counts), np.int64), 0, 0
    for cell in np.nonzero(counts)[0]:
        if held and held + counts[cell] > BLOCK_ROWS:
            block, held = block + 1, 0
        first[cell] = block
        held += counts[cell]
        if chunks[cell] > 1:
            block, held = block + int(chunks[cell]), 0
    return MultiIndex(left, right, counts, first, chunks), placed


def _best(queries: np.ndarray, block: np.ndarray, ids: np.ndarray, own: list[int], fits: np.ndarray, k: int):
    """The k nearest rows of a block for each query: cosines by one product, the near-ties of the last one exactly."""
    norms = np.linalg.norm(block, axis=1)
    scores = (queries @ block.T) / norms / np.linalg.norm(queries, axis=1)[:, None]
    scores[~fits] = -np.inf
    scores[np.array(own)[:, None] == ids[None, :]] = -np.inf
    for i, row in enumerate(scores):
        allowed = int((row > -np.inf).sum())
        if not allowed:
            continue
        least = np.partition(row, -min(k, allowed))[-min(k, allowed)]
        near = np.nonzero(row >= least - _TIE)[0]
        near = near[row[near] > -np.inf]
        exact = cosines(queries[i], block[near])
        for j in np.lexsort((ids[near], -exact))[:k]:
            yield i, int(ids[near[j]]), float(exact[j])


def cosines(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of a vector and each row; equal rows give equal results wherever they stand."""
    return (rows * a).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((a * a).sum()))


def search(vectors: DataFrame, queries: Column, k: int = 5, probe: float = PROBE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by cosine that the index finds for each row of ``queries``.

    Rows are indexed by the nearest centroids of their two halves, vectors scaled to length one. A query takes pairs of
    centroids by summed distance until their cells hold the share ``probe`` of all rows, and these are ranked exactly on the
    original vectors; ties go to the smaller vec_id. The row's own vec_id is left out.

    Cells are put together to blocks of bounded size, and a cell with more rows is dealt to several blocks by a hash, so
    copies of one vector spread. A task holds one block and streams the block's queries; each query keeps k rows of a block.
    Rows that cannot take part (see ``usable``) neither ask nor answer; repeated rows answer each, repeated queries ask once.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    result = f"query_id {kind}, vec_id {kind}, score double"
    built = build(rows)
    if built is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index, placed = built
    wanted = max(k + 1, int(np.ceil(probe * index.counts.sum())))
    where = f"block int, kind int, vec_id {kind}, embedding array<double>, cell int, cells array<int>"
    names = [c.split()[0] for c in where.split(", ")]
    id_type = placed.select("vec_id").limit(0).toArrow().schema.field("vec_id").type

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            mixed = batch.column("spread").to_numpy()
            block = index.first_block[cells] + mixed % index.chunks[cells]
            n = len(cells)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block, pa.int32()), pa.array(np.zeros(n), pa.int32()), batch.column("vec_id"),
                    batch.column("embedding"), batch.column("cell"), pa.nulls(n, pa.list_(pa.int32())),
                ],
                names,
            )

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_pylist(), batch.column("embedding")
            out: list[tuple] = []
            for i, found in enumerate(index.probes(unit(_matrix(vectors)), wanted)):
                blocks: dict[int, list[int]] = {}
                for cell in found:
                    first = int(index.first_block[cell])
                    for block in range(first, first + int(index.chunks[cell])):
                        blocks.setdefault(block, []).append(cell)
                vector = vectors[i].as_py()
                out += [(block, 1, ids[i], vector, None, cells) for block, cells in blocks.items()]
                if len(out) >= 1024:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), id_type, pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, waiting = None, [], []
        ids = cells = matrix = None

        def ready() -> None:
            nonlocal ids, cells, matrix
            if matrix is None:
                ids = np.array([r[0] for r in held])
                cells = np.array([r[1] for r in held])
                matrix = np.array([r[2] for r in held])

        def run() -> pa.RecordBatch:
            ready()
            known, place = np.unique(cells, return_inverse=True)
            fits = np.zeros((len(waiting), len(known)), bool)
            for i, (_, _, probed) in enumerate(waiting):
                fits[i] = np.isin(known, probed)
            found = _best(
                np.array([w[1] for w in waiting]), matrix, ids, [w[0] for w in waiting], fits[:, place], k
            )
            out = [(waiting[i][0], other, score) for i, other, score in found]
            waiting.clear()
            columns = list(zip(*out)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (id_type, id_type, pa.float64()))], ["query_id", "vec_id", "score"]
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                number, what, vec_id, vector, cell, probed = row
                if number != block:
                    if waiting:
                        yield run()
                    block, held, matrix = number, [], None
                if what == 0:
                    held.append((vec_id, cell, vector))
                    continue
                waiting.append((vec_id, vector, probed))
                if len(waiting) >= _QUERIES:
                    yield run()
        if waiting:
            yield run()

    spread = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30).cast("long")).alias("spread")
    index_rows = placed.select("vec_id", "embedding", "cell", spread).mapInArrow(entries, where)
    ask = placed.where(queries).select("vec_id", "embedding").distinct()
    both = index_rows.unionByName(ask.mapInArrow(asked, where))
    both = both.repartition(partitions(spark), "block").sortWithinPartitions("block", "kind", "vec_id")
    found = both.mapInArrow(rerank, result)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


@query("op6_multi_index")
def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")
