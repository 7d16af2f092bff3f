"""Extremely randomised regression trees, grown level by level for all trees at once.

A level takes two aggregates over the rows: the ranges of the features in each open node of each tree, from which one
threshold a feature is drawn, and the sums on the left of each drawn threshold, from which the best is taken. Rows are spread
and stored once and then never shuffled or rewritten: a task finds their nodes anew by walking the trees grown so far, batch by batch,
and sends one row of sums for each node. What is done with the sums is done by Spark on small tables of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standout.operators.matrix import KEYS, clean_features
from standout.session import cut_lineage, stored

NODE = "tree int, node int, level int, feature int, threshold double, left int, value double, rows double, gain double"
#: The trees travel to the tasks as one value; settings that allow more nodes than this are refused.
MOST_NODES = 1 << 20


def _unit(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _drawn_times(u: Column) -> Column:
    """How often a bootstrap takes a row: Poisson of mean 1 from a uniform number, 6 at most."""
    times, below, term = F.lit(6), 0.0, 0.36787944117144233
    bounds = []
    for k in range(6):
        below += term
        bounds.append((k, below))
        term /= k + 1
    for k, bound in reversed(bounds):
        times = F.when(u < bound, F.lit(k)).otherwise(times)
    return times


def _arrays(nodes: DataFrame) -> dict[str, np.ndarray]:
    """The nodes of all trees, one after the other, for the tasks; children and roots by their place there.

    Tasks get plain arrays and functions made here, so this package need not be known where they run.
    """
    columns = ["tree", "node", "level", "feature", "threshold", "left", "value"]
    table = nodes.select(*columns).orderBy("tree", "node").toArrow()
    out = {c: table.column(c).to_numpy() for c in columns}
    tree = out["tree"].astype(np.int64)
    roots = np.flatnonzero(out["node"] == 0)
    leaf = out["feature"] < 0
    out["left"] = np.where(leaf, np.arange(len(tree)), np.nan_to_num(out["left"]).astype(np.int64) + roots[np.cumsum(out["node"] == 0) - 1])
    out["feature"] = np.where(leaf, 0, out["feature"]).astype(np.int64)
    out["threshold"] = np.where(leaf, np.inf, out["threshold"])  # so that a row stays in a leaf
    out["none"] = table.column("value").is_null().to_numpy()
    return out | {"roots": roots}


def _walker(trees: dict[str, np.ndarray]) -> Callable[[np.ndarray, int, int], np.ndarray]:
    """The place among all nodes that each column of ``x`` (feature by row) reaches in a tree after so many steps."""
    feature, threshold, left, roots = (trees[c] for c in ("feature", "threshold", "left", "roots"))

    def walk(x: np.ndarray, tree: int, steps: int) -> np.ndarray:
        at, row, flat, size = np.full(x.shape[1], roots[tree]), np.arange(x.shape[1]), x.ravel(), x.shape[1]
        cells = feature * size
        for _ in range(steps):
            at = left.take(at) + (flat.take(cells.take(at) + row) > threshold.take(at))
        return at

    return walk


def _reader(width: int) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features by row, targets, and by tree how often the rows were drawn."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(width)])
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
        return x, batch.column("y").to_numpy(zero_copy_only=False), np.ascontiguousarray(times.reshape(batch.num_rows, -1).T)

    return read


def _node_sums(rows: DataFrame, nodes: DataFrame, width: int, level: int) -> DataFrame:
    """``tree, node, n, s, q, ends``: numbers and sums of the rows in the open nodes of a level, and the ranges of their features."""
    trees = _arrays(nodes)
    walk, read, open_ = _walker(trees), _reader(width), trees["level"] == level
    which, number = np.flatnonzero(open_), np.cumsum(open_) - 1
    kind = "tree int, node int, n double, s double, q double, lo array<double>, hi array<double>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lo, hi = np.zeros((3, len(which))), np.full((width, len(which)), np.inf), np.full((width, len(which)), -np.inf)
        for batch in batches:
            x, y, times = read(batch)
            for tree in range(len(times)):
                inside = np.flatnonzero(times[tree])
                at = walk(x.take(inside, axis=1), tree, level)
                reached = open_.take(at)
                inside, spots = inside[reached], number.take(at[reached])
                if not len(inside):
                    continue
                low, high = spots.min(), spots.max()
                order = np.argsort((spots - low).astype(np.uint16 if high - low < 1 << 16 else np.int64), kind="stable")
                inside, spots = inside.take(order), spots.take(order)
                first = np.concatenate([[0], np.flatnonzero(np.diff(spots)) + 1])
                here = spots[first]
                w, own = times[tree].take(inside).astype(np.float64), y.take(inside)
                for k, part in enumerate((w, w * own, w * own * own)):
                    total[k, here] += np.add.reduceat(part, first)
                for i in range(width):
                    values = x[i].take(inside)
                    lo[i, here] = np.minimum(lo[i, here], np.minimum.reduceat(values, first))
                    hi[i, here] = np.maximum(hi[i, here], np.maximum.reduceat(values, first))
        seen = np.flatnonzero(total[0] > 0)
        columns = [pa.array(trees[c][which[seen]], pa.int32()) for c in ("tree", "node")] + [pa.array(t[seen]) for t in total]
        columns += [pa.array(list(ends.T[seen]), pa.list_(pa.float64())) for ends in (lo, hi)]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "n", "s", "q", "lo", "hi"])

    ends = [F.struct(F.min(F.col("lo")[i]).alias("lo"), F.max(F.col("hi")[i]).alias("hi")) for i in range(width)]
    return rows.drop("key").mapInArrow(sums, kind).groupBy("tree", "node").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.array(*ends).alias("ends"))


def _left_sums(rows: DataFrame, nodes: DataFrame, drawn: DataFrame, width: int, level: int) -> DataFrame:
    """``tree, node, feature, threshold, nl, sl``: the rows on the left of every drawn threshold, and the sum of their targets."""
    trees = _arrays(nodes)
    walk, read = _walker(trees), _reader(width)
    open_ = trees["level"] == level
    which, number = np.flatnonzero(open_), np.cumsum(open_) - 1
    cuts = drawn.select("tree", "node", F.posexplode("drawn").alias("j", "c")).select("tree", "node", "j", "c.feature", "c.threshold").toArrow()
    cuts = {c: cuts.column(c).to_numpy() for c in cuts.column_names}
    tried = int(cuts["j"].max()) + 1 if len(cuts["j"]) else 0
    feature, threshold = np.full((tried, len(which)), -1), np.zeros((tried, len(which)))
    places = number[trees["roots"][cuts["tree"]] + cuts["node"]]
    feature[cuts["j"], places], threshold[cuts["j"], places] = cuts["feature"], cuts["threshold"]
    kind = "tree int, node int, feature int, threshold double, nl double, sl double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, tried, len(which)))
        for batch in batches:
            x, y, times = read(batch)
            for tree in range(len(times)):
                drawn_rows = np.flatnonzero(times[tree])
                own = x.take(drawn_rows, axis=1)
                at = walk(own, tree, level)
                reached = np.flatnonzero(open_.take(at))
                spots = number.take(at.take(reached))
                flat, size, rows_here = own.ravel(), own.shape[1], drawn_rows.take(reached)
                for j in range(tried):
                    tries = feature[j].take(spots)
                    values = flat.take(np.maximum(tries, 0) * size + reached)
                    left = np.flatnonzero((tries >= 0) & ~(values > threshold[j].take(spots)))
                    inside, here = rows_here.take(left), spots.take(left)
                    if not len(here):
                        continue
                    low = here.min()
                    w = times[tree].take(inside).astype(np.float64)
                    for k, part in enumerate((w, w * y.take(inside))):
                        found = np.bincount(here - low, part)
                        total[k, j, low : low + len(found)] += found
        for j in range(tried):
            tries = np.flatnonzero(feature[j] >= 0)
            columns = [pa.array(x[tries], pa.int32()) for x in (trees["tree"][which], trees["node"][which], feature[j])]
            columns += [pa.array(x[tries]) for x in (threshold[j], total[0, j], total[1, j])]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "feature", "threshold", "nl", "sl"])

    return rows.drop("key").mapInArrow(sums, kind).groupBy("tree", "node", "feature", "threshold").agg(F.sum("nl").alias("nl"), F.sum("sl").alias("sl"))


class ExtraTrees:
    """A fitted model: its nodes as a table, and ``transform`` like other models."""

    def __init__(self, nodes: DataFrame, names: Sequence[str], depth: int):
        self.nodes, self.names, self.depth = nodes, list(names), depth

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``estimate``, the mean over the trees of the value where a row ends."""
        trees, depth = _arrays(self.nodes), self.depth
        walk, count = _walker(trees), len(trees["roots"])

        @F.arrow_udf("double")
        def mean(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
            total, none = np.zeros(x.shape[1]), np.zeros(x.shape[1], bool)
            for tree in range(count):
                at = walk(x, tree, max(depth, 1))
                total += trees["value"][at]
                none |= trees["none"][at]
            return pa.array(total / count, mask=none)

        # a row without a feature goes left, one whose feature is no number right
        cells = [F.col(f"`{n}`").cast("double") for n in self.names]
        cells = [F.coalesce(F.nanvl(c, F.lit(float("inf"))), F.lit(float("-inf"))) for c in cells]
        return df.withColumn("estimate", mean(*cells))

    def importances(self) -> DataFrame:
        """``rank, name, importance``: shares of the squared error that splits on a feature removed."""
        spark = self.nodes.sparkSession
        named = spark.createDataFrame(list(enumerate(self.names)), "feature int, name string")
        gains = self.nodes.where("feature >= 0").groupBy("feature").agg(F.sum("gain").alias("gain"))
        total = F.coalesce(F.nullif(gains.agg(F.sum("gain")).scalar(), F.lit(0.0)), F.lit(1.0))
        rows = named.join(gains, "feature", "left").select("name", (F.coalesce("gain", F.lit(0.0)) / total).alias("importance"))
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "name")  # as many rows as features
        return rows.withColumn("rank", F.row_number().over(order))

    def save(self, path: str) -> None:
        extra = F.lit(",".join(self.names)).alias("names"), F.lit(self.depth).alias("depth")
        self.nodes.select("*", *extra).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExtraTrees:
        rows = spark.read.parquet(path)
        first = rows.select("names", "depth").first()
        return cls(rows.drop("names", "depth"), first["names"].split(","), first["depth"])


def train_extra_trees(
    df: DataFrame,
    names: Sequence[str],
    target: str = "grade",
    seed: int = 0,
    numTrees: int = 50,
    maxDepth: int = 10,
    minInstancesPerNode: int = 1,
    featureShare: float = 0.5,
    bootstrap: bool = True,
) -> ExtraTrees:
    """Fit trees whose nodes try one random threshold on each of a random share of their varying features.

    The threshold is uniform between a feature's least and greatest value in the node; the cut that removes most squared error
    is taken. ``bootstrap`` weights rows per tree by a hash of their keys. Rows without a target take no part; without
    any row every estimate is NULL. The driver sees no row and no sum, only the nodes, whose number the settings bound.
    """
    if numTrees << (maxDepth + 1) > MOST_NODES:
        raise ValueError(f"{numTrees} trees of depth {maxDepth} may have more than {MOST_NODES} nodes")
    spark, width = df.sparkSession, len(names)
    tried = max(1, round(featureShare * width))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, as adaptive execution would merge rows that are few but dear
    rows = clean_features(df, names).where(F.col(target).isNotNull())
    x = [F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)]
    rows = rows.select(*x, F.col(target).cast("double").alias("y"), F.xxhash64(*KEYS).alias("key")).repartition(tasks, "key")
    times = [_drawn_times(_unit(F.col("key"), F.lit(tree), F.lit(seed))) if bootstrap else F.lit(1) for tree in range(numTrees)]
    rows = stored(rows.withColumn("times", F.array(*[t.cast("tinyint") for t in times])), "tree-rows")

    leaf = [F.lit(-1).alias("feature"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("int").alias("left")]
    roots = spark.range(numTrees).select(F.col("id").cast("int").alias("tree"), F.lit(0).alias("node"), F.lit(0).alias("level"), *leaf,
                                         F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("rows"), F.lit(0.0).alias("gain"))
    # a bootstrap may miss every row of a tiny table; the mean of all rows stands in
    nodes = cut_lineage(roots.withColumn("value", rows.agg(F.avg("y")).scalar()))

    for level in range(maxDepth):
        sums = _node_sums(rows, nodes, width, level)

        def cut(end, i):
            here = [F.col("tree"), F.col("node"), i, F.lit(seed)]
            threshold = end["lo"] + (end["hi"] - end["lo"]) * _unit(*here, F.lit("threshold"))
            return F.struct(F.xxhash64(*here, F.lit("order")).alias("place"), i.alias("feature"), threshold.alias("threshold"), (end["hi"] > end["lo"]).alias("varies"))

        cuts = F.slice(F.array_sort(F.filter(F.transform("ends", cut), lambda c: c["varies"])), 1, tried)
        cuts = F.transform(cuts, lambda c: F.struct(c["feature"].alias("feature"), c["threshold"].alias("threshold")))
        error = F.col("q") - F.col("s") * F.col("s") / F.col("n")
        splits = (F.col("n") >= 2 * minInstancesPerNode) & (error > 1e-12 * F.greatest(F.col("q"), F.lit(1e-300)))
        drawn = cut_lineage(sums.select("tree", "node", "n", "s", F.when(splits, cuts).alias("drawn")))

        # what is left of every drawn threshold, and the best of each node
        left = _left_sums(rows, nodes, drawn, width, level)
        left = left.join(drawn.drop("drawn"), ["tree", "node"])
        nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
        gain = F.try_divide(F.col("sl") * F.col("sl"), F.col("nl")) + F.try_divide(sr * sr, nr) - F.col("s") * F.col("s") / F.col("n")
        left = left.withColumn("gain", gain).where((F.col("nl") >= minInstancesPerNode) & (nr >= minInstancesPerNode) & (F.col("gain") > 0))
        best = left.groupBy("tree", "node").agg(F.max(F.struct("gain", -F.col("feature"), "feature", "threshold", "nl", "sl", "n", "s")).alias("b"))
        best = best.select("tree", "node", "b.gain", "b.feature", "b.threshold", "b.nl", "b.sl", "b.n", "b.s")
        in_tree = Window.partitionBy("tree").orderBy("node")  # at most 2 ** level nodes
        first = nodes.groupBy("tree").agg((F.max("node") + 1).alias("first"))
        best = best.join(first, "tree").withColumn("left", (F.col("first") + 2 * (F.row_number().over(in_tree) - 1)).cast("int"))
        best = cut_lineage(best)
        if best.isEmpty():
            break

        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("nl").alias("rows"), (F.col("sl") / F.col("nl")).alias("value")),
                        F.struct(F.lit(1).alias("side"), nr.alias("rows"), (sr / nr).alias("value")))
        children = best.select("tree", "left", F.inline(sides)).select(
            "tree", (F.col("left") + F.col("side")).alias("node"), F.lit(level + 1).alias("level"), *leaf, "value", "rows", F.lit(0.0).alias("gain"))
        grown = best.select("tree", "node", *[F.col(c).alias(f"_{c}") for c in ("feature", "threshold", "left", "gain")])
        known = nodes.join(grown, ["tree", "node"], "left").join(
            drawn.select("tree", "node", F.col("n").alias("_n"), (F.col("s") / F.col("n")).alias("_v")), ["tree", "node"], "left")
        known = known.select(
            "tree", "node", "level", *[F.coalesce(f"_{c}", c).alias(c) for c in ("feature", "threshold", "left")],
            F.coalesce("_v", "value").alias("value"), F.coalesce("_n", "rows").alias("rows"), F.coalesce("_gain", "gain").alias("gain"))
        nodes = cut_lineage(known.unionByName(children))
    return ExtraTrees(nodes, names, maxDepth)
