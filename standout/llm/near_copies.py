"""Documents whose sets of five-word shingles are alike: bands of min-hashes find those that may have a partner, SimHash fingerprints
and then prefixes of their shingles in the order of rising frequency the candidate pairs, and each candidate is checked exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standout.llm.common import fingerprint, new_folder, removed, stored
from standout.llm.components import components
from standout.llm.substrings import SHINGLE, shingles, words_of

#: Two documents are near copies if the Jaccard similarity of their shingles is at least LEAST / OF.
LEAST, OF = 4, 5
#: Bands of min-hashes, and min-hashes of a band. Documents of similarity 0.8 share no band with a probability of
#: (1 - 0.8 ** 4) ** 24, three in a million.
BANDS, ROWS = 24, 4
#: Rounds in which the documents of a shingle are compared with one of them only, after the fingerprints and before those still
#: apart are paired.
STARS = 1
#: Shingles that are hashed at once.
_SLICE = 4096
_MULTIPLIERS = np.random.default_rng(42).integers(1 << 62, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = "doc_id {}, mark string, shape long, size int, bands array<long>"


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text of fewer words is a single one, a text without words has none."""
    words = words_of(text)
    return np.unique(shingles(words, min(width, len(words)))) if words else np.zeros(0, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """A hash for each band of min-hashes of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _SLICE):
        np.minimum(least, (found[at : at + _SLICE, None] * _MULTIPLIERS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def text_mark() -> Column:
    """128 bits that stand for a text; a NULL text counts as empty."""
    return F.md5(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, shape, size, bands)`` for each document: a digest of its text, a hash of its shingles, their number, its bands."""
    schema = _SKETCH.format(docs.schema["doc_id"].dataType.simpleString())
    names = ["doc_id", "mark", "shape", "size", "bands"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            shapes, sizes, keys = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py())
                shape = xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0
                if shape not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[shape] = bands(found).view(np.int64).tolist() if len(found) else []
                shapes.append(shape)
                sizes.append(len(found))
                keys.append(known[shape])
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(np.array(shapes, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names)

    return docs.select("doc_id", text_mark().alias("mark"), "text").mapInArrow(sketch, schema)


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(shape, bits, shingles)`` of the wanted ``(shape, one)``, where ``one`` names a document by doc_id and mark; ``bits`` is the
    SimHash fingerprint of the shingles."""
    rows = docs.select("doc_id", text_mark().alias("mark"), "text")
    named = wanted.select("shape", F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark"))
    rows = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("shape", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(shapes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            marks = np.array([fingerprint(x) for x in sets], np.uint64).view(np.int64)
            columns = [pa.array(shapes), pa.array(marks), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["shape", "bits", "shingles"])

        for batch in batches:
            shapes, sets, held = [], [], 0
            for shape, text in zip(batch.column("shape").to_pylist(), batch.column("text")):
                shapes.append(shape)
                sets.append(shingle_set(text.as_py()))
                held += len(sets[-1])
                if held > 1 << 20:
                    yield batch_of(shapes, sets)
                    shapes, sets, held = [], [], 0
            if shapes:
                yield batch_of(shapes, sets)

    return rows.mapInArrow(cut, "shape long, bits long, shingles array<long>").dropDuplicates(["shape"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have the similarity; exact."""
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("shape").alias(s), F.col("shingles").alias(f"{s}_set")), s)
    both = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    return pairs.where(both * (LEAST + OF) >= LEAST * (F.size("a_set") + F.size("b_set"))).select("a", "b")


def prefixes(sets: DataFrame) -> DataFrame:
    """``(token, shape, size, rest, place)``: the shingles by which a set ``(shape, shingles)`` can meet an alike one.

    Sets of ``x`` and ``y`` shingles are alike only if 4/9 of ``x + y`` are in both. So, with shingles ordered by the number of sets
    that have them, the first that they share has at least that many at and behind its ``place`` in either set (``admits``), and
    as ``y`` is 4/5 of ``x`` or more it is one of the first ``x - 4x/5 + 1``. Shingles of one set only come first and meet none: a set with
    too many of them has no prefix left and is out. ``rest`` is the number of the others, a bound on what a pair can share.
    """
    rows = sets.select("shape", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    own = Window.partitionBy("shape")
    rows = rows.join(shared, "token").withColumn("rest", F.count("*").over(own).cast("int"))
    place = F.row_number().over(own.orderBy("sets", "token")) + F.col("size") - F.col("rest")
    rows = rows.withColumn("place", place)
    longest = F.col("size") - F.floor((LEAST * F.col("size") + OF - 1) / OF) + 1
    return rows.where(F.col("place") <= longest).select("token", "shape", "size", "rest", "place")


def admits(size: str, place: str, other: str) -> Column:
    """Whether the shingles from a place on are enough to be alike to a set of another size."""
    return (F.col(size) - F.col(place) + 1) * (LEAST + OF) >= (F.col(size) + F.col(other)) * LEAST


def shape_roots(docs: DataFrame, marked: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(shape, root)`` of the shapes that are linked to another one; ``marked`` are the sketches of ``docs``.

    Only components are needed, so pairs within one are never compared. At first sets with equal fingerprints and those that
    ``near`` joins are compared, one of each fingerprint. Then each member of a shingle's group is compared with
    one other: the one with the fewest shingles of its own, which is mostly what the others were copied from. Those still
    in different components are then paired at the shingles that admit it from both sides, whatever their number.
    """
    spark, old = docs.sparkSession, []

    def kept(df: DataFrame, label: str) -> DataFrame:
        old.append(new_folder(spark, label))
        return stored(df, label, folder=old[-1])

    one = F.struct("doc_id", "mark")
    shapes = marked.where("size > 0").groupBy("shape").agg(F.min(one).alias("one"), F.first("bands").alias("bands"))
    keyed = shapes.select("shape", "one", F.explode("bands").alias("band"))
    bands_shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    wanted = keyed.join(bands_shared, "band").groupBy("shape").agg(F.min("one").alias("one"))
    sets = kept(shingle_table(docs, wanted), "near-shingles")
    links = kept(alike(by_fingerprint(sets.select("shape", "bits"), near), sets), "near-links")

    def linked() -> DataFrame:
        return stored(components(links).select(F.col("node").alias("shape"), "root"), "near-roots")

    roots = linked()
    found = kept(prefixes(sets), "near-prefixes")
    met = found.groupBy("token").agg(F.count("*").alias("n"), F.min("size").alias("least")).where("n > 1")
    members = kept(found.join(met, "token").where(admits("size", "place", "least")).drop("n", "least"), "near-members")
    removed(spark, old[-2])
    bound = F.least("a_rest", "b_rest") * (LEAST + OF) >= (F.col("a_size") + F.col("b_size")) * LEAST
    columns = ["shape", "size", "rest", "place", "root"]
    for turn in range(STARS + 1):
        now = members.join(roots, "shape", "left").withColumn("root", F.coalesce("root", "shape"))
        apart = now.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
        now = kept(now.join(apart, "token").select("token", *columns), "near-apart")
        left, right = (now.select("token", *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "ab")
        if turn < STARS:
            first = (F.col("a_size") - F.col("a_rest")) / F.col("a_size") if turn == 0 else F.xxhash64(F.lit(turn), "a_shape")
            by = F.struct(first, *[f"a_{c}" for c in columns])
            left = left.groupBy("token").agg(F.min(by).alias("m")).select("token", *[f"m.a_{c}" for c in columns])
            admitted = bound
        else:
            admitted = (F.col("a_shape") < F.col("b_shape")) & admits("a_size", "a_place", "b_size") & admits("b_size", "b_place", "a_size")
        pairs = left.join(right, "token").where((F.col("a_root") != F.col("b_root")) & admitted)
        pairs = pairs.select(F.least("a_shape", "b_shape").alias("a"), F.greatest("a_shape", "b_shape").alias("b")).distinct()
        pairs = kept(pairs, "near-pairs")
        new = kept(alike(pairs, sets), "near-links")
        removed(spark, *old[-3:-1])
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        roots = linked()
    removed(spark, *old)
    return roots


def by_fingerprint(marks: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``(a, b)`` of shapes ``(shape, bits)``: the first of a fingerprint with the others of it, and with the first of a near one."""
    classes = marks.groupBy("bits").agg(F.min("shape").alias("first"))
    copies = marks.join(classes, "bits").where("shape <> first").select(F.col("first").alias("a"), F.col("shape").alias("b"))
    pairs = near(classes.select("bits")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    for bits, name in (("x", "a"), ("y", "b")):
        pairs = pairs.join(classes.select(F.col("bits").alias(bits), F.col("first").alias(name)), bits)
    return copies.unionByName(pairs.select("a", "b"))
