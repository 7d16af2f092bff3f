"""Near-duplicate documents by SimHash fingerprints and pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standout.llm.catalog import query
from standout.llm.common import fingerprint, stored, table
from standout.llm.components import components
from standout.llm.near_copies import shape_roots, sketches, text_mark

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 7
PAIRWISE = 64


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned number; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < width:
        whole = [hashed(b" ".join(words), SEED)]
    else:
        whole = [hashed(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)))]
    return fingerprint(np.array(whole, np.uint64))


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, bits)``, a row for each document; NULL texts count as empty."""
    return docs.select("doc_id", _fingerprint(F.col("text")).alias("bits"))


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """The 64 bits cut into a ring of segments of nearly equal length."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_budgets(distance: int, segments: int) -> list[int]:
    """Bits that the first 1, 2, ... segments of a chain may differ in: their share of the distance, rounded down."""
    return [distance * length // segments for length in range(1, segments + 1)]


def chain_holds(diff: Column, start: Column, distance: int, segments: int) -> Column:
    """Whether every prefix of the chain that begins at segment ``start`` stays within its budget."""
    masks, budgets = segment_masks(segments), chain_budgets(distance, segments)
    holds = F.lit(False)
    for first in range(segments):
        covered, fine = 0, F.lit(True)
        for length, budget in enumerate(budgets):
            covered |= masks[(first + length) % segments]
            if budget and (length + 1 == segments or budgets[length + 1] != budget):
                fine &= F.bit_count(diff.bitwiseAND(F.lit(_signed(covered)))) <= budget
        holds = F.when(start == first, fine).otherwise(holds)
    return holds


def near_pairs(
    bits: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, pairwise: int = PAIRWISE
) -> DataFrame:
    """Edges ``(a, b)`` that join all fingerprints with at most ``distance`` differing bits; ``bits`` are distinct.

    Pigeonring principle: on a ring of m segments two such fingerprints have a segment from which every run of l
    segments differs in at most l * distance / m bits. The leading runs whose budget is below one bit are equal, so
    they are the join key; the later budgets prune the candidates, and the last one is the full distance.

    Keys with more than ``pairwise`` fingerprints are not paired. Their fingerprints meet at shared one-bit variants instead:
    two fingerprints share one exactly if they differ in at most two bits, and at most 65 share one. That gives a star for
    each variant, hence the same components, with work in proportion to the fingerprints.
    """
    if distance != 2:
        raise ValueError("one-bit variants meet at distance 2 only")
    masks, budgets = segment_masks(segments), chain_budgets(distance, segments)
    equal = sum(b == 0 for b in budgets)
    if not equal:
        raise ValueError("more segments than bits of distance are needed")
    keys = []
    for first in range(segments):
        mask = sum(masks[(first + i) % segments] for i in range(equal))
        keys.append(F.struct(F.lit(first).alias("start"), F.col("bits").bitwiseAND(F.lit(_signed(mask))).alias("key")))
    keyed = bits.select("bits", F.explode(F.array(*keys)).alias("k")).select("bits", "k.start", "k.key")
    shared = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keyed.join(shared, ["start", "key"]), "simhash-keys")
    small = members.where(F.col("n") <= pairwise)
    left = small.select("start", "key", F.col("bits").alias("a"))
    right = small.select("start", "key", F.col("bits").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = left.join(right, ["start", "key"]).where(
        (F.col("a") < F.col("b")) & chain_holds(diff, F.col("start"), distance, segments)
    )
    pairs = pairs.where(F.bit_count(diff) <= distance).select("a", "b")
    large = members.where(F.col("n") > pairwise).select("bits").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    variants = large.select("bits", F.explode(flips).alias("flip")).select(
        "bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("variant")
    )
    least = variants.withColumn("least", F.min("bits").over(Window.partitionBy("variant")))
    stars = least.where("bits <> least").select(F.col("least").alias("a"), F.col("bits").alias("b"))
    return pairs.unionByName(stars).distinct()


def _roots(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bits, first)`` with the least doc_id of each fingerprint, and ``(bits, root)`` of the linked ones."""
    classes = marked.groupBy("bits").agg(F.min("doc_id").alias("first"))
    roots = components(near_pairs(classes.select("bits"))).select(F.col("node").alias("bits"), "root")
    return classes, stored(roots, "simhash-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each document.

    Documents are linked if their fingerprints differ in at most two bits; the component's id is the least doc_id that
    can be reached. Copies share a fingerprint and are linked through it, never paired. Texts that are NULL or without
    words have the fingerprint zero and are linked like any other. Rows without a doc_id are kept; they never name a
    component with other members (a component of such rows alone has a NULL id). Only doc_id and text are read.
    """
    marked = stored(fingerprints(docs), "simhash-bits")
    classes, roots = _roots(marked)
    firsts = roots.join(classes, "bits").groupBy("root").agg(F.min("first").alias("linked"))
    linked = roots.join(firsts, "root").select("bits", "linked")
    named = classes.join(linked, "bits", "left").select("bits", F.coalesce("linked", "first").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return marked.join(named, "bits").select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the least doc_id, then of the least hash of the text.

    Documents are linked if their five-word shingles have a Jaccard similarity of 0.8 or more; texts without words are alike. Pairs
    come from SimHash fingerprints of these shingles by ``near_pairs``, then, as alike sets also differ in more bits, from shared
    shingles; each pair is checked exactly.
    Rows without a doc_id stay only where a component has no other. Of repeated rows one stays. All columns are kept.
    """
    marked = stored(sketches(docs), "near-sketches")
    named = marked.join(shape_roots(docs, marked, near_pairs), "shape", "left").withColumn("root", F.coalesce("root", "shape"))
    one = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    kept = named.groupBy("root").agg(F.min(one).alias("one")).select("one.doc_id", "one.mark").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_mark().alias("text_mark"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_mark") == F.col("mark")), "left_semi")
    return rows.dropDuplicates(["id", "text_mark"]).select("row.*")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
