"""Document fingerprints by consistent weighted sampling of their words."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standout.llm.catalog import query
from standout.llm.common import partitions, table

#: Samples of a fingerprint; the likeness has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 64
#: Blocks of consecutive documents for each shuffle partition, so that the blocks spread evenly.
BLOCKS = 8
#: Characters of text and rows of words that are worked on at once.
_CHARS, _TERMS = 1 << 19, 4096
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input changes each bit of the output with even odds."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 32 bits each."""
    return (bits.astype(np.float64) + 0.5) * 2.0**-32


def _variates(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term and sample, fixed by the term's hash: r and log c, both Gamma(2, 1), and b, uniform."""
    low = np.uint64(0xFFFFFFFF)
    seeds = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = _mixed(terms[:, None] ^ seeds[None, :])
    one = _mixed(base + np.uint64(0x632BE59BD9B4E019))
    two = _mixed(base + np.uint64(0xD1342543DE82EF95))
    r = -np.log(_uniform(one >> np.uint64(32)) * _uniform(one & low))
    c = -np.log(_uniform(two >> np.uint64(32)) * _uniform(two & low))
    return r, np.log(c), _uniform(base >> np.uint64(32))


def signatures(documents: list[Counter], samples: int = SAMPLES) -> np.ndarray:
    """Samples of weighted bags, an array of 32-bit values (documents, samples); empty bags give zeros.

    A sample takes the term of least ln a = ln c - r (t - b + 1) with t = floor(ln(weight) / r + b), and keeps the hash of
    term and t. Two bags agree in a sample with a probability of their generalised Jaccard similarity, sum of the minima by
    sum of the maxima of the weights. Terms of weight one have t = 0 and a rank that no document changes.
    """
    words = list(dict.fromkeys(w for bag in documents for w in bag))
    place = {w: i for i, w in enumerate(words)}
    terms = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = np.zeros((len(documents), samples), np.uint32)
    best = np.full((len(documents), samples), np.inf)
    rows = np.array([place[w] for bag in documents for w in bag], np.int64)
    logs = np.log(np.array([n for bag in documents for n in bag.values()], np.float64))
    owner = np.repeat(np.arange(len(documents)), [len(bag) for bag in documents])
    salts = _mixed(np.arange(samples, dtype=np.uint64) + np.uint64(77))
    for at in range(0, len(words), _TERMS):
        r, c, b = _variates(terms[at : at + _TERMS], samples)
        single = c - r * (1.0 - b)
        here = np.nonzero((rows >= at) & (rows < at + _TERMS))[0]
        if not len(here):
            continue
        ids, starts = np.unique(owner[here], return_index=True)
        for doc, lo, hi in zip(ids, starts, [*starts[1:], len(here)]):
            own = here[lo:hi]
            local = rows[own] - at
            rank = single[local]
            heavy = np.nonzero(logs[own] > 0)[0]
            t = None
            if len(heavy):
                pick = local[heavy]
                t = np.floor(logs[own][heavy, None] / r[pick] + b[pick])
                rank[heavy] = c[pick] - r[pick] * (t - b[pick] + 1.0)
            least = rank.argmin(axis=0)
            value = rank[least, np.arange(samples)]
            level = np.zeros(samples)
            if t is not None:
                back = np.full(len(own), -1)
                back[heavy] = np.arange(len(heavy))
                chosen = back[least]
                level = np.where(chosen >= 0, t[chosen, np.arange(samples)], 0.0)
            mark = _mixed(terms[at + local[least]] + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            better = value < best[doc]
            best[doc] = np.where(better, value, best[doc])
            out[doc] = np.where(better, (_mixed(mark ^ salts) >> np.uint64(32)).astype(np.uint32), out[doc])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=-1)


def bag(text: str) -> Counter:
    """Words of a text, A-Z folded, with their number as weight."""
    return Counter(text.encode("utf-8", "surrogatepass").lower().split())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many (or all) characters from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _block_of(cuts: list[int]) -> Column:
    """Number of the block of a doc_id from 1 upwards; documents without one are block 0, below all others."""
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64)) + 1)

    return F.when(F.col("doc_id").isNull(), 0).otherwise(place(F.coalesce("doc_id", F.lit(0).cast("long"))))


def _blocks(docs: DataFrame, count: int) -> tuple[list[int], dict[int, int | None]]:
    """Cut points of doc_id into blocks of about equal size, and the largest doc_id of each block with rows."""
    shares = [i / count for i in range(1, count)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * count)).first()[0]
    cuts = sorted(set(cuts or []))
    heads = docs.withColumn("block", _block_of(cuts)).groupBy("block").agg(F.max("doc_id").alias("head")).collect()
    return cuts, {r["block"]: r["head"] for r in heads}


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document's.

    The next document is the one with the next smaller doc_id (documents without one come last); after the last one comes
    the first. Rows with the same doc_id follow each other by the hash of their text. The only row of a table is its own
    next. NULL texts are empty; two empty bags are alike in all samples. Columns other than doc_id and text are not read.

    Texts are shuffled once, in blocks of consecutive documents; the first document of each block goes to the block before
    too, so that every document meets its next one in one pass over sorted rows.
    """
    spark = docs.sparkSession
    count = BLOCKS * partitions(spark)
    cuts, heads = _blocks(docs.select("doc_id"), count)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", _block_of(cuts))
    last_first = sorted(heads, reverse=True)
    previous = dict(zip(last_first, last_first[-1:] + last_first[:-1]))
    numbers = range(len(cuts) + 2)
    head = F.get(F.array(*[F.lit(heads.get(k)).cast("long") for k in numbers]), F.col("block"))
    target = F.get(F.array(*[F.lit(previous.get(k)).cast("int") for k in numbers]), F.col("block"))
    rows = rows.withColumn("target", F.when(head.eqNullSafe(F.col("doc_id")), target))
    own = F.struct("block", F.lit(False).alias("copy"))
    copied = F.struct(F.col("target").alias("block"), F.lit(True).alias("copy"))
    places = F.when(F.col("target").isNotNull(), F.array(own, copied)).otherwise(F.array(own))
    rows = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "place.block", "place.copy")
    rows = rows.withColumn("tie", F.xxhash64("text")).repartition(partitions(spark), "block")
    rows = rows.sortWithinPartitions("block", "copy", F.col("doc_id").desc_nulls_last(), "tie")
    schema = spark.createDataFrame([], _RESULT).schema
    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for batch in batches:
            columns = [batch.column(x) for x in ("doc_id", "text", "block", "copy")]
            for row in zip(*columns):
                row = tuple(x.as_py() for x in row)
                held.append(row)
                chars += len(row[1])
                if chars >= _CHARS and len(held) > 1:
                    yield _finish(held, samples, arrow)
                    held, chars = held[-1:], len(row[1])
        if len(held) > 1:
            yield _finish(held, samples, arrow)

    return rows.mapInArrow(work, _RESULT)


def _finish(held: list[tuple], samples: int, schema: pa.Schema) -> pa.RecordBatch:
    """Results of the rows whose next row is held too: those of the same block that are not copies themselves."""
    done = [
        (held[i][0], held[i][1], i) for i in range(len(held) - 1) if not held[i][3] and held[i][2] == held[i + 1][2]
    ]
    changed = [edited(text, held[i + 1][1]) for _, text, i in done]
    needed = sorted({i for *_, i in done} | {i + 1 for *_, i in done})
    at = {i: k for k, i in enumerate(needed)}
    signs = signatures([bag(held[i][1]) for i in needed] + [bag(x) for x in changed], samples)
    out = []
    for k, ((doc_id, text, i), new) in enumerate(zip(done, changed)):
        mine, following, other = signs[at[i]], signs[at[i + 1]], signs[len(needed) + k]
        out.append(
            (
                doc_id,
                len(text),
                hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                mine.astype(">u4").tobytes().hex(),
                other.astype(">u4").tobytes().hex(),
                float(likeness(mine, other)),
                float(likeness(mine, following)),
            )
        )
    columns = list(zip(*out)) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


@query("op3_weighted_samples")
def op3_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
