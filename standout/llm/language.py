"""Language of a text by a small convolutional network over its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standout.llm.catalog import query
from standout.llm.common import bounded_sample, remainder, table

#: Bytes of a window; neighbouring windows share three bytes, so that no filter misses a place.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Training uses at most this many documents of each language, and of each a slice of this many characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 1000, 1024
STEPS, BATCH, RATE = 400, 64, 0.01
UNKNOWN = "und"
_REACH = max(WIDTHS)
_WINDOWS = 64
_RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass
class ByteNetwork:
    """Embedded bytes, filters of several widths (zero beyond their width), max pooling and softmax."""

    languages: list[str]
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes under the filters at each place: (windows, places, reach * embedding)."""
        embedded = np.ascontiguousarray(self.bytes_[windows])
        n, length, size = embedded.shape
        step = embedded.strides
        shape = (n, length - _REACH + 1, _REACH * size)
        view = np.lib.stride_tricks.as_strided(embedded, shape, (step[0], step[1], step[2]), writeable=False)
        return np.ascontiguousarray(view)

    def pooled(self, columns: np.ndarray) -> np.ndarray:
        n, places, size = columns.shape
        found = (columns.reshape(-1, size) @ self.filters).reshape(n, places, -1)
        return found

    def log_shares(self, windows: np.ndarray) -> np.ndarray:
        """Log probability of each language for each window of bytes."""
        best = self.pooled(self.columns(windows)).max(axis=1) + self.bias
        scores = np.maximum(best, 0) @ self.out + self.out_bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def cut(text: str) -> np.ndarray:
    """The windows of a whole text; the last one is filled up with zero bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    step = WINDOW - _REACH + 1
    count = max(1, -(-(len(data) - _REACH + 1) // step))
    filled = np.zeros((count - 1) * step + WINDOW, np.uint8)
    filled[: len(data)] = data[: len(filled)]
    return np.lib.stride_tricks.as_strided(filled, (count, WINDOW), (step, 1), writeable=False)


def train(texts: list[str], languages: list[str], seed: int = 7, steps: int = STEPS) -> ByteNetwork:
    """Fit the network by Adam on random windows of labelled texts, every language as often."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    groups = [[t for t, x in zip(texts, languages) if x == name] for name in names]
    groups = [[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in g] for g in groups]
    wide = FILTERS * len(WIDTHS)
    mask = np.zeros((_REACH, EMBEDDING, len(WIDTHS), FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i] = 1
    mask = mask.reshape(_REACH * EMBEDDING, wide)
    net = ByteNetwork(
        names,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(wide, np.float32),
        rng.normal(0, 0.2, (wide, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    weights = [net.bytes_, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rows = np.arange(BATCH)
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(names), BATCH)
        windows = np.zeros((BATCH, WINDOW), np.uint8)
        for i, label in enumerate(labels):
            data = groups[label][rng.integers(len(groups[label]))]
            size = int(rng.integers(32, WINDOW + 1))
            at = int(rng.integers(max(1, len(data) - size + 1)))
            piece = data[at : at + size]
            windows[i, : len(piece)] = piece
        columns = net.columns(windows)
        found = net.pooled(columns)
        place = found.argmax(axis=1)
        best = np.take_along_axis(found, place[:, None, :], 1)[:, 0] + net.bias
        hidden = np.maximum(best, 0)
        scores = hidden @ net.out + net.out_bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = scores / scores.sum(axis=1, keepdims=True)
        error[rows, labels] -= 1
        error /= BATCH
        back = (error @ net.out.T) * (best > 0)
        under = columns[rows[:, None], place]
        of_bytes = (back[:, :, None] * net.filters.T[None]).reshape(BATCH, wide, _REACH, EMBEDDING)
        at = windows[rows[:, None, None], place[:, :, None] + np.arange(_REACH)]
        gradient = np.zeros_like(net.bytes_)
        np.add.at(gradient, at, of_bytes)
        gradients = [
            gradient, np.einsum("bfi,bf->if", under, back) * mask, back.sum(0), hidden.T @ error, error.sum(0),
        ]
        for w, g, m, v in zip(weights, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: ByteNetwork | None, texts: Iterator[str | None]) -> tuple[list[str], list[float]]:
    """Most likely language and its share for each text, from the mean of its windows' log probabilities."""
    found: list[tuple[str, float]] = []
    waiting: list[tuple[int, np.ndarray]] = []
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}

    def run() -> None:
        owners = np.concatenate([np.full(len(w), i) for i, w in waiting])
        windows = np.concatenate([w for _, w in waiting])
        for at in range(0, len(windows), _WINDOWS):
            shares = net.log_shares(windows[at : at + _WINDOWS]).astype(np.float64)
            ids, starts = np.unique(owners[at : at + _WINDOWS], return_index=True)
            for i, total in zip(ids, np.add.reduceat(shares, starts)):
                sums[i] = sums.get(i, 0) + total
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        found.append((UNKNOWN, 0.0))
        if text is None or net is None:
            continue
        windows = cut(text)
        counts[i] = len(windows)
        for at in range(0, len(windows), 16 * _WINDOWS):
            waiting.append((i, windows[at : at + 16 * _WINDOWS]))
            held += len(waiting[-1][1])
            if held >= 16 * _WINDOWS:
                run()
                held = 0
    if waiting:
        run()
    for i, total in sums.items():
        share = np.exp(total / counts[i] - (total / counts[i]).max())
        share /= share.sum()
        best = int(share.argmax())
        found[i] = (net.languages[best], float(share[best]))
    return [x for x, _ in found], [x for _, x in found]


def fit(docs: DataFrame) -> ByteNetwork | None:
    """Train on a bounded sample of the documents whose remainder by 4 is not 2; None where no such text has a language.

    The sample has at most 1000 documents of each language, those with the smallest hash of doc_id and slice, and of each
    a slice of 1024 characters at a place that a hash of doc_id fixes.
    """
    labelled = docs.where(remainder("doc_id", 4) != 2).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("doc_id", F.lit(1)), spare.cast("long")) + 1).cast("int")
    labelled = labelled.select(
        "doc_id", F.col("lang").cast("string"), F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("slice")
    )
    rows = bounded_sample(labelled, ["doc_id", "slice"], SAMPLE_DOCUMENTS, "lang").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, r["slice"]))
    return train([r["slice"] for r in rows], [r["lang"] for r in rows]) if rows else None


def language(net: ByteNetwork | None, text: Column) -> Column:
    """A struct of ``lang`` and ``score``; texts that are NULL or have no letter are ``und`` with score 0."""

    @F.pandas_udf(_RESULT)
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(net, iter(texts))
        return pd.DataFrame({"lang": names, "score": scores})

    return guess(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, a row for each document, repeated rows too.

    The network sees the bytes of the text only. Where no row is labelled all are ``und``. A NULL doc_id counts as empty text
    in the remainder. Columns other than doc_id, text and lang are not read; an empty table gives no rows.
    """
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    rows = docs.select("doc_id", held_out, language(fit(docs), F.col("text")).alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


@query("op10_byte_network")
def op10_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
