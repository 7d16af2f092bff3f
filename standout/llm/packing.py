"""Packing documents into token sequences whose windows hold the sources in their target proportions."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standout.llm.catalog import query
from standout.llm.common import partitions, stored, table

#: Tokens of a full sequence, and the id that ends every document.
WINDOW, END = 2048, 1
#: A source whose deficit is smaller waits, unless its document ends sooner; keeps documents from being cut to shreds.
LEAST_PIECE = 64
#: Groups of documents for each shuffle partition; each is packed by one task in one pass.
GROUPS = 4
#: Tokens that a pass holds before it fills windows, so that the queues of all sources have something to give.
BACKLOG = 1 << 18
_CACHE = 300_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CachedTokenizer:
    """Ids of whole texts by a byte-level vocabulary of ranks, with the ids of space-separated units kept.

    Such a tokenizer never joins characters across a single space between two others, so a text is the sequence of its units,
    each with the space before it. Texts with white space next to such a space are encoded whole. Texts are cut at the added
    tokens of the tokenizer file beside the ranks, which have ids of their own.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ids = own.encode_ordinary
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens are matched as they are only")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.kind = np.dtype("<u2") if max(*ranks.values(), *self.added.values()) < 1 << 16 else np.dtype("<u4")
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self.bytes_of[rank] = len(word)
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids, at = [], 0
        for found in self.cut.finditer(text):
            ids += [*self.ids(text[at : found.start()]), self.added[found.group()]]
            at = found.end()
        return np.array([*ids, *self.ids(text[at:])] if at else self.ids(text), self.kind).tobytes()

    def _learn(self, units: list[str]) -> None:
        """Encode units of at least one character, each with its space, as one text and cut the ids at their bytes."""
        ids = np.array(self.ids(" " + " ".join(units)), self.kind)
        ends = np.cumsum([1 + len(u.encode()) for u in units])
        cuts = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * self.kind.itemsize
        data, cuts = ids.tobytes(), cuts.tolist()
        self.known.update((u, data[a:b]) for u, a, b in zip(units, [0, *cuts], cuts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers, with the end id; the texts of one call share what they need."""
        end = np.array([END], self.kind).tobytes()
        if len(self.known) > _CACHE:
            self.known = {}
        known = self.known
        split: list[list[str] | None] = []
        missing: dict[str, None] = {}
        for text in texts:
            if self.cut.search(text):
                split.append(None)
                continue
            units = text.split(" ")
            new = [u for u in units[1:] if u not in known]
            if _loose(units[0]) or any(map(_loose, new)):
                split.append(None)
            else:
                split.append(units)
                missing.update(dict.fromkeys(new))
        if missing:
            self._learn(list(missing))
        out = []
        for text, units in zip(texts, split):
            if units is None:
                out.append(self._whole(text) + end)
            else:
                out.append(self._whole(units[0]) + b"".join([known[u] for u in units[1:]]) + end)
        return out


def _loose(unit: str) -> bool:
    """Whether a unit is empty or has white space at an end."""
    return not unit or unit[0].isspace() or unit[-1].isspace()


_loaded: dict[str, CachedTokenizer] = {}


def tokenizer_at(path: str) -> CachedTokenizer:
    """The tokenizer of a file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]


def tokens(docs: DataFrame, path: str, groups: int) -> DataFrame:
    """``(doc_id, source, part, place, n, ids)``: the ids of whole texts, and a group and a place in it from a hash."""
    place = F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit(""))))
    part = F.pmod(F.xxhash64(place, F.lit(3)), F.lit(groups)).cast("int")
    rows = docs.select("doc_id", F.col("source").cast("string"), part.alias("part"), place.alias("place"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_at(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) < 1 << 21):
                    chars += len(texts[stop])
                    stop += 1
                ids = own.encode(texts[at:stop])
                part = batch.slice(at, stop - at)
                sizes = pa.array([len(x) // own.kind.itemsize for x in ids], pa.int64())
                columns = [part.column(c) for c in ("doc_id", "source", "part", "place")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, sizes, pa.array(ids, pa.binary())], ["doc_id", "source", "part", "place", "n", "ids"]
                )
                at = stop

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, part int, place long, n long, ids binary"
    return rows.mapInArrow(encode, schema)


def shares(counted: DataFrame) -> DataFrame:
    """``(part, source, share, deficit)``: the source's share of all tokens, and what it is owed when the group begins.

    The deficit is the share of all tokens of the earlier groups less the source's tokens in them: groups are packed whole, so
    that is what each leaves to the next.
    """
    parts = counted.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(every).alias("all")
    )
    own = Window.partitionBy("source")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = counted.withColumn("whole", F.sum("n").over(own))
    rows = rows.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).join(parts, "part")
    share = F.col("whole") / F.col("all")
    return rows.select("part", "source", share.alias("share"), (share * F.col("before") - F.col("used")).alias("deficit"))


class RoundRobin:
    """Deficit round-robin over queues of documents, one queue for each source.

    Every window adds to each source's deficit its share of the window. Sources are visited in turn, the first one changing,
    and give pieces as long as their deficit covers them. Where those that have documents are owed too little to fill the
    window, the one owed most gives ahead. Deficits stay from window to window.
    """

    def __init__(self, window: int, least: int) -> None:
        self.window, self.least = window, least
        self.share: dict[str | None, float] = {}
        self.deficit: dict[str | None, float] = {}
        self.queues: dict[str | None, deque] = {}
        self.backlog = self.turn = 0

    def add_source(self, source: str | None, share: float, deficit: float) -> None:
        self.share[source], self.deficit[source] = share, deficit

    def add(self, source: str | None, doc_id: int | None, ids: np.ndarray) -> None:
        self.queues.setdefault(source, deque()).append([doc_id, ids, 0])
        self.backlog += len(ids)

    def _give(self, source: str | None, take: int, at: int) -> tuple:
        queue = self.queues[source]
        head = queue[0]
        doc_id, ids, start = head
        head[2] += take
        if head[2] == len(ids):
            queue.popleft()
            if not queue:
                del self.queues[source]
        self.deficit[source] -= take
        self.backlog -= take
        return doc_id, start, ids[start : start + take], len(ids), at

    def fill(self, size: int) -> list[tuple]:
        """Pieces (doc_id, start, ids, document's tokens, offset) of one sequence; the backlog holds at least ``size``."""
        for source, share in self.share.items():
            self.deficit[source] += share * size
        names = list(self.queues)
        self.turn += 1
        first = self.turn % len(names)
        names = names[first:] + names[:first]
        pieces, at = [], 0
        while at < size:
            gave = False
            for source in names:
                while at < size and source in self.queues:
                    _, ids, start = self.queues[source][0]
                    left = len(ids) - start
                    if self.deficit[source] < min(left, self.least):
                        break
                    take = min(left, size - at, int(self.deficit[source]))
                    pieces.append(self._give(source, take, at))
                    at += take
                    gave = True
            if at < size and not gave:
                source = max(self.queues, key=self.deficit.__getitem__)
                _, ids, start = self.queues[source][0]
                take = min(len(ids) - start, size - at, self.least)
                pieces.append(self._give(source, take, at))
                at += take
        return pieces

    def sequences(self, keep: int) -> Iterator[list[tuple]]:
        """Fill windows while more than ``keep`` tokens wait; with none to keep, the rest goes to powers of two."""
        while self.backlog > keep and (self.backlog >= self.window or not keep):
            yield self.fill(min(self.window, 1 << (self.backlog.bit_length() - 1)))


def pack(
    docs: DataFrame,
    path: str = public_tokenizers.path("byte_bpe_50k.tiktoken"),
    window: int = WINDOW,
    least: int = LEAST_PIECE,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids``.

    Documents are dealt to groups by a hash, so that each has the sources mixed; a group is packed in one pass over rows in
    hash order. Target proportions are the sources' shares of all tokens. What a group leaves open is carried to the next, and
    the tokens left at its end, fewer than a window, fill sequences of powers of two, so nothing is padded.

    NULL texts are empty documents of one token, NULL is a source of its own, repeated rows are packed each. ``window`` must be
    a power of two. Only doc_id, source and text are read; an empty table gives no rows.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    count = GROUPS * partitions(spark)
    encoded = stored(tokens(docs, path, count), "tokens")
    owed = shares(encoded.groupBy("part", "source").agg(F.sum("n").alias("n")))
    key = encoded.schema["doc_id"].dataType
    heads = owed.select(
        "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(None).cast(key).alias("doc_id"), "source",
        F.lit(None).cast("binary").alias("ids"), "share", "deficit",
    )
    nothing = F.lit(None).cast("double")
    rows = encoded.select(
        "part", F.lit(1).alias("kind"), "place", "doc_id", "source", "ids", nothing.alias("share"), nothing.alias("deficit")
    )
    rows = heads.unionByName(rows).repartition(partitions(spark), "part").sortWithinPartitions("part", "kind", "place", "doc_id")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokenizer_at(path).kind
        robin, part, done, out = RoundRobin(window, least), None, 0, []

        def emit(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal done, out
            for pieces in found:
                for doc_id, start, ids, whole, at in pieces:
                    data = ids.astype("<u4").tobytes()
                    row = (doc_id, start, len(ids), zlib.crc32(data), whole, (part << 40) + done, at)
                    out.append((*row, data) if with_ids else row)
                done += 1
                if len(out) >= 4096:
                    yield batch_of(out)
                    out = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            columns = [batch.column(c) for c in ("part", "kind", "doc_id", "source", "ids", "share", "deficit")]
            for row in zip(*columns):
                number, what, doc_id, source, ids, share, deficit = (x.as_py() for x in row)
                if number != part:
                    if part is not None:
                        yield from emit(robin.sequences(0))
                    robin, part, done = RoundRobin(window, least), number, 0
                if what == 0:
                    robin.add_source(source, share, deficit)
                    continue
                robin.add(source, doc_id, np.frombuffer(ids, kind))
                if robin.backlog >= 2 * BACKLOG:
                    yield from emit(robin.sequences(BACKLOG))
        if part is not None:
            yield from emit(robin.sequences(0))
        if out:
            yield batch_of(out)

    return rows.mapInArrow(fill, _PIECES + ", ids binary" * with_ids)


@query("op7_round_robin_packing")
def op7_round_robin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
