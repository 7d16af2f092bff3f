"""Token ids in binary files, compressed by a grammar of pairs and decoded at any place."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from standout.llm.catalog import query
from standout.llm.common import made, new_folder, partitions, removed, stored, table

#: The id that ends every document.
END = 1
#: A pair is replaced while it stands so often in a shard at places that do not overlap; a rule takes the room of two symbols.
LEAST = 8
#: The last round is the one that replaces fewer than 1 / GAIN of the symbols.
GAIN = 256
#: A shard is closed once it has so many ids.
SHARD_IDS = 1 << 21
#: Ids of whole documents that a reader expands at once.
READ_IDS = 1 << 18
#: Units and pieces whose ids a worker keeps, letter runs that are encoded as one text, and bytes of texts that are encoded at once.
_CACHE, _RUN, _BYTES = 800_000, 256, 1 << 21
_MAGIC, _HEAD = b"REPAIR01", struct.Struct("<8s6q")
_BUCKETS = 1 << 20
_WRITTEN = "file string, documents long, ids long, symbols long, rules long"


class PieceTokenizer:
    """Ids of whole texts by a tokenizer that cuts lower-cased text into pieces (letter runs, single digits, marks, the endings of
    contractions) and never joins across them, with the ids of units (between white space) and of pieces kept.

    Units of up to 16 bytes are found by their bytes in a hash table of numpy arrays, all units of many texts at once; longer
    ones in a dictionary. A letter run ends with the only token of it that is marked as a word's end, so many new ones are
    encoded as one text and cut there; where the cuts do not fit them, each is encoded alone. Texts in which cutting first could
    differ are encoded whole: those with an added token, with NUL (it fills up keys) or characters that are white space to Python only, not in composed
    form, or with the one letter whose lower case is a letter and a mark.
    """

    PIECES = re.compile(r"'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    #: Stands behind every text and becomes the end id; texts with this byte are encoded whole.
    STOP = b"\x1c"
    SLOTS = 1 << 21
    SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
    LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, path: str) -> None:
        own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if model["model"]["end_of_word_suffix"] != "</w>" or [n["type"] for n in model["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a tokenizer of lower-cased words with ends")
        self.encode_all = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        self.odd = [t["content"].encode() for t in model["added_tokens"]] + [bytes([c]) for c in (0, *range(0x1C, 0x20))] + ["\u0130".encode()]
        self.size = own.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        for word, number in own.get_vocab().items():
            self.ends[number] = word.endswith("</w>")
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.long: dict[bytes, int] = {}
        self.keys = np.zeros((self.SLOTS, 2), np.uint64)
        self.unit_at = np.full(self.SLOTS, -1, np.int32)
        self.units, self.firsts, self.counts, self.flat, self.used = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.kind), 0
        low, high = self._key(self.STOP)
        self._place(np.array([low], np.uint64), np.array([high], np.uint64), self._add([self._bytes([END])]))

    @staticmethod
    def _key(unit: bytes) -> tuple[int, int]:
        return int.from_bytes(unit[:8], "little"), int.from_bytes(unit[8:], "little")

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _add(self, coded: list[bytes]) -> np.ndarray:
        """Keep the ids of new units and return the units' numbers."""
        data = np.frombuffer(b"".join(coded), self.kind)
        sizes = np.array([len(c) // self.kind.itemsize for c in coded], np.int64)
        while self.units + len(coded) > len(self.firsts):
            self.firsts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.firsts, self.counts))
        while self.used + len(data) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        numbers = np.arange(self.units, self.units + len(coded))
        self.firsts[numbers], self.counts[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(data)] = data
        self.units, self.used = self.units + len(coded), self.used + len(data)
        return numbers

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(43)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of units by their bytes, -1 for new ones; slots are tried one after the other."""
        out, rest, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(rest):
            there = self.unit_at[slot]
            hit = (there >= 0) & (self.keys[slot, 0] == low[rest]) & (self.keys[slot, 1] == high[rest])
            out[rest[hit]] = there[hit]
            on = (there >= 0) & ~hit
            rest, slot = rest[on], (slot[on] + 1) % self.SLOTS
        return out

    def _place(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Put distinct new units into free slots; of those that want one slot the last gets it, the others go on."""
        slot = self._slot(low, high)
        while len(numbers):
            free = self.unit_at[slot] < 0
            self.unit_at[slot[free]] = numbers[free]
            got = free & (self.unit_at[slot] == numbers)
            self.keys[slot[got], 0], self.keys[slot[got], 1] = low[got], high[got]
            low, high, numbers, slot = low[~got], high[~got], numbers[~got], (slot[~got] + 1) % self.SLOTS

    def _coded(self, units: list[str]) -> list[bytes]:
        """Ids of units, from those of their pieces; new pieces are encoded."""
        known = self.pieces
        cut = [[u] if u.isalpha() else self.PIECES.findall(u) for u in units]
        new = {p for pieces in cut for p in pieces if p not in known}
        alone = [p for p in new if not p.isalpha()]
        runs = [p for p in new if p.isalpha()]
        parts = [runs[i : i + _RUN] for i in range(0, len(runs), _RUN)]
        for part, ids in zip(parts, self.encode_all([" ".join(p) for p in parts])):
            numbers = np.array(ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[numbers]) + 1) * self.kind.itemsize).tolist()
            if len(cuts) != len(part):
                alone += part
                continue
            data = numbers.tobytes()
            known.update((u, data[a:b]) for u, a, b in zip(part, [0, *cuts], cuts))
        known.update(zip(alone, map(self._bytes, self.encode_all(alone))))
        return [known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in cut]

    def _cuttable(self, text: bytes) -> bool:
        if any(o in text for o in self.odd):
            return False
        return text.isascii() or unicodedata.is_normalized("NFC", text.decode())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, given in UTF-8, as little-endian numbers, with the end id."""
        if self.units > _CACHE or len(self.pieces) > _CACHE:
            self._forget()
        cuttable = [self._cuttable(t) for t in texts]
        text = b" " + b"".join([t + b" " + self.STOP + b" " for t, c in zip(texts, cuttable) if c]).translate(self.LOWER)
        data = np.frombuffer(text + bytes(16), np.uint8)
        edges = np.diff(self.SPACE[data[: len(text)]].view(np.int8))
        starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
        sizes = ends - starts
        short = sizes <= 16
        at, size = starts[short], sizes[short]
        words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
        low = words[at] & self.HEADS[np.minimum(size, 8)]
        high = words[at + 8] & self.HEADS[np.maximum(size - 8, 0)]
        numbers = np.empty(len(starts), np.int64)
        found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, first, again = np.unique(low[new] * np.uint64(0x9E3779B97F4A7C15) + high[new], return_index=True, return_inverse=True)
            one = new[first]
            fits = (low[new] == low[one][again]) & (high[new] == high[one][again])
            units = [text[a : a + n].decode() for a, n in zip(at[one].tolist(), size[one].tolist())]
            placed = self._add(self._coded(units))
            self._place(low[one], high[one], placed)
            found[new[fits]] = placed[again[fits]]
            for k in new[~fits].tolist():  # two new units of one hash
                if (now := int(self._find(low[k : k + 1], high[k : k + 1])[0])) < 0:
                    added = self._add(self._coded([text[at[k] : at[k] + size[k]].decode()]))
                    self._place(low[k : k + 1], high[k : k + 1], added)
                    now = int(added[0])
                found[k] = now
        numbers[short] = found
        wide = np.flatnonzero(~short)
        if len(wide):
            units = [text[a:b] for a, b in zip(starts[wide].tolist(), ends[wide].tolist())]
            fresh = [u for u in dict.fromkeys(units) if u not in self.long]
            if fresh:
                self.long.update(zip(fresh, self._add(self._coded([u.decode() for u in fresh])).tolist()))
            numbers[wide] = [self.long[u] for u in units]
        counts = self.counts[numbers]
        upto = np.cumsum(counts)
        ids = self.flat[np.repeat(self.firsts[numbers] - upto + counts, counts) + np.arange(upto[-1] if len(upto) else 0)]
        stops = (upto[numbers == 0] * self.kind.itemsize).tolist()
        coded = memoryview(ids.tobytes())
        cut = iter([bytes(coded[a:b]) for a, b in zip([0, *stops], stops)])
        whole = iter(self.encode_all([t.decode() for t, c in zip(texts, cuttable) if not c]))
        return [next(cut) if c else self._bytes([*next(whole), END]) for c in cuttable]


_loaded: dict[str, PieceTokenizer] = {}


def tokenizer_at(path: str) -> PieceTokenizer:
    """The tokenizer of a file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]


class Grammar:
    """A sequence of ids as symbols: ids below ``base`` stand for themselves, ``base + i`` for the two symbols of rule ``i``.

    ``lengths`` are the rules' expansion lengths. With the running lengths of the symbols they tell which symbols a range of the
    sequence needs, so any range is decoded without the rest.
    """

    def __init__(self, base: int, rules: np.ndarray, symbols: np.ndarray, lengths: np.ndarray | None = None) -> None:
        self.base, self.rules, self.symbols = base, rules, symbols
        self.lengths = self._lengths() if lengths is None else lengths
        self.ends = np.cumsum(self._of(symbols))

    def _lengths(self) -> np.ndarray:
        """Sides of a rule are ids or earlier rules, so a few passes settle all."""
        lengths = np.ones(len(self.rules), np.int64)
        inner, at = self.rules >= self.base, np.where(self.rules >= self.base, self.rules - self.base, 0)
        while len(lengths):
            now = np.where(inner, lengths[at], 1).sum(axis=1)
            if (now == lengths).all():
                break
            lengths = now
        return lengths

    def _of(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.rules):
            return np.ones(len(symbols), np.int64)
        inner = symbols >= self.base
        return np.where(inner, self.lengths[np.where(inner, symbols - self.base, 0)], 1)

    @staticmethod
    def of(ids: np.ndarray, base: int, least: int = LEAST, gain: int = GAIN) -> Grammar:
        """Replace frequent pairs by new symbols, round by round, until none is left or a round shortens by less than 1 / ``gain``.

        A round counts the pairs and takes, of any places that overlap, that of the more frequent pair (of a run of one pair
        every second place). Pairs left with fewer than ``least`` places wait for a later round. Pairs are counted in hash
        buckets, which orders them; what is replaced is counted exactly.
        """
        seq, rules, size = ids.astype(np.uint32), [], base
        one = np.zeros(_BUCKETS, np.uint64)
        while len(seq) > 1:
            bucket = ((seq[:-1] * np.uint32(0x9E3779B1) ^ seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(12)).astype(np.int64)
            counts = np.minimum(np.bincount(bucket, minlength=_BUCKETS), 2047).astype(np.int32)
            rank = np.where(counts >= least, counts << 20 | np.arange(_BUCKETS, dtype=np.int32), -1)[bucket]
            after, before = np.append(rank[1:], -1), np.insert(rank[:-1], 0, -1)
            best = (rank >= 0) & (rank >= after) & (rank >= before)
            twice = np.flatnonzero(best & ((rank == after) | (rank == before)))
            if len(twice):  # runs of one bucket: whole ones only, every second place
                opens = np.insert((np.diff(twice) > 1) | (rank[twice[1:]] != rank[twice[:-1]]), 0, True)
                starts = np.flatnonzero(opens)
                run = np.cumsum(opens) - 1
                first, last = twice[starts], twice[np.append(starts[1:], len(twice)) - 1]
                whole = (before[first] < rank[first]) & (after[last] < rank[last])
                best[twice] = whole[run] & ((twice - first[run]) % 2 == 0)
            places = np.flatnonzero(best)
            keys, of = seq[places].astype(np.uint64) << np.uint64(32) | seq[places + 1], bucket[places]
            one[of] = keys  # one pair of each bucket; others of it wait for the next round
            own = one[of] == keys
            places, of = places[own], of[own]
            enough = np.bincount(of, minlength=_BUCKETS) >= least
            own = enough[of]
            places, of = places[own], of[own]
            if not len(places):
                break
            pairs, number = one[enough], np.cumsum(enough) - 1 + size
            rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64))
            seq[places] = number[of]
            stays = np.ones(len(seq), bool)
            stays[places + 1] = False
            seq, size = seq[stays], size + len(pairs)
            if len(places) * gain < len(stays):
                break
        return Grammar(base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), seq.astype(np.int64))

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def decode(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: symbols outside are never expanded, those inside level by level to their places."""
        out = np.zeros(stop - start, np.int64)
        if stop <= start:
            return out
        first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left")
        symbols = self.symbols[first : last + 1]
        at = self.ends[first : last + 1] - self._of(symbols) - start
        while len(symbols):
            inner = symbols >= self.base
            out[at[~inner]] = symbols[~inner]
            rules = self.rules[symbols[inner] - self.base]
            middle = at[inner] + self._of(rules[:, 0])
            symbols, at = rules.T.ravel(), np.concatenate([at[inner], middle])
            inside = (at < stop - start) & (at + self._of(symbols) > 0)
            symbols, at = symbols[inside], at[inside]
        return out


def packed(numbers: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of all numbers, then a bitmap for each higher bit."""
    high = [np.packbits((numbers >> k & 1).astype(np.uint8)).tobytes() for k in range(16, bits)]
    return b"".join([(numbers & 0xFFFF).astype("<u2").tobytes(), *high])


def packed_size(count: int, bits: int) -> int:
    return 2 * count + (count + 7) // 8 * max(0, bits - 16)


def unpacked(data: memoryview, count: int, bits: int) -> np.ndarray:
    out = np.frombuffer(data, "<u2", count).astype(np.int64)
    row = (count + 7) // 8
    for k in range(16, bits):
        plane = np.frombuffer(data, np.uint8, row, 2 * count + (k - 16) * row)
        out |= np.unpackbits(plane, count=count).astype(np.int64) << k
    return out


def to_bytes(doc_ids: list[int | None], counts: list[int], grammar: Grammar) -> bytes:
    """A shard: a header, then doc_ids and whether they are there, ids of each, rules, their lengths, symbols; and a CRC32 of all."""
    bits = (grammar.base + len(grammar.rules)).bit_length()
    body = b"".join(
        [
            _HEAD.pack(_MAGIC, len(doc_ids), len(grammar), grammar.base, len(grammar.rules), len(grammar.symbols), bits),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.array(counts, "<u4").tobytes(),
            packed(grammar.rules.ravel(), bits),
            grammar.lengths.astype("<u4").tobytes(),
            packed(grammar.symbols, bits),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A file's documents: ``doc_ids``, the running number of ids ``ends``, and ``ids(start, stop)`` of any range."""

    def __init__(self, data: bytes) -> None:
        if len(data) < _HEAD.size + 4 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("the file is cut off or damaged")
        magic, docs, ids, base, rules, symbols, bits = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a file of compressed ids")
        view, at = memoryview(data), _HEAD.size

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return view[at - size : at]

        numbers, there = np.frombuffer(take(8 * docs), "<i8"), np.frombuffer(take(docs), np.uint8)
        self.doc_ids = [n if t else None for n, t in zip(numbers.tolist(), there.tolist())]
        self.ends = np.cumsum(np.frombuffer(take(4 * docs), "<u4"), dtype=np.int64)
        sides = unpacked(take(packed_size(2 * rules, bits)), 2 * rules, bits).reshape(-1, 2)
        lengths = np.frombuffer(take(4 * rules), "<u4").astype(np.int64)
        self.grammar = Grammar(base, sides, unpacked(take(packed_size(symbols, bits)), symbols, bits), lengths)
        if len(self.grammar) != ids or (self.ends[-1] if docs else 0) != ids:
            raise ValueError("lengths do not fit")

    def ids(self, start: int, stop: int) -> np.ndarray:
        return self.grammar.decode(start, stop)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, tie, ids)``: the ids of whole texts with the end id, and their CRC32, which orders documents of one doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_at(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) < _BYTES):
                    size += len(texts[stop])
                    stop += 1
                ids = own.encode(texts[at:stop])
                ties = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                doc_ids = batch.column("doc_id").slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([doc_ids, ties, pa.array(ids, pa.binary())], ["doc_id", "tie", "ids"])
                at = stop

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, tie long, ids binary")


def write_ids(
    docs: DataFrame,
    folder: str,
    path: str = public_tokenizers.path("word_bpe_49k.json"),
    shard_ids: int = SHARD_IDS,
    least: int = LEAST,
) -> DataFrame:
    """Write the ids of all documents below ``folder`` and return ``(file, documents, ids, symbols, rules, offset)``, stored.

    Documents ascend by doc_id (NULL first, equal ones by the CRC32 of their ids) over all files in the order of names; ``offset`` is
    the number of ids in earlier files. A file is closed at ``shard_ids`` ids, so a reader can hold one; a longer document has
    one of its own. NULL texts are documents of the end id only; repeated rows are written each; an empty table writes none.

    Rows are sorted over all partitions, so a task that runs again writes the same bytes to the same names; a file gets its
    name when it is complete. ``folder`` must be a place that all executors reach. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    made(spark, folder)
    scratch = new_folder(spark, "ids")
    rows = stored(token_ids(docs, path), "ids", folder=scratch)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, own = TaskContext.get(), tokenizer_at(path)
        done, doc_ids, held, size = [], [], [], 0

        def close() -> None:
            grammar = Grammar.of(np.frombuffer(b"".join(held), own.kind), own.size, least)
            name = f"part-{task.partitionId():06d}-{len(done):06d}.ids"
            hidden = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(hidden) as out:
                out.write(to_bytes(doc_ids, [len(x) // own.kind.itemsize for x in held], grammar))
            store.move(hidden, f"{root}/{name}")
            sums = {"documents": len(held), "ids": len(grammar), "symbols": len(grammar.symbols), "rules": len(grammar.rules)}
            done.append({"file": name, **sums})

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                data = ids.as_py()
                if held and size + len(data) // own.kind.itemsize > shard_ids:
                    close()
                    doc_ids, held, size = [], [], 0
                doc_ids.append(doc_id)
                held.append(data)
                size += len(data) // own.kind.itemsize
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    written = stored(rows.select("doc_id", "ids").mapInArrow(write, _WRITTEN), "ids-written")
    removed(spark, scratch)
    part = F.substring("file", 1, 11)
    parts = written.groupBy(part.alias("part")).agg(F.sum("ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    rows = written.withColumn("part", part).join(parts, "part")
    offset = F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return stored(rows.select(*written.columns, offset.alias("offset")), "ids-files")


def read_ids(listed: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` and, if asked, ``ids`` (little-endian unsigned 32-bit numbers) of each document.

    ``listed`` is what write_ids returned; ``start`` counts the ids of all documents before. A file that is cut off or damaged
    is an error. A task expands some documents of a file at a time.
    """
    found = listed.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                shard = Shard(content.as_py())
                ends, first = shard.ends, 0
                while first < len(ends):
                    start = int(ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, start + READ_IDS, "right")))
                    data = memoryview(shard.ids(start, int(ends[last - 1])).astype("<u4").tobytes())
                    stops = (ends[first:last] - start).tolist()
                    starts = [0, *stops[:-1]]
                    texts = [data[4 * a : 4 * b] for a, b in zip(starts, stops)]
                    columns = [
                        pa.array([name] * len(stops)), pa.array(shard.doc_ids[first:last], pa.int64()),
                        pa.array([start + a for a in starts], pa.int64()), pa.array([b - a for a, b in zip(starts, stops)], pa.int64()),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([bytes(t) for t in texts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    first = last

    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(read, schema)
    rows = rows.join(listed.select("file", "offset"), "file").withColumn("start", F.col("offset") + F.col("at"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


@query("op12_repair_ids")
def op12_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "repair")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder), folder, with_ids=False)
