"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standout.llm.catalog import query
from standout.llm.common import partitions, remainder, stored, table

#: Bytes before the predicted one that a predictor's context holds; it reaches back to the last byte of the word before. The
#: last predictor's context is all of the word so far.
ORDERS = (1, 2, 3, 5)
PREDICTORS = len(ORDERS) + 1
#: Each predictor counts in a table of 2 ** bits slots, whatever the size of the corpus; longer contexts have larger ones.
SLOT_BITS = (16, 17, 18, 19, 20)
SLOTS = sum(1 << b for b in SLOT_BITS)
#: Tables of different tasks are added in blocks of this many slots.
BLOCK = 1 << 14
#: Added to both counts of a slot.
PRIOR = 0.1
#: Buckets of the adaptive map, over scores from -REACH to REACH, and the weight of its start.
BUCKETS, REACH, MAP_PRIOR = 33, 8.0, 30.0
#: Words whose counts every task holds, the most frequent ones; the counts of all others are joined.
HEAD_WORDS = 100_000
#: Smoothing of the base score.
BASE_PRIOR = 0.1
RATE, SLOW, START_WEIGHT = 1.0, 100.0, 0.7
#: Counts from which a context is trusted anew.
_LEVELS = (1, 2, 4, 16, 64, 1024)
_DEPTHS = 8
_GATES = _DEPTHS * (1 + PREDICTORS * len(_LEVELS))
_AT_ONCE = 1 << 14
#: An odd multiplier and its inverse modulo 2 ** 64, for hashes of prefixes from running sums.
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_KEYS = 300_000
_LEAST = 1e-6
_PAD = max(ORDERS)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z folded, and the end as an empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def keys_of(words: list[bytes]) -> list[bytes]:
    """What the model sees of each word: the last byte of the word before, a blank, and the word."""
    before = [b"", *(w[-1:] for w in words[:-1])]
    return [a + b" " + w for a, w in zip(before, words)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Code:
    """A Huffman code of the bytes, so that frequent bytes take few decisions; every byte has one."""

    def __init__(self, counts: np.ndarray) -> None:
        heap = [(float(n) + 1.0, byte, byte) for byte, n in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for made in range(256, 511):
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], parent[right] = (made, 0), (made, 1)
            heapq.heappush(heap, (a + b, made, made))
        paths = []
        for byte in range(256):
            path, at = [], byte
            while at in parent:
                at, bit = parent[at]
                path.append((at - 256, bit))
            paths.append(path[::-1])
        self.sizes = np.array([len(p) for p in paths])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.nodes = np.array([node for p in paths for node, _ in p])
        self.bits = np.array([bit for p in paths for _, bit in p])


@dataclass
class Bits:
    """Binary decisions of some keys: for each byte from the word's first to its terminator the way through the code's tree."""

    owner: np.ndarray
    bit: np.ndarray
    node: np.ndarray
    depth: np.ndarray
    slots: list[np.ndarray]


def decisions(keys: list[bytes], code: Code) -> Iterator[Bits]:
    """The decisions in pieces; words end with a blank, the end itself is a line feed."""
    buffer = np.frombuffer(b"".join([b"\0" * _PAD + k + (b"\n" if k[-1:] == b" " else b" ") for k in keys]), np.uint8)
    sizes = np.array([len(k) for k in keys], np.int64)
    skip = np.array([k.index(b" ") + 1 for k in keys], np.int64)
    starts = np.cumsum(sizes + _PAD + 1) - (sizes + 1)
    counts = sizes - skip + 1
    owner = np.repeat(np.arange(len(keys)), counts)
    begins = np.repeat(starts + skip, counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins
    power = np.full(len(buffer) + 1, _INVERSE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    grown = np.full(len(buffer) + 1, _MULTIPLIER, np.uint64)
    grown[0] = 1
    grown = np.multiply.accumulate(grown)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    for at in range(0, len(place), _AT_ONCE):
        here, own, begin = (x[at : at + _AT_ONCE] for x in (place, owner, begins))
        byte = buffer[here]
        steps = code.sizes[byte]
        whose = np.repeat(np.arange(len(here)), steps)
        depth = np.arange(len(whose)) - np.repeat(np.cumsum(steps) - steps, steps)
        way = code.starts[byte][whose] + depth
        node = code.nodes[way]
        mark = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        context, bases = np.zeros(len(here), np.uint64), []
        for back in range(1, _PAD + 1):
            context |= buffer[here - back].astype(np.uint64) << np.uint64(8 * back - 8)
            if back in ORDERS:
                bases.append(_mixed(context + np.uint64(0xA0761D6478BD642F >> back)))
        # bytes from the word's start, the i-th one times the inverse of the multiplier to the power of i
        prefix = (sums[here] - sums[begin]) * grown[begin]
        bases.append(_mixed(_mixed(prefix) + (here - begin).astype(np.uint64)))
        first, slots = 0, []
        for base, bits in zip(bases, SLOT_BITS):
            hashed = ((base[whose] + mark) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(64 - bits)
            slots.append(hashed.view(np.int64) + first)
            first += 1 << bits
        yield Bits(own[whose], code.bits[way], node, np.minimum(depth, _DEPTHS - 1), slots)


def count_bits(code: Code, batches: Iterator[tuple[list[bytes], np.ndarray]]) -> np.ndarray:
    """Zeros and ones of every slot of every predictor, weighted by the number of each key."""
    tables = np.zeros((2, SLOTS), np.float32)
    flat = tables.reshape(-1)
    for keys, weights in batches:
        for part in decisions(keys, code):
            weight, side = weights[part.owner], SLOTS * part.bit
            for slots in part.slots:
                np.add.at(flat, slots + side, weight)
    return tables


def level(total: np.ndarray) -> np.ndarray:
    """Number of the levels that a count reaches."""
    out = (total >= _LEVELS[0]).astype(np.int8)
    for least in _LEVELS[1:]:
        out += total >= least
    return out


class Mixer:
    """Weights for each gate, and the adaptive map that refines what they give.

    Inputs are the stretched prediction of the shortest context, and what each longer one with counts adds to the one before.
    The gate is the decision's depth in the code with the longest context that has counts and how many. Weights move by the error
    of each batch of decisions in turn, scaled by the curvature so far; the map keeps how often a one came for each node of the
    byte and bucket of the score.
    """

    def __init__(self) -> None:
        self.weights = np.full((_GATES, PREDICTORS), START_WEIGHT)
        self.weights[:, 0] = 1
        self.bends = np.zeros_like(self.weights)
        middle = np.linspace(-REACH, REACH, BUCKETS)
        self.ones = np.repeat((MAP_PRIOR / (1 + np.exp(-middle)))[None], 256, 0)
        self.seen = np.full((256, BUCKETS), MAP_PRIOR)

    @staticmethod
    def gated(
        stretched: list[np.ndarray], levels: list[np.ndarray], depth: np.ndarray
    ) -> tuple[list[np.ndarray], np.ndarray]:
        """Inputs and gate from the stretched predictions and the levels of their counts, 0 for none."""
        inputs, gate, before = [], levels[0].astype(np.int64), stretched[0]
        inputs.append(before)
        for k in range(1, len(stretched)):
            counted = levels[k] > 0
            inputs.append(np.where(counted, stretched[k] - before, np.float32(0)))
            before = np.where(counted, stretched[k], before)
            gate = np.where(counted, k * len(_LEVELS) + levels[k], gate)
        return inputs, gate * _DEPTHS + depth

    def mix(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        score = weights[:, 0][gate] * inputs[0]
        for k in range(1, len(inputs)):
            score += weights[:, k][gate] * inputs[k]
        return score

    def refined(self, score: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mixed one and the map's, between the two buckets next to it."""
        place = (np.clip(score, -REACH, REACH) + REACH) * ((BUCKETS - 1) / (2 * REACH))
        low = np.minimum(place.astype(np.int64), BUCKETS - 2)
        part = place - low
        map_ = self.ones / self.seen
        flat = node * BUCKETS + low
        other = map_.ravel()[flat] * (1 - part) + map_.ravel()[flat + 1] * part
        return np.clip(0.5 * (1 / (1 + np.exp(-score)) + other), _LEAST, 1 - _LEAST)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, node: np.ndarray, weight: np.ndarray) -> None:
        score = self.mix(inputs, gate)
        p = 1 / (1 + np.exp(-score))
        error, curve = (bit - p) * weight, p * (1 - p) * weight
        for k, x in enumerate(inputs):
            pull = np.bincount(gate, error * x, _GATES)
            bend = np.bincount(gate, curve * x * x, _GATES)
            self.bends[:, k] += bend
            self.weights[:, k] += RATE * pull / (self.bends[:, k] + SLOW)
        np.clip(self.weights, -2, 4, out=self.weights)
        place = np.rint((np.clip(score, -REACH, REACH) + REACH) * ((BUCKETS - 1) / (2 * REACH))).astype(np.int64)
        flat = node * BUCKETS + place
        self.ones += np.bincount(flat, bit * weight, 256 * BUCKETS).reshape(256, BUCKETS)
        self.seen += np.bincount(flat, weight, 256 * BUCKETS).reshape(256, BUCKETS)


def learn_weights(
    tables: np.ndarray, code: Code, batches: Iterator[tuple[list[bytes], np.ndarray]]
) -> tuple[Mixer, float]:
    """Train a mixer on one stream of keys. Each decision is predicted from the counts without one occurrence of its own."""
    mixer, used = Mixer(), 0.0
    for keys, weights in batches:
        for part in decisions(keys, code):
            one = part.bit.astype(np.float32)
            stretched, levels = [], []
            for slots in part.slots:
                zeros = np.maximum(tables[0][slots] - (1 - one), 0)
                ones = np.maximum(tables[1][slots] - one, 0)
                stretched.append(np.log((ones + PRIOR) / (zeros + PRIOR)))
                levels.append(level(zeros + ones))
            weight = weights[part.owner].astype(np.float64)
            mixer.learn(*mixer.gated(stretched, levels, part.depth), part.bit, part.node, weight)
            used += float(weight.sum())
    return mixer, used


class Model:
    """The trained model: stretched predictions and counts of all slots, and one mixer. It is not changed by scoring, so a
    text's score does not depend on what was scored before it."""

    def __init__(self, tables: np.ndarray, code: Code, mixer: Mixer) -> None:
        self.inputs = np.log((tables[1] + PRIOR) / (tables[0] + PRIOR)).astype(np.float16)
        self.levels = level(tables[0] + tables[1])
        self.code, self.mixer = code, mixer
        self.known: dict[bytes, float] = {}

    def logs(self, keys: list[bytes]) -> np.ndarray:
        """log10 probability of each key's word after the byte before it."""
        out = np.zeros(len(keys))
        for part in decisions(keys, self.code):
            stretched = [self.inputs[slots].astype(np.float32) for slots in part.slots]
            inputs, gate = self.mixer.gated(stretched, [self.levels[slots] for slots in part.slots], part.depth)
            p = self.mixer.refined(self.mixer.mix(inputs, gate), part.node)
            out += np.bincount(part.owner, np.log10(np.where(part.bit == 1, p, 1 - p)), len(keys))
        return out

    def scores(self, texts: list[list[bytes]]) -> list[float]:
        """log10 probability of each text, given the keys of its words."""
        if len(self.known) > _KEYS:
            self.known = {}
        known = self.known
        missing = list({k: None for keys in texts for k in keys if k not in known})
        if missing:
            known.update(zip(missing, self.logs(missing).tolist()))
        return [math.fsum([known[k] for k in keys]) for keys in texts]


def _slices(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_keys(docs: DataFrame) -> DataFrame:
    """``(key, used, seen)``: how often each key stands in training documents and in all; combined in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, others = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for counts, share in ((learned, 1), (others, 0)):
                seen = np.fromiter(counts.values(), np.int64, len(counts))
                columns = [pa.array(list(counts), pa.binary()), pa.array(seen * share), pa.array(seen)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "used", "seen"])
                counts.clear()

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist()):
                (others if held else learned).update(keys_of(words_of(text.as_py())))
                if len(learned) + len(others) > 2 * _KEYS:
                    yield from flush()
        yield from flush()

    found = docs.mapInArrow(count, "key binary, used long, seen long")
    return stored(found.groupBy("key").agg(F.sum("used").alias("used"), F.sum("seen").alias("seen")), "keys")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("key").to_pylist(), batch.column("used").to_numpy().astype(np.float32)


def _packed(values: np.ndarray) -> bytes:
    """A table as its length, the places of what is not zero, and the values there."""
    places = np.nonzero(values)[0].astype(np.uint32)
    return np.array([len(values), len(places)], np.uint32).tobytes() + places.tobytes() + values[places].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    size, count = np.frombuffer(data, np.uint32, 2)
    values = np.zeros(size, np.float32)
    values[np.frombuffer(data, np.uint32, count, 8)] = np.frombuffer(data, np.float32, count, 8 + 4 * int(count))
    return values


def _added(parts: DataFrame, keys: list[str], spark: SparkSession) -> DataFrame:
    """Sums of the float tables ``(*keys, data)``, row after row, so that a task holds one table whatever their number."""
    names = [*keys, "data"]
    schema = ", ".join(f"{k} int" for k in keys) + ", data binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None

        def done() -> pa.RecordBatch:
            columns = [pa.array([x], pa.int32()) for x in own] + [pa.array([_packed(total)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in names)):
                *key, data = (x.as_py() for x in row)
                values = _unpacked(data)
                if key != own:
                    if own is not None:
                        yield done()
                    own, total = key, values
                else:
                    total += values
        if own is not None:
            yield done()

    return parts.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def train(keys: DataFrame) -> Model:
    """Spell the bytes by their frequency, count the decisions of all training keys, then learn the weights from all of them.

    Tables of the tasks are added block by block, first in groups of about the square root of their number; the driver gets the
    sums, whose size is fixed by SLOT_BITS. Weights are learned on each partition from the same start and averaged
    by the words seen; the counts of the adaptive maps are added.
    """
    spark = keys.sparkSession
    used = keys.where("used > 0").select("key", "used")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256)
        for keys, weights in _batches(batches):
            weights = np.repeat(weights, [len(k) for k in keys])
            counts += np.bincount(np.frombuffer(b"".join(keys), np.uint8), weights, 256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(counts)], ["byte", "n"])

    code = np.zeros(256)
    for r in used.mapInArrow(spell, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        code[r["byte"]] = r["n"]
    code = Code(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = count_bits(code, _batches(batches)).reshape(-1, BLOCK)
        for block in np.nonzero(tables.any(axis=1))[0].tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([_packed(tables[block])], pa.binary())], ["block", "data"]
            )

    tasks = max(1, min(partitions(spark), spark.sparkContext.defaultParallelism))
    parts = used.repartition(tasks).mapInArrow(count, "block int, data binary")
    groups = max(1, math.isqrt(tasks))
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(groups)))
    parts = _added(parts.select("block", "salt", "data"), ["block", "salt"], spark)
    rows = _added(parts.select("block", "data"), ["block"], spark).collect()
    tables = np.zeros((2 * SLOTS // BLOCK, BLOCK), np.float32)
    for r in rows:
        tables[r["block"]] = _unpacked(r["data"])
    tables = tables.reshape(2, SLOTS)
    shared = spark.sparkContext.broadcast(tables)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, words = learn_weights(shared.value, code, _batches(batches))
        if words:
            state = np.concatenate([[words], words * mixer.weights.ravel(), (mixer.ones - Mixer().ones).ravel(), (mixer.seen - MAP_PRIOR).ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([_packed(state.astype(np.float32))], pa.binary())], ["all", "data"]
            )

    states = used.repartition(tasks).mapInArrow(learn, "all int, data binary")
    states = states.withColumn("all", F.pmod(F.spark_partition_id(), F.lit(groups)))
    mixer, sums = Mixer(), None
    for r in _added(states, ["all"], spark).collect():
        state = _unpacked(r["data"]).astype(np.float64)
        sums = state if sums is None else sums + state
    if sums is not None:
        cut = 1 + mixer.weights.size
        mixer.weights = (sums[1:cut] / sums[0]).reshape(mixer.weights.shape)
        mixer.ones += sums[cut : cut + mixer.ones.size].reshape(mixer.ones.shape)
        mixer.seen += sums[cut + mixer.ones.size :].reshape(mixer.seen.shape)
    shared.unpersist()
    return Model(tables, code, mixer)


def score(docs: DataFrame, held_out_of: int = 10, head_words: int = HEAD_WORDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, a row for each document.

    Learned from all documents whose remainder by ``held_out_of`` is not 0; a NULL doc_id counts as empty text there. Texts
    are the sequences of their words with A-Z folded, and their end; NULL texts are empty. ``score`` is the log10 probability
    that the model gives to the bytes of the words, each with a blank after it, and of the end.

    Counts of the most frequent words are given to the tasks, which have a bounded number of them; all other words of a
    document are joined with the vocabulary. Without training documents every word is unknown. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    held = remainder("doc_id", held_out_of) == 0
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    keys = count_keys(rows.select("held_out", "text"))
    blank = F.expr("substring(key, 1, 1) = X'20'")
    word = F.when(blank, F.expr("substring(key, 2)")).otherwise(F.expr("substring(key, 3)"))
    words = keys.groupBy(word.alias("word")).agg(F.sum("used").alias("used"), F.sum("seen").alias("seen"))
    words = stored(words, "vocabulary")
    n, v = words.agg(F.coalesce(F.sum("used"), F.lit(0)), F.count(F.when(F.col("used") > 0, 1))).first()
    whole = math.log10(n + BASE_PRIOR * (v + 1))
    head = words.orderBy(F.desc("seen"), "word").limit(head_words).select("word", "used")
    head = {bytes(r["word"]): r["used"] for r in head.collect()}
    shared = spark.sparkContext.broadcast((head, train(keys)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, "
        "rest array<struct<word: binary, n: long>>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, model = shared.value
        logs = {w: math.log10(c + BASE_PRIOR) for w, c in common.items()}
        kinds = [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.int64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))]
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text").to_pylist()):
                split = [words_of(t) for t in texts]
                out = []
                for own, total in zip(split, model.scores([keys_of(w) for w in split])):
                    rest = [w for w in own if w not in logs]
                    known = sum(common[w] > 0 for w in own if w in common)
                    base = math.fsum([logs[w] for w in own if w in logs])
                    found = [{"word": w, "n": k} for w, k in Counter(rest).items()]
                    out.append((len(own), known, base, total, sum(map(len, own)) + len(own), found))
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns = [part.column("doc_id"), part.column("held_out")]
                columns += [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ", 7)])

    scored = stored(rows.mapInArrow(work, schema), "scored").withColumn("row", F.monotonically_increasing_id())
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    rest = rest.join(words.select("word", "used"), "word")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("used") > 0, F.col("n"))).alias("more"),
        F.sum(F.col("n") * F.log10(F.col("used") + F.lit(BASE_PRIOR))).alias("log"),
    )
    both = scored.drop("rest").join(rest, "row", "left")
    base = F.col("base") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


@query("op8_context_mixing")
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
