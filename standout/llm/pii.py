"""Personal data in text: fixed patterns, and a bidirectional character LSTM with CRF transitions that adds to them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standout.llm.catalog import query
from standout.llm.common import bounded_sample, table

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window; the next one starts half a window later.
WINDOW, STRIDE = 96, 48
#: Training uses at most this many documents that hold a digit or an at sign, and of each this many windows.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 600, 4
EMBEDDING, HIDDEN = 12, 16
STEPS, BATCH, RATE = 160, 48, 0.015
TAGS = 1 + 2 * len(KINDS)
_CHARACTERS = 131
_AT_ONCE = 256
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried once: a start inside it sees the same rest.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[int, int, str]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right. Each match holds an at sign, and the run before it is where the match starts."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the fixed patterns in the order of start and kind; matches that fail a check are gone."""
    if not _TRIGGER.search(text):
        return []
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if _octets(m.group().split("."))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def plausible(text: str, kind: str) -> bool:
    """What an added span must hold: an at sign with characters around it, or as many digits as its kind has."""
    if kind == "email":
        local, sign, domain = text.partition("@")
        return bool(local and domain) and "@" not in domain and not any(c.isspace() for c in text)
    digits = _digits(text)
    if kind == "ip":
        return _octets([p for p in re.split(r"[^0-9]+", text) if p])
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def characters(text: str) -> np.ndarray:
    """ASCII by itself, other letters and other characters by two shared numbers, 0 for padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = codes.astype(np.int64) + 1
    other = np.nonzero(codes >= 128)[0]
    if len(other):
        values, back = np.unique(codes[other], return_inverse=True)
        kinds = np.array([129 if chr(v).isalpha() else 130 for v in values])
        out[other] = kinds[back]
    return out


@dataclass
class Tagger:
    """Weights of the network; the first axis of the LSTM's is the direction."""

    embedding: np.ndarray
    inputs: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    steps: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.inputs, self.hidden, self.bias, self.out, self.out_bias, self.steps]

    def emissions(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Scores of the tags (windows, characters, tags); ``keep`` gathers what training needs."""
        n, length = windows.shape
        size = self.hidden.shape[1]
        forward = self.embedding[windows.T]
        both = np.stack([forward, forward[::-1]], axis=1)
        gates = both @ self.inputs + self.bias[:, None]
        h = np.zeros((2, n, size), np.float32)
        c = np.zeros_like(h)
        states = np.empty((length, 2, n, size), np.float32)
        for t in range(length):
            g = gates[t]
            g += h @ self.hidden
            g[..., : 3 * size] *= 0.5
            np.tanh(g, out=g)
            g[..., : 3 * size] *= 0.5
            g[..., : 3 * size] += 0.5
            before = c
            c = g[..., size : 2 * size] * c + g[..., :size] * g[..., 3 * size :]
            bent = np.tanh(c)
            h = g[..., 2 * size : 3 * size] * bent
            states[t] = h
            if keep is not None:
                keep.append((before, bent))
        joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        if keep is not None:
            keep.append((both, gates, states, joined))
        return (joined @ self.out + self.out_bias).transpose(1, 0, 2)

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """Best tag path of each window; inside tags follow only their own kind."""
        scores = self.emissions(windows)
        allowed = np.zeros((TAGS, TAGS), bool)
        for tag in range(TAGS):
            for following in range(TAGS):
                inside = following and following % 2 == 0
                allowed[tag, following] = not inside or tag in (following, following - 1)
        steps = np.where(allowed, self.steps, -1e4).astype(np.float32)
        best = scores[:, 0].copy()
        best[:, 2::2] = -1e4
        n, length, _ = scores.shape
        back = np.empty((length, n, TAGS), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + steps
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        path = np.empty((n, length), np.int8)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[t, rows, path[:, t]]
        return path


def _crf(scores: np.ndarray, steps: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by the emissions and the transitions."""
    n, length, size = scores.shape
    odds = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(steps)
    ahead, after = np.empty_like(odds), np.empty_like(odds)
    ahead[:, 0] = odds[:, 0] / odds[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        x = (ahead[:, t - 1] @ move) * odds[:, t]
        ahead[:, t] = x / x.sum(axis=1, keepdims=True)
    after[:, -1] = 1.0 / size
    for t in range(length - 1, 0, -1):
        x = (odds[:, t] * after[:, t]) @ move.T
        after[:, t - 1] = x / x.sum(axis=1, keepdims=True)
    shares = ahead * after
    shares /= shares.sum(axis=2, keepdims=True)
    left, right = ahead[:, :-1], odds[:, 1:] * after[:, 1:]
    norm = ((left @ move) * right).sum(axis=2, keepdims=True)
    of_steps = np.einsum("bti,btj->ij", left / norm, right) * move
    np.add.at(of_steps, (tags[:, :-1], tags[:, 1:]), -1.0)
    np.put_along_axis(shares, tags[:, :, None], np.take_along_axis(shares, tags[:, :, None], 2) - 1.0, 2)
    return shares, of_steps


def train(windows: np.ndarray, tags: np.ndarray, seed: int = 11, steps: int = STEPS) -> Tagger:
    """Fit the network by Adam on the likelihood of labelled windows, half of every batch with spans if there are any."""
    rng = np.random.default_rng(seed)

    def weight(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)

    bias = np.zeros((2, 4 * HIDDEN), np.float32)
    bias[:, HIDDEN : 2 * HIDDEN] = 1
    net = Tagger(
        rng.normal(0, 0.5, (_CHARACTERS, EMBEDDING)).astype(np.float32),
        weight(2, EMBEDDING, 4 * HIDDEN), weight(2, HIDDEN, 4 * HIDDEN), bias,
        weight(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32),
    )
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    marked, plain = np.nonzero(tags.any(axis=1))[0], np.arange(len(tags))
    size = HIDDEN
    for step in range(1, steps + 1):
        half = rng.choice(marked, BATCH // 2) if len(marked) else np.empty(0, np.int64)
        pick = np.concatenate([half, rng.choice(plain, BATCH - len(half))])
        x, y = windows[pick], tags[pick].astype(np.int64)
        keep: list = []
        scores = net.emissions(x, keep)
        both, gates, states, joined = keep.pop()
        of_scores, of_steps = _crf(scores, net.steps, y)
        of_scores = (of_scores / (BATCH * WINDOW)).astype(np.float32).transpose(1, 0, 2)
        of_steps = (of_steps / (BATCH * WINDOW)).astype(np.float32)
        of_out = np.tensordot(joined, of_scores, ((0, 1), (0, 1)))
        of_joined = of_scores @ net.out.T
        of_states = np.stack([of_joined[..., :size], of_joined[::-1, :, size:]], axis=1)
        of_gates = np.empty_like(gates)
        of_h = np.zeros((2, BATCH, size), np.float32)
        of_c = np.zeros_like(of_h)
        for t in range(WINDOW - 1, -1, -1):
            before, bent = keep[t]
            i, f, o, z = (gates[t][..., k * size : (k + 1) * size] for k in range(4))
            of_h = of_h + of_states[t]
            of_c = of_c + of_h * o * (1 - bent * bent)
            g = of_gates[t]
            g[..., :size] = of_c * z * i * (1 - i)
            g[..., size : 2 * size] = of_c * before * f * (1 - f)
            g[..., 2 * size : 3 * size] = of_h * bent * o * (1 - o)
            g[..., 3 * size :] = of_c * i * (1 - z * z)
            of_h = g @ net.hidden.transpose(0, 2, 1)
            of_c = of_c * f
        earlier = np.concatenate([np.zeros_like(states[:1]), states[:-1]])
        of_both = of_gates @ net.inputs.transpose(0, 2, 1)
        of_embedding = np.zeros_like(net.embedding)
        np.add.at(of_embedding, x.T, of_both[:, 0] + of_both[::-1, 1])
        gradients = [
            of_embedding, np.einsum("tdbi,tdbj->dij", both, of_gates), np.einsum("tdbi,tdbj->dij", earlier, of_gates),
            of_gates.sum(axis=(0, 2)), of_out, of_scores.sum(axis=(0, 1)), of_steps,
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        for w, g, m, v in zip(weights, gradients, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _near(text: str) -> list[int]:
    """Numbers of the windows within a stride of a digit or an at sign; a plausible span lies in no other."""
    last = max(0, -(-(len(text) - STRIDE) // STRIDE) - 1)
    wanted, done = [], -1
    for m in _TRIGGER.finditer(text):
        place = m.start() // STRIDE
        for k in range(max(done + 1, place - 2), min(last, place + 1) + 1):
            wanted.append(k)
            done = k
    return wanted


def _window(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    piece = codes[k * STRIDE : k * STRIDE + WINDOW]
    out[: len(piece)] = piece
    return out


def tagged(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, kind) of a tag sequence: a begin tag, or an inside tag after another kind, and what follows inside."""
    places = np.nonzero(tags)[0]
    start = kind = None
    end = -1
    for p in places:
        own = (int(tags[p]) - 1) // 2
        if start is not None and p == end and own == kind and tags[p] % 2 == 0:
            end = p + 1
            continue
        if start is not None:
            yield start, end, kind
        start, end, kind = int(p), int(p) + 1, own
    if start is not None:
        yield start, end, kind


def find(texts: Iterable[str | None], net: Tagger | None) -> Iterator[list[tuple[Span, bool]]]:
    """For each text its spans in order, each with whether the fixed patterns found it.

    Windows near a digit or an at sign are decoded; each character takes its tag from the window whose middle is nearest,
    so a span that crosses windows is put together over the whole text. A found span is added if it touches no span of the
    patterns, after blanks and marks at its ends are taken off, and is plausible for its kind.
    """
    for group in _groups(texts):
        bases = [base_spans(t) for t in group]
        wanted, codes = [], {}
        if net is not None:
            for i, text in enumerate(group):
                near = _near(text)
                if near:
                    codes[i] = characters(text)
                    wanted += [(i, k) for k in near]
        merged: dict[int, np.ndarray] = {}
        for at in range(0, len(wanted), _AT_ONCE):
            part = wanted[at : at + _AT_ONCE]
            paths = net.decode(np.stack([_window(codes[i], k) for i, k in part]))
            for (i, k), path in zip(part, paths):
                tags = merged.setdefault(i, np.zeros(len(codes[i]), np.int8))
                low = k * STRIDE + (STRIDE // 2 if k else 0)
                high = min(len(tags), k * STRIDE + WINDOW - STRIDE // 2)
                if high + STRIDE // 2 >= len(tags):
                    high = min(len(tags), k * STRIDE + WINDOW)
                tags[low:high] = path[low - k * STRIDE : high - k * STRIDE]
        for i, (text, base) in enumerate(zip(group, bases)):
            spans = [(s, True) for s in base]
            if i in merged:
                for start, end, kind in tagged(merged[i]):
                    while start < end and not (text[start].isalnum() or text[start] in "+("):
                        start += 1
                    while start < end and not text[end - 1].isalnum():
                        end -= 1
                    apart = all(end <= a or b <= start for a, b, _ in base)
                    if start < end and apart and plausible(text[start:end], KINDS[kind]):
                        spans.append(((start, end, KINDS[kind]), False))
                spans.sort(key=lambda s: _order(s[0]))
            yield spans


def _groups(texts: Iterable[str | None], chars: int = 1 << 21) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _labelled(text: str, draw: np.random.Generator) -> Iterator[tuple[list[int], list[int]]]:
    """Windows at random places around the triggers of a text, with the tags of the fixed patterns."""
    places = [m.start() for m in _TRIGGER.finditer(text)]
    if not places:
        return
    codes, tags = characters(text), np.zeros(len(text), np.int64)
    spans = base_spans(text)
    for start, end, kind in spans:
        if not tags[start:end].any():
            tags[start] = 1 + 2 * KINDS.index(kind)
            tags[start + 1 : end] = 2 + 2 * KINDS.index(kind)
    for k in range(SAMPLE_WINDOWS):
        middle = spans[int(draw.integers(len(spans)))][0] if spans and k % 2 == 0 else places[int(draw.integers(len(places)))]
        at = max(0, middle - int(draw.integers(WINDOW - 8)))
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        x[: len(codes[at : at + WINDOW])] = codes[at : at + WINDOW]
        y[: len(tags[at : at + WINDOW])] = tags[at : at + WINDOW]
        yield x.tolist(), y.tolist()


def fit(docs: DataFrame) -> Tagger | None:
    """Train on a bounded sample of labelled windows; None where no text holds a digit or an at sign.

    At most 600 documents with such a character, those with the smallest hash of doc_id and text, give 4 windows each, labelled by
    the fixed patterns.
    """
    some = docs.where("text RLIKE '[0-9@]'").select("doc_id", "text")
    sample = bounded_sample(some, ["doc_id", "text"], SAMPLE_DOCUMENTS)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                draw = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little"))
                rows += [{"x": x, "y": y} for x, y in _labelled(text, draw)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    rows = sample.select("text").mapInArrow(label, "x array<long>, y array<long>").collect()
    rows = sorted((r["x"], r["y"]) for r in rows)
    if not rows:
        return None
    return train(np.array([x for x, _ in rows]), np.array([y for _, y in rows]))


_SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("base", T.BooleanType()),
    ]
)


def personal_data(net: Tagger | None, text: Column) -> Column:
    """Array of ``(start, end, kind, base)`` in code points, in the order of start and kind; none for NULL."""

    @F.pandas_udf(T.ArrayType(_SPAN))
    def spans(texts: pd.Series) -> pd.Series:
        found = find(texts, net)
        return pd.Series([[{"start": a, "end": b, "kind": k, "base": own} for (a, b, k), own in row] for row in found])

    return spans(text)


def redacted(net: Tagger | None, text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap, by the kind of the first."""

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, find(texts, net)):
            if not spans:
                out.append(text)
                continue
            parts, at, open_end = [], 0, -1
            for (start, end, kind), _ in spans:
                if start < open_end:
                    open_end = max(open_end, end)
                    at = open_end
                    continue
                parts += [text[at:start], f"[{kind.upper()}]"]
                at = open_end = end
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return redact(text)


def detect(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``, a row for each document, repeated rows too; only doc_id and text are read.

    NULL and empty texts have no spans. Without labelled text to learn from only the fixed patterns are used.
    """
    return docs.select("doc_id", personal_data(fit(docs), F.col("text")).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op9_char_tagger")
def op9_char_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the fixed patterns, as is the digest; ``n_added`` counts what the network adds."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return detect(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
