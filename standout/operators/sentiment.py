"""Term frequency and sentiment.

Texts are ``text_id`` (one or more key columns) and ``text``; a lexicon is ``term, score``. Tokens of
three characters or more count. Windows are cut from the text of the mention's own row, so the text
is shuffled once; a small lexicon is broadcast by the optimizer, a large one joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standout.functions import porter
from standout.functions.text import normalise_text, rank_in, running_sums
from standout.session import stored

MIN_LETTERS = 3
NEUTRAL = 0.5


def tf_features(mentions: DataFrame) -> DataFrame:
    """Share of an entity's mentions among all of the document, its title and its body."""
    counts = mentions.groupBy("doc_id", "entity_id").agg(
        F.count_if(F.col("field") == "title").alias("t"), F.count_if(F.col("field") == "body").alias("b")
    )
    totals = counts.groupBy("doc_id").agg(F.sum("t").alias("tt"), F.sum("b").alias("bb"))
    rows = counts.join(totals, "doc_id")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    t, b, tt, bb = (F.col(c) for c in ("t", "b", "tt", "bb"))
    return rows.select(
        "doc_id", "entity_id",
        share(t + b, tt + bb).alias("doc_freq"), share(t, tt).alias("title_freq"), share(b, bb).alias("body_freq"),
    )


def stem_words(words: DataFrame, column: str = "token") -> DataFrame:
    """``column, stem`` for distinct words."""
    return words.where(F.length(column) > 0).withColumn("stem", porter.stem(F.col(column)))


def with_stems(rows: DataFrame, column: str = "token", stem: bool = True) -> DataFrame:
    """Add the stem of each token: the distinct vocabulary is stemmed once, stored, so that its size is known, and joined back."""
    if not stem:
        return rows.withColumn("stem", F.col(column))
    vocabulary = stored(stem_words(rows.select(column).distinct(), column), "stems")
    return rows.join(vocabulary, column, "left")


def stem_tokens(texts: DataFrame, keys: Sequence[str], stem: bool = True, unique: bool = True) -> DataFrame:
    """Stems of each text; ``unique`` gives the sorted distinct ones, else one row per token."""
    plain = texts.withColumn("text", normalise_text("text"))
    tokens = plain.select(*keys, F.explode(F.split("text", " ")).alias("token"))
    rows = with_stems(tokens, "token", stem).where(F.length("stem") >= MIN_LETTERS)
    if not unique:
        return rows.select(*keys, "token", "stem")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("stem")).alias("stems"))


def prepare_lexicon(lexicon: DataFrame, stem: bool = True) -> DataFrame:
    """Normalised terms with their score; the last line of equal terms wins.

    Terms of several words keep their blanks, so they never match a token.
    """
    words = lexicon.select(
        "line_no", "score", F.posexplode(F.split(normalise_text("term"), " ")).alias("pos", "token")
    )
    words = with_stems(words, "token", stem).where(F.length("stem") >= MIN_LETTERS)
    item = F.struct("pos", "stem")
    terms = words.groupBy("line_no", "score").agg(F.array_sort(F.collect_list(item)).alias("w"))
    terms = terms.select("line_no", "score", F.array_join(F.transform("w", lambda x: x["stem"]), " ").alias("term"))
    return terms.groupBy("term").agg(F.max_by("score", "line_no").alias("score"))


def text_tokens(
    texts: DataFrame, keys: Sequence[str], stem: bool = False, normalised: bool = False
) -> DataFrame:
    """Stems per text with their number of occurrences; a text without any keeps one NULL row.

    Counting inside the text first makes a hot word one row per text.
    """
    text = F.col("text") if normalised else normalise_text("text")
    tokens = texts.select(*keys, F.explode_outer(F.split(text, " ")).alias("token"))
    tokens = tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    rows = with_stems(tokens, "token", stem)
    valid = F.length("stem") >= MIN_LETTERS
    return rows.groupBy(*keys, F.when(valid, F.col("stem")).alias("stem")).agg(F.sum("n").alias("n"))


def text_words(texts: DataFrame, keys: Sequence[str], stem: bool = False) -> DataFrame:
    """The same with a row for each occurrence, which nothing has to hold: for sums that need no counts of a text's words."""
    tokens = texts.select(*keys, F.explode_outer(F.split(normalise_text("text"), " ")).alias("token"))
    valid = F.length("stem") >= MIN_LETTERS
    return with_stems(tokens, "token", stem).select(*keys, F.when(valid, F.col("stem")).alias("stem"), F.lit(1).cast("long").alias("n"))


def _with_scores(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Scores of the stems; rows without one get a key of a hash that no term has, so they do not meet in one task."""
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64(*tokens.columns), F.lit(1024)).cast("string"))
    rows = tokens.withColumn("_key", F.coalesce("stem", spread))
    return rows.join(lexicon.select(F.col("term").alias("_key"), "score"), "_key", "left").drop("_key")


def text_scores(tokens: DataFrame, lexicon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per text: words, score total, and words with a score >= 0 and < 0."""
    rows = _with_scores(tokens, lexicon)
    n, score = F.col("n"), F.col("score")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return rows.groupBy(*keys).agg(
        total(F.when(F.col("stem").isNotNull(), n)).alias("words"),
        total(n * score).alias("total"),
        total(F.when(score >= 0, n)).alias("positive"),
        total(F.when(score < 0, n)).alias("negative"),
    )


def sentiment_of() -> Column:
    """Mean word score moved into 0..1; 0 for a text without words."""
    return F.when(F.col("words") > 0, (F.col("total") / F.col("words") + 5.0) / 10.0).otherwise(0.0)


def share_of(part: str) -> Column:
    return F.when(F.col("words") > 0, F.col(part) / F.col("words")).otherwise(0.0)


def lexicon_sentiment(texts: DataFrame, lexicon: DataFrame, keys: Sequence[str], stem: bool = False) -> DataFrame:
    """Sentiment and positive and negative share of each text."""
    scores = text_scores(text_tokens(texts, keys, stem), lexicon, keys)
    return scores.select(
        *keys, sentiment_of().alias("sentiment"), share_of("positive").alias("pos"), share_of("negative").alias("neg")
    )


def propagate_term_weights(texts: DataFrame, lexicon: DataFrame, keys: Sequence[str], stem: bool = False) -> DataFrame:
    """``term, count, total``: each occurrence of a word receives the score of its text.

    The score joins the text before its words are unfolded, as a number for each text; so the words of a text are neither
    sorted nor held, and only the vocabulary of a task is shuffled.
    """
    totals = text_scores(text_words(texts, keys, stem), lexicon, keys).select(*keys, "total")
    rows = texts.join(totals.hint("shuffle_hash"), list(keys))
    rows = text_words(rows, [*keys, "total"], stem).where("stem IS NOT NULL")
    return rows.groupBy(F.col("stem").alias("term")).agg(
        F.sum("n").alias("count"), F.sum(F.col("n") * F.col("total")).alias("total")
    )


def corpus_extremes(texts: DataFrame, lexicon: DataFrame, key: str, stem: bool = False) -> DataFrame:
    """Sum of the text scores, and the most positive and negative text above and below 0."""
    scores = text_scores(text_words(texts, [key], stem), lexicon, [key]).select(key, "total")
    total, place = F.col("total"), -F.col(key)
    best = F.max_by(F.struct(total, key), F.struct(total, place)).alias("best")
    worst = F.max_by(F.struct(total, key), F.struct(-total, place)).alias("worst")
    out = scores.agg(F.sum("total").alias("sum_sentiment"), best, worst)
    return out.select(
        "sum_sentiment",
        F.greatest("best.total", F.lit(0)).alias("max_sentiment"),
        F.when(F.col("best.total") > 0, F.col(f"best.{key}")).alias("max_text"),
        F.least("worst.total", F.lit(0)).alias("min_sentiment"),
        F.when(F.col("worst.total") < 0, F.col(f"worst.{key}")).alias("min_text"),
    )


def propagation_ratio(weights: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Total sentiment of lexicon words over their own contribution; 0 without any."""
    rows = weights.join(lexicon.select("term", "score"), "term")
    out = rows.agg(F.sum("total").alias("total"), F.sum(F.col("score") * F.col("count")).alias("own"))
    ratio = F.when(F.coalesce(F.col("own"), F.lit(0)) != 0, F.col("total") / F.col("own")).otherwise(0.0)
    return out.select(ratio.alias("ratio"))


def propagated_sentiment(
    texts: DataFrame,
    weights: DataFrame,
    lexicon: DataFrame,
    keys: Sequence[str],
    stem: bool = False,
    normalised: bool = False,
) -> DataFrame:
    """Summed word totals over the ratio and the number of words; NULL where one of them is 0."""
    tokens = text_tokens(texts, keys, stem, normalised)
    rows = tokens.join(weights.select(F.col("term").alias("stem"), "total"), "stem", "left")
    sums = rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("n") * F.col("total")), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("stem").isNotNull(), F.col("n"))), F.lit(0)).alias("words"),
    )
    ratio = propagation_ratio(weights, lexicon).scalar()
    value = F.try_divide(F.try_divide("total", ratio), F.col("words").cast("double"))
    return sums.select(*keys, value.alias("sentiment"))


def _fields(docs: DataFrame) -> DataFrame:
    """``doc_id, field, text``: the normalised title and body, cut into blank-separated tokens as ``tokens``."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.col("title").alias("text")),
        F.struct(F.lit("body").alias("field"), F.col("body").alias("text")),
    )
    rows = docs.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", "f.text")
    return rows.select("doc_id", "field", F.split(normalise_text(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


def _mentioned(mentions: DataFrame) -> DataFrame:
    """The mentions of a field, each once and no more than its text has room for, in one row."""
    item = F.struct("entity_id", "start", "end")
    return mentions.groupBy("doc_id", "field").agg(F.collect_set(item).alias("found"))


def _token_at(starts: Column, m: Column) -> Column:
    """The mention with the places of its first and last token among the tokens' ascending starts."""
    return F.struct(
        m["entity_id"].alias("entity_id"),
        m["start"].alias("start"),
        (rank_in(starts, m["start"] + 1) - 1).alias("a"),
        (rank_in(starts, m["end"] + 1) - 1).alias("b"),
    )


def mention_windows(docs: DataFrame, mentions: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Window texts of each mention for each number of words on both sides.

    A text is normalised and cut once; a mention's tokens are found by halving, so a window costs its own words only.
    """
    starts = running_sums(F.transform("tokens", lambda t: F.length(t) + 1))
    rows = _fields(docs).withColumn("starts", F.slice(starts, F.lit(1), F.size("tokens")))
    rows = rows.join(_mentioned(mentions), ["doc_id", "field"])
    last = F.size("tokens") - 1

    def window(m: Column, n: int) -> Column:
        at = F.sequence(F.greatest(m["a"] - n, F.lit(0)), F.least(m["b"] + n, last))
        text = F.trim(F.array_join(F.transform(at, lambda i: F.get("tokens", i)), " "))
        return F.struct(m["entity_id"].alias("entity_id"), m["start"].alias("start"), F.lit(n).alias("length"), text.alias("text"))

    # unfolded by the outer form: for the other the optimizer adds a filter on the array, which would be computed again
    placed = F.transform("found", lambda m: _token_at(F.col("starts"), m))
    cut = F.flatten(F.transform(placed, lambda m: F.array(*[window(m, n) for n in lengths])))
    rows = rows.select("doc_id", "field", cut.alias("cut")).select("doc_id", "field", F.explode_outer("cut").alias("w"))
    return rows.select("doc_id", "w.entity_id", "field", "w.start", "w.length", "w.text")


def window_sums(docs: DataFrame, mentions: DataFrame, lexicon: DataFrame, lengths: Sequence[int], stem: bool = False) -> DataFrame:
    """``doc_id, entity_id, field, start, length, words, total, positive, negative`` of each mention's windows.

    ``lexicon`` has one row per term. A document's different words meet it once; its texts, their scores and its mentions then come in one
    row, where running sums over a text's tokens give each window by two look-ups, whatever the number of mentions and lengths. So
    no row of a token is sorted or shuffled, where the lexicon is below the optimizer's broadcast threshold. Texts of one doc_id
    are one document, token by token.
    """
    plain = docs.select("doc_id", *[normalise_text(F.coalesce(f, F.lit(""))).alias(f) for f in ("title", "body")])
    cut = F.concat(F.split("title", " "), F.split("body", " "))
    words = with_stems(plain.select("doc_id", F.explode(F.array_distinct(cut)).alias("token")), "token", stem)
    words = words.where(F.length("stem") >= MIN_LETTERS)
    score = F.col("score")
    words = words.join(lexicon.select(F.col("term").alias("stem"), "score"), "stem", "left" if stem else "inner")
    sign = F.when(score >= 0, 1).when(score < 0, -1).otherwise(0)
    word = F.struct("token", F.coalesce(score.cast("long"), F.lit(0)).alias("total"), sign.alias("sign"))
    scored = words.groupBy("doc_id").agg(F.collect_list(word).alias("w")).select("doc_id", *[f"w.{c}" for c in ("token", "total", "sign")])
    texts = plain.groupBy("doc_id").agg(F.collect_list(F.struct("title", "body")).alias("t")).select("doc_id", "t.title", "t.body")
    item = F.struct("field", "entity_id", "start", "end")
    spots = ["entity_id", "field", "start", "end"]
    found = mentions.groupBy("doc_id").agg(F.collect_set(item).alias("m")).select("doc_id", *[f"m.{c}" for c in spots])
    rows = texts.join(found, "doc_id").join(scored, "doc_id", "left")
    kinds = {c: mentions.schema[c].dataType.simpleString() for c in spots}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, entity_id {kinds['entity_id']}, field string, start {kinds['start']}, "
    schema += "length int, words long, total long, positive long, negative long"
    sizes, shortest = np.array(lengths, np.int64), MIN_LETTERS
    names = [c.split()[0] for c in schema.split(", ")]

    def sums(tokens: list[str], scores: dict, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Words, total, positive and negative ones of each mention, low to high, in each window: one row a mention."""
        width = np.array([len(t) + 1 for t in tokens])
        starts = np.cumsum(width) - width
        total, sign = np.array([scores.get(t, (0, 0)) for t in tokens], np.int64).T
        valid = np.array([t in scores for t in tokens]) if stem else width > shortest
        first = (np.searchsorted(starts, low + 1) - 1)[:, None] - sizes
        last = (np.searchsorted(starts, high + 1) - 1)[:, None] + sizes
        first, last = np.maximum(first, 0), np.minimum(last, len(tokens) - 1) + 1
        so_far = [np.concatenate([[0], np.cumsum(x)]) for x in (valid, total * valid, (sign > 0) & valid, (sign < 0) & valid)]
        return [(x[last] - x[first]).ravel() for x in so_far]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.schema.field("doc_id").type, []
            entity_kind, start_kind = (batch.schema.field(c).type.value_type for c in ("entity_id", "start"))
            for row in batch.to_pylist():
                scores = dict(zip(row["token"] or [], zip(row["total"] or [], row["sign"] or [])))
                for field in ("title", "body"):
                    at = [i for i, f in enumerate(row["field"]) if f == field]
                    if not at:
                        continue
                    parts = [t.split(" ") for t in row[field]]
                    tokens = parts[0] if len(parts) == 1 else [t for same in zip_longest(*parts) for t in same if t is not None]
                    low, high = (np.array([row[c][i] for i in at], np.int64) for c in ("start", "end"))
                    of_mention = [np.repeat(np.array([row["entity_id"][i] for i in at]), len(sizes)), np.repeat(low, len(sizes))]
                    out.append((row["doc_id"], field, *of_mention, np.tile(sizes, len(at)), *sums(tokens, scores, low, high)))
            if out:
                count = [len(o[2]) for o in out]
                doc_ids = pa.array([o[0] for o in out], ids).take(pa.array(np.repeat(np.arange(len(out)), count)))
                fields = pa.array([o[1] for o in out]).take(pa.array(np.repeat(np.arange(len(out)), count)))
                entities, start, length, *values = (np.concatenate([o[k] for o in out]) for k in range(2, 9))
                columns = [doc_ids, pa.array(entities, entity_kind), fields, pa.array(start, start_kind), pa.array(length, pa.int32()), *map(pa.array, values)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(windows, schema)


window_training_texts = mention_windows


def sentiment_features(
    docs: DataFrame, mentions: DataFrame, lexicon: DataFrame, n: int = 20, stem: bool = False, agg: str = "sum"
) -> DataFrame:
    """Title and body sentiment, positive and negative share around each entity's mentions.

    Values of several mentions are summed; ``agg='mean'`` averages them. A field without mentions
    counts as neutral.
    """
    return sentiment_features_by_length(docs, mentions, lexicon, [n // 2], stem, agg).drop("length")


def sentiment_features_by_length(
    docs: DataFrame, mentions: DataFrame, lexicon: DataFrame, lengths: Sequence[int], stem: bool = False, agg: str = "sum"
) -> DataFrame:
    """The same for several window lengths in one job, one row per (document, entity, length)."""
    scores = window_sums(docs, mentions, lexicon, lengths, stem)
    fold = F.sum if agg == "sum" else F.avg

    def value(field: str, c: Column, default: float) -> Column:
        return F.coalesce(fold(F.when(F.col("field") == field, c)), F.lit(default))

    columns = []
    for field in ("title", "body"):
        columns += [
            value(field, sentiment_of(), NEUTRAL).alias(f"{field}_sentiment"),
            value(field, share_of("positive"), 0.0).alias(f"{field}_pos"),
            value(field, share_of("negative"), 0.0).alias(f"{field}_neg"),
        ]
    return scores.groupBy("doc_id", "entity_id", "length").agg(*columns)


def multi_window_sentiment(
    docs: DataFrame,
    mentions: DataFrame,
    weights: DataFrame,
    lexicon: DataFrame,
    lengths: Sequence[int] = tuple(range(2, 10)),
    stem: bool = False,
) -> DataFrame:
    """Propagated sentiment summed over window lengths and mentions per (document, entity)."""
    sums = window_sums(docs, mentions, weights.select("term", F.col("total").alias("score")), lengths, stem)
    ratio = propagation_ratio(weights, lexicon).scalar()
    value = F.try_divide(F.try_divide("total", ratio), F.col("words").cast("double"))
    return sums.groupBy("doc_id", "entity_id").agg(F.sum(value).alias("sentiment"))


def sentiment_delta_by_class(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Headline minus body score of ``headline_id, body_id, class`` pairs."""
    head = scores.select(F.col("text_id").alias("headline_id"), F.col("sentiment").alias("_h"))
    body = scores.select(F.col("text_id").alias("body_id"), F.col("sentiment").alias("_b"))
    rows = pairs.join(head, "headline_id").join(body, "body_id")
    return rows.withColumn("delta", F.col("_h") - F.col("_b")).drop("_h", "_b")


def minmax_normalise(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Column moved and scaled to 0..1 over the whole table."""
    value = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    rows = df.withColumn("_e", ends)
    scaled = F.try_divide(value - F.col("_e.low"), F.col("_e.high") - F.col("_e.low"))
    return rows.withColumn(name or column, scaled).drop("_e")


def peak_normalised_histogram(df: DataFrame, column: str, by: str, bins: int = 100) -> DataFrame:
    """Histogram of each class between its own ends, divided by its fullest bin."""
    value = F.col(column).cast("double")
    ends = df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    rows = df.where(value.isNotNull()).join(ends, by)
    low, high = F.col("low"), F.col("high")
    place = F.when(high > low, F.floor((value - low) / (high - low) * bins)).otherwise(0)
    counts = rows.groupBy(by, F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("count"))
    return counts.withColumn("height", F.col("count") / F.max("count").over(Window.partitionBy(by)))
