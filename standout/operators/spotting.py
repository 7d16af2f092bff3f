"""Mention detection. Output: ``doc_id, field, entity_id, start, end, surface``.

``docs`` are ``doc_id, title, body``; texts are shuffled at most once, joined with the per-document
list of entities and searched there; only places are unfolded, so no text is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standout.functions import needles
from standout.functions.text import with_offsets

cloudpickle.register_pickle_by_value(needles)  # workers need not have the package

MENTION = ["doc_id", "field", "entity_id", "start", "end", "surface"]


def _wanted(doc_entities: DataFrame, titles: DataFrame | None, fallback: bool) -> DataFrame:
    """One row per document with its needles (underscores are blanks), their entities and first tokens as ``wanted``."""
    rows = doc_entities if titles is None else doc_entities.join(titles.select("entity_id", "title"), "entity_id")
    needle = F.lower(F.replace("title", F.lit("_"), F.lit(" ")))
    first = F.lower(F.substring_index("title", "_", 1)) if fallback else F.lit("")
    item = F.struct(needle.alias("needle"), "entity_id", first.alias("first"))
    return rows.groupBy("doc_id").agg(F.collect_set(item).alias("wanted"))


def _mentions_in(fallback: bool, random_place: bool, id_type: str) -> Callable[..., Column]:
    """The mentions of one document, from its texts, their lower-case forms and its wanted needles."""
    kind = f"array<struct<field: string, entity_id: {id_type}, stage: string, start: bigint, `end`: bigint, surface: string>>"

    def of_text(doc_id: int, field: str, text: str, low: str, wanted: Sequence[tuple], known: needles.Needles) -> Iterator[tuple]:
        """Entity, stage, width (None: a stand-in), places and surfaces of each entity in one text."""
        found = known.places(low, {w for needle, _, first in wanted for w in (needle, first) if w})
        for needle, entity, first in wanted:
            at, stage, word = found.get(needle, ()), "title", needle
            if fallback and not at:
                at, stage, word = found.get(first, ()), "token", first
                if not at and random_place and field == "body" and text:
                    start, stop = needles.random_place(doc_id, entity, text)
                    yield entity, "place", 0, [start], [text[start:stop]]
            if at:
                yield entity, stage, len(word), at, [text[p : p + len(word)] for p in at]

    @F.arrow_udf(kind)
    def found(ids: pa.Array, titles: pa.Array, low_titles: pa.Array, bodies: pa.Array, low_bodies: pa.Array, lists: pa.Array) -> pa.Array:
        flat, ends = lists.values, lists.offsets.to_pylist()
        wanted = list(zip(*[flat.field(c).to_pylist() for c in ("needle", "entity_id", "first")]))
        known = needles.Needles({w for needle, _, first in wanted for w in (needle, first) if w})
        fields, entities, stages, sizes, counts, starts, surfaces, offsets = [], [], [], [], [], [], [], [0]
        texts = zip(ids, titles, low_titles, bodies, low_bodies, ends, ends[1:])
        for doc_id, title, low_title, body, low_body, low, high in texts:
            for field, text, lowered in (("title", title.as_py(), low_title.as_py()), ("body", body.as_py(), low_body.as_py())):
                if text is None:
                    continue
                for entity, stage, size, at, cut in of_text(doc_id.as_py(), field, text, lowered, wanted[low:high], known):
                    fields.append(field)
                    entities.append(entity)
                    stages.append(stage)
                    sizes.append(size)
                    counts.append(len(at))
                    starts += at
                    surfaces += cut
            offsets.append(len(starts))
        each = np.repeat(np.arange(len(counts)), counts)
        start, size = np.array(starts, np.int64), np.array(sizes, np.int64)
        columns = {
            "field": pa.array(fields, pa.string()).take(pa.array(each)),
            "entity_id": pa.array(entities, flat.field("entity_id").type).take(pa.array(each)),
            "stage": pa.array(stages, pa.string()).take(pa.array(each)),
            "start": pa.array(start), "end": pa.array(start + size[each]), "surface": pa.array(surfaces, pa.string()),
        }
        mentions = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), mentions)

    return found


def spot_titles(
    docs: DataFrame,
    doc_entities: DataFrame,
    titles: DataFrame | None = None,
    fallback: bool = True,
    random_place: bool = True,
    keep_stage: bool = False,
) -> DataFrame:
    """All occurrences, overlapping ones too, of each entity's title in the title and body.

    Where an entity's title is not found, its first ``_`` token is searched; where that fails in
    a body too, one mention at a reproducible place stands in. ``doc_entities`` is
    ``doc_id, entity_id`` with ``titles(entity_id, title)``, or carries ``title`` itself.

    A text stays in one row with the needles of its document and is passed once for all of them; surfaces are cut there, so
    neither needles nor hits multiply the length of a text, and only the mentions are unfolded.
    """
    rows = docs.select("doc_id", "title", "body").join(_wanted(doc_entities, titles, fallback), "doc_id")
    found = _mentions_in(fallback, random_place, doc_entities.schema["entity_id"].dataType.simpleString())
    mentions = found("doc_id", "title", F.lower("title"), "body", F.lower("body"), "wanted")
    # the outer form: for the other the optimizer adds a filter on the array, which would be computed again
    rows = rows.select("doc_id", mentions.alias("found")).select("doc_id", F.inline_outer("found")).where("start IS NOT NULL")
    out = rows.select(*MENTION, "stage")
    return out if keep_stage else out.drop("stage")


def word_ngrams(docs: DataFrame, max_words: int = 4) -> DataFrame:
    """At each word start of a field the 1..max_words blank-separated n-grams with their offsets."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.col("title").alias("text")),
        F.struct(F.lit("body").alias("field"), F.col("body").alias("text")),
    )
    text = docs.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", "f.text")
    words = text.where("text IS NOT NULL").withColumn("words", F.split("text", " "))
    words = words.withColumn("sizes", F.transform("words", lambda w: F.length(w) + 1))
    words = with_offsets(words, "sizes", "starts")
    # each place takes its own few words along, so the arrays of the text are not repeated per row
    places = F.transform(
        "words",
        lambda w, i: F.struct(F.element_at("starts", i + 1).alias("start"), F.slice("words", i + 1, F.lit(max_words)).alias("next")),
    )
    rows = words.select("doc_id", "field", F.explode_outer(places).alias("p"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("p.next"))))
    piece = F.array_join(F.slice("p.next", F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", "field", F.col("p.start").cast("long").alias("start"), piece.alias("piece"))


def spot_dictionary(docs: DataFrame, anchors: DataFrame, max_words: int = 4) -> DataFrame:
    """Dictionary mentions: n-grams, lower-cased and stripped, also without a final full stop.

    ``anchors`` is ``anchor_key, entity_id`` with one row per key. N-grams stay with their document;
    the dictionary is broadcast by the optimizer below its threshold, else joined by a shuffle.
    """
    plain = F.trim(F.lower("piece"))
    size = F.length("piece")
    whole = F.struct(plain.alias("key"), size.alias("width"))
    short = F.struct(F.substring(plain, F.lit(1), F.length(plain) - 1).alias("key"), (size - 1).alias("width"))
    forms = F.when((F.length(plain) > 1) & plain.endswith("."), F.array(whole, short)).otherwise(F.array(whole))
    rows = word_ngrams(docs, max_words).select("doc_id", "field", "start", "piece", F.explode(forms).alias("k"))
    rows = rows.where("k.key <> ''")
    hits = rows.join(anchors.select("anchor_key", "entity_id"), F.col("k.key") == F.col("anchor_key"))
    return hits.select(
        "doc_id",
        "field",
        "entity_id",
        "start",
        (F.col("start") + F.col("k.width")).cast("long").alias("end"),
        F.substring(F.col("piece"), F.lit(1), F.col("k.width")).alias("surface"),
    )


def spot_title_keys(docs: DataFrame, titles: DataFrame, max_words: int = 4) -> DataFrame:
    """Title-key mentions: full stops and blanks become underscores inside the stripped n-gram."""
    key = F.replace(F.trim(F.replace(F.lower("piece"), F.lit("."), F.lit(" "))), F.lit(" "), F.lit("_"))
    rows = word_ngrams(docs, max_words).withColumn("title_key", key).where("title_key <> ''")
    hits = rows.join(titles.select("title_key", "entity_id"), "title_key")
    return hits.select(
        "doc_id",
        "field",
        "entity_id",
        "start",
        (F.col("start") + F.length("piece")).cast("long").alias("end"),
        F.col("piece").alias("surface"),
    )


def _anchor_pieces(pages: DataFrame, html: str) -> DataFrame:
    """Add ``pieces`` of the HTML between and inside anchors: ``surface``, ``href`` of anchors, and ``size`` in the plain text.

    An anchor that another one interrupts before it is closed has the text up to there as its surface, but that text is said
    again in the other one and takes no room.
    """
    tag = "</?a(?: [^>]*)?>"
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.col(html)), "^<div>", ""), "</div>$", "")
    rows = pages.withColumn("cuts", F.split(plain, "(?=<a[ >])|(?<=</a>)", -1)).where("cuts IS NOT NULL")

    def piece(p: Column, i: Column) -> Column:
        opened, closed = p.rlike("^<a[ >]"), p.endswith("</a>")
        cut_off = opened & ~closed & F.coalesce(F.get("cuts", i + 1).rlike("^<a[ >]"), F.lit(False))
        surface = F.regexp_replace(p, tag, "")
        return F.struct(
            surface.alias("surface"),
            F.when(opened & (closed | cut_off), F.regexp_extract(p, '^<a[^>]*href="([^"]*)"', 1)).alias("href"),
            F.when(cut_off, 0).otherwise(F.length(surface)).alias("size"),
        )

    return rows.withColumn("pieces", F.transform("cuts", piece)).drop("cuts")


def html_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Annotated HTML without its anchor tags and without the text of interrupted anchors."""
    kept = F.transform(F.filter("pieces", lambda p: p["size"] > 0), lambda p: p["surface"])
    return _anchor_pieces(pages, html).withColumn("text", F.array_join(kept, "")).drop("pieces")


def spot_html_anchors(pages: DataFrame, titles: DataFrame, prefix: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """Mentions behind the anchors of annotated HTML, with offsets in the text without anchor tags.

    The target id comes from the href behind ``prefix``, -1 if unknown. The pieces of one page are
    a row-sized array, so offsets are running lengths inside the row.
    """
    rows = _anchor_pieces(pages.select(key, html), html).select(key, "pieces")
    rows = rows.withColumn("sizes", F.transform("pieces", lambda p: p["size"]))
    placed = F.transform(
        "pieces", lambda p, i: F.struct(p["surface"].alias("surface"), p["href"].alias("href"), F.element_at("starts", i + 1).alias("start"))
    )
    anchors = F.filter(placed, lambda p: p["href"].isNotNull())
    rows = with_offsets(rows, "sizes", "starts").select(key, F.explode(anchors).alias("p"))
    rows = rows.select(
        key,
        F.col("p.start").cast("long").alias("start"),
        F.col("p.surface").alias("surface"),
        F.when(F.col("p.href").startswith(prefix), F.lower(F.substring(F.col("p.href"), F.lit(len(prefix) + 1), F.length("p.href")))).alias("title_key"),
    )
    out = rows.join(titles.select("title_key", "entity_id"), "title_key", "left")
    return out.select(
        key,
        F.coalesce("entity_id", F.lit(-1)).cast("long").alias("entity_id"),
        "start",
        (F.col("start") + F.length("surface")).alias("end"),
        "surface",
    )


def find_documents(docs: DataFrame, term: str, golden: DataFrame) -> DataFrame:
    """Documents whose body contains the term, ignoring case, with their judgements."""
    hits = docs.where(F.lower("body").contains(term.lower())).select("doc_id", "title")
    return hits.join(golden, "doc_id", "left")
