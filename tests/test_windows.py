"""Places, windows and titles against plain Python on small texts with awkward edges."""

import re

import pytest
from pyspark.sql import functions as F

from standout.functions.text import PUNCTUATION, LINE_SIGNS, rank_in, running_sums, sentence_place, sign_places
from standout.operators import light, sentiment, spotting

LONG = " ".join(f"word{i % 7} Tail{i % 5}." for i in range(400))
BODIES = ["", ".", "one. two three. four", "aaaa aa. AAb", " lead  two  blanks ", LONG]
DOCS = [(i, None if i == 0 else f"Title {i} aa", body) for i, body in enumerate(BODIES)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, body string")


def plain(text):
    return "".join(" " if c in PUNCTUATION + LINE_SIGNS else c for c in (text or "").lower())


def fields():
    return {(d, f): text for d, title, body in DOCS for f, text in (("title", title), ("body", body)) if text is not None}


def hits(text, needle):
    return [i for i in range(len(text) - len(needle) + 1) if text[i : i + len(needle)] == needle] if needle else []


@pytest.mark.parametrize("n", [1, 127, 128, 129, 300])
def test_running_sums_over_blocks(spark, n):
    sizes = [i % 5 for i in range(n)]
    got = spark.range(1).select(running_sums(F.array(*[F.lit(x) for x in sizes])).alias("s")).first()["s"]
    assert got == [sum(sizes[:i]) for i in range(n + 1)]


def test_rank_in_counts_smaller_elements(spark):
    for ordered in ([], [3], [1, 1, 4, 9], list(range(0, 64, 2))):
        array = F.array(*[F.lit(x) for x in ordered]).cast("array<int>")
        got = spark.range(70).select("id", rank_in(array, F.col("id")).alias("r")).collect()
        assert all(r["r"] == sum(x < r["id"] for x in ordered) for r in got)


def test_sentence_place_against_text(docs):
    rows = docs.select("doc_id", sign_places("body", ".").alias("stops"), F.explode(F.sequence(F.lit(0), F.length("body"))).alias("at"))
    for r in rows.where("at < 120").select("doc_id", "at", sentence_place(F.col("stops"), F.col("at")).alias("x")).collect():
        body, at = BODIES[r["doc_id"]], r["at"]
        low, high = body.rfind(".", 0, at) + 1, body.find(".", at)
        want = (at - low) / (high - low) if high > at else None
        assert r["x"] == want, (r, want)


@pytest.fixture(scope="module")
def mentions(spark):
    rows = []
    for (d, f), text in fields().items():
        for entity, word in enumerate(["two", "aa", "word3", "tail4", "title"]):
            rows += [(d, f, entity, i, i + len(word), text[i : i + len(word)]) for i in hits(text.lower(), word)]
    # a mention that stands twice counts once
    return spark.createDataFrame(rows + rows[:2], "doc_id long, field string, entity_id long, start long, `end` long, surface string")


def window(text, start, end, n):
    tokens = plain(text).split(" ")
    a, b = plain(text)[:start].count(" "), plain(text)[:end].count(" ")
    return tokens[max(a - n, 0) : b + n + 1]


def test_windows_and_sums(spark, docs, mentions):
    lengths, texts = [1, 3, 49], fields()
    scores = {"one": 2, "two": -3, "blanks": 1, "word3": 4, "tail1": -1, "aa": 5}
    lexicon = spark.createDataFrame(list(scores.items()), "term string, score long")
    unique = {tuple(r) for r in mentions.collect()}
    want_text, want_sums = set(), set()
    for d, f, entity, start, end, _ in unique:
        for n in lengths:
            cut = window(texts[d, f], start, end, n)
            words = [w for w in cut if len(w) >= 3]
            found = [scores[w] for w in words if w in scores]
            want_text.add((d, entity, f, start, n, " ".join(cut).strip(" ")))
            want_sums.add((d, entity, f, start, n, len(words), sum(found), sum(x >= 0 for x in found), sum(x < 0 for x in found)))
    got = [tuple(r) for r in sentiment.mention_windows(docs, mentions, lengths).collect()]
    assert len(got) == len(want_text) and set(got) == want_text
    got = [tuple(r) for r in sentiment.window_sums(docs, mentions, lexicon, lengths).collect()]
    assert len(got) == len(want_sums) and set(got) == want_sums


def test_light_facts(docs, mentions):
    got = light.text_features(light.mention_facts(docs, mentions)).collect()
    assert got
    for r in got:
        found = [m for m in mentions.collect() if (m["doc_id"], m["entity_id"], m["field"]) == (r["doc_id"], r["entity_id"], "body")]
        surface = max(found, key=lambda m: m["start"])["surface"]
        assert r["surface_frequency"] == BODIES[r["doc_id"]].count(surface)


def test_titles_with_fallbacks(spark, docs):
    titles = {1: "aa", 2: "two_three", 3: "two_nine", 4: "word3_tail4", 5: "zz", 6: "AA", 7: "word3_none"}
    wanted = spark.createDataFrame([(d, e, t) for d, _, _ in DOCS for e, t in titles.items()], "doc_id long, entity_id long, title string")
    got = spotting.spot_titles(docs, wanted, random_place=False, keep_stage=True).collect()
    want = set()
    for (d, f), text in fields().items():
        for e, title in titles.items():
            for needle, stage in ((title.replace("_", " ").lower(), "title"), (title.split("_")[0].lower(), "token")):
                places = hits(text.lower(), needle)
                want |= {(d, f, e, i, i + len(needle), text[i : i + len(needle)], stage) for i in places}
                if places:
                    break
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    placed = spotting.spot_titles(docs, wanted.where("entity_id = 5"), keep_stage=True).collect()
    assert {r["doc_id"] for r in placed} == {d for d, _, body in DOCS if body} and {r["stage"] for r in placed} == {"place"}
    # a place is a blank, or the start of the text, up to the next blank
    assert all(re.fullmatch(r" ?[^ ]*", r["surface"]) for r in placed)


def test_empty_tables(docs, mentions):
    none = mentions.limit(0)
    assert sentiment.mention_windows(docs, none, [2]).count() == 0
    assert light.mention_facts(docs, none).count() == 0
