"""Hand-computed values of the string expressions, mentions and light features."""

import pytest
from pyspark.sql import functions as F

from standout.functions import porter
from standout.functions.text import find_nth, ngram_window, occurrences, section_bounds
from standout.operators import light, spotting


def first(df):
    return df.first().asDict(recursive=True)


@pytest.mark.parametrize(
    "text, needle",
    [("", "israel"), ("Israel israeL", "israel"), ("aaaa", "aa"), ("xx ababab ab", "abab"), ("abc", "abc"), ("abcabc", "abc"), ("a.b.a.b", "."), ("naïve É é", "é")],
)
def test_occurrences_match_a_scan(spark, text, needle):
    low = text.lower()
    want = [i for i in range(len(low)) if low.startswith(needle, i)]
    row = spark.createDataFrame([(text, needle)], "t string, n string").select(occurrences(F.lower("t"), F.col("n")).alias("o")).first()
    assert row["o"] == want


@pytest.mark.parametrize("n, want", [(-1, 1), (0, 1), (1, 1), (2, 3), (3, -1)])
def test_find_nth(spark, n, want):
    df = spark.createDataFrame([("a.b.",)], "t string")
    assert df.select(find_nth("t", ".", n).alias("x")).first()["x"] == want


@pytest.mark.parametrize("n, want", [(3, "b c d e f g h"), (4, "a b c d e f g h i"), (6, "a b c d e f g h i j k")])
def test_window(spark, n, want):
    df = spark.createDataFrame([("a b c d e f g h i j k", 8, 9)], "t string, s long, e long")
    assert df.select(ngram_window("t", "s", "e", n).alias("x")).first()["x"] == want


def test_section_bounds_of_a_short_body(spark):
    df = spark.createDataFrame([("Iranian  ",)], "t string").select(section_bounds("t").alias("b"))
    assert first(df)["b"] == {"opening_end": 9, "closing_start": 9, "size": 9}


def features(spark, body, title=""):
    docs = spark.createDataFrame([(1, title, body)], "doc_id long, title string, body string")
    wanted = spark.createDataFrame([(1, 7, "Iranian")], "doc_id long, entity_id long, title string")
    mentions = spotting.spot_titles(docs, wanted, fallback=False)
    return first(light.light_features(docs, mentions, None))


def test_positions(spark):
    row = features(spark, "Iranian  ", "the Iranian nuclear program. France ")
    assert (row["first_in_opening"], row["first_in_middle"], row["first_in_closing"]) == (0.0, None, None)
    assert row["first_in_title"] == pytest.approx(0.111, abs=1e-3)
    body = "sentence. sentence. Iranian.  sentence. sentence.  middle Iranian. sentence.sentence. end Iranian."
    row = features(spark, body)
    assert row["first_in_opening"] == pytest.approx(0.7143, abs=1e-4)
    assert row["first_in_middle"] == pytest.approx(0.6170, abs=1e-4)
    assert row["first_in_closing"] == pytest.approx(0.6190, abs=1e-4)


def test_sentences_frequencies_and_shape(spark):
    row = features(spark, "Iranian. Iranian. Iranian", "Iranian. Iranian.")
    assert row["sentence_position"] == pytest.approx(0.0625)
    assert [row[c] for c in ("freq_opening", "freq_middle", "freq_closing", "freq_title")] == [3, 0, 0, 2]
    assert row["uppercase_ratio"] == pytest.approx(1 / 7)
    assert (row["avg_words"], row["avg_chars"], row["any_all_caps"], row["in_title"]) == (1.0, 7.0, 0.0, 1.0)
    row = features(spark, "bla. bla. bla. Iranian. Iranian. Iranian")
    assert [row[c] for c in ("freq_opening", "freq_middle", "freq_closing", "freq_title")] == [0, 0, 3, 0]
    row = features(spark, "Iranian. Iranian. Iranian, Cat Dog Australia. Bla. France, United States")
    assert (row["surface_frequency"], row["document_length"]) == (3, 72)
    row = features(spark, "an IRANIAN text.")
    assert (row["any_all_caps"], row["uppercase_ratio"]) == (1.0, 1.0)


def test_fallbacks(spark):
    docs = spark.createDataFrame([(1, "", "New homes in york")], "doc_id long, title string, body string")
    wanted = spark.createDataFrame([(1, 1, "new_york"), (1, 2, "zzz_q")], "doc_id long, entity_id long, title string")
    rows = {r["entity_id"]: r for r in spotting.spot_titles(docs, wanted, keep_stage=True).collect()}
    assert (rows[1]["stage"], rows[1]["surface"]) == ("token", "New")
    assert rows[2]["stage"] == "place" and rows[2]["start"] == rows[2]["end"]


def test_html_anchors(spark):
    html = '<div>President <a href="http://x/Michelle_Obama">Michelle Obama</a> called <a href="http://x/Thursday">Thursday</a></div>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    titles = spark.createDataFrame([("michelle_obama", 5)], "title_key string, entity_id long")
    assert spotting.html_text(pages).first()["text"] == "President Michelle Obama called Thursday"
    rows = sorted((r["start"], r["end"], r["surface"], r["entity_id"]) for r in spotting.spot_html_anchors(pages, titles, "http://x/").collect())
    assert rows == [(10, 24, "Michelle Obama", 5), (32, 40, "Thursday", -1)]


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
    "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal",
    "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
    "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "by": "by",
    "dying": "die", "archaeological": "archaeolog", "abandoned": "abandon", "happiness": "happi",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", porter.stem(F.col("w")).alias("s")).collect()}
    assert got == STEMS


def test_offsets_are_running_sums(spark):
    from standout.functions.text import with_offsets

    rows = spark.createDataFrame([(n, [i % 5 for i in range(n)]) for n in (1, 2, 127, 128, 129, 1000)], "n int, sizes array<int>")
    for r in with_offsets(rows, "sizes", "at").collect():
        assert r["at"] == [sum(r["sizes"][:i]) for i in range(r["n"] + 1)]


def test_an_anchor_inside_another(spark):
    html = '<div><a href="k/North_Sea">North S<a href="k/North_Sea">North Sea</a> and <a href="k/Elbe">the Elbe</a> meet</div>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, 'no <a href="k/Elbe">end')], "page_id long, html string")
    titles = spark.createDataFrame([("north_sea", 5), ("elbe", 6)], "title_key string, entity_id long")
    assert {r["page_id"]: r["text"] for r in spotting.html_text(pages).collect()} == {1: "North Sea and the Elbe meet", 3: "no end"}
    got = [tuple(r)[1:] for r in spotting.spot_html_anchors(pages, titles, "k/").orderBy("start", "end").collect()]
    assert got == [(5, 0, 7, "North S"), (5, 0, 9, "North Sea"), (6, 14, 22, "the Elbe")]
