"""Every operator and stage on awkward tables: NULLs, empty and long texts, repeated rows, no rows, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from standout.llm import common, divergence, fingerprints, language, merkle, mixing, neighbours, packing, pii, repair, scoring, simhash, substrings, warc

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, bits long, part int, kind int, "
    "place long, block int, value long, key string, row long, _mark string, word string, spans string, held_out string, "
    "mix_size long, _found string, _mix_key string"
)
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    extra = (1, 2, 3, 4, 5, 6, 7, "k", 8, "m", "w", "s", "h", 91, "f", "x")
    return spark.createDataFrame([(d, t, la, s, len(t or ""), *extra) for d, t, la, s in rows], SCHEMA)


AWKWARD = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n ", "de", None),
    (5, LONG, "en", "a"),
    (6, "12345 !!! 67890", None, "c"),
    (7, "der Hund und die Katze saßen auf der Matte", "de", "c"),
    (None, "mail ann.b@example.org or call +49 (30) 1234-5678 now", "en", None),
    (None, None, None, None),
    (7, "ein anderer Text mit der gleichen Nummer", "de", "c"),
    (9, "日本語 текст 😀 é", "en", "ü"),
]

def reread(docs):
    folder = common.new_folder(docs.sparkSession, "test")
    return repair.read_ids(repair.write_ids(docs, folder), folder)


TABLES = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "one_of_each": lambda d: simhash.one_of_each(d),
    "substrings": lambda d: substrings.repeated_passages(d),
    "fingerprints": lambda d: fingerprints.fingerprint_edits(d),
    "mixing": lambda d: mixing.allot(d),
    "mixed": lambda d: mixing.mixed(d),
    "packing": lambda d: packing.pack(d),
    "scoring": lambda d: scoring.score(d),
    "pii": lambda d: pii.detect(d),
    "language": lambda d: language.identify(d),
    "merkle": lambda d: merkle.verified(merkle.manifest(d), F.col("leaf")),
    "divergence": lambda d: divergence.audit(d, least_documents=1),
    "repair": lambda d: reread(d),
}
PER_ROW = ["simhash", "fingerprints", "mixing", "scoring", "pii", "language", "merkle", "repair"]


@pytest.mark.parametrize("name", TABLES)
def test_no_rows(spark, name):
    assert TABLES[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", TABLES)
def test_awkward_rows(spark, name):
    rows = TABLES[name](documents(spark, AWKWARD)).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in AWKWARD)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    for rows in ([], AWKWARD):
        docs = documents(spark, rows)
        out = stage(spark, docs, "")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
            for r in out.collect():  # other columns keep their values, whatever their names
                assert (r["size"], r["bits"], r["key"], r["_mark"], r["mix_size"], r["_found"], r["_mix_key"]) == (1, 2, "k", "m", 91, "f", "x")
        assert (out.count() > 0) == bool(rows)


def test_pipeline_decisions(spark):
    docs = documents(spark, AWKWARD)
    kept = corpus_pipeline.language(spark, docs, "")
    texts = [r["text"] for r in kept.collect()]
    assert None not in texts and "12345 !!! 67890" not in texts and "" not in texts
    one = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sum(r["doc_id"] == 1 for r in one) == 1 and sum(not (r["text"] or "").split() for r in one) == 1
    clean = corpus_pipeline.personal_data(spark, docs, "").where("text LIKE 'mail%'").first()
    assert clean["text"] == "mail [EMAIL] or call [PHONE] now" and clean["n_chars"] == len(clean["text"])


def test_pages(spark):
    schema = "page_id long, url string, html string, digest string, keeper long, keepers string"
    big = "x" * 1500
    rows = [(1, "http://a", big), (2, None, big), (2, None, big), (None, "u\r\nv", big), (3, "b", None), (4, "c", ""), (5, "d", "é" * 400)]
    for data in ([], rows):
        pages = spark.createDataFrame([(*r, "d", 1, "k") for r in data], schema)
        folder = warc.new_folder(spark, "test")
        warc.write_archives(pages, folder).collect()
        if not data:
            continue
        out = warc.read_archives(spark, folder).collect()
        assert len(out) == len(rows) and all(r["error"] is None for r in out)
        by = {}
        for r in out:
            by.setdefault(r["page_id"], []).append(r)
        assert by[1][0]["record_type"] == "revisit" and by[1][0]["refers_to"] == 2
        assert all(r["record_type"] == "response" for k in (2, None, 3, 4, 5) for r in by[k])
        assert bytes(by[5][0]["payload"]).decode() == "é" * 400 and by[5][0]["payload_bytes"] == 800


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, cell int, block int, score double"
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]),
        (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.0]),
    ]
    vectors = spark.createDataFrame([(i, v, 1, 1, 1, 1.0) for i, v in rows], schema)
    got = neighbours.search(vectors, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 10)]
    assert [r["score"] for r in got] == [1.0, 0.0, 0.0, -1.0]
    assert neighbours.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
