"""Term frequency, sentiment, and the flagship ranking-quality query."""

from __future__ import annotations

from pyspark.sql import functions as F

from standout.functions.text import round9
from standout.operators import ranking, scoring, sentiment
from standout.operators.golden import attach_golden
from standout.plans import inputs
from standout.plans.catalog import query
from standout.plans.inputs import with_inputs
from standout.session import stored

SIGNS = "',.()\"'':;?!@[]/“”‘’' || chr(10) || chr(9), '                    '"


def _plain(text: str) -> str:
    return f"translate(lower({text}), {SIGNS})"


TF = (
    "mc AS MATERIALIZED (SELECT doc_id, entity_id, count(*) FILTER (WHERE field = 'title') AS t, count(*) FILTER (WHERE field = 'body') AS b FROM mentions GROUP BY ALL), "
    "tf AS MATERIALIZED (SELECT doc_id, entity_id, (t + b) / sum(t + b) OVER w AS doc_freq, coalesce(t / nullif(sum(t) OVER w, 0), 0) AS title_freq, "
    "coalesce(b / nullif(sum(b) OVER w, 0), 0) AS body_freq FROM mc WINDOW w AS (PARTITION BY doc_id))"
)


@query("tf_features", with_inputs("mentions", "SELECT doc_id, entity_id, round(doc_freq, 9) AS doc_freq, round(title_freq, 9) AS title_freq, round(body_freq, 9) AS body_freq FROM tf", TF))
def _(spark, sf):
    out = sentiment.tf_features(inputs.mentions(spark, sf))
    return out.select("doc_id", "entity_id", *[round9(c).alias(c) for c in ("doc_freq", "title_freq", "body_freq")])


@query("baseline_ranking_quality", with_inputs("mentions golden",
       "SELECT doc_id, round(coalesce(d / nullif(b, 0), 0), 9) AS ndcg, round(p, 9) AS p5 FROM (SELECT doc_id, "
       "sum((2 ** s - 1) * disc) FILTER (WHERE judged) AS d, sum(7 * disc) FILTER (WHERE judged) AS b, count(*) FILTER (WHERE grade >= 2 AND rank <= 5) / 5 AS p FROM ("
       "SELECT *, CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 1 / log2(greatest(rank, 2)) END AS disc FROM ("
       "SELECT tf.doc_id, tf.entity_id, round(doc_freq, 9) AS s, coalesce(g.grade, 0) AS grade, g.grade IS NOT NULL AS judged, "
       "row_number() OVER (PARTITION BY tf.doc_id ORDER BY round(doc_freq, 9) DESC, tf.entity_id) AS rank FROM tf LEFT JOIN golden g USING (doc_id, entity_id))) GROUP BY doc_id)", TF))
def _(spark, sf):
    known = inputs.entities(spark, sf)
    features = sentiment.tf_features(inputs.mentions(spark, sf, known)).withColumn("doc_freq", round9("doc_freq"))
    # both are read several times, also to find the bounds of sorted partitions
    scores = stored(scoring.baseline_first_value(features, "doc_freq"), "scores")
    golden = stored(inputs.golden(spark, sf, known), "golden")
    ndcg = ranking.salience_ndcg(scores, golden).select("doc_id", round9("ndcg").alias("ndcg"))
    top = attach_golden(ranking.rank_entities(scores), golden)
    p5 = top.groupBy("doc_id").agg(round9(F.count_if((F.col("grade") >= 2) & (F.col("rank") <= 5)) / 5).alias("p5"))
    return ndcg.join(p5, "doc_id")


TOKENS = (
    "tk AS MATERIALIZED (SELECT doc_id, field, CAST(idx AS BIGINT) AS idx, w FROM (SELECT doc_id, field, unnest(range(0, len(a))) AS idx, unnest(a) AS w FROM ("
    f"SELECT doc_id, field, string_split({_plain('text')}, ' ') AS a FROM (SELECT doc_id, 'title' AS field, title AS text FROM docs UNION ALL SELECT doc_id, 'body', body FROM docs))))"
)


@query("stem_tokens_plain", with_inputs("docs", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split("
       + _plain("body") + ", ' '), lambda x: length(x) >= 3))), ' ') AS stems FROM docs WHERE len(list_filter(string_split(" + _plain("body") + ", ' '), lambda x: length(x) >= 3)) > 0"))
def _(spark, sf):
    texts = inputs.docs(spark, sf).select("doc_id", F.col("body").alias("text"))
    return sentiment.stem_tokens(texts, ["doc_id"], stem=False).select("doc_id", F.array_join("stems", " ").alias("stems"))


@query("stem_tokens")
def _(spark, sf):
    texts = inputs.docs(spark, sf).select("doc_id", F.col("body").alias("text"))
    return sentiment.stem_tokens(texts, ["doc_id"]).select("doc_id", F.size("stems").cast("long").alias("stems"))


WINDOW = (
    "fields AS MATERIALIZED (SELECT doc_id, field, " + _plain("text") + " AS plain FROM (SELECT doc_id, 'title' AS field, title AS text FROM docs UNION ALL SELECT doc_id, 'body', body FROM docs)), "
    "at AS MATERIALIZED (SELECT m.doc_id, m.field, m.entity_id, m.start, len(string_split(left(f.plain, CAST(m.start AS BIGINT)), ' ')) - 1 AS a, "
    "len(string_split(left(f.plain, CAST(m.\"end\" AS BIGINT)), ' ')) - 1 AS b FROM mentions m JOIN fields f USING (doc_id, field))"
).replace("at AS MATERIALIZED", "placed AS MATERIALIZED")


@query("ngram_window", with_inputs("mentions", "SELECT p.doc_id, p.entity_id, p.field, p.start, trim(array_to_string((string_split(f.plain, ' '))[greatest(a - 4, 0) + 1:b + 4 + 1], ' '), ' ') AS text "
       "FROM placed p JOIN fields f USING (doc_id, field)", WINDOW))
def _(spark, sf):
    return sentiment.mention_windows(inputs.docs(spark, sf), inputs.mentions(spark, sf), [4]).drop("length")


@query("prepare_lexicon", with_inputs("lexicon", "SELECT left(term, 5) AS term, CAST(first(score ORDER BY line_no * 100000 + place DESC) AS BIGINT) AS score FROM ("
       "SELECT *, row_number() OVER (ORDER BY term) AS place FROM lexicon) GROUP BY 1"))
def _(spark, sf):
    from pyspark.sql import Window

    rows = inputs.lexicon(spark, sf)
    place = F.row_number().over(Window.orderBy("term"))  # a lexicon is small
    rows = rows.withColumn("line_no", F.col("line_no") * 100_000 + place)
    rows = rows.withColumn("term", F.concat(F.lit("("), F.translate(F.substring("term", 1, 5), "aeiou", "AEIOU"), F.lit(").")))
    return sentiment.prepare_lexicon(rows, stem=False)


WORDS = (
    "tx AS MATERIALIZED (SELECT doc_id, idx, w FROM tk WHERE field = 'body' AND length(w) >= 3), "
    "sc AS MATERIALIZED (SELECT d.doc_id, count(t.w) AS words, CAST(coalesce(sum(l.score), 0) AS BIGINT) AS total, count(*) FILTER (WHERE l.score >= 0) AS pos, count(*) FILTER (WHERE l.score < 0) AS neg "
    "FROM docs d LEFT JOIN tx t USING (doc_id) LEFT JOIN lexicon l ON l.term = t.w GROUP BY d.doc_id), "
    "wt AS MATERIALIZED (SELECT t.w AS term, count(*) AS count, CAST(sum(s.total) AS BIGINT) AS total FROM tx t JOIN sc s USING (doc_id) GROUP BY t.w), "
    "ra AS MATERIALIZED (SELECT coalesce(sum(w.total) / nullif(sum(l.score * w.count), 0), 0) AS ratio FROM wt w JOIN lexicon l USING (term))"
)


def _bodies(spark, sf):
    return inputs.docs(spark, sf).select("doc_id", F.col("body").alias("text"))


def _weights(spark, sf, lexicon):
    return sentiment.propagate_term_weights(_bodies(spark, sf), lexicon, ["doc_id"])


def _stored_weights(spark, sf, lexicon):
    """A row for each word, read several times: made once, and joined by its size."""
    return stored(_weights(spark, sf, lexicon), "weights")


@query("propagate_term_weights", with_inputs("docs lexicon", "SELECT term, count, total FROM wt", TOKENS + ", " + WORDS))
def _(spark, sf):
    return _weights(spark, sf, inputs.lexicon(spark, sf))


@query("corpus_extremes", with_inputs("docs lexicon", "SELECT CAST(sum(total) AS BIGINT) AS sum_sentiment, greatest(max(total), 0) AS max_sentiment, "
       "CASE WHEN max(total) > 0 THEN first(doc_id ORDER BY total DESC, doc_id) END AS max_text, least(min(total), 0) AS min_sentiment, "
       "CASE WHEN min(total) < 0 THEN first(doc_id ORDER BY total, doc_id) END AS min_text FROM sc", TOKENS + ", " + WORDS))
def _(spark, sf):
    return sentiment.corpus_extremes(_bodies(spark, sf), inputs.lexicon(spark, sf), "doc_id")


@query("propagation_ratio", with_inputs("docs lexicon", "SELECT round(ratio, 6) AS ratio FROM ra", TOKENS + ", " + WORDS))
def _(spark, sf):
    lexicon = inputs.lexicon(spark, sf)
    return sentiment.propagation_ratio(_weights(spark, sf, lexicon), lexicon).select(round9("ratio", 6).alias("ratio"))


@query("propagated_sentiment", with_inputs("docs lexicon", "SELECT d.doc_id, round(coalesce(sum(w.total), 0) / (SELECT nullif(ratio, 0) FROM ra) / nullif(count(t.w), 0), 6) AS sentiment "
       "FROM docs d LEFT JOIN tx t USING (doc_id) LEFT JOIN wt w ON w.term = t.w GROUP BY d.doc_id", TOKENS + ", " + WORDS))
def _(spark, sf):
    lexicon = inputs.lexicon(spark, sf)
    out = sentiment.propagated_sentiment(_bodies(spark, sf), _stored_weights(spark, sf, lexicon), lexicon, ["doc_id"])
    return out.select("doc_id", round9("sentiment", 6).alias("sentiment"))


SIMPLE = "CASE WHEN words = 0 THEN 0 ELSE (total / words + 5) / 10 END"


@query("lexicon_sentiment", with_inputs("docs lexicon", f"SELECT doc_id, round({SIMPLE}, 9) AS sentiment, round(coalesce(pos / nullif(words, 0), 0), 9) AS pos, "
       "round(coalesce(neg / nullif(words, 0), 0), 9) AS neg FROM sc", TOKENS + ", " + WORDS))
def _(spark, sf):
    out = sentiment.lexicon_sentiment(_bodies(spark, sf), inputs.lexicon(spark, sf), ["doc_id"])
    return out.select("doc_id", *[round9(c).alias(c) for c in ("sentiment", "pos", "neg")])


PREFIX = (
    "cum AS MATERIALIZED (SELECT doc_id, field, idx, sum(CASE WHEN length(w) >= 3 THEN 1 ELSE 0 END) OVER o AS cw, sum(CASE WHEN length(w) >= 3 THEN coalesce(score, 0) ELSE 0 END) OVER o AS ct, "
    "sum(CASE WHEN score >= 0 THEN 1 ELSE 0 END) OVER o AS cp, sum(CASE WHEN score < 0 THEN 1 ELSE 0 END) OVER o AS cn, max(idx) OVER (PARTITION BY doc_id, field) AS final "
    "FROM tk LEFT JOIN lexicon l ON l.term = tk.w AND length(w) >= 3 WINDOW o AS (PARTITION BY doc_id, field ORDER BY idx))"
)


def _window_sums(lengths: str, table: str = "cum", columns: str = "cw ct cp cn") -> str:
    names = columns.split()
    got = ", ".join(f"h.{c} - coalesce(l.{c}, 0) AS {c[1:]}" for c in names)
    return (
        f"ws AS MATERIALIZED (SELECT p.*, {got} FROM (SELECT placed.*, n, least(b + n, f.final) AS hi, greatest(a - n, 0) - 1 AS lo FROM placed, (VALUES {lengths}) v(n), "
        f"(SELECT doc_id, field, max(final) AS final FROM {table} GROUP BY ALL) f WHERE f.doc_id = placed.doc_id AND f.field = placed.field) p "
        f"JOIN {table} h ON h.doc_id = p.doc_id AND h.field = p.field AND h.idx = p.hi LEFT JOIN {table} l ON l.doc_id = p.doc_id AND l.field = p.field AND l.idx = p.lo)"
    )


def _six(fold: str) -> str:
    out = []
    for field in ("title", "body"):
        f = f"FILTER (WHERE field = '{field}')"
        out += [
            f"round(coalesce({fold}(CASE WHEN w = 0 THEN 0 ELSE (t / w + 5) / 10 END) {f}, 0.5), 9) AS {field}_sentiment",
            f"round(coalesce({fold}(coalesce(p / nullif(w, 0), 0)) {f}, 0), 9) AS {field}_pos",
            f"round(coalesce({fold}(coalesce(n_ / nullif(w, 0), 0)) {f}, 0), 9) AS {field}_neg",
        ]
    return ", ".join(out)


SIX = ["title_sentiment", "title_pos", "title_neg", "body_sentiment", "body_pos", "body_neg"]
CUM = ", ".join([TOKENS, WINDOW, PREFIX.replace(" AS cn,", " AS cn_,")])


@query("sentiment_features", with_inputs("mentions lexicon", f"SELECT doc_id, entity_id, {_six('sum')} FROM ws GROUP BY ALL", CUM + ", " + _window_sums("(10)", columns="cw ct cp cn_")))
def _(spark, sf):
    out = sentiment.sentiment_features(inputs.docs(spark, sf), inputs.mentions(spark, sf), inputs.lexicon(spark, sf))
    return out.select("doc_id", "entity_id", *[round9(c).alias(c) for c in SIX])


@query("sentiment_features_mean", with_inputs("mentions lexicon", f"SELECT doc_id, entity_id, {_six('avg')} FROM ws GROUP BY ALL", CUM + ", " + _window_sums("(10)", columns="cw ct cp cn_")))
def _(spark, sf):
    out = sentiment.sentiment_features(inputs.docs(spark, sf), inputs.mentions(spark, sf), inputs.lexicon(spark, sf), agg="mean")
    return out.select("doc_id", "entity_id", *[round9(c).alias(c) for c in SIX])


@query("sentiment_features_by_length", with_inputs("mentions lexicon", f"SELECT doc_id, entity_id, n AS length, {_six('sum')} FROM ws GROUP BY doc_id, entity_id, n",
       CUM + ", " + _window_sums("(5), (32)", columns="cw ct cp cn_")))
def _(spark, sf):
    out = sentiment.sentiment_features_by_length(inputs.docs(spark, sf), inputs.mentions(spark, sf), inputs.lexicon(spark, sf), [5, 32])
    return out.select("doc_id", "entity_id", "length", *[round9(c).alias(c) for c in SIX])


TOTALS = ("cumt AS MATERIALIZED (SELECT doc_id, field, idx, sum(CASE WHEN length(w) >= 3 THEN 1 ELSE 0 END) OVER o AS cw, sum(coalesce(total, 0)) OVER o AS ct, max(idx) OVER (PARTITION BY doc_id, field) AS final "
          "FROM tk LEFT JOIN wt ON wt.term = tk.w WINDOW o AS (PARTITION BY doc_id, field ORDER BY idx))")


@query("multi_window_sentiment", with_inputs("mentions lexicon", "SELECT doc_id, entity_id, round(sum(t / (SELECT nullif(ratio, 0) FROM ra) / nullif(w, 0)), 5) AS sentiment FROM ws GROUP BY doc_id, entity_id",
       ", ".join([TOKENS, WINDOW, WORDS, TOTALS, _window_sums("(2), (3), (4), (5), (6), (7), (8), (9)", "cumt", "cw ct")])))
def _(spark, sf):
    docs, lexicon = inputs.docs(spark, sf), inputs.lexicon(spark, sf)
    out = sentiment.multi_window_sentiment(docs, inputs.mentions(spark, sf), _stored_weights(spark, sf, lexicon), lexicon)
    return out.select("doc_id", "entity_id", round9("sentiment", 5).alias("sentiment"))


@query("window_training_texts", with_inputs("mentions", "SELECT p.doc_id, p.entity_id, p.field, p.start, n AS length, trim(array_to_string((string_split(f.plain, ' '))[greatest(a - n, 0) + 1:b + n + 1], ' '), ' ') AS text "
       "FROM placed p JOIN fields f USING (doc_id, field), (VALUES (2), (3), (4), (5), (6), (7), (8), (9)) v(n)", WINDOW))
def _(spark, sf):
    return sentiment.window_training_texts(inputs.docs(spark, sf), inputs.mentions(spark, sf), range(2, 10))


TURNS = (
    "turns AS MATERIALIZED (SELECT conv_id * 100 + turn AS text_id, text FROM conversations), "
    "ts AS MATERIALIZED (SELECT text_id, count(*) FILTER (WHERE length(w) >= 3) AS words, coalesce(sum(l.score) FILTER (WHERE length(w) >= 3), 0) AS total FROM "
    f"(SELECT text_id, unnest(string_split({_plain('text')}, ' ')) AS w FROM turns) LEFT JOIN lexicon l ON l.term = w GROUP BY text_id), "
    f"tsent AS MATERIALIZED (SELECT text_id, {SIMPLE} AS s FROM ts), "
    "delta AS MATERIALIZED (SELECT a.conv_id * 100 + a.turn AS headline_id, a.conv_id * 100 + b.turn AS body_id, b.role AS class, x.s - y.s AS d FROM conversations a "
    "JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0 JOIN tsent x ON x.text_id = a.conv_id * 100 + a.turn JOIN tsent y ON y.text_id = b.conv_id * 100 + b.turn)"
)


def _delta(spark, sf):
    turns = inputs.table(spark, sf, "conversations").withColumn("text_id", F.col("conv_id") * 100 + F.col("turn"))
    scores = sentiment.lexicon_sentiment(turns.select("text_id", "text"), inputs.lexicon(spark, sf), ["text_id"])
    heads = turns.where("turn = 0").select("conv_id", F.col("text_id").alias("headline_id"))
    bodies = turns.where("turn > 0").select("conv_id", F.col("text_id").alias("body_id"), F.col("role").alias("class"))
    return sentiment.sentiment_delta_by_class(heads.join(bodies, "conv_id").drop("conv_id"), scores)


@query("sentiment_delta_by_class", with_inputs("lexicon", "SELECT headline_id, body_id, class, round(d, 9) AS delta FROM delta", TURNS))
def _(spark, sf):
    return _delta(spark, sf).withColumn("delta", round9("delta"))


@query("minmax_normalise", with_inputs("lexicon", "SELECT headline_id, body_id, class, round((d - (SELECT min(d) FROM delta)) / (SELECT max(d) - min(d) FROM delta), 9) AS delta FROM delta", TURNS))
def _(spark, sf):
    return sentiment.minmax_normalise(_delta(spark, sf), "delta").withColumn("delta", round9("delta"))


@query("peak_normalised_histogram", "SELECT class, bin, count, round(count / max(count) OVER (PARTITION BY class), 9) AS height FROM (SELECT class, bin, count(*) AS count FROM ("
       "SELECT l_returnflag AS class, least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 100) AS BIGINT), 99) AS bin FROM lineitem JOIN (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi "
       "FROM lineitem GROUP BY 1) USING (l_returnflag)) GROUP BY ALL)")
def _(spark, sf):
    rows = inputs.table(spark, sf, "lineitem").withColumn("class", F.col("l_returnflag"))
    return sentiment.peak_normalised_histogram(rows, "l_extendedprice", "class").withColumn("height", round9("height"))
