"""Feature-matrix algebra, splits, baselines, statistics and vector similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from standout.functions.text import round9
from standout.operators import matrix, scoring, splits, stats, vectors
from standout.plans import inputs
from standout.plans.catalog import query
from standout.plans.inputs import with_inputs

NAMES = ["f1", "f2", "f3", "f4"]


def _place():
    """Order of the lines of one supplier in an order: by price, then by line number."""
    return F.round(F.col("l_extendedprice") * 100).cast("long") * 10 + F.col("l_linenumber")


@query("clean_features", with_inputs("matrix", "SELECT doc_id, entity_id, CASE WHEN f1 > 40 THEN 0 ELSE f1 END AS f1, "
       "CASE WHEN f3 = 0 THEN 0 ELSE f2 END AS f2, f3, f4, y FROM matrix"))
def _(spark, sf):
    rows = inputs.matrix(spark, sf).withColumns(
        {"f1": F.when(F.col("f1") <= 40, F.col("f1")), "f2": F.when(F.col("f3") == 0, F.lit(float("nan"))).otherwise(F.col("f2"))}
    )
    return matrix.clean_features(rows, NAMES)


#: Suppliers of lines with little tax get an id that the other table does not have, so rows without a partner occur.
LOW_TAX_APART = "CASE WHEN l_tax < 0.02 THEN -l_suppkey ELSE l_suppkey END"


def _second(spark, sf):
    orders = inputs.table(spark, sf, "lineitem")
    return orders.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("entity_id"), _place().alias("line_no"),
        F.col("l_quantity").alias("g1"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("y"),
    )


def _first(spark, sf):
    orders = inputs.table(spark, sf, "lineitem")
    return orders.select(
        F.col("l_orderkey").alias("doc_id"), F.expr(LOW_TAX_APART).alias("entity_id"), _place().alias("line_no"),
        F.col("l_tax").alias("f1"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
    )


@query("join_features", "SELECT a.doc_id, a.entity_id, a.f1, b.g1, (a.y + b.y) / 2 AS y FROM "
       "(SELECT l_orderkey AS doc_id, " + LOW_TAX_APART + " AS entity_id, arg_max(l_tax, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS f1, "
       "CAST(arg_max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS DOUBLE) AS y FROM lineitem GROUP BY ALL) a JOIN "
       "(SELECT l_orderkey AS doc_id, l_suppkey AS entity_id, arg_max(l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS g1, "
       "CAST(arg_max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS DOUBLE) AS y FROM lineitem GROUP BY ALL) b USING (doc_id, entity_id)")
def _(spark, sf):
    return matrix.join_features(_first(spark, sf), _second(spark, sf), order="line_no")


@query("select_features", with_inputs("matrix ranking", "SELECT m.doc_id, m.entity_id, f2, f4, coalesce(g.grade, 0) AS grade FROM matrix m "
       "LEFT JOIN ranking g ON g.doc_id = m.doc_id AND g.entity_id = m.entity_id"))
def _(spark, sf):
    return matrix.select_features(inputs.matrix(spark, sf), ["f2", "f4"], inputs.ranking(spark, sf))


@query("mask_features", with_inputs("matrix", "SELECT doc_id, entity_id, f1, 0.0::DOUBLE AS f2, f3, 0.0::DOUBLE AS f4, y FROM matrix"))
def _(spark, sf):
    return matrix.mask_features(inputs.matrix(spark, sf), NAMES, [1, 3])


@query("combine_light_heavy", "SELECT b.doc_id, b.entity_id, coalesce(a.f1, 0) AS f1, b.g1 FROM "
       "(SELECT l_orderkey AS doc_id, " + LOW_TAX_APART + " AS entity_id, arg_max(l_tax, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS f1 FROM lineitem GROUP BY ALL) a RIGHT JOIN "
       "(SELECT l_orderkey AS doc_id, l_suppkey AS entity_id, arg_max(l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS g1 FROM lineitem GROUP BY ALL) b USING (doc_id, entity_id)")
def _(spark, sf):
    light = matrix.last_rows(_first(spark, sf), "line_no").select("doc_id", "entity_id", "f1")
    heavy = matrix.last_rows(_second(spark, sf), "line_no").select("doc_id", "entity_id", "g1")
    return matrix.combine_light_heavy(light, heavy)


@query("feature_index", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS entity_id, l_returnflag || ' ' || l_linestatus AS name, "
       "CAST(CASE l_returnflag || '_' || l_linestatus WHEN 'R_F' THEN 0 WHEN 'A_F' THEN 1 WHEN 'N_O' THEN 2 ELSE -1 END AS BIGINT) AS position FROM lineitem")
def _(spark, sf):
    rows = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("entity_id"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("name")
    )
    return matrix.feature_index(rows, ["R_F", "A_F", "N_O"])


# --- splits


def _hash(key: str, seed: str) -> str:
    mixed = f"((({key}) % 1000003 * 7919 + ({seed}) * 104729 + 13) % 1000003)"
    return f"(({mixed} * {mixed} + {mixed} * 31) % 1000003 / 1000003)"


@query("split_by_group", with_inputs("matrix", f"SELECT doc_id, entity_id, CASE WHEN {_hash('doc_id', '5')} < 0.8 THEN 'train' ELSE 'test' END AS side FROM matrix"))
def _(spark, sf):
    return splits.split_by_group(inputs.matrix(spark, sf).select("doc_id", "entity_id"), "doc_id", 0.8, seed=5)


@query("split_by_list", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 'train' ELSE 'test' END AS side FROM documents")
def _(spark, sf):
    listed = inputs.table(spark, sf, "labels").where("toxic = 0")
    return splits.split_by_list(inputs.table(spark, sf, "documents").select("doc_id"), listed)


@query("split_varying", with_inputs("golden", "SELECT doc_id, entity_id, CASE WHEN " + _hash("doc_id % 1000003 * 1009 + entity_id % 1000003", "3")
       + " < 0.5 THEN 'train' ELSE 'test' END AS side FROM golden WHERE entity_id IN (SELECT entity_id FROM golden GROUP BY 1 HAVING count(*) > 1 AND min(grade) < max(grade))"))
def _(spark, sf):
    from standout.operators.golden import varying_entities

    rows = inputs.golden(spark, sf)
    return splits.split_varying(rows, varying_entities(rows), 0.5, seed=3).drop("grade")


@query("kfold", with_inputs("matrix", "SELECT doc_id, entity_id, ntile(7) OVER (ORDER BY doc_id, entity_id) AS fold FROM matrix"))
def _(spark, sf):
    return splits.kfold(inputs.matrix(spark, sf).select("doc_id", "entity_id"), 7)


@query("shuffle_split", with_inputs("matrix", "SELECT doc_id, entity_id, r AS repetition, CASE WHEN " + _hash("doc_id", "r * 17")
       + " >= 0.2 THEN 'train' ELSE 'test' END AS side FROM matrix, (VALUES (1), (2), (3)) v(r)"))
def _(spark, sf):
    return splits.shuffle_split(inputs.matrix(spark, sf).select("doc_id", "entity_id"), 3, 0.2)


# --- baselines and score metrics


@query("baseline_first_value", with_inputs("matrix", "SELECT doc_id, entity_id, f1 AS score FROM matrix"))
def _(spark, sf):
    return scoring.baseline_first_value(inputs.matrix(spark, sf), "f1")


@query("baseline_perfect", with_inputs("doc_entity golden", "SELECT e.doc_id, e.entity_id, coalesce(grade, 0) AS score FROM doc_entity e LEFT JOIN golden g USING (doc_id, entity_id)"))
def _(spark, sf):
    return scoring.baseline_perfect(inputs.doc_entities(spark, sf), inputs.golden(spark, sf))


@query("baseline_random", with_inputs("doc_entity", "SELECT doc_id, entity_id, " + _hash("doc_id % 1000003 * 1009 + entity_id % 1000003", "0") + " AS score FROM doc_entity"))
def _(spark, sf):
    return scoring.baseline_random(inputs.doc_entities(spark, sf))


@query("select_candidates", with_inputs("ranking", "SELECT doc_id, entity_id, score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best, "
       "row_number() OVER (PARTITION BY doc_id ORDER BY entity_id) AS n FROM ranking) WHERE score > 2.4 OR (best <= 2.4 AND n <= 2)"))
def _(spark, sf):
    return scoring.select_candidates(inputs.ranking(spark, sf).drop("grade"), threshold=2.4, min_pass=2)


@query("regression_metrics", with_inputs("ranking", "SELECT count(*) AS n, round(sqrt(avg((grade - score) ** 2)), 9) AS rmse, "
       "round(1 - sum((grade - score) ** 2) / (SELECT sum((grade - m) ** 2) FROM ranking, (SELECT avg(grade) AS m FROM ranking)), 9) AS r2 FROM ranking"))
def _(spark, sf):
    out = scoring.regression_metrics(inputs.ranking(spark, sf), "grade", "score")
    return out.select("n", round9("rmse").alias("rmse"), round9("r2").alias("r2"))


@query("classification_metrics", with_inputs("ranking", "SELECT label, tp, fp, fn, tn, round(a / (a + b), 9) AS precision, round(a / (a + c), 9) AS recall, "
       "round(2 * a / (2 * a + b + c), 9) AS f1, round(1.25 * a / (1.25 * a + 0.25 * c + b), 9) AS fbeta, a + c AS support FROM ("
       "SELECT *, CASE label WHEN 1 THEN tp ELSE tn END AS a, CASE label WHEN 1 THEN fp ELSE fn END AS b, CASE label WHEN 1 THEN fn ELSE fp END AS c FROM ("
       "SELECT count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, "
       "count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM (SELECT grade >= 2 AS t, score >= 1.5 AS g FROM ranking)), (VALUES (1::BIGINT), (0::BIGINT)) v(label))"))
def _(spark, sf):
    out = scoring.classification_metrics(inputs.ranking(spark, sf), F.col("grade") >= 2, F.col("score") >= 1.5, beta=0.5)
    return out.withColumns({c: round9(c) for c in ("precision", "recall", "f1", "fbeta")})


# --- statistics

CELLS = ("long AS MATERIALIZED (UNPIVOT (SELECT y, f1 > 20 AS a, f3 <> 0 AS b, f4 <> 0 AS c FROM matrix) ON a, b, c INTO NAME feature VALUE is_set), "
         "hy AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT count(*) / (SELECT count(*) FROM matrix) AS p FROM matrix GROUP BY y)), "
         "hs AS (SELECT feature, is_set, sum(n) AS s, -sum(n / t * ln(n / t)) AS h FROM (SELECT feature, is_set, n, sum(n) OVER (PARTITION BY feature, is_set) AS t "
         "FROM (SELECT feature, is_set, y, count(*) AS n FROM long GROUP BY ALL)) GROUP BY ALL), "
         "ig AS (SELECT feature, (SELECT h FROM hy) - sum(s * h) / sum(s) AS gain FROM hs GROUP BY feature)")


def _gain(spark, sf):
    rows = inputs.matrix(spark, sf).select("y", F.when(F.col("f1") > 20, 1.0).otherwise(0.0).alias("a"), F.col("f3").alias("b"), F.col("f4").alias("c"))
    return stats.information_gain(rows, ["a", "b", "c"], "y")


@query("information_gain", with_inputs("matrix", "SELECT feature, round(gain, 9) AS gain FROM ig", CELLS))
def _(spark, sf):
    return _gain(spark, sf).withColumn("gain", round9("gain"))


@query("gain_over_cost", with_inputs("matrix", "SELECT *, round(gain * 1000000 / cost, 6) AS gain_over_cost FROM (SELECT CASE feature WHEN 'a' THEN 'v0_a' WHEN 'b' THEN 'v1_b' ELSE feature END AS feature, "
       "round(gain * 1000000, 6) AS gain, CAST(CASE feature WHEN 'a' THEN 3.75 WHEN 'b' THEN 112.5 ELSE 1 END AS DOUBLE) AS cost FROM ig)".replace("round(gain * 1000000 / cost, 6)", "round(gain / cost, 5)"), CELLS))
def _(spark, sf):
    gain = _gain(spark, sf).withColumn(
        "feature", F.when(F.col("feature") == "a", "v0_a").when(F.col("feature") == "b", "v1_b").otherwise(F.col("feature"))
    )
    gain = gain.withColumn("gain", round9(F.col("gain") * 1_000_000, 6))
    return stats.gain_over_cost(gain).withColumn("gain_over_cost", round9("gain_over_cost", 5))


@query("chi2_select", with_inputs("matrix", "SELECT feature, round(chi2, 6) AS chi2, row_number() OVER (ORDER BY chi2 DESC, feature) AS enters FROM ("
       "SELECT feature, sum((o - e) ** 2 / e) AS chi2 FROM (SELECT feature, o, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM ("
       "UNPIVOT (SELECT y, count(*) AS n, sum(f1) AS f1, sum(f2) AS f2, sum(f3) AS f3, sum(f4) AS f4 FROM matrix GROUP BY y) ON f1, f2, f3, f4 INTO NAME feature VALUE o)) GROUP BY feature)"))
def _(spark, sf):
    return stats.chi2_select(inputs.matrix(spark, sf), NAMES, "y").withColumn("chi2", round9("chi2", 6))


def _series(spark, sf):
    rows = inputs.table(spark, sf, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("system"), F.col("l_orderkey").alias("doc_id")).agg(round9(F.avg("l_discount")).alias("value"))


SERIES = ("series AS MATERIALIZED (SELECT l_returnflag AS system, l_orderkey AS doc_id, round(avg(l_discount), 9) AS value FROM lineitem GROUP BY ALL), "
          "wide AS (SELECT doc_id, coalesce(max(value) FILTER (WHERE system = 'A'), 0) AS a, coalesce(max(value) FILTER (WHERE system = 'N'), 0) AS n, "
          "coalesce(max(value) FILTER (WHERE system = 'R'), 0) AS r FROM series GROUP BY doc_id)")


@query("paired_t_matrix", "WITH " + SERIES + " SELECT a, b, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM ("
       "SELECT 'A' AS a, 'N' AS b, a - n AS d FROM wide UNION ALL SELECT 'A', 'R', a - r FROM wide UNION ALL SELECT 'N', 'R', n - r FROM wide) GROUP BY a, b")
def _(spark, sf):
    return stats.paired_t_matrix(_series(spark, sf), ["A", "N", "R"]).withColumn("t", round9("t", 6))


@query("paired_t_p_values")
def _(spark, sf):
    return stats.with_p_values(stats.paired_t_matrix(_series(spark, sf), ["A", "N", "R"]))


@query("golden_statistics", with_inputs("golden", "SELECT avg(n) AS mean_entities, min(n) AS min_entities, max(n) AS max_entities, CAST(sum(n) AS BIGINT) AS sum_entities, "
       "avg(h) AS mean_salient, min(h) AS min_salient, max(h) AS max_salient, CAST(sum(h) AS BIGINT) AS sum_salient, "
       "(SELECT round(avg(grade), 9) FROM golden) AS mean_grade, (SELECT round(stddev_pop(grade), 9) FROM golden) AS std_grade, (SELECT min(grade) FROM golden) AS min_grade, "
       "(SELECT max(grade) FROM golden) AS max_grade FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE grade >= 2) AS h FROM golden GROUP BY 1)"))
def _(spark, sf):
    return stats.golden_statistics(inputs.golden(spark, sf)).withColumns({c: round9(c) for c in ("mean_grade", "std_grade")})


@query("length_statistics", with_inputs("docs", "SELECT min(w) AS min_words, max(w) AS max_words, avg(w) AS mean_words, min(c) AS min_chars, max(c) AS max_chars, avg(c) AS mean_chars "
       "FROM (SELECT CAST(len(string_split(body, ' ')) AS BIGINT) AS w, length(body) AS c FROM docs)"))
def _(spark, sf):
    return stats.length_statistics(inputs.docs(spark, sf))


@query("system_overlap", "WITH " + SERIES + " SELECT x.doc_id, x.value AS a, y.value AS b, CASE WHEN x.value < 0.05 THEN 'below' ELSE 'above' END AS agreement "
       "FROM series x JOIN series y USING (doc_id) WHERE x.system = 'A' AND y.system = 'R' AND (x.value < 0.05) = (y.value < 0.05)")
def _(spark, sf):
    series = _series(spark, sf)
    return stats.system_overlap(series.where("system = 'A'"), series.where("system = 'R'"), 0.05)


@query("scores_with_entity", with_inputs("ranking", "SELECT doc_id, entity_id, score, grade FROM ranking WHERE doc_id IN (SELECT doc_id FROM ranking WHERE entity_id = 17)"))
def _(spark, sf):
    rows = inputs.ranking(spark, sf)
    return stats.scores_with_entity(rows, rows, 17)


@query("salience_distribution", with_inputs("ranking", "SELECT *, row_number() OVER (ORDER BY mean_grade DESC, entity_id) AS place_by_mean, "
       "row_number() OVER (ORDER BY std_grade DESC, entity_id) AS place_by_std, row_number() OVER (ORDER BY documents DESC, entity_id) AS place_by_documents FROM ("
       "SELECT entity_id, round(avg(grade), 9) AS mean_grade, round(stddev_pop(grade), 9) AS std_grade, count(*) AS documents FROM ranking GROUP BY entity_id)"))
def _(spark, sf):
    out = stats.salience_distribution(inputs.ranking(spark, sf))
    return out.withColumns({c: round9(c) for c in ("mean_grade", "std_grade")})


@query("histogram", "SELECT bin, round(lo + (hi - lo) / 10 * bin, 6) AS low, count(*) AS count, round(count(*) / (any_value(n) * (hi - lo) / 10), 12) AS density FROM ("
       "SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin, lo, hi, n "
       "FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem)) GROUP BY bin, lo, hi")
def _(spark, sf):
    out = stats.histogram(inputs.table(spark, sf, "lineitem"), "l_extendedprice")
    return out.withColumns({"low": round9("low", 6), "density": round9("density", 12)})


@query("salient_entity_listing", with_inputs("golden entity docs", "SELECT d.doc_id, d.title, d.body, coalesce(string_agg(DISTINCT e.title, '|' ORDER BY e.title) FILTER (WHERE grade >= 2), '') AS salient, "
       "coalesce(string_agg(DISTINCT e.title, '|' ORDER BY e.title) FILTER (WHERE grade < 2), '') AS other, "
       "coalesce(string_agg(DISTINCT f.title, '|' ORDER BY f.title) FILTER (WHERE grade >= 2), '') AS salient_canonical, "
       "coalesce(string_agg(DISTINCT f.title, '|' ORDER BY f.title) FILTER (WHERE grade < 2), '') AS other_canonical "
       "FROM docs d JOIN golden g USING (doc_id) JOIN entity e USING (entity_id) JOIN canon c ON c.p = left(e.title, 4) JOIN entity f ON f.entity_id = c.id GROUP BY d.doc_id, d.title, d.body",
       "canon AS (SELECT left(title, 4) AS p, min(entity_id) AS id FROM entity GROUP BY 1)"))
def _(spark, sf):
    known = inputs.entities(spark, sf)
    head = known.groupBy(F.substring("title", 1, 4).alias("p")).agg(F.min("entity_id").alias("canonical_id"))
    ids = known.select("entity_id", F.substring("title", 1, 4).alias("p")).join(head, "p").drop("p")
    return stats.salient_entity_listing(inputs.docs(spark, sf), inputs.golden(spark, sf), ids, known)


@query("reconcile_ids", "SELECT doc_id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL "
       "SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return stats.reconcile_ids(inputs.table(spark, sf, "documents"), inputs.table(spark, sf, "labels"))


# --- vectors

UNIT = ("un AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")


def _vec(i: int) -> str:
    return f"(SELECT u FROM un WHERE vec_id = {i})"


def _vectors(spark, sf):
    return inputs.table(spark, sf, "embeddings")


@query("most_similar", "WITH " + UNIT + f" SELECT vec_id, round(list_dot_product(u, {_vec(3)}), 9) AS similarity FROM un WHERE vec_id <> 3 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return vectors.most_similar(_vectors(spark, sf), 3).withColumn("similarity", round9("similarity"))


MEAN = "mean AS (SELECT list_transform(range(1, 65), lambda i: a.u[i] + b.u[i] - c.u[i]) AS m FROM un a, un b, un c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 5)"


@query("analogy", "WITH " + UNIT + ", " + MEAN + " SELECT vec_id, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)), 9) AS similarity "
       "FROM un, mean WHERE vec_id NOT IN (1, 2, 5) ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return vectors.analogy(_vectors(spark, sf), [1, 2], [5]).withColumn("similarity", round9("similarity"))


@query("analogy_multiplicative", "WITH " + UNIT + f" SELECT vec_id, round((1 + list_dot_product(u, {_vec(1)})) / 2 * (1 + list_dot_product(u, {_vec(2)})) / 2 / "
       f"((1 + list_dot_product(u, {_vec(5)})) / 2 + 0.000001), 9) AS similarity FROM un WHERE vec_id NOT IN (1, 2, 5) ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return vectors.analogy_multiplicative(_vectors(spark, sf), [1, 2], [5]).withColumn("similarity", round9("similarity"))


GROUP = "mean AS (SELECT list_transform(range(1, 65), lambda i: a.u[i] + b.u[i] + c.u[i] + d.u[i]) AS m FROM un a, un b, un c, un d WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 5 AND d.vec_id = 9)"


@query("odd_one_out", "WITH " + UNIT + ", " + GROUP + " SELECT vec_id, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)), 9) AS similarity "
       "FROM un, mean WHERE vec_id IN (1, 2, 5, 9) ORDER BY 2, 1 LIMIT 1")
def _(spark, sf):
    return vectors.odd_one_out(_vectors(spark, sf), [1, 2, 5, 9]).withColumn("similarity", round9("similarity"))


@query("pair_similarity", "WITH " + UNIT + " SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.u, y.u), 9) AS similarity FROM un x JOIN un y ON y.vec_id = x.vec_id + 1")
def _(spark, sf):
    pairs = _vectors(spark, sf).select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return vectors.pair_similarity(pairs, _vectors(spark, sf)).withColumn("similarity", round9("similarity"))
