"""Ranking evaluation over the order lines: prices as scores, quantities as grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from standout.functions.text import round9
from standout.operators import ranking
from standout.plans import inputs
from standout.plans.catalog import query
from standout.plans.inputs import with_inputs
from standout.session import stored


def _lines(spark, sf):
    """Stored: read several times, also to find the bounds of sorted partitions."""
    return stored(inputs.ranking(spark, sf), "ranking")


def run(lines):
    """All lines; the cheap ones are retrieved under an id that nobody judges."""
    return lines.selectExpr("doc_id", "if(score < 0.3, -entity_id, entity_id) AS entity_id", "score")


def qrels(lines):
    """All lines; the dearest ones are judged under an id that is not retrieved."""
    return lines.selectExpr("doc_id", "if(score > 2.7, -entity_id, entity_id) AS entity_id", "grade")


RUN = (
    "run AS MATERIALIZED (SELECT doc_id, CASE WHEN score < 0.3 THEN -entity_id ELSE entity_id END AS entity_id, score FROM ranking), "
    "qrels AS MATERIALIZED (SELECT doc_id, CASE WHEN score > 2.7 THEN -entity_id ELSE entity_id END AS entity_id, grade FROM ranking), "
    "rk AS MATERIALIZED (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY score DESC, r.entity_id) AS rank, q.grade "
    "FROM run r LEFT JOIN qrels q USING (doc_id, entity_id)), "
    "ev AS MATERIALIZED (SELECT *, coalesce(grade >= 2, FALSE) AS hit, "
    "count(*) FILTER (WHERE grade >= 2) OVER w AS hits, count(*) FILTER (WHERE grade < 2) OVER w AS misses "
    "FROM rk WHERE doc_id IN (SELECT doc_id FROM qrels) WINDOW w AS (PARTITION BY doc_id ORDER BY rank)), "
    "tot AS MATERIALIZED (SELECT doc_id, count(*) FILTER (WHERE grade >= 2) AS rel, count(*) FILTER (WHERE grade < 2) AS nonrel, "
    "sum(CASE WHEN grade >= 2 THEN grade ELSE 0 END / log2(pos + 1)) AS ideal FROM (SELECT *, row_number() OVER "
    "(PARTITION BY doc_id ORDER BY grade DESC, entity_id) AS pos FROM qrels) GROUP BY doc_id)"
)
STEEP = "(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 1 / log2(greatest(rank, 2)) END)"


@query("rank_entities", with_inputs("ranking", "SELECT doc_id, entity_id, score, rank FROM rk", RUN))
def _(spark, sf):
    return ranking.rank_entities(run(_lines(spark, sf)))


@query("salience_ndcg", with_inputs("ranking", "SELECT doc_id, round(coalesce(d, 0), 9) AS dcg, round(coalesce(b, 0), 9) AS best_dcg, "
       "round(coalesce(d / nullif(b, 0), 0), 9) AS ndcg FROM (SELECT doc_id, sum((2 ** score - 1) * " + STEEP + ") FILTER (WHERE grade IS NOT NULL) AS d, "
       "sum(7 * " + STEEP + ") FILTER (WHERE grade IS NOT NULL) AS b FROM rk GROUP BY doc_id)", RUN))
def _(spark, sf):
    lines = _lines(spark, sf)
    out = ranking.salience_ndcg(run(lines), qrels(lines))
    return out.withColumns({c: round9(c) for c in ("dcg", "best_dcg", "ndcg")})


@query("salience_ndcg_binary", with_inputs("ranking", "SELECT doc_id, round(coalesce(sum((CASE WHEN score > 0 THEN 1 ELSE 0 END) * " + STEEP
       + ") FILTER (WHERE grade IS NOT NULL) / sum(1 * " + STEEP + ") FILTER (WHERE grade IS NOT NULL), 0), 9) AS ndcg FROM rk GROUP BY doc_id", RUN))
def _(spark, sf):
    lines = _lines(spark, sf)
    out = ranking.salience_ndcg(run(lines), qrels(lines), max_score=1.0, binary=True)
    return out.select("doc_id", round9("ndcg").alias("ndcg"))


@query("dcg_curve", with_inputs("ranking", "SELECT doc_id, entity_id, rank, round(sum(CASE WHEN grade IS NULL THEN 0 ELSE (2 ** score - 1) * " + STEEP
       + " END) OVER (PARTITION BY doc_id ORDER BY rank), 9) AS dcg FROM rk", RUN))
def _(spark, sf):
    lines = _lines(spark, sf)
    return ranking.dcg_curve(run(lines), qrels(lines)).withColumn("dcg", round9("dcg"))


@query("ideal_dcg", with_inputs("ranking", "SELECT doc_id, entity_id, rank, round(sum((2 ** grade - 1) * " + STEEP + ") OVER (PARTITION BY doc_id ORDER BY rank), 9) AS dcg "
       "FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grade DESC, entity_id) AS rank FROM qrels)", RUN))
def _(spark, sf):
    return ranking.ideal_dcg(qrels(_lines(spark, sf))).withColumn("dcg", round9("dcg"))


DOC = "FROM ev JOIN tot USING (doc_id) GROUP BY doc_id, rel, nonrel, ideal"
MEASURES = {
    "retrieval_counts": "count(*) AS num_ret, rel AS num_rel, count(*) FILTER (WHERE hit) AS num_rel_ret",
    "precision_at_k": ", ".join(f'round(count(*) FILTER (WHERE hit AND rank <= {k}) / {k}, 9) AS "P_{k}"' for k in ranking.CUTOFFS),
    "average_precision": "round(coalesce(sum(hits / rank) FILTER (WHERE hit) / nullif(rel, 0), 0), 9) AS map",
    "r_precision": 'round(coalesce(count(*) FILTER (WHERE hit AND rank <= rel) / nullif(rel, 0), 0), 9) AS "Rprec"',
    "bpref": "round(coalesce(sum(CASE WHEN misses = 0 THEN 1 ELSE 1 - least(misses, rel) / least(rel, nonrel) END) FILTER (WHERE hit) / nullif(rel, 0), 0), 9) AS bpref",
    "reciprocal_rank": "round(coalesce(1 / min(rank) FILTER (WHERE hit), 0), 9) AS recip_rank",
    "interpolated_precision": ", ".join(
        f'round(coalesce(max(hits / rank) FILTER (WHERE hit AND hits >= (rel * {k} + 9) // 10), 0), 9) AS {ranking.level_name(k)}'
        for k in ranking.LEVELS
    ),
    "trec_ndcg": "round(coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE hit) / nullif(ideal, 0), 0), 9) AS ndcg",
}


def _measure(name, columns):
    @query(name, with_inputs("ranking", f"SELECT doc_id, {MEASURES[name]} {DOC}", RUN))
    def _(spark, sf):
        lines = _lines(spark, sf)
        out = ranking.document_measures(run(lines), qrels(lines))
        if name == "retrieval_counts":
            return out.select("doc_id", *columns)
        return out.select("doc_id", *[round9(c).alias(c) for c in columns])


_measure("retrieval_counts", ranking.COUNTS)
_measure("precision_at_k", [f"P_{k}" for k in ranking.CUTOFFS])
_measure("average_precision", ["map"])
_measure("r_precision", ["Rprec"])
_measure("bpref", ["bpref"])
_measure("reciprocal_rank", ["recip_rank"])
_measure("interpolated_precision", [ranking.level_name(k) for k in ranking.LEVELS])
_measure("trec_ndcg", ["ndcg"])

ALL_MEASURES = ", ".join(MEASURES.values())
MEANS = ["map", "Rprec", "bpref", "recip_rank", *[ranking.level_name(k) for k in ranking.LEVELS],
         *[f"P_{k}" for k in ranking.CUTOFFS], "ndcg"]


@query("evaluation_report", with_inputs("ranking",
       "SELECT regexp_replace(measure, '^(iprec_at_recall_[01])_', '\\1.') AS measure, qid, value FROM (UNPIVOT overall ON COLUMNS(* EXCLUDE (qid)) INTO NAME measure VALUE value) UNION ALL "
       "SELECT regexp_replace(measure, '^(iprec_at_recall_[01])_', '\\1.'), qid, value FROM (UNPIVOT (SELECT CAST(doc_id AS VARCHAR) AS qid, CAST(COLUMNS(* EXCLUDE (doc_id)) AS DOUBLE) FROM per) "
       "ON COLUMNS(* EXCLUDE (qid)) INTO NAME measure VALUE value)",
       RUN + f", per AS MATERIALIZED (SELECT doc_id, {ALL_MEASURES} {DOC}), overall AS MATERIALIZED (SELECT 'all' AS qid, "
       "CAST(count(*) AS DOUBLE) AS num_q, " + ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in ranking.COUNTS)
       + ", round(exp(avg(ln(greatest(map, 0.00001)))), 7) AS gm_map, " + ", ".join(f'round(avg("{c}"), 7) AS "{c}"' for c in MEANS) + " FROM per)"))
def _(spark, sf):
    lines = _lines(spark, sf)
    out = ranking.evaluation_report(run(lines), qrels(lines))
    return out.withColumn("value", F.when(F.col("qid") == "all", round9("value", 7)).otherwise(round9("value")))
