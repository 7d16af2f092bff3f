"""Ranking evaluation. ``run(doc_id, entity_id, score)`` against ``qrels(doc_id, entity_id, grade)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standout.functions.ordering import ordinal, running
from standout.session import stored

CUTOFFS = (1, 2, 3, 4, 5, 10, 15, 20, 30, 100, 200, 500, 1000)
LEVELS = tuple(range(11))  # tenths of recall
GEOMETRIC_FLOOR = 1e-5
COUNTS = ["num_ret", "num_rel", "num_rel_ret"]


def level_name(tenths: int) -> str:
    """Column name of a recall level; the report writes it with a point."""
    return f"iprec_at_recall_{tenths // 10}_{tenths % 10}0"


def rank_entities(scores: DataFrame) -> DataFrame:
    """Rank by score descending inside each document; a missing score is 0, ties go by entity id."""
    clean = scores.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    return ordinal(clean, ["doc_id"], F.col("score"), F.col("entity_id"), "rank")


def _steep_discount(rank: Column | str = "rank") -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.when(rank == 1, 1.0).otherwise(1.0 / F.log2(F.greatest(rank, F.lit(2)).cast("double")))


def _gained(scores: DataFrame, golden: DataFrame, binary: bool) -> DataFrame:
    judged = golden.select("doc_id", "entity_id", F.lit(True).alias("judged"))
    rows = rank_entities(scores).join(judged, ["doc_id", "entity_id"], "left")
    value = (F.col("score") > 0).cast("double") if binary else F.col("score")
    gain = F.when(F.col("judged"), (F.pow(F.lit(2.0), value) - 1) * _steep_discount())
    return rows.withColumn("gain", F.coalesce(gain, F.lit(0.0)))


def salience_ndcg(
    scores: DataFrame, golden: DataFrame, max_score: float = 3.0, binary: bool = False
) -> DataFrame:
    """Per document the share of the best possible gain at the ranks of its judged entities.

    The gain comes from the model's score; unjudged entities use up ranks but gain nothing.
    """
    rows = _gained(scores, golden, binary)
    best = F.when(F.col("judged"), (2.0**max_score - 1) * _steep_discount()).otherwise(0.0)
    out = rows.groupBy("doc_id").agg(F.sum("gain").alias("dcg"), F.sum(best).alias("best_dcg"))
    return out.withColumn("ndcg", F.when(F.col("best_dcg") != 0, F.col("dcg") / F.col("best_dcg")).otherwise(0.0))


def dcg_curve(scores: DataFrame, golden: DataFrame, binary: bool = False) -> DataFrame:
    """Cumulative gain at each rank."""
    rows = _gained(scores, golden, binary)
    return running(rows, ["doc_id"], "rank", {"dcg": F.col("gain")}).select("doc_id", "rank", "entity_id", "dcg")


def ideal_dcg(golden: DataFrame) -> DataFrame:
    """The same cumulative gain for the golden grades themselves; the last one is the total."""
    rows = golden.select("doc_id", "entity_id", F.col("grade").alias("score"))
    ranked = rank_entities(rows)
    gain = (F.pow(F.lit(2.0), F.col("score")) - 1) * _steep_discount()
    return running(ranked, ["doc_id"], "rank", {"dcg": gain}).select("doc_id", "rank", "entity_id", "dcg")


def judged_run(run: DataFrame, qrels: DataFrame, relevant: float = 2.0) -> DataFrame:
    """Ranked rows of documents with judgements: grade, relevance, and running judged counts.

    Only documents of both inputs are evaluated.
    """
    judged_docs = qrels.select("doc_id").distinct()
    evaluated = run.join(judged_docs, "doc_id", "left_semi").select("doc_id", "entity_id", "score")
    ranked = rank_entities(evaluated)
    rows = ranked.join(qrels.select("doc_id", "entity_id", "grade"), ["doc_id", "entity_id"], "left")
    hit, miss = F.col("grade") >= relevant, F.col("grade") < relevant
    rows = rows.withColumns({"hit": F.coalesce(hit, F.lit(False)), "miss": F.coalesce(miss, F.lit(False))})
    return running(
        rows, ["doc_id"], "rank", {"hits": F.col("hit").cast("long"), "misses": F.col("miss").cast("long")}
    )


def qrels_totals(qrels: DataFrame, relevant: float = 2.0) -> DataFrame:
    """Per document the judged totals and the ideal linear gain."""
    ranked = rank_entities(qrels.select("doc_id", "entity_id", F.col("grade").alias("score")))
    kept = F.when(F.col("score") >= relevant, F.col("score")).otherwise(0.0)
    return ranked.groupBy("doc_id").agg(
        F.count_if(F.col("score") >= relevant).alias("num_rel"),
        F.count_if(F.col("score") < relevant).alias("num_nonrel"),
        F.sum(kept / F.log2(F.col("rank") + 1.0)).alias("ideal"),
    )


def document_measures(
    run: DataFrame,
    qrels: DataFrame,
    relevant: float = 2.0,
    cutoffs: Sequence[int] = CUTOFFS,
    totals: DataFrame | None = None,
) -> DataFrame:
    """All measures, one row per evaluated document, from one pass over the ranked rows.

    ``totals`` are the ``qrels_totals``, where many runs are measured against the same judgements.
    """
    totals = qrels_totals(qrels, relevant) if totals is None else totals
    rows = judged_run(run, qrels, relevant).join(totals, "doc_id")
    hit, rank, hits, misses = F.col("hit"), F.col("rank"), F.col("hits"), F.col("misses")
    rel, nonrel = F.col("num_rel"), F.col("num_nonrel")
    precision = hits / rank
    above = F.least(misses, rel) / F.least(rel, nonrel)
    preference = F.when(misses == 0, 1.0).otherwise(1.0 - above)
    levels = {level_name(k): F.floor((rel * k + 9) / 10) for k in LEVELS}
    gain = F.when(hit, F.col("grade")).otherwise(0.0) / F.log2(rank + 1.0)
    out = rows.groupBy("doc_id").agg(
        F.count("*").alias("num_ret"),
        F.max("num_rel").alias("num_rel"),
        F.count_if(hit).alias("num_rel_ret"),
        F.sum(F.when(hit, precision).otherwise(0.0)).alias("_ap"),
        F.count_if(hit & (rank <= rel)).alias("_top"),
        F.sum(F.when(hit, preference).otherwise(0.0)).alias("_pref"),
        F.coalesce(1.0 / F.min(F.when(hit, rank)), F.lit(0.0)).alias("recip_rank"),
        *[F.coalesce(F.max(F.when(hit & (hits >= need), precision)), F.lit(0.0)).alias(n) for n, need in levels.items()],
        *[(F.count_if(hit & (rank <= k)) / k).alias(f"P_{k}") for k in cutoffs],
        F.sum(gain).alias("_gain"),
        F.max("ideal").alias("_ideal"),
    )

    def share(part: str) -> Column:
        return F.when(F.col("num_rel") > 0, F.col(part) / F.col("num_rel")).otherwise(0.0)

    return out.select(
        "doc_id",
        *COUNTS,
        share("_ap").alias("map"),
        share("_top").alias("Rprec"),
        share("_pref").alias("bpref"),
        "recip_rank",
        *levels,
        *[f"P_{k}" for k in cutoffs],
        F.when(F.col("_ideal") > 0, F.col("_gain") / F.col("_ideal")).otherwise(0.0).alias("ndcg"),
    )


def evaluation_report(
    run: DataFrame, qrels: DataFrame, relevant: float = 2.0, per_document: bool = True
) -> DataFrame:
    """``measure, qid, value`` for every document and for qid ``all``.

    The documents' measures are made once and stored in one row each; they are turned into rows of the report without a
    shuffle, and the whole is one aggregate over them. Over all documents counts are summed and other measures averaged;
    ``gm_map`` and the number of documents exist there only.
    """
    documents = stored(document_measures(run, qrels, relevant), "measures")
    names = [c for c in documents.columns if c != "doc_id"]
    wide = documents.select(
        F.col("doc_id").cast("string").alias("qid"),
        *[F.col(c).cast("double").alias(c) for c in names],
    )
    means = [(F.sum(c) if c in COUNTS else F.avg(c)).alias(c) for c in names]
    log_map = F.log(F.greatest("map", F.lit(GEOMETRIC_FLOOR)))
    whole = wide.agg(F.lit("all").alias("qid"), *means, F.sum(F.lit(1.0)).alias("num_q"), F.exp(F.avg(log_map)).alias("gm_map"))
    # without any document there is nothing to report
    out = whole.where("num_q IS NOT NULL").unpivot(["qid"], [*names, "num_q", "gm_map"], "measure", "value")
    if per_document:
        out = wide.unpivot(["qid"], names, "measure", "value").unionByName(out)
    measure = F.regexp_replace("measure", "^(iprec_at_recall_[01])_", "$1.")
    return out.select(measure.alias("measure"), "qid", "value")
