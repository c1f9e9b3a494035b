"""Correlating requirements with evidence: one pass over requirements with pre-aggregated evidence.

What many rows say about a requirement is reduced to flags, counts and firsts before it meets the requirement, so a
requirement with any share of the rows stays one row.  Supporting chunks are rows of their own table (``trace.run``).
Order of decision: a linked implementation, a strong retrieval score, no score worth naming, else
undecided.  Duplicated rows count once (by ``seq``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.config import SETTINGS
from traceloom.functions.text import is_claim, is_negative, is_positive, round4, word_set
from traceloom.operators.blocks import Postings, best_target

# How far a method and a status are believed.
METHOD_WEIGHT = {"deterministic_rule": 1.0, "llm_stage2": 0.7}
STATUS_FACTOR = {
    "IMPLEMENTED_AND_VALIDATED": 1.0,
    "IMPLEMENTED_WITHOUT_EVALUATION": 0.9,
    "PARTIALLY_IMPLEMENTED": 0.85,
    "IMPLEMENTED_BUT_NEGATIVELY_EVALUATED": 0.85,
    "REQUIREMENT_NOT_IMPLEMENTED": 0.8,
    "CLAIMED_BUT_NO_EVIDENCE": 0.7,
    "EVALUATION_WITHOUT_REQUIREMENT": 0.75,
}


MOST_NAMED = 5  # candidates that an open requirement takes to the classifier (the reference's number; a parameter everywhere)


def best_of(candidates: DataFrame, most: int, least: float | None = None) -> DataFrame:
    """requirement_id, chunk_id, score, rank of each requirement's ``most`` best candidates, those below ``least`` left out."""
    pair = scored_pairs(candidates)
    pair = pair if least is None else pair.filter(F.col("score") >= least)
    order = Window.partitionBy("req_id").orderBy(F.desc("score"), "chunk_id")
    return pair.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(F.col("req_id").alias("requirement_id"), "chunk_id", "score", "rank")


def linked(evidence: DataFrame) -> DataFrame:
    """Per linked requirement: counts, the first implementation, and whether its evaluations are good or bad."""
    rows = evidence.dropDuplicates(["seq"]).filter(F.col("linked_requirement").isNotNull() & (F.trim("linked_requirement") != ""))
    impl, ev = F.col("entity_type") == "IMPLEMENTATION", F.col("entity_type") == "EVALUATION"
    return rows.groupBy(F.col("linked_requirement").alias("requirement_id")).agg(
        F.count_if(impl).alias("n_impl"),
        F.count_if(ev).alias("n_eval"),
        F.min(F.when(impl, F.struct("seq", "entity_id")))["entity_id"].alias("first_impl"),
        F.coalesce(F.bool_or(ev & is_positive(F.col("text"))), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(ev & is_negative(F.col("text"))), F.lit(False)).alias("bad"),
    )


def requirements(evidence: DataFrame) -> DataFrame:
    """One row per requirement id, its first text."""
    rows = evidence.filter(F.col("entity_type") == "REQUIREMENT")
    return rows.groupBy(F.col("entity_id").alias("requirement_id")).agg(F.min(F.struct("seq", F.col("text").alias("text"), F.col("chunk_id").alias("chunk_id"))).alias("_f")).select("requirement_id", F.col("_f.seq").alias("seq"), F.col("_f.text").alias("text"), F.col("_f.chunk_id").alias("chunk_id"))


def scored_pairs(candidates: DataFrame) -> DataFrame:
    """req_id, chunk_id and the best score of the pair; candidates without a score (NaN, null) are left out."""
    return candidates.filter(~F.isnan("combined_score") & F.col("combined_score").isNotNull()).groupBy("req_id", "chunk_id").agg(F.max("combined_score").alias("score"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Per requirement the best score, its chunk, and how many candidates are strong or worth naming."""
    s = SETTINGS
    pair = scored_pairs(candidates)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c")))
    return pair.groupBy(F.col("req_id").alias("requirement_id")).agg((-best["s"]).alias("best_score"), best["c"].alias("best_chunk"), F.count_if(F.col("score") >= s.high_score).alias("n_strong"), F.count_if(F.col("score") >= s.no_evidence_floor).alias("n_named"))


def decide(evidence: DataFrame, candidates: DataFrame, most_named: int = MOST_NAMED) -> DataFrame:
    """requirement_id, rule_name, status (NULL: for the classifier), evidence_entity_id, best_score, n_supporting.

    An open requirement goes to the classifier with its ``most_named`` best candidates; that is what counts as its support.
    """
    return decided(evidence, candidates, most_named).select("requirement_id", "rule_name", "status", "evidence_entity_id", "best_score", "n_supporting")


def decided(evidence: DataFrame, candidates: DataFrame, most_named: int = MOST_NAMED) -> DataFrame:
    """``decide`` with the requirement's text, its unrounded best score and what was counted."""
    s = SETTINGS
    known = requirements(evidence).select("requirement_id", "text").join(linked(evidence), "requirement_id", "left").join(best_candidates(candidates), "requirement_id", "left")
    best, n_impl, n_eval = F.coalesce("best_score", F.lit(0.0)), F.coalesce("n_impl", F.lit(0)), F.coalesce("n_eval", F.lit(0))
    rule = (
        F.when(n_impl > 0, "exact_requirement_id_match")
        .when(best >= s.high_score, "strong_semantic_match")
        .when(best < s.no_evidence_floor, "requirement_with_no_evidence")
        .otherwise("ambiguous_with_retrieval_evidence")
    )
    verdict = F.when((n_eval > 0) & F.col("bad"), "IMPLEMENTED_BUT_NEGATIVELY_EVALUATED").when((n_eval > 0) & F.col("good"), "IMPLEMENTED_AND_VALIDATED").otherwise("IMPLEMENTED_WITHOUT_EVALUATION")
    name = F.col("rule_name")
    out = known.withColumn("rule_name", rule)
    status = F.when(name.isin("exact_requirement_id_match", "strong_semantic_match"), verdict).when(name == "requirement_with_no_evidence", "REQUIREMENT_NOT_IMPLEMENTED")
    target = F.when(name == "exact_requirement_id_match", F.col("first_impl")).when(name == "strong_semantic_match", F.col("best_chunk")).otherwise("(none)")
    support = F.when(name == "exact_requirement_id_match", n_impl + n_eval).when(name == "strong_semantic_match", F.coalesce("n_strong", F.lit(0)) + n_eval).when(name == "requirement_with_no_evidence", 0).otherwise(F.least(F.coalesce("n_named", F.lit(0)), F.lit(most_named)))
    return out.select(
        "requirement_id", "text", "rule_name", status.alias("status"), target.alias("evidence_entity_id"), F.round(best, 6).alias("best_score"), support.cast("bigint").alias("n_supporting"),
        best.alias("best"), n_impl.alias("n_impl"), n_eval.alias("n_eval"), F.coalesce("n_strong", F.lit(0)).alias("n_strong"),
    )


def _overlap(targets: Postings, rows: pa.RecordBatch) -> np.ndarray:
    words = rows.column(1)
    shared = targets.sums(words, None, rows.num_rows)
    return shared / np.maximum(1, np.diff(words.offsets.to_numpy()))[None, :]


def orphan_evaluations(evidence: DataFrame) -> DataFrame:
    """Evaluations without a link: the requirement whose words they share most, the first of equals, if that is enough; else NULL.

    Requirements go out in blocks by word, so an evaluation meets those alone that share a word, where it lies.
    """
    rows = evidence.dropDuplicates(["seq"])
    loose = rows.filter((F.col("entity_type") == "EVALUATION") & (F.col("linked_requirement").isNull() | (F.trim("linked_requirement") == "")))
    words = loose.select(F.col("seq").alias("row_id"), word_set(F.col("text")).alias("words")).filter(F.size("words") > 0)
    targets = requirements(evidence).select(F.col("requirement_id").alias("target_id"), "seq", word_set(F.col("text")).alias("words")).filter(F.size("words") > 0)
    best = best_target(words, targets, lambda block: Postings(list(block["words"])), _overlap, "seq", SETTINGS.min_word_overlap)
    named = best.select(F.col("row_id").alias("seq"), F.col("target_id").alias("requirement_id"), F.round("score", 6).alias("overlap"))
    return loose.select("seq", "entity_id").join(named, "seq", "left")


def verbal_claims(evidence: DataFrame) -> DataFrame:
    """Implementations that only a conversation claims."""
    rows = evidence.dropDuplicates(["seq"]).filter(F.col("entity_type") == "IMPLEMENTATION")
    return rows.filter(is_claim(F.col("text"), F.col("source_document"))).select("seq", "entity_id", "linked_requirement", "source_document")


def confidence(best: Column, method: Column, n: Column, n_sources: Column, status: Column) -> Column:
    """Weighted score, method, evidence count and diversity of sources, times how far the status is believed; 4 places."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    wr, wm, we, wd = SETTINGS.confidence_weights
    r = F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0))
    e = F.when(n == 0, 0.0).when(n == 1, 0.5).otherwise(F.least(F.lit(1.0), F.log(n + 1) / F.log(F.lit(6.0))))
    d = F.least(F.lit(1.0), n_sources / 3.0)
    raw = wr * r + wm * F.coalesce(F.try_element_at(table(METHOD_WEIGHT), method), F.lit(0.5)) + we * e + wd * d
    return round4(F.least(raw * F.coalesce(F.try_element_at(table(STATUS_FACTOR), status), F.lit(0.8)), F.lit(1.0)))


def chunk_documents(evidence: DataFrame) -> DataFrame:
    """The document of each chunk that holds evidence, by its last row."""
    return evidence.filter("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("seq", "source_document"))["source_document"].alias("source_document"))


def listed_support(correlation: DataFrame) -> DataFrame:
    """correlation_id, chunk_id: the supporting chunks that stored correlations list, each once per correlation."""
    return correlation.select("correlation_id", F.explode(F.array_distinct("supporting_chunk_ids")).alias("chunk_id"))


def support_of(support: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per correlation the supporting chunks that hold evidence, and their distinct documents; ``support``: correlation_id, chunk_id."""
    return support.select("correlation_id", "chunk_id").distinct().join(chunk_documents(evidence), "chunk_id").groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source_document").alias("n_sources"))


def rescore(correlation: DataFrame, evidence: DataFrame, candidates: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """correlation_id and its formula confidence.

    Counts come from the requirement's candidates, else from supporting rows, else from the chunks listed.  ``support`` replaces the
    lists (``supporting_chunk_ids``) of stored correlations; the number listed is then the column ``n_supporting``.
    """
    rows = correlation.dropDuplicates(["correlation_id"])
    pairs = candidates.filter("req_id is not null").select(F.col("req_id").alias("requirement_entity_id"), "chunk_id").distinct()
    wide = pairs.join(chunk_documents(evidence), "chunk_id", "left").groupBy("requirement_entity_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("source_document").alias("candidate_sources"))
    best = best_candidates(candidates).select(F.col("requirement_id").alias("requirement_entity_id"), "best_score")
    joined = rows.join(support_of(listed_support(rows) if support is None else support, evidence), "correlation_id", "left").join(best, "requirement_entity_id", "left").join(wide, "requirement_entity_id", "left")
    listed = F.greatest(F.coalesce(F.size("supporting_chunk_ids"), F.lit(0)), F.lit(0)) if support is None else F.col("n_supporting")
    n = F.coalesce("n_candidates", "n_rows", listed)
    sources = F.coalesce("candidate_sources", "n_sources", F.lit(0))
    return joined.select("correlation_id", confidence(F.coalesce("best_score", F.lit(0.0)), F.col("resolution_method"), n, sources, F.col("status")).alias("confidence"))
