"""The whole run: rules, classifier, confidence, stored correlations, matrix.

All requirements, evaluations and claims go through each step at once.  What supports a correlation is a table of its
own (correlation_id, chunk_id), so a requirement with any share of the evidence never becomes one long list; only what
the classifier reads about a pair is an array, of ``most_named`` + 1 texts at most.  What several later steps read is
stored once, in the shared folder.

Defined results: repeated rows count once (by ``seq``); a pair whose requirement has no text or does not exist is left out,
as is one the classifier gives no valid label; without requirements there is no matrix row, and evaluations
without a match stay as correlations of ``(unlinked)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.config import SETTINGS
from traceloom.functions.providers import Classifier, OverlapClassifier, classify
from traceloom.functions.text import chunk_id, round4
from traceloom.operators import correlate, matrix, store
from traceloom.plans.lineage import checkpoint

RULES = ("exact_requirement_id_match", "strong_semantic_match", "requirement_with_no_evidence")
STEP = 1 << 48  # correlations are in the order of their step, then of the row they come from


@dataclass
class Run:
    correlations: DataFrame  # seq, correlation_id, requirement_entity_id, evidence_entity_id, status, resolution_method, rule_name, rule_confidence, confidence, n_supporting, reasoning
    support: DataFrame  # correlation_id, chunk_id
    matrix: DataFrame | None


def chunk_texts(raw_chunks: DataFrame) -> DataFrame:
    """chunk_id, source_document, chunk_text: one row per chunk, its first; for ``chunks`` below."""
    rows = raw_chunks.filter("chunk_text is not null").select(chunk_id(F.col("source_hash"), F.col("chunk_index")).alias("chunk_id"), F.struct("chunk_uid", "source_document", "chunk_text").alias("_c"))
    return rows.groupBy("chunk_id").agg(F.min("_c").alias("_c")).select("chunk_id", "_c.source_document", "_c.chunk_text")


def evidence_block(position: Column, source: Column, score: Column, text: Column) -> Column:
    """What the classifier reads of one text: its number, source and score, then the whole text."""
    return F.format_string("[Evidence %d] source: %s, score: %.2f\n%s", position, F.coalesce(source, F.lit("unknown")), score, text)


def open_pairs(evidence: DataFrame, candidates: DataFrame, chunks: DataFrame, decided: DataFrame, orphans: DataFrame, most_named: int = correlate.MOST_NAMED, most_of_claim: int = 3) -> tuple[DataFrame, DataFrame]:
    """What the rules leave to the classifier: (pairs, items).

    Pairs: correlation_id, seq, requirement_entity_id, evidence_entity_id (the best candidate, else the evidence), text, rule_name.
    Items: correlation_id, position, chunk_id, source_document, score, text; the candidates of a pair, then its own evidence.
    """
    texts = correlate.requirements(evidence).select(F.col("requirement_id"), "text").filter("text <> ''")
    own = evidence.dropDuplicates(["seq"]).select("seq", "entity_id", "chunk_id", "source_document", F.col("text").alias("_text"))
    first = lambda step, seq: (F.lit(step * STEP) + seq).cast("bigint")

    named = decided.filter("rule_name = 'ambiguous_with_retrieval_evidence' and text <> ''").select(F.concat(F.lit("ambiguous:"), "requirement_id").alias("correlation_id"), F.lit(STEP).cast("bigint").alias("seq"), "requirement_id", "text", F.lit("ambiguous_with_retrieval_evidence").alias("rule_name"), F.lit(None).cast("string").alias("_entity"), F.lit(None).cast("bigint").alias("_row"))
    loose = orphans.filter("requirement_id is not null").join(texts, "requirement_id")
    loose = loose.select(F.concat(F.lit("orphan:"), F.col("seq").cast("string")).alias("correlation_id"), first(2, F.col("seq")).alias("seq"), "requirement_id", "text", F.lit("orphan_evaluation_with_candidate_req").alias("rule_name"), F.col("entity_id").alias("_entity"), F.col("seq").alias("_row"))
    said = correlate.verbal_claims(evidence).withColumnRenamed("linked_requirement", "requirement_id").join(texts, "requirement_id")
    said = said.select(F.concat(F.lit("claim:"), F.col("seq").cast("string")).alias("correlation_id"), first(3, F.col("seq")).alias("seq"), "requirement_id", "text", F.lit("verbal_claim_without_evidence").alias("rule_name"), F.col("entity_id").alias("_entity"), F.col("seq").alias("_row"))
    pairs = named.unionByName(loose).unionByName(said)

    best = correlate.best_of(candidates, max(most_named, most_of_claim))
    wanted = pairs.filter("rule_name <> 'orphan_evaluation_with_candidate_req'").select("correlation_id", "requirement_id", "rule_name").join(best, "requirement_id")
    claim = F.col("rule_name") == "verbal_claim_without_evidence"
    wanted = wanted.filter(F.when(claim, F.col("rank") <= most_of_claim).otherwise((F.col("rank") <= most_named) & (F.col("score") >= SETTINGS.no_evidence_floor)))
    seen = wanted.join(chunks, "chunk_id", "left").select("correlation_id", F.col("rank").alias("position"), "chunk_id", "source_document", "score", F.col("chunk_text").alias("text"))
    behind = pairs.filter("_row is not null").select("correlation_id", F.col("_row").alias("seq")).join(own, "seq")
    items = seen.unionByName(behind.select("correlation_id", F.lit(max(most_named, most_of_claim) + 1).alias("position"), "chunk_id", "source_document", F.lit(1.0).alias("score"), F.col("_text").alias("text")))
    top = seen.filter("position = 1").select("correlation_id", F.col("chunk_id").alias("_top"))
    pairs = pairs.join(top, "correlation_id", "left").withColumn("evidence_entity_id", F.coalesce("_top", "_entity"))
    return pairs.select("correlation_id", "seq", F.col("requirement_id").alias("requirement_entity_id"), "evidence_entity_id", "text", "rule_name"), items


def classified(pairs: DataFrame, items: DataFrame, factory: Callable[[], Classifier] = OverlapClassifier) -> DataFrame:
    """The pairs with the classifier's ``status``; those without a valid one are left out."""
    block = evidence_block(F.col("position"), F.col("source_document"), F.col("score"), F.col("text"))
    read = items.filter("text is not null").groupBy("correlation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x["b"]).alias("_blocks"))
    told = pairs.join(read, "correlation_id", "left").withColumn("status", classify(F.col("text"), F.col("_blocks"), factory))
    none = F.col("_blocks").isNull()
    return told.filter("status is not null").withColumn("evidence_entity_id", F.when(none, "(none)").otherwise(F.col("evidence_entity_id"))).drop("_blocks")


def run(evidence: DataFrame, candidates: DataFrame, chunks: DataFrame, factory: Callable[[], Classifier] | None = OverlapClassifier, run_id: str = "", with_matrix: bool = True) -> Run:
    """Rules, then the classifier for what they leave open (``factory=None``: rules alone), then confidence and the matrix.

    ``chunks``: chunk_id, source_document, chunk_text, one row per chunk.  Identifiers of correlations follow from what they join and ``run_id``.
    """
    decided = checkpoint(correlate.decided(evidence, candidates))
    orphans = checkpoint(correlate.orphan_evaluations(evidence))
    rows = evidence.dropDuplicates(["seq"])
    settled = decided.filter(F.col("rule_name").isin(*RULES))
    settled_id = F.concat(F.lit("rule:"), F.col("requirement_id"))
    exact, strong = F.col("rule_name") == RULES[0], F.col("rule_name") == RULES[1]
    believed = F.when(exact, F.when(F.col("n_eval") > 0, 0.95).otherwise(0.85)).when(strong, round4(F.least(F.col("best"), F.lit(1.0)))).otherwise(0.80)
    why = F.when(exact, F.format_string("%d implementation(s) name this requirement", "n_impl")).when(strong, F.format_string("the best chunk scores %.2f, %d chunk(s) are strong", "best", "n_strong")).otherwise(F.format_string("nothing names it and the best score is %.2f", "best"))
    rule = F.lit("deterministic_rule").alias("resolution_method")
    made = settled.select(settled_id.alias("correlation_id"), F.lit(0).cast("bigint").alias("seq"), F.col("requirement_id").alias("requirement_entity_id"), "evidence_entity_id", "status", rule, "rule_name", believed.alias("rule_confidence"), why.alias("reasoning"))
    alone = orphans.filter("requirement_id is null")
    alone_id = F.concat(F.lit("orphan:"), F.col("seq").cast("string"))
    made = made.unionByName(alone.select(alone_id.alias("correlation_id"), (F.lit(2 * STEP) + F.col("seq")).alias("seq"), F.lit("(unlinked)").alias("requirement_entity_id"), F.col("entity_id").alias("evidence_entity_id"), F.lit("EVALUATION_WITHOUT_REQUIREMENT").alias("status"), rule, F.lit("orphan_evaluation").alias("rule_name"), F.lit(0.80).alias("rule_confidence"), F.lit("no requirement is linked or shares its words").alias("reasoning")))

    named = rows.filter(F.col("entity_type").isin("IMPLEMENTATION", "EVALUATION") & (F.trim("linked_requirement") != "")).select(F.col("linked_requirement").alias("requirement_id"), "entity_type", "chunk_id")
    ruled = settled.filter(exact | strong).select(settled_id.alias("correlation_id"), "requirement_id", "rule_name")
    support = [
        ruled.join(named, "requirement_id").filter(exact | (F.col("entity_type") == "EVALUATION")).select("correlation_id", "chunk_id"),
        ruled.filter(strong).join(correlate.scored_pairs(candidates).filter(F.col("score") >= SETTINGS.high_score).withColumnRenamed("req_id", "requirement_id"), "requirement_id").select("correlation_id", "chunk_id"),
        alone.join(rows.select("seq", "chunk_id"), "seq").select(alone_id.alias("correlation_id"), "chunk_id"),
    ]
    if factory:
        pairs, items = open_pairs(evidence, candidates, chunks, decided, orphans)
        items = checkpoint(items)
        told = checkpoint(classified(pairs, items, factory))
        made = made.unionByName(told.select("correlation_id", "seq", "requirement_entity_id", "evidence_entity_id", "status", F.lit("llm_stage2").alias("resolution_method"), F.lit(None).cast("string").alias("rule_name"), F.lit(0.0).alias("rule_confidence"), F.concat(F.lit("classified: "), "rule_name").alias("reasoning")))
        support.append(items.select("correlation_id", "chunk_id").join(told.filter("evidence_entity_id <> '(none)'").select("correlation_id"), "correlation_id", "left_semi"))
    support_rows = checkpoint(reduce(DataFrame.unionByName, support).filter("chunk_id is not null"))
    sizes = support_rows.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n_supporting"))
    counted = made.join(sizes, "correlation_id", "left").na.fill(0, ["n_supporting"])
    scored = checkpoint(counted.join(correlate.rescore(counted, evidence, candidates, support_rows), "correlation_id"))
    if run_id:
        stamped = lambda df: df.withColumn("correlation_id", F.sha2(F.concat_ws(":", F.lit(run_id), "correlation_id"), 256))
        scored, support_rows = stamped(scored), stamped(support_rows)
    built = matrix.build(evidence, scored, candidates, chunks, support_rows) if with_matrix else None
    return Run(scored, support_rows, built)


def save(done: Run, path: str) -> None:
    """Appends a run's correlations and supporting rows to the stored tables; both are whole before a reader needs them together."""
    store.append(done.support, f"{path}/support")
    good, _ = store.split_valid_correlation(done.correlations)
    store.append(good, f"{path}/correlation")
