"""The traceability matrix and its summaries.

A requirement has one row per requirement row (duplicates of the whole row count once); its best correlation is the
one of highest confidence, the first stored among equals.  Aggregates find it, no sort does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.config import STATUS_COLOURS
from traceloom.operators.correlate import best_of, chunk_documents, listed_support

IMPLEMENTED = ("IMPLEMENTED_AND_VALIDATED", "IMPLEMENTED_WITHOUT_EVALUATION", "IMPLEMENTED_BUT_NEGATIVELY_EVALUATED")


def best_correlations(correlation: DataFrame) -> DataFrame:
    """Per requirement the correlation of highest confidence, then of lowest ``seq``; needs ``n_supporting`` or the lists of a stored table."""
    if "n_supporting" not in correlation.columns:
        correlation = correlation.withColumn("n_supporting", F.greatest(F.coalesce(F.size("supporting_chunk_ids"), F.lit(0)), F.lit(0)))
    kept = ["correlation_id", "status", "resolution_method", "rule_name", "confidence", "reasoning", "n_supporting"]
    value = F.struct((-F.col("confidence")).alias("_c"), "seq", *kept)
    best = correlation.filter("requirement_entity_id is not null").groupBy("requirement_entity_id").agg(F.min(value).alias("_b"))
    return best.select("requirement_entity_id", *[f"_b.{c}" for c in kept])


def documents_of(best: DataFrame, support: DataFrame, evidence: DataFrame, candidates: DataFrame | None, chunks: DataFrame | None, most: int) -> DataFrame:
    """requirement_entity_id, source_document: distinct documents behind the best correlation's chunks and the ``most`` best candidates.

    A candidate's document is that of its chunk (``chunks``: chunk_id, source_document), else that of the evidence taken from it.
    """
    known = chunk_documents(evidence)
    rows = best.select("requirement_entity_id", "correlation_id").join(support.select("correlation_id", "chunk_id"), "correlation_id").join(known, "chunk_id").select("requirement_entity_id", "source_document")
    if candidates is not None and most:
        theirs = best_of(candidates, most).select(F.col("requirement_id").alias("requirement_entity_id"), "chunk_id")
        if chunks is not None:
            own = chunks.groupBy("chunk_id").agg(F.min("source_document").alias("_own"))
            theirs = theirs.join(own, "chunk_id", "left").join(known, "chunk_id", "left").withColumn("source_document", F.coalesce("_own", "source_document"))
        else:
            theirs = theirs.join(known, "chunk_id")
        rows = rows.unionByName(theirs.select("requirement_entity_id", "source_document"))
    return rows.filter("source_document is not null").distinct()


def build(evidence: DataFrame, correlation: DataFrame, candidates: DataFrame | None = None, chunks: DataFrame | None = None, support: DataFrame | None = None, candidate_documents: int = 3) -> DataFrame:
    """requirement_id, requirement_text, status, confidence, evidence_count, source_documents, reasoning, resolution_method, colour.

    Source documents are those of the best correlation's chunks and of the ``candidate_documents`` best candidates.  ``support``
    (correlation_id, chunk_id) replaces the lists of a stored table.
    """
    wanted = evidence.filter(F.col("entity_type") == "REQUIREMENT").dropDuplicates(["seq"]).select(F.col("entity_id").alias("requirement_id"), F.col("text").alias("requirement_text"), "seq")
    best = best_correlations(correlation)
    named = documents_of(best, listed_support(correlation) if support is None else support, evidence, candidates, chunks, candidate_documents)
    documents = named.groupBy(F.col("requirement_entity_id").alias("_documents_of")).agg(F.array_sort(F.collect_list("source_document")).alias("source_documents"))
    rows = wanted.join(best, F.col("requirement_id") == F.col("requirement_entity_id"), "left").join(documents, F.col("requirement_id") == F.col("_documents_of"), "left")
    n = F.coalesce("n_supporting", F.lit(0))
    if candidates is not None:
        counts = candidates.groupBy(F.col("req_id").alias("requirement_id")).agg(F.count_distinct("chunk_id").alias("_n"))
        rows = rows.join(counts, "requirement_id", "left")
        n = F.greatest(n, F.coalesce("_n", F.lit(0)))
    status = F.coalesce("status", F.lit("REQUIREMENT_NOT_IMPLEMENTED"))
    colours = F.create_map(*[F.lit(x) for pair in STATUS_COLOURS.items() for x in pair])
    return rows.select(
        "requirement_id", "seq", "requirement_text", status.alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), n.cast("bigint").alias("evidence_count"),
        F.coalesce("source_documents", F.array().cast("array<string>")).alias("source_documents"), F.coalesce("reasoning", F.lit("No correlation computed.")).alias("reasoning"),
        F.coalesce("resolution_method", F.lit("none")).alias("resolution_method"), F.try_element_at(colours, status).alias("colour"),
    )


def load_latest(evidence: DataFrame, correlation: DataFrame) -> DataFrame:
    """The matrix from the stored correlations of each requirement's latest moment, without candidates."""
    return build(evidence, latest(correlation))


def status_distribution(matrix: DataFrame) -> DataFrame:
    n = matrix.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))  # seven statuses


def coverage_by_source(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.explode("source_documents").alias("source_document")).groupBy("source_document").agg(F.count(F.lit(1)).alias("n_requirements"))


def summary(matrix: DataFrame) -> DataFrame:
    """One row; an empty matrix gives zeros."""
    done = F.col("status").isin(*IMPLEMENTED)
    one = matrix.agg(
        F.count(F.lit(1)).alias("total_requirements"),
        F.count_if(done).alias("implemented"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("average_confidence"),
        F.count_if(F.col("resolution_method") == "deterministic_rule").alias("deterministic"),
        F.count_if(F.col("resolution_method") == "llm_stage2").alias("classified"),
    )
    return one.withColumn("coverage_percent", F.round(F.coalesce(F.col("implemented") * 100.0 / F.nullif("total_requirements", F.lit(0)), F.lit(0.0)), 1))


def latest(correlation: DataFrame, unit: str = "second") -> DataFrame:
    """All correlations of a requirement's latest moment, ties included; ``unit`` is the resolution of the store."""
    moment = F.date_trunc(unit, "created_at")
    last = correlation.groupBy("requirement_entity_id").agg(F.max(moment).alias("_at"))
    rows = correlation.withColumn("_moment", moment)
    return rows.join(last.hint("merge"), "requirement_entity_id").filter("_moment = _at").drop("_moment", "_at")


def filtered(matrix: DataFrame, statuses: list[str] | None = None, least_confidence: float = 0.0) -> DataFrame:
    kept = matrix.filter(F.col("confidence") >= least_confidence)
    return kept.filter(F.col("status").isin(*statuses)) if statuses else kept


def export(matrix: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes the matrix as CSV (lists joined by ``; ``) or JSON lines, sorted by requirement."""
    rows = matrix.orderBy("requirement_id", "seq")
    if kind == "csv":
        rows.withColumn("source_documents", F.array_join("source_documents", "; ")).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)
