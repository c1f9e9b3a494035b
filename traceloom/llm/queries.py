"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import abuse, codedoc, email, fusion, mixing, packing, splitting, tokens
from traceloom.plans.lineage import checkpoint
from traceloom.plans.tables import table

SCORES = ["vector_score", "bm25_score", "combined_score"]


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(table(spark, d, "candidates"), "req_id", "chunk_id", SCORES, zero_missing=("vector_score",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_of_each(_p1(spark, d), "req_id", "chunk_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.final_order(_p1(spark, d), "req_id", "chunk_id").select("req_id", "chunk_id", *[f"rank_{s}" for s in SCORES], "rrf", "position")


def _p3(spark: SparkSession, d: str, only_new: bool = True) -> DataFrame:
    mails = table(spark, d, "raw_chunks").filter(F.col("source_type") == "EMAIL")
    return email.new_lines(mails, "chunk_uid", only_new=only_new)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).select("chunk_uid", "line_no").distinct()


def p3_label_report(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each label the mails hold."""
    lines = _p3(spark, d, only_new=False).select("chunk_uid", "line_no", "label").distinct()
    return lines.groupBy("label").agg(F.count(F.lit(1)).alias("n_lines"))


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "raw_chunks"), "chunk_uid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select("chunk_uid").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).dropDuplicates(["chunk_uid", "piece_no"])


def _p5(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "python_elements").filter(F.col("element_type").isin("function", "class", "plain_text"))
    return codedoc.extract_pairs(elements, "element_row")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("element_row", "function_name").distinct()


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).dropDuplicates(["element_row", "function_name", "line_start"])


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    rows = table(spark, d, "pack_capacities").filter("container_kind is not null and capacity_tokens > 0").distinct().collect()
    return {r["container_kind"]: r["capacity_tokens"] for r in rows}  # settings, a row per kind


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = checkpoint(tokens.count_tokens(table(spark, d, "documents"), ["doc_id"], "text"))
    return packing.pack(sizes, _capacities(spark, d))


def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d), _capacities(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_share_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def _p10(spark: SparkSession, d: str, *also: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = abuse.fit_on_labels(docs, table(spark, d, "abuse_labels"))
    return abuse.score_documents(docs, model, also=also)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d).filter("found").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d).dropDuplicates(["doc_id"])


def p10_rate_report(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rate_report(_p10(spark, d, "source").dropDuplicates(["doc_id"]))


_P1_SQL = """
WITH m AS (SELECT req_id, chunk_id,
    max(CASE WHEN NOT isnan(vector_score) AND vector_score <> 0 THEN vector_score END) AS v,
    max(CASE WHEN NOT isnan(bm25_score) THEN bm25_score END) AS b,
    max(CASE WHEN NOT isnan(combined_score) THEN combined_score END) AS c
  FROM candidates WHERE req_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT req_id, chunk_id, coalesce(v, min(v) OVER w) AS v, coalesce(b, min(b) OVER w) AS b, coalesce(c, min(c) OVER w) AS c
  FROM m WINDOW w AS (PARTITION BY req_id)),
r AS (SELECT req_id, chunk_id,
    rank() OVER (PARTITION BY req_id ORDER BY v DESC NULLS LAST) AS rank_vector_score,
    rank() OVER (PARTITION BY req_id ORDER BY b DESC NULLS LAST) AS rank_bm25_score,
    rank() OVER (PARTITION BY req_id ORDER BY c DESC NULLS LAST) AS rank_combined_score FROM f),
t AS (SELECT *, round(1.0::DOUBLE / (60 + rank_vector_score) + 1.0::DOUBLE / (60 + rank_bm25_score) + 1.0::DOUBLE / (60 + rank_combined_score), 12) AS rrf FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY rrf DESC, chunk_id) AS position FROM t)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_ranking": p1_ranking,
    "p3_found": p3_found,
    "p3_label_report": p3_label_report,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p8_containers": p8_containers,
    "p8_fill_report": p8_fill_report,
    "p9_mixture": p9_mixture,
    "p9_share_report": p9_share_report,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rate_report": p10_rate_report,
}
SQL = {
    "p1_found": _P1_SQL + "SELECT req_id, chunk_id FROM o WHERE position = 1",
    "p1_ranking": _P1_SQL + "SELECT * FROM o",
    "p4_found": "SELECT DISTINCT chunk_uid FROM raw_chunks WHERE length(chunk_text) > 1500",
}
