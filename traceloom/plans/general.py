"""Queries of the general data-preparation operators: timestamps, sessions, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.keys import person_key
from traceloom.functions.timestamps import normalise, union_all
from traceloom.operators.references import orphan_references, orphan_report
from traceloom.operators.sessions import sessionise
from traceloom.plans.tables import table

STAMPED = (("chat_messages", "msg_id", "timestamp", "loaded_at"), ("git_commits", "commit_row", "date", "loaded_at"), ("evidence", "seq", "timestamp", "created_at"))


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every timestamp with its instant, NULL where it is unreadable; one row per row key."""
    zones = table(spark, d, "ingestion_log").select("filename", "zone_name")
    parts = []
    for name, key, text, near in STAMPED:
        rows = table(spark, d, name).select(F.col(key).alias("row_id"), F.col(text).alias("written"), "source_document", F.col(near).alias("near"))
        made = normalise(rows, "written", "source_document", zones, near="near")
        parts.append(made.select(F.lit(name).alias("src_table"), "row_id", "written", "utc_micros").dropDuplicates(["src_table", "row_id"]))
    return union_all(parts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_instants(spark, d).filter("utc_micros is not null").select("src_table", "row_id", "utc_micros")


def p6_unreadable_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table: rows, readable ones, and those with a text that names no instant."""
    made = p6_instants(spark, d)
    filled = F.length(F.trim(F.col("written"))) > 0
    return made.groupBy("src_table").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("utc_micros").alias("n_readable"), F.count_if(filled & F.col("utc_micros").isNull()).alias("n_unreadable")
    )


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each sender within one chat export."""
    chat = table(spark, d, "chat_messages").select("msg_id", "source_document", "sender", "timestamp", "loaded_at", "is_media", "is_system", "message_text")
    zones = table(spark, d, "ingestion_log").select("filename", "zone_name")
    made = normalise(chat, "timestamp", "source_document", zones, near="loaded_at")
    counted = made.filter((~F.col("is_media")) & (~F.col("is_system")) & F.col("message_text").rlike(r"(?U)[^\s\p{Z}\p{Cf}\p{Cc}]") & F.col("utc_micros").isNotNull())
    keyed = counted.select("source_document", person_key(F.col("sender")).alias("sender"), "utc_micros", "msg_id")
    return sessionise(keyed, ["source_document", "sender"], "utc_micros", "msg_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_sessions(spark, d).select(F.col("first_id").alias("first_msg_id"), F.col("last_id").alias("last_msg_id"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    ev, co = table(spark, d, "evidence"), table(spark, d, "correlation")
    ref = lambda df, name, field, kind: df.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col("seq").alias("ref_seq"), F.lit(kind).alias("kind"), F.col(field).alias("target"), "created_at")
    refs = union_all([ref(ev, "evidence", "linked_requirement", "requirement"), ref(co, "correlation", "requirement_entity_id", "requirement"), ref(co, "correlation", "evidence_entity_id", "artifact")])
    kind = F.when(F.col("entity_type") == "REQUIREMENT", "requirement").when(F.col("entity_type").isin("IMPLEMENTATION", "EVALUATION"), "artifact")
    from traceloom.functions.keys import id_key

    keys = F.when(kind == "artifact", F.array("entity_id", "chunk_id")).otherwise(F.array("entity_id"))
    parents = ev.filter(kind.isNotNull()).select(kind.alias("kind"), F.explode(keys).alias("target"), F.col("entity_id").alias("entity"), "created_at")
    parents = parents.withColumn("key", id_key(F.col("target"))).filter("key is not null").drop("target")
    return orphan_references(refs, parents, table(spark, d, "deleted_entities"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("ref_table", "ref_field", "ref_seq", "reason")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_p7(spark, d))


_P7_SQL = r"""
WITH refs AS (
  SELECT DISTINCT 'evidence' AS ref_table, 'linked_requirement' AS ref_field, seq AS ref_seq, 'requirement' AS kind, linked_requirement AS target, created_at FROM evidence
  UNION ALL SELECT DISTINCT 'correlation', 'requirement_entity_id', seq, 'requirement', requirement_entity_id, created_at FROM correlation
  UNION ALL SELECT DISTINCT 'correlation', 'evidence_entity_id', seq, 'artifact', evidence_entity_id, created_at FROM correlation),
keyed AS (SELECT *, lower(trim(target, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS k FROM refs WHERE target IS NOT NULL),
asked AS (SELECT * FROM keyed WHERE k <> '' AND k NOT IN ('(none)', '(unlinked)', '(unknown)', 'none', 'null', 'n/a', '-', 'unknown', 'unlinked')),
gone AS (SELECT lower(trim(entity_id)) AS e, max(deleted_at) AS deleted_at FROM deleted_entities GROUP BY 1),
rows_ AS (SELECT CASE WHEN entity_type = 'REQUIREMENT' THEN 'requirement' ELSE 'artifact' END AS kind, lower(trim(entity_id)) AS k, lower(trim(entity_id)) AS e, created_at FROM evidence
  UNION ALL SELECT 'artifact', lower(trim(chunk_id)), lower(trim(entity_id)), created_at FROM evidence WHERE entity_type <> 'REQUIREMENT'),
par AS (SELECT kind, k, min(CASE WHEN deleted_at IS NULL OR deleted_at <= created_at THEN created_at END) AS valid_from FROM rows_ LEFT JOIN gone USING (e) GROUP BY 1, 2),
judged AS (SELECT ref_table, ref_field, ref_seq, asked.created_at,
  CASE WHEN par.k IS NULL THEN 'missing' WHEN valid_from IS NULL THEN 'deleted' WHEN valid_from > asked.created_at THEN 'late' END AS reason
  FROM asked LEFT JOIN par ON par.kind = asked.kind AND par.k = asked.k)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_sessions": p2_sessions,
    "p6_found": p6_found,
    "p6_unreadable_report": p6_unreadable_report,
    "p7_found": p7_found,
    "p7_report": p7_report,
}
SQL = {
    "p7_found": _P7_SQL + "SELECT ref_table, ref_field, ref_seq, reason FROM judged WHERE reason IS NOT NULL",
    "p7_report": _P7_SQL + "SELECT ref_table, ref_field, strftime(created_at, '%Y-%m') AS month, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
