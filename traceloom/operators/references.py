"""References to records that do not exist: missing, deleted or later than what refers to them.

References and parents are partitioned by the same key, sorted and merged once (a sort-merge
join).  Parents are first reduced to one interval summary per key: whether any row
exists, and the earliest creation among the rows that were not deleted afterwards.  A reference then
needs that one row only.  Parents shuffle pre-aggregated, so hot parents cost nothing; hot references
are split by adaptive execution (``spark.sql.adaptive.skewJoin``), each part against one row.

Defined results: null, blank and placeholder references are none; keys differ neither by letter
case nor outer white space; repeated rows count once; a parent without creation time exists but
is never late; a reference without time can be missing or deleted, never late; with an empty parent table every
reference is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.keys import id_key

# What stands for "no reference".
PLACEHOLDERS = ("(none)", "(unlinked)", "(unknown)", "none", "null", "n/a", "-", "unknown", "unlinked")


def parent_intervals(parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """``parents``: kind, key, entity, created_at. One row per (kind, key): the earliest creation of a row still valid.

    A row is void if its entity was deleted after it was created; the last deletion per entity decides that.
    """
    last = deletions.select(id_key(F.col("entity_id")).alias("_entity"), "deleted_at").filter("_entity is not null").groupBy("_entity").agg(F.max("deleted_at").alias("_deleted"))
    rows = parents.select("kind", "key", "created_at", id_key(F.col("entity")).alias("_entity")).join(last, "_entity", "left")
    valid = ~F.coalesce(F.col("_deleted") > F.col("created_at"), F.lit(False))
    start = F.coalesce(F.unix_micros("created_at"), F.lit(-(2**62)))
    return rows.groupBy("kind", "key").agg(F.min(F.when(valid, start)).alias("valid_from"))


def orphan_references(references: DataFrame, parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """``references``: ref_table, ref_field, ref_seq, kind, target, created_at.  Returns the faulty ones with a reason."""
    refs = references.select("ref_table", "ref_field", "ref_seq", "kind", "created_at", id_key(F.col("target")).alias("key")).filter(F.col("key").isNotNull() & ~F.col("key").isin(*PLACEHOLDERS))
    intervals = parent_intervals(parents, deletions)
    found = refs.join(intervals.withColumn("_found", F.lit(True)).hint("merge"), ["kind", "key"], "left")
    reason = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("valid_from").isNull(), "deleted")
        .when(F.col("valid_from") > F.unix_micros("created_at"), "late")
    )
    return found.withColumn("reason", reason).filter("reason is not null").select("ref_table", "ref_field", "ref_seq", "key", "created_at", "reason").dropDuplicates(["ref_table", "ref_field", "ref_seq"])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Faulty references counted per table, field, month of creation and reason; a null month is kept."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    return orphans.groupBy("ref_table", "ref_field", month, "reason").agg(F.count(F.lit(1)).alias("n"))
