"""Tables on Parquet with the store's mutations: insert if absent, replace, upsert, append, delete.

Each is a pure function of the rows before and the rows to come; ``publish`` writes results as a new version and then
names it, so a reader sees the old or the new tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.config import ENTITY_TYPES, STATUSES

# The tables of the store.
TABLES = {
    "chunks": "chunk_id string, source_document string, source_hash string, source_type string, chunk_index int, source_locator string, normalized_text string, char_count int, metadata map<string,string>, created_at timestamp",
    "embeddings": "chunk_id string, embedding array<float>",
    "evidence": "seq bigint, entity_type string, entity_id string, text string, linked_requirement string, source_document string, chunk_id string, author string, timestamp string, metadata string, created_at timestamp",
    "correlation": "seq bigint, correlation_id string, requirement_entity_id string, evidence_entity_id string, status string, resolution_method string, rule_name string, confidence double, supporting_chunk_ids string, reasoning string, created_at timestamp, run_id bigint",
    "ingestion_log": "filename string, file_hash string, file_size bigint, source_type string, chunk_count int, status string, error_message string, ingested_at timestamp",
}


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``new`` to append: keys not there yet, and the first of each key within ``new``."""
    firsts = new.groupBy(*keys).agg(F.min(order).alias(order))
    return new.join(firsts, [*keys, order], "left_semi").dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def replace_by_key(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows with one per key, the last written; rows of ``new`` come after those there."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    stamp = F.struct("_new", *order, *[c for c in new.columns if c not in order])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max(stamp).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in new.columns])


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows there whose key does not come, and all that come."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_where(existing: DataFrame, column: str, value: str) -> DataFrame:
    """Without the rows of a value; rows with a null there stay."""
    return existing.filter(~F.coalesce(F.col(column) == value, F.lit(False)))


def split_valid_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the table's rules, the others)."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    ok = F.coalesce(F.col("entity_type").isin(*ENTITY_TYPES), F.lit(False)) & filled("source_document") & filled("chunk_id")
    return rows.filter(ok), rows.filter(~ok)


def split_valid_correlation(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("status").isin(*STATUSES) & F.col("resolution_method").isin("deterministic_rule", "llm_stage2") & F.col("confidence").between(0.0, 1.0)
    return rows.filter(F.coalesce(ok, F.lit(False))), rows.filter(~F.coalesce(ok, F.lit(False)))


def append(new: DataFrame, path: str, partition: str | None = None) -> None:
    writer = new.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_correlations(new: DataFrame, path: str) -> DataFrame:
    """Appends the rows that keep the table's rules, their lists encoded as JSON; returns the rows that do not."""
    good, bad = split_valid_correlation(new)
    append(good.withColumn("supporting_chunk_ids", F.to_json(F.coalesce("supporting_chunk_ids", F.array().cast("array<string>")))), path)
    return bad


def scan(rows: DataFrame, newest: str = "created_at", **equal: str | None) -> DataFrame:
    """The rows whose columns equal the given values (all rows without any), newest first; the conditions reach the scan."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc(newest))


def create_tables(spark: SparkSession, path: str, schemas: dict[str, str] = TABLES) -> None:
    """An empty table for each name that ``path`` does not hold yet; calling it again changes nothing."""
    for name, schema in schemas.items():
        if not _exists(spark, f"{path}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")


# ---- versions ---------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _folder(spark, path)
    return fs.exists(target)


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, target = _folder(spark, f"{path}/_versions")
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def current_version(spark: SparkSession, path: str) -> str | None:
    """The newest version that was written whole; None if there is none."""
    versions = _versions(spark, path)
    return versions[-1].partition("-")[2] if versions else None


def publish(tables: dict[str, DataFrame], path: str, keep: int = 2) -> str:
    """Writes tables together as a new version of ``path`` and then names it by creating one small file, which is a single step.

    A reader sees the version before or this one, never a part, and the tables may be read from ``path`` themselves.  The
    ``keep`` newest versions stay, so that readers under way can end.
    """
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    for table, rows in tables.items():
        rows.write.parquet(f"{path}/{name}/{table}")
    before = _versions(spark, path)
    number = int(before[-1].partition("-")[0]) + 1 if before else 0
    fs, target = _folder(spark, f"{path}/_versions/{number:012d}-{name}")
    fs.create(target, False).close()
    for old in _versions(spark, path)[:-keep]:
        fs.delete(_folder(spark, f"{path}/_versions/{old}")[1], False)
        fs.delete(_folder(spark, f"{path}/{old.partition('-')[2]}")[1], True)
    return name


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.parquet(f"{path}/{version}/{table}")


def rewrite(rows: DataFrame, path: str) -> None:
    """Replaces a one-table store, from which ``rows`` may itself be read; see ``publish``."""
    publish({"rows": rows}, path)


def flat_metadata(metadata_column: str = "metadata"):
    """Scalar metadata with prefixed names, nulls left out."""
    kept = F.map_filter(F.col(metadata_column), lambda _, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, _: F.concat(F.lit("meta_"), k))
