"""All core queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceloom.plans import general, reference

QUERIES = {**reference.QUERIES, **general.QUERIES}
SQL = {**reference.SQL, **general.SQL}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The traceability matrix: every requirement with its best correlation, evidence and documents."""
    return reference.m04_matrix(spark, folder)
