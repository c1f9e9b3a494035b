"""How well a ranking and a classification do: Recall@k, Precision@k, MRR, confusion matrix.

``ranked``: query_id, row_id, rank.  ``relevant``: query_id, row_id.  A query without relevant rows does not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: n_queries, recall, precision, mrr."""
    wanted = relevant.select("query_id", "row_id").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("_m"))
    hits = ranked.filter(F.col("rank") <= k).join(wanted, ["query_id", "row_id"], "left_semi").groupBy("query_id").agg(F.count_distinct("row_id").alias("_h"), F.min("rank").alias("_first"))
    per = sizes.join(hits, "query_id", "left").na.fill(0, ["_h"])
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.col("_h") / F.col("_m")), 6).alias("recall"),
        F.round(F.avg(F.col("_h") / F.lit(float(k))), 6).alias("precision"),
        F.round(F.avg(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))), 6).alias("mrr"),
    )


def confusion(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """actual, predicted, n; NULL where one side lacks the key."""
    pair = actual.select(key, F.col("label").alias("actual")).join(predicted.select(key, F.col("label").alias("predicted")), key, "full_outer")
    return pair.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
