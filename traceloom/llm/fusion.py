"""One ranking from several differently scaled scores: reciprocal rank fusion.

Items of a group are ranked per score; an item's total is the sum of 1 / (k + rank), so only
orders count and every score has the same say.

Defined results: rows of one (group, item) pair merge, the highest value per score
counting; null, NaN and (where asked) zero scores are missing and rank with the group's lowest value;
equal values share the better rank; equal totals are ordered by item; rows with a null group or item are
left out; an empty table gives an empty ranking.

Scale: one plan for all sizes.  The items of a group of up to ``hot_rows`` rows are ranked in one window.  Of larger groups not
items but the distinct values are ranked, each with the number of its items, so any number of equal or missing scores is
one row.  Distinct values are cut into 1,024 ranges of the whole table's distribution, so a group with a third of
all rows is many tasks; within a range a window counts what is higher, and a range's start follows from one sum per
range.  The ranks then meet the items by value, a join whose hot values adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.plans.lineage import checkpoint

HOT_ROWS = 200_000  # a group of more rows is ranked by ranges
FAN = 32  # ranges are found in two steps of this many


def _present(name: str, zero_missing: bool) -> Column:
    value = F.col(name)
    gone = F.isnan(value) | (value == 0) if zero_missing else F.isnan(value)
    return F.when(~F.coalesce(gone, F.lit(True)), value)


def merge_pairs(df: DataFrame, group: str, item: str, scores: list[str], zero_missing: tuple[str, ...] = ()) -> DataFrame:
    """One row per (group, item), each score the highest that is not missing."""
    kept = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    return kept.groupBy(group, item).agg(*[F.max(_present(s, s in zero_missing)).alias(s) for s in scores])


def _cuts(df: DataFrame, scores: list[str], zero_missing: tuple[str, ...]) -> list[np.ndarray]:
    """Per score the quantiles of all its values, the ends of its ranges.

    One row of ``FAN`` x ``FAN`` numbers per score comes to the driver, whatever the data's size.
    """
    n = FAN * FAN
    row = df.agg(*[F.percentile_approx(_present(s, s in zero_missing), [i / n for i in range(1, n)], 4 * n) for s in scores]).first()
    return [np.array(row[i] or [0.0] * (n - 1), np.float64) for i in range(len(scores))]


def _range(cuts: list[np.ndarray], score: Column, value: Column) -> Column:
    """The range of a value, 0 for the highest; equal values share one, and higher values never have a higher one."""
    above = lambda ends: F.size(F.filter(ends, lambda c: c > value))
    pick = lambda arrays: F.get(F.array(*[F.lit(x) for x in arrays]), score)
    high = above(pick([c[FAN - 1 :: FAN] for c in cuts]))
    return high * FAN + above(F.slice(pick(cuts), (FAN - 1 - high) * FAN + 1, FAN - 1))


def value_ranks(long: DataFrame, cuts: list[np.ndarray], group: str) -> DataFrame:
    """``long``: group, _score, _v (NaN: missing).  Each distinct (group, _score, _v) with ``_rank``: 1 + the items of a higher value; missing ones rank as the lowest."""
    counts = long.filter(~F.isnan("_v")).groupBy(group, "_score", "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.withColumn("_range", _range(cuts, F.col("_score"), F.col("_v")))
    sums = placed.groupBy(group, "_score", "_range").agg(F.sum("_n").alias("_m"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.withColumn("_shift", F.coalesce(F.sum("_m").over(before(Window.partitionBy(group, "_score").orderBy("_range"))), F.lit(0))).drop("_m")
    inner = F.coalesce(F.sum("_n").over(before(Window.partitionBy(group, "_score", "_range").orderBy(F.desc("_v")))), F.lit(0))
    ranked = placed.withColumn("_inner", inner).join(shift, [group, "_score", "_range"]).select(group, "_score", "_v", (F.col("_inner") + F.col("_shift") + 1).alias("_rank"))
    lowest = counts.groupBy(group, "_score").agg(F.lit(float("nan")).alias("_v"), (F.sum("_n") - F.min(F.struct("_v", "_n"))["_n"] + 1).alias("_rank"))
    return ranked.unionByName(lowest)


def _window_ranks(merged: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """``rank_<score>`` of each item, its group in one window."""
    whole = Window.partitionBy(group)
    out = merged.withColumns({f"_v_{s}": F.coalesce(F.col(s), F.min(s).over(whole)) for s in scores})
    for s in scores:
        out = out.withColumn(f"rank_{s}", F.rank().over(whole.orderBy(F.desc(f"_v_{s}"))).cast("bigint"))
    return out.drop(*scores, *[f"_v_{s}" for s in scores])


def _range_ranks(merged: DataFrame, group: str, item: str, scores: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """The same by distinct values in ranges."""
    values = F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(float("nan"))) for s in scores])
    long = merged.select(F.col(group), F.col(item), F.posexplode(values).alias("_score", "_v"))
    ranked = long.join(value_ranks(long.drop(item), cuts, group), [group, "_score", "_v"], "left")
    rank = F.coalesce("_rank", F.lit(1))  # a score that the whole group lacks
    return ranked.groupBy(group, item).agg(*[F.max(F.when(F.col("_score") == i, rank)).alias(f"rank_{s}") for i, s in enumerate(scores)])


def reciprocal_rank_fusion(df: DataFrame, group: str, item: str, scores: list[str], zero_missing: tuple[str, ...] = (), k: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Columns: group, item, ``rank_<score>`` of each score, and ``rrf`` (rounded to 12 places, so equal sums are equal).

    The table of groups above ``hot_rows`` is broadcast; it has fewer rows than the data divided by ``hot_rows``.
    """
    merged = merge_pairs(df, group, item, scores, zero_missing)
    hot = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(group)
    usual = _window_ranks(merged.join(F.broadcast(hot), group, "left_anti"), group, scores)
    large = _range_ranks(merged.join(F.broadcast(hot), group, "left_semi"), group, item, scores, _cuts(df, scores, zero_missing))
    total = reduce(lambda a, b: a + b, [F.lit(1.0) / (k + F.col(f"rank_{s}")) for s in scores])
    return usual.unionByName(large).withColumn("rrf", F.round(total, 12))


def first_of_each(fused: DataFrame, group: str, item: str) -> DataFrame:
    """The item with the highest total per group (then the smallest item); partial aggregates, no sort."""
    return fused.groupBy(group).agg(F.min(F.struct((-F.col("rrf")).alias("_s"), F.col(item).alias(item))).alias("_best")).select(group, F.col(f"_best.{item}").alias(item))


def final_order(fused: DataFrame, group: str, item: str) -> DataFrame:
    """Adds ``position``, 1 for the highest total; equal totals in the order of the items.

    Rows are dealt by ranges of (group, total, item), which are unique, so neither a hot group nor equal totals meet in one task; they are
    numbered within their part, and a part's first number follows from one count per group and part.  The parts are stored, as both steps need the same.
    """
    parts = checkpoint(fused.repartitionByRange(group, F.desc("rrf"), item).withColumn("_part", F.spark_partition_id()))
    inner = F.row_number().over(Window.partitionBy(group, "_part").orderBy(F.desc("rrf"), item))
    sizes = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    return parts.withColumn("_inner", inner).join(shift, [group, "_part"]).withColumn("position", F.col("_inner") + F.col("_shift")).drop("_part", "_inner", "_shift")
