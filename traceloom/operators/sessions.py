"""Sessions: runs of events of one key without a silence longer than a gap.

Merging interval state: each event opens an interval of the gap's length and
overlapping intervals merge.  ``session_window`` keeps that state, in batch and (with
a watermark) in streams.  So that one key may hold any share of the rows, the events of one stretch of clock time no
longer than the gap, which are one session whatever comes between them, first become one interval by a partial
aggregate; a key then has as many intervals at most as its time span has stretches, however many its events.

Defined results: events with a null key or time are left out; an event repeated as a
whole row counts once; a silence of exactly the gap does not split; at equal times the smaller
id is earlier; an empty table gives no sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessionise(events: DataFrame, keys: list[str], micros: str, event_id: str, gap_seconds: int = 1800, stretch_seconds: int | None = None) -> DataFrame:
    """Columns: ``keys``, first_id, last_id, start_micros, end_micros, duration_seconds, n_events.

    One shuffle removes repeats (by key, time and id, which no key can skew), one carries pre-aggregated stretches (the gap long, or
    ``stretch_seconds`` if that is given), one their intervals by key.
    """
    stretch = (gap_seconds if stretch_seconds is None else stretch_seconds) * 1_000_000
    if not 0 < stretch <= gap_seconds * 1_000_000:
        raise ValueError("a stretch must not be longer than the gap")
    at, point = F.col("_us"), F.struct("_us", "_id")
    rows = events.select(*keys, F.col(micros).alias("_us"), F.col(event_id).alias("_id")).filter(at.isNotNull() & F.col("_id").isNotNull()).dropna(subset=keys).dropDuplicates([*keys, "_us", "_id"])
    parts = rows.groupBy(*keys, F.floor(at / stretch).alias("_stretch")).agg(F.min(point).alias("_first"), F.max(point).alias("_last"), F.count(F.lit(1)).alias("_n"))
    # the interval of a stretch: from its first event until the gap after its last
    length = F.col("_last._us") - F.col("_first._us") + gap_seconds * 1_000_000
    timed = parts.withColumn("_at", F.timestamp_micros("_first._us")).withColumn("_for", F.make_interval(secs=(length / 1_000_000).cast("decimal(18,6)")))
    merged = timed.groupBy(*keys, F.session_window("_at", F.col("_for"))).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("_n"))
    first, last = F.col("_first._us"), F.col("_last._us")
    return merged.select(
        *keys, F.col("_first._id").alias("first_id"), F.col("_last._id").alias("last_id"), first.alias("start_micros"), last.alias("end_micros"),
        ((last - first) / 1_000_000).alias("duration_seconds"), F.col("_n").alias("n_events"),
    )


def sessionise_stream(events: DataFrame, keys: list[str], time: str | Column, gap: str = "30 minutes", lateness: str = "7 days") -> DataFrame:
    """The same over a stream: state is kept until ``lateness`` has passed, late events within it merge into their session.

    Events later than that are dropped by the watermark. The state store partitions by ``keys``.
    """
    timed = events.withColumn("_at", F.col(time) if isinstance(time, str) else time).dropna(subset=[*keys, "_at"])
    return (
        timed.withWatermark("_at", lateness)
        .groupBy(*keys, F.session_window("_at", gap))
        .agg(F.min("_at").alias("session_start"), F.max("_at").alias("session_end"), F.count(F.lit(1)).alias("n_events"))
        .drop("session_window")
    )
