from __future__ import annotations

import random
from datetime import datetime, timedelta

from traceloom.operators.sessions import sessionise, sessionise_stream

GAP = 1800 * 1_000_000
SCHEMA = "k string, j string, us long, id long"


def brute(rows):
    groups = {}
    for k, j, us, i in set(rows):
        if None not in (k, j, us, i):
            groups.setdefault((k, j), []).append((us, i))
    out = []
    for key, events in groups.items():
        events.sort()
        run = [events[0]]
        for e in events[1:]:
            if e[0] - run[-1][0] > GAP:
                out.append((*key, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(e)
        out.append((*key, run[0][1], run[-1][1], len(run)))
    return sorted(out)


def run(spark, rows, **more):
    out = sessionise(spark.createDataFrame(rows, SCHEMA), ["k", "j"], "us", "id", **more).collect()
    return sorted((r.k, r.j, r.first_id, r.last_id, r.n_events) for r in out)


def test_random_events_equal_brute_force(spark):
    r = random.Random(3)
    base = 1_700_000_000_000_000
    rows = [(r.choice("ab"), r.choice("xy"), base + r.randrange(0, 400) * 300_000_000, i) for i in range(600)]
    rows += rows[:40] + [(None, "x", base, 1), ("a", None, base, 2), ("a", "x", None, 3), ("a", "x", base, None)]
    for width in (7, 600, None):
        assert run(spark, rows, stretch_seconds=width) == brute(rows)


def test_exactly_the_gap_does_not_split(spark):
    rows = [("a", "x", 0, 1), ("a", "x", GAP, 2), ("a", "x", 2 * GAP + 1, 3)]
    assert run(spark, rows) == [("a", "x", 1, 2, 2), ("a", "x", 3, 3, 1)]


def test_across_a_slice_end_and_before_the_epoch(spark):
    day = 86_400_000_000
    rows = [("a", "x", day - 1, 1), ("a", "x", day + GAP - 1, 2), ("a", "x", -5, 3), ("a", "x", 5, 4)]
    assert run(spark, rows) == [("a", "x", 1, 2, 2), ("a", "x", 3, 4, 2)]


def test_a_chain_over_many_slices_is_one_session(spark):
    rows = [("a", "x", i * GAP, i) for i in range(1, 200)]
    assert run(spark, rows, stretch_seconds=1799) == [("a", "x", 1, 199, 199)]


def test_one_hot_key(spark):
    r = random.Random(8)
    rows = [("hot", "x", r.randrange(0, 3000) * 60_000_000, i) for i in range(4000)] + [(f"k{i % 50}", "x", r.randrange(0, 9000) * 60_000_000, i) for i in range(2000)]
    assert run(spark, rows) == brute(rows)


def test_ties_and_empty(spark):
    assert run(spark, [("a", "x", 7, 9), ("a", "x", 7, 3)]) == [("a", "x", 3, 9, 2)]
    assert sessionise(spark.createDataFrame([], SCHEMA), ["k", "j"], "us", "id").collect() == []


def test_stream_accepts_late_events(spark, tmp_path):
    start = datetime(2024, 1, 1, 10)
    folder = str(tmp_path / "in")
    minute = lambda n: start + timedelta(minutes=n)
    for batch in ([("a", minute(0)), ("a", minute(20))], [("a", minute(70)), ("a", minute(45))], [("a", minute(9000))]):
        spark.createDataFrame(batch, "k string, t timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    q = sessionise_stream(stream, ["k"], "t", lateness="2 days").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("late").collect()
    assert [(r.session_start, r.session_end, r.n_events) for r in rows] == [(minute(0), minute(70), 4)]
