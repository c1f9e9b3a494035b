from __future__ import annotations

import random

from traceloom.llm.fusion import final_order, first_of_each, reciprocal_rank_fusion

SCORES = ["a", "b", "c"]
SCHEMA = "g string, i string, a double, b double, c double, rrf string, extra int"


def brute(rows):
    pairs = {}
    for g, i, *values in rows:
        if g is None or i is None:
            continue
        best = pairs.setdefault((g, i), [None] * 3)
        for n, v in enumerate(values):
            if v is not None and v == v and not (n == 0 and v == 0):
                best[n] = v if best[n] is None else max(best[n], v)
    out = {}
    for g in {g for g, _ in pairs}:
        items = {i: v for (h, i), v in pairs.items() if h == g}
        total = dict.fromkeys(items, 0.0)
        for n in range(3):
            there = [v[n] for v in items.values() if v[n] is not None]
            value = {i: (v[n] if v[n] is not None else min(there, default=0.0)) for i, v in items.items()}
            for i in items:
                total[i] += 1 / (60 + 1 + sum(w > value[i] for w in value.values()))
        for p, i in enumerate(sorted(items, key=lambda i: (-round(total[i], 12), i)), 1):
            out[g, i] = p
    return out


def run(spark, rows, hot=200_000):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    fused = reciprocal_rank_fusion(df, "g", "i", SCORES, ("a",), hot_rows=hot)
    ordered = {(r.g, r.i): r.position for r in final_order(fused, "g", "i").collect()}
    first = {r.g: r.i for r in first_of_each(fused, "g", "i").collect()}
    return ordered, first


def test_equals_brute_force(spark):
    r = random.Random(5)
    value = lambda top: r.choice([None, float("nan"), 0.0, r.random() * top, float(r.randrange(4))])
    rows = [(r.choice("xxxy"), f"i{r.randrange(60)}", value(1), value(90), value(5)) for _ in range(300)]
    rows += [(None, "i1", 1.0, 1.0, 1.0), ("x", None, 1.0, 1.0, 1.0), ("z", "only", None, None, None), ("w", "a", -0.0, 0.0, 1.0), ("w", "b", 0.0, -0.0, float("inf")), *rows[:20]]
    want = brute(rows)
    for hot in (0, 10, 200_000):
        ordered, first = run(spark, rows, hot)
        assert ordered == want, hot
    assert first == {g: i for (g, i), p in want.items() if p == 1}


def test_one_hot_group_with_ties_and_missing_scores(spark):
    r = random.Random(7)
    rows = [("hot", f"i{n:05}", None if n % 3 else r.random(), 0.0 if n % 2 else r.random() * 100, float(r.randrange(3))) for n in range(3000)]
    rows += [(f"g{n % 500}", f"i{n}", r.random(), r.random(), None) for n in range(3000)]
    ordered, first = run(spark, rows, 1000)
    hot = [x for x in rows if x[0] == "hot"]
    want = brute_ranks(hot)
    assert {i: p for (g, i), p in ordered.items() if g == "hot"} == want
    assert len(ordered) == len(rows) and first["hot"] == min(want, key=want.get)


def brute_ranks(rows):
    """``brute`` for many items of one group: ranks by sorted values."""
    from bisect import bisect_right

    total = dict.fromkeys((x[1] for x in rows), 0.0)
    for n in range(3):
        there = [x[2 + n] for x in rows if x[2 + n] is not None and not (n == 0 and x[2 + n] == 0)]
        low = min(there, default=0.0)
        value = {x[1]: x[2 + n] if x[2 + n] is not None and not (n == 0 and x[2 + n] == 0) else low for x in rows}
        ordered = sorted(value.values())
        for i, v in value.items():
            total[i] += 1 / (61 + len(ordered) - bisect_right(ordered, v))
    return {i: p for p, i in enumerate(sorted(total, key=lambda i: (-round(total[i], 12), i)), 1)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    fused = reciprocal_rank_fusion(df, "g", "i", SCORES)
    assert first_of_each(fused, "g", "i").collect() == [] and final_order(fused, "g", "i").collect() == []


def test_scale_of_a_score_does_not_matter(spark):
    rows = [("g", f"i{n}", float(n), float(-n), float(n % 3)) for n in range(20)]
    big = [(g, i, a * 1e9 + 1, b, c) for g, i, a, b, c in rows]
    assert run(spark, rows[1:]) == run(spark, big[1:])
