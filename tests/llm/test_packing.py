from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from traceloom.llm.packing import fill_report, pack, plan_containers


@pytest.mark.parametrize("capacity", [1, 7, 512, 2048])
@pytest.mark.parametrize("n", [0, 1, 3, 400, 5000])
def test_plan_holds_every_item_once_within_capacity(capacity, n):
    r = random.Random(n)
    lengths = [min(capacity, max(1, int(r.lognormvariate(4, 1.5)))) for _ in range(n)]
    counts = Counter(lengths)
    plan, opened = plan_containers(counts, capacity)
    by_size = defaultdict(list)
    for size, rank, base, per in plan:
        by_size[size].append((rank, base, per))
    used = Counter()
    for size, count in counts.items():
        spans = sorted(by_size[size])
        assert spans[0][0] == 0
        for k in range(count):
            rank, base, per = [s for s in spans if s[0] <= k][-1]
            used[base + (k - rank) // per] += size
    assert sum(used.values()) == sum(lengths) and max(used.values(), default=0) <= capacity
    assert len(used) <= opened
    if n >= 400:
        assert sum(lengths) / (len(used) * capacity) > 0.95


def test_table(spark):
    r = random.Random(4)
    sizes = [(i, r.choice([0, 1, 5, 99, 100, 101, 250, 1000, r.randrange(1, 300)])) for i in range(500)] + [(501, None)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumnRenamed("x", "y").selectExpr("*", "'e' as container_kind", "3 as piece_no")
    for part_rows in (10, 100_000):
        packed = pack(df, {"small": 100, "large": 1000}, part_rows=part_rows)
        rows = packed.collect()
        for kind, capacity in (("small", 100), ("large", 1000)):
            own = [x for x in rows if x.container_kind == kind]
            fill, pieces = Counter(), defaultdict(list)
            for x in own:
                fill[x.container_id] += x.n_tokens
                pieces[x.doc_id].append((x.start_token, x.n_tokens, x.piece_no))
            assert max(fill.values()) <= capacity
            for doc, size in sizes:
                parts = sorted(pieces.get(doc, []))
                assert sum(p[1] for p in parts) == (size or 0)
                assert len(parts) == (-(-size // capacity) if size else 0)
                assert [p[0] for p in parts] == [capacity * i for i in range(len(parts))]
        report = {x.container_kind: x for x in fill_report(packed, {"small": 100, "large": 1000}).collect()}
        assert report["small"].fullest <= 100 and report["large"].filled_share > 0.97


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(df, {"a": 10}).collect() == []
