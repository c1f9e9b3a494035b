"""Filling containers of fixed capacity with texts of varying length.

Linear grouping: large lengths are sorted and cut into groups of equal cardinality, every
length counts as the longest of its group, and for these few sizes configurations of a container
are optimised (the fullest one that holds the largest size left, used as often as the counts
allow).  Then the actual texts take the slots of their group, and the small ones go, longest first,
into the container in which they leave the least room.

All of this needs only how many items each length has, a table bounded by the
capacities (one entry per possible length), so it is planned on the driver whatever the data's size.
The plan says for each length which ranks go to which containers; the texts themselves are
numbered within their length in a distributed window (lengths that many texts share are numbered in
several parts) and look their container up afterwards.  Container contents never meet in one task.

Defined results: a text longer than the capacity is cut at multiples of the capacity, its full pieces
fill containers of their own; null texts and texts without tokens need no container and get none; an empty
table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUPS, LARGE_SHARE, PART_ROWS = 128, 1 / 6, 100_000
BROADCAST_BYTES = 64 << 20  # a plan beyond this is joined by its key instead of being broadcast

Interval = tuple[int, int, int, int]  # length, first rank, first container, items of this length per container


def _groups(counts: dict[int, int], limit: float, n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality of the lengths above ``limit``: (rounded size, [(length, count)]), largest first."""
    large = sorted(((s, n) for s, n in counts.items() if s > limit), reverse=True)
    total = sum(n for _, n in large)
    each = max(1, -(-total // n_groups))
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for size, n in large:
        while n:
            if room == 0:
                groups.append((size, []))
                room = each
            take = min(n, room)
            groups[-1][1].append((size, take))
            n, room = n - take, room - take
    return groups


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """The fullest container that holds the largest size left, as a count per size."""
    first = next(g for g, n in enumerate(left) if n)
    room = capacity - sizes[first]
    best = np.full(room + 1, -1, np.int64)  # the last size used to reach a sum, -2 for the empty sum
    best[0] = -2
    use = np.zeros((len(sizes), room + 1), np.int16)
    for g, size in enumerate(sizes):
        usable = left[g] - (g == first)
        for _ in range(min(usable, room // size)):
            reach = np.flatnonzero((best[: room + 1 - size] != -1) & (best[size:] == -1) & (use[g, : room + 1 - size] < usable))
            if not reach.size:
                break
            best[reach + size] = g
            use[g, reach + size] = use[g, reach] + 1
    total = int(np.flatnonzero(best != -1)[-1])
    chosen = [0] * len(sizes)
    chosen[first] = 1
    while total:
        g = int(best[total])
        chosen[g] += 1
        total -= sizes[g]
    return chosen


def _substitute(groups, taken: list[int], config: list[int], times: int, base: int, capacity: int) -> tuple[list[Interval], list[tuple[int, int, int]]]:
    """The actual lengths in ``times`` containers of one configuration: intervals, and (room, first container, count) classes."""
    intervals: list[Interval] = []
    cuts = {0, times}
    spans = []
    for g, m in enumerate(config):
        if not m:
            continue
        lo, hi, at = taken[g], taken[g] + m * times, 0
        for size, n in groups[g][1]:
            a, b = max(at, lo), min(at + n, hi)
            if a < b:
                spans.append((g, m, size, a - lo, b - lo))
                cuts.update(x for x in ((a - lo) // m, -(-(a - lo) // m), (b - lo) // m, -(-(b - lo) // m)) if 0 <= x <= times)
            at += n
    edges = sorted(cuts)
    room = {e: capacity for e in edges[:-1]}
    for _, m, size, a, b in spans:
        for e, f in zip(edges, edges[1:]):
            lo, hi = max(a, e * m), min(b, f * m)
            if lo < hi:
                per = m if f - e > 1 else hi - lo
                room[e] -= size * per
                intervals.append((size, hi - lo, base + e, per))
    return intervals, [(room[e], base + e, f - e) for e, f in zip(edges, edges[1:])]


def plan_containers(counts: dict[int, int], capacity: int, n_groups: int = GROUPS) -> tuple[list[Interval], int]:
    """Intervals (length, first rank, first container, items per container), and the number of containers."""
    raw: list[Interval] = []  # with the number of items in place of the first rank
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []
    opened = 0

    def offer(room: int, base: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in rooms or not rooms[room]:
                insort(order, room)
            rooms[room].append((base, n))

    limit = capacity * LARGE_SHARE
    groups = _groups(counts, limit, n_groups)
    sizes, left, taken = [g[0] for g in groups], [sum(n for _, n in g[1]) for g in groups], [0] * len(groups)
    while any(left):
        config = _configuration(sizes, left, capacity)
        times = min(left[g] // m for g, m in enumerate(config) if m)
        made, classes = _substitute(groups, taken, config, times, opened, capacity)
        raw += made
        for room, base, n in classes:
            offer(room, base, n)
        for g, m in enumerate(config):
            left[g] -= m * times
            taken[g] += m * times
        opened += times
    for size in sorted((s for s, n in counts.items() if 0 < s <= limit and n), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(order, size)
            if at == len(order):
                base, have, room = opened, -(-n // (capacity // size)), capacity
                opened += have
            else:
                room = order[at]
                base, have = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            fits = room // size
            full = min(have, n // fits)
            if full:
                raw.append((size, full * fits, base, fits))
                offer(room - fits * size, base, full)
                n -= full * fits
                base, have = base + full, have - full
            if n and have:
                some = min(n, fits)
                raw.append((size, some, base, some))
                offer(room - some * size, base, 1)
                n -= some
                base, have = base + 1, have - 1
            offer(room, base, have)
    ranks: dict[int, int] = defaultdict(int)
    out: list[Interval] = []
    for size, n, base, per in raw:
        out.append((size, ranks[size], base, per))
        ranks[size] += n
    return out, opened


def pack(items: DataFrame, capacities: dict[str, int], key: str = "doc_id", size: str = "n_tokens", n_groups: int = GROUPS, part_rows: int = PART_ROWS) -> DataFrame:
    """``items`` (key, size) into containers of every capacity; pass a stored table, it is read twice.

    Columns: container_kind, container_id, key, piece_no, start_token, n_tokens.
    """
    spark = items.sparkSession
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(capacities.items())])
    rows = items.filter(F.col(size) > 0).select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_size"), F.explode(kinds).alias("_k")).select("_key", "_size", "_k.*")
    rows = rows.withColumn("_full", F.floor((F.col("_size") - 1) / F.col("capacity"))).withColumn("_rest", F.col("_size") - F.col("_full") * F.col("capacity"))
    counts: dict[str, dict[int, int]] = {k: {} for k in capacities}
    for kind, rest, n in rows.groupBy("container_kind", "_rest").agg(F.count(F.lit(1))).collect():  # at most the sum of the capacities
        counts[kind][rest] = n
    look_up = []
    for kind, capacity in capacities.items():
        by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for length, rank, base, per in plan_containers(counts[kind], capacity, n_groups)[0]:
            by_size[length].append((rank, base, per))
        look_up += [(kind, length, sorted(v)) for length, v in by_size.items()]
    plan = spark.createDataFrame(look_up, "container_kind string, _rest bigint, _plan array<struct<rank:bigint,base:bigint,per:bigint>>")
    # texts are numbered within their length first, in as many parts as the most frequent length needs; only then the plan joins
    n_parts = max([1, *(-(-n // part_rows) for c in counts.values() for n in c.values())])
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(n_parts)))
    w = Window.partitionBy("container_kind", "_rest", "_part").orderBy("_key")
    ranked = dealt.withColumn("_rank", (F.row_number().over(w) - 1).cast("bigint"))
    sizes = dealt.groupBy("container_kind", "_rest", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("container_kind", "_rest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("container_kind", "_rest", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = ranked.join(shift, ["container_kind", "_rest", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_shift")) if n_parts > 1 else ranked
    small = 24 * sum(len(v) for _, _, v in look_up) <= BROADCAST_BYTES
    numbered = ranked.join(F.broadcast(plan) if small else plan, ["container_kind", "_rest"])
    at = F.element_at(F.filter("_plan", lambda p: p["rank"] <= F.col("_rank")), -1)
    numbered = numbered.withColumn("_at", at)
    number = F.col("_at.base") + F.floor((F.col("_rank") - F.col("_at.rank")) / F.col("_at.per"))
    rest = F.struct(F.format_string("%s/%d", "container_kind", number).alias("container_id"), F.col("_full").cast("int").alias("piece_no"), F.col("_rest").alias("n_tokens"))
    whole = F.transform(
        F.when(F.col("_full") > 0, F.sequence(F.lit(0), F.col("_full").cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat_ws("/", "container_kind", F.lit("full"), F.col("_key").cast("string"), i.cast("string")).alias("container_id"), i.alias("piece_no"), F.col("capacity").alias("n_tokens")),
    )
    pieces = numbered.select("container_kind", F.col("_key").alias(key), "capacity", F.explode(F.concat(whole, F.array(rest))).alias("_p"))
    return pieces.select("container_kind", "_p.container_id", key, "_p.piece_no", (F.col("_p.piece_no") * F.col("capacity")).alias("start_token"), "_p.n_tokens")


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per kind: containers, tokens, the share of the room that is filled, and the least number of containers any packing needs."""
    capacity = F.create_map(*[F.lit(x) for pair in sorted(capacities.items()) for x in pair])
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"))
    out = per.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    size = F.try_element_at(capacity, F.col("container_kind"))
    return out.withColumn("capacity", size).withColumn("filled_share", F.round(F.col("n_tokens") / (F.col("n_containers") * size), 6)).withColumn("least_containers", F.ceil(F.col("n_tokens") / size))
