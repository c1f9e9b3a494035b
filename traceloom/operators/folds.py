"""Order-dependent steps over the rows of many keys, none of which has to fit a task.

Rows are dealt by ranges of (key, order), so a key with any share of the rows is many parts in order.  A step reads
its part as a stream and hands a small state from row to row.  What a part hands to the next follows from one summary
row per part: most states forget what came before (``Fold.forgets``), so a part's last state is known without its first; the few that do not
are read again once the state before them is known.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.plans.lineage import checkpoint


class Fold(Protocol):
    """A step over the rows of one key.  The state is None before the first row; it must stay small."""

    def forgets(self, row: dict) -> bool:
        """Whether the state after this row is the same whatever the state before."""

    def step(self, state: Any, row: dict) -> tuple[Any, list[tuple]]:
        """(state, rows put out)."""

    def end(self, state: Any) -> list[tuple]:
        """What is put out after the key's last row."""


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def ordered_fold(rows: DataFrame, key: str, order: list[str], make: Callable[[], Fold], schema: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Columns: key, position (from 0 within the key), and those of ``schema`` (name, Spark type, Arrow type) that the fold puts out.

    ``key`` and ``order`` together are unique; rows with a null key are left out.
    """
    names = rows.columns
    dealt = rows.filter(F.col(key).isNotNull()).repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id())
    parts = checkpoint(dealt)  # both readings need the same parts; a stored part keeps its order
    key_field = rows.schema[key]
    key_type, spark = key_field.dataType.simpleString(), rows.sparkSession
    summary_type = f"part int, first_key {key_type}, last_key {key_type}, known boolean, state binary"

    def summaries(known: dict[int, Any] | None) -> DataFrame:
        """``known``: the states before the parts to read again; None: all parts, as if nothing came before."""
        sent = spark.sparkContext.broadcast(known)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold, first, last, state, sure, part = make(), None, None, None, True, None
            for row in _rows(batches):
                here = row[key]
                if part is None:
                    part, first = row["_part"], here
                    if sent.value is not None and part not in sent.value:
                        return
                    state, sure = (sent.value or {}).get(part), sent.value is not None
                elif here != last:
                    state, sure = None, True
                sure = sure or fold.forgets(row)
                state, _ = fold.step(state, row)
                last = here
            if part is not None:
                kind = batch_type(key_type)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], kind), pa.array([last], kind), pa.array([sure]), pa.array([pickle.dumps(state)])], ["part", "first_key", "last_key", "known", "state"])

        return parts.select(*names, "_part").mapInArrow(read, summary_type)

    ends = sorted(summaries(None).collect(), key=lambda r: r["part"])  # a small row per part
    states, unsure = {r["part"]: pickle.loads(r["state"]) for r in ends}, {r["part"] for r in ends if not r["known"]}
    before: dict[int, Any] = {}
    going_on: set[int] = set()
    for a, b in zip(ends, ends[1:]):
        if a["last_key"] == b["first_key"]:
            going_on.add(a["part"])
    follows = {b["part"]: a["part"] for a, b in zip(ends, ends[1:]) if a["part"] in going_on}
    unsure &= set(follows)
    while unsure:  # parts without a row that forgets, after a part of the same key
        ready = {p: states[follows[p]] for p in unsure if follows[p] not in unsure}
        for r in summaries(ready).collect():
            states[r["part"]] = pickle.loads(r["state"])
        unsure -= set(ready)
    before = {p: states[q] for p, q in follows.items()}
    sent = spark.sparkContext.broadcast((before, going_on))
    out_names = [n for n, _, _ in schema]

    def fold_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states_before, open_parts = sent.value
        fold, last, state, part, number = make(), None, None, None, 0
        keys, numbers, out = [], [], []

        def put(made: list[tuple]) -> None:
            nonlocal number
            for x in made:
                keys.append(last)
                numbers.append(number)
                out.append(x)
                number += 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in out], t) for i, (_, _, t) in enumerate(schema)]
            made = pa.RecordBatch.from_arrays([pa.array(keys, batch_type(key_type)), pa.array([part] * len(keys), pa.int32()), pa.array(numbers, pa.int64()), *columns], [key, "_part", "_no", *out_names])
            keys.clear(), numbers.clear(), out.clear()
            return made

        for row in _rows(batches):
            if part is None:
                part, state = row["_part"], states_before.get(row["_part"])
            elif row[key] != last:
                put(fold.end(state))
                state, number = None, 0
            last = row[key]
            state, made = fold.step(state, row)
            put(made)
            if len(out) >= 2000:
                yield batch()
        if part is not None:
            if part not in open_parts:
                put(fold.end(state))
            yield batch()

    made = parts.select(*names, "_part").mapInArrow(fold_part, ", ".join([f"`{key}` {key_type}", "_part int", "_no bigint", *[f"`{n}` {t}" for n, t, _ in schema]]))
    if not follows:
        return made.select(key, F.col("_no").alias("position"), *out_names)
    sizes = made.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    return made.join(shift, [key, "_part"]).select(key, (F.col("_no") + F.col("_shift")).alias("position"), *out_names)


def batch_type(spark_type: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[spark_type]
