"""A query set against all rows, in blocks: rows stream past the queries, nothing of the rows is shuffled or copied.

The queries are cut into blocks of fixed size.  A block is brought into the form its scorer wants, sent once to
every executor, and read against each batch of rows where the row lies; a task keeps the best ``k`` per query and only
those leave it.  No pair of a query and a row becomes a Spark row.  What is broadcast is bounded by the block size
whatever the number of queries: more queries are more blocks, and each block reads the rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.plans.lineage import checkpoint

CELLS = 4_000_000  # scores that a task holds at a time

Prepare = Callable[[pd.DataFrame], Any]  # a block of queries -> what the scorer reads; runs on the driver, once per block
Scorer = Callable[[Any, pa.RecordBatch], np.ndarray]  # -> scores, queries down, rows across; NaN: no pair


def query_blocks(queries: DataFrame, key: str, size: int) -> list[pd.DataFrame]:
    """The queries in blocks of about ``size``, one after the other on the driver; equal keys share a block."""
    n = max(1, -(-queries.select(key).count() // size))
    dealt = queries.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)))
    dealt = checkpoint(dealt) if n > 1 else dealt
    return [dealt.filter(F.col("_b") == b).drop("_b").toPandas() for b in range(n)]


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, width))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _best(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    return pairs.sort_values(["q", "score", "row"], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k)


def block_top_k(queries: DataFrame, rows: DataFrame, prepare: Prepare, scorer: Scorer, k: int, query_block: int = 4096, digits: int = 9) -> DataFrame:
    """Columns: query_id, row_id, score, rank.  ``queries`` has query_id and ``rows`` row_id first, both unique and not null.

    Order: score rounded to ``digits`` descending, then row_id.
    """
    spark = rows.sparkSession
    q_field, r_field = queries.schema["query_id"], rows.schema["row_id"]
    schema = f"query_id {q_field.dataType.simpleString()}, row_id {r_field.dataType.simpleString()}, score double"
    parts = []
    for block in query_blocks(queries, "query_id", query_block):
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast((block["query_id"].to_numpy(), prepare(block)))

        def top(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, state = sent.value
            held, least = [], np.full(len(ids), -np.inf)
            waiting = 0
            kind = None
            for batch in batches:
                kind = batch.schema.field(0).type
                for part in _slices(batch, len(ids)):
                    score = np.round(scorer(state, part), digits)
                    score = np.where(np.isnan(score), -np.inf, score)
                    bound = least
                    if part.num_rows > k:
                        bound = np.maximum(bound, np.partition(score, part.num_rows - k, axis=1)[:, part.num_rows - k])
                    q, r = np.nonzero((score >= bound[:, None]) & np.isfinite(score))
                    if len(q):
                        rows_ = part.column(0).to_pandas().to_numpy()
                        held.append(pd.DataFrame({"q": q, "row": rows_[r], "score": score[q, r]}))
                        waiting += len(q)
                    if waiting > 4 * k * len(ids) + CELLS // 8:
                        kept = _best(pd.concat(held), k)
                        held, waiting = [kept], len(kept)
                        full = kept.groupby("q")["score"].agg(["size", "min"])
                        full = full[full["size"] >= k]
                        least[full.index.to_numpy()] = full["min"].to_numpy()
            if held:
                kept = _best(pd.concat(held), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[kept["q"].to_numpy()]), pa.array(kept["row"].to_numpy(), kind), pa.array(kept["score"].to_numpy(np.float64))], ["query_id", "row_id", "score"])

        parts.append(rows.mapInArrow(top, schema))
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_target(rows: DataFrame, targets: DataFrame, prepare: Prepare, scorer: Scorer, order: str, least: float, target_block: int = 16_384, digits: int = 9) -> DataFrame:
    """For each row the target of the highest score, ``least`` or more, the lowest ``order`` among equals: row_id, target_id, score.

    ``targets``: target_id, ``order`` (a number) and what the scorer reads; in blocks as above, so that a row meets all of them
    where it lies and leaves one candidate per block.
    """
    spark = rows.sparkSession
    t_field, r_field = targets.schema["target_id"], rows.schema["row_id"]
    schema = f"row_id {r_field.dataType.simpleString()}, score double, place bigint, target_id {t_field.dataType.simpleString()}"
    parts = []
    for block in query_blocks(targets, "target_id", target_block):
        if not len(block):
            continue
        block = block.sort_values(order, ignore_index=True)
        sent = spark.sparkContext.broadcast((block["target_id"].to_numpy(), block[order].to_numpy(np.int64), prepare(block)))

        def pick(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, places, state = sent.value
            for batch in batches:
                for part in _slices(batch, len(ids)):
                    score = np.round(scorer(state, part), digits)
                    score = np.where(np.isnan(score), -np.inf, score)
                    at = score.argmax(axis=0)  # the first of equals
                    best = score[at, np.arange(part.num_rows)]
                    keep = np.flatnonzero(best >= least)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(best[keep]), pa.array(places[at[keep]]), pa.array(ids[at[keep]])], ["row_id", "score", "place", "target_id"])

        parts.append(rows.mapInArrow(pick, schema))
    if not parts:
        return spark.createDataFrame([], schema).drop("place")
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        found = found.groupBy("row_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "target_id")).alias("_b")).select("row_id", (-F.col("_b.s")).alias("score"), "_b.target_id")
    return found.select("row_id", "target_id", "score")


class Postings:
    """Weighted terms of a block, by term: adds, for each row and each of the row's terms, weight x value to every query that asks for it."""

    def __init__(self, terms: list, weights: list | None = None):
        lengths = np.array([len(t) for t in terms], np.int64)
        flat = pa.array([t for own in terms for t in own], pa.string()).dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.vocabulary = flat.dictionary
        self.asking = np.repeat(np.arange(len(terms)), lengths)[order]
        self.weight = (np.concatenate([np.asarray(w, np.float64) for w in weights]) if weights is not None and len(code) else np.ones(len(code)))[order]
        self.start = np.searchsorted(code[order], np.arange(len(self.vocabulary) + 1))
        self.n = len(terms)

    def sums(self, terms: pa.ListArray, values: np.ndarray | None, n_rows: int) -> np.ndarray:
        """Queries down, rows across; ``values`` per term of each row (1 if None)."""
        import pyarrow.compute as pc

        out = np.zeros(self.n * n_rows)
        flat = terms.flatten()
        if len(flat) and len(self.vocabulary):
            row = np.repeat(np.arange(n_rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            found = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            kept = np.flatnonzero(found >= 0)
            code, row = found[kept], row[kept]
            value = np.ones(len(kept)) if values is None else values[kept]
            many = self.start[code + 1] - self.start[code]
            ends = np.cumsum(many)
            edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + 1, CELLS)), len(code)))
            for lo, hi in zip(np.append(0, edges[:-1]), edges):
                m = many[lo:hi]
                if m.sum():
                    at = np.repeat(self.start[code[lo:hi]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    out += np.bincount(self.asking[at] * n_rows + np.repeat(row[lo:hi], m), self.weight[at] * np.repeat(value[lo:hi], m), len(out))
        return out.reshape(self.n, n_rows)
