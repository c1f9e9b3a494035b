"""Retrieval: metadata filters, exact vector search, BM25, identifier matches, and their merge.

All queries run at once, as a table.  Null or empty vectors and texts match nothing; ties are ordered by
the row's id; duplicates of a pair merge with their highest scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.config import SETTINGS
from traceloom.functions.text import round4, tokens
from traceloom.operators.blocks import Postings, block_top_k, query_blocks

PRESETS = {"implementation": ("PYTHON", "GIT"), "evaluation": ("PDF", "DOCX"), "discussion": ("WHATSAPP", "EMAIL")}


def metadata_filter(source_types: list[str] | None = None, source_document: str | None = None, project: str | None = None, since: datetime | None = None, until: datetime | None = None) -> Column | None:
    """A conjunction over chunk columns that reaches the scan; None without any condition."""
    parts = []
    if source_types:
        parts.append(F.col("source_type").isin(*source_types))
    if source_document:
        parts.append(F.col("source_document") == source_document)
    if project:
        parts.append(F.col("metadata")["project"] == project)
    if since:
        parts.append(F.col("created_at") >= F.lit(since))
    if until:
        parts.append(F.col("created_at") <= F.lit(until))
    return reduce(lambda a, b: a & b, parts) if parts else None


# ---- vectors ---------------------------------------------------------------------------------------------


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def _query_vectors(block: pd.DataFrame) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, np.float64) for v in block["vector"]]))


def _cosine(queries: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
    vectors = rows.column(1)
    return np.maximum(queries @ _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)).T, 0.0)


def vector_top_k(queries: DataFrame, rows: DataFrame, k: int = SETTINGS.retrieval_top_k, where: Column | None = None, query_block: int = 4096) -> DataFrame:
    """Exact cosine search; ``queries`` (query_id, vector), ``rows`` (row_id, vector); similarities below 0 count as 0.

    ``where`` filters the rows before the best ``k`` are taken.  Vectors of norm 0 match nothing, null and empty ones are left out.
    """
    kept = rows.filter(where) if where is not None else rows
    usable = F.size("vector") > 0
    return block_top_k(queries.select("query_id", "vector").filter(usable), kept.select("row_id", "vector").filter(usable), _query_vectors, _cosine, k, query_block)


# ---- BM25 ------------------------------------------------------------------------------------------------


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (row_id, text) to (row_id, terms, counts, length): each document counts its own terms, without a shuffle."""
    id_type = docs.schema["row_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            n = np.diff(words.offsets.to_numpy()) if len(words) else np.zeros(0, np.int64)
            flat = words.flatten().dictionary_encode()
            size = max(1, len(flat.dictionary))
            code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            pair, times = np.unique(np.repeat(np.arange(len(n)), n) * size + code, return_counts=True)
            ends = pa.array(np.searchsorted(pair // size, np.arange(len(n) + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, flat.dictionary.take(pa.array(pair % size)) if len(pair) else pa.array([], pa.string()))
            counts = pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, counts, pa.array(n, pa.int32())], ["row_id", "terms", "counts", "length"])

    return docs.select("row_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words")).mapInArrow(count, f"row_id {id_type}, terms array<string>, counts array<int>, length int")


def term_statistics(counted: DataFrame, epsilon: float = SETTINGS.bm25_epsilon) -> DataFrame:
    """(term, df, idf) over the whole corpus; a negative idf becomes ``epsilon`` times the mean idf over all terms."""
    n = counted.agg(F.count(F.lit(1)).alias("_n"))
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("_mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("_mean")).otherwise(F.col("raw")).alias("idf"))  # one row


def _bm25(rows_average: tuple[Postings, float], rows: pa.RecordBatch) -> np.ndarray:
    postings, average = rows_average
    k1, b = SETTINGS.bm25_k1, SETTINGS.bm25_b
    terms, counts, length = rows.column(1), rows.column(2), rows.column(3).to_numpy(zero_copy_only=False)
    base = k1 * (1 - b + b * length / average) if average else np.full(len(length), k1)
    n = counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    each = np.repeat(base, np.diff(counts.offsets.to_numpy()))
    out = postings.sums(terms, n * (k1 + 1) / (n + each), len(length))
    return np.where(out > 0, out, np.nan)


def bm25_top_k(queries: DataFrame, counted: DataFrame, statistics: DataFrame, k: int = SETTINGS.retrieval_top_k, where: Column | None = None, query_block: int = 4096, rows: DataFrame | None = None) -> DataFrame:
    """``queries`` (query_id, text) against documents counted by ``term_counts``; a repeated query term counts each time.

    ``where``, or ``rows`` (some of the counted documents), filters after the statistics were taken over all of them.
    """
    average = counted.agg(F.avg("length")).first()[0] or 0.0
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    weighted = terms.join(statistics.select("term", "idf"), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("n") * F.col("idf")).alias("w"))).alias("_t"))
    weighted = weighted.select("query_id", F.transform("_t", lambda t: t["term"]).alias("terms"), F.transform("_t", lambda t: t["w"]).alias("weights"))
    kept = rows if rows is not None else counted.filter(where) if where is not None else counted
    prepare = lambda block: (Postings(list(block["terms"]), list(block["weights"])), average)
    return block_top_k(weighted, kept.select("row_id", "terms", "counts", "length"), prepare, _bm25, k, query_block)


def index_size(counted: DataFrame) -> DataFrame:
    """One row: whether the index holds a document, how many, and how many with at least one term."""
    n = F.count(F.lit(1))
    return counted.agg((n > 0).alias("is_built"), n.alias("n_documents"), F.count_if(F.col("length") > 0).alias("n_with_terms"))


def min_max(df: DataFrame, group: str, score: str, out: str) -> DataFrame:
    """Scores of a group brought to 0..1; a group of equal scores is 1 throughout.  Pre-aggregated, joined by group."""
    ends = df.groupBy(group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(ends, group).withColumn(out, scaled).drop("_lo", "_hi")


# ---- identifiers -----------------------------------------------------------------------------------------


def id_matches(ids: DataFrame, docs: DataFrame, id_block: int = 50_000) -> DataFrame:
    """Every (query_id, row_id) whose text holds the id as a substring, whatever the case; blank ids match nothing.

    ``ids`` (query_id string), ``docs`` (row_id, text).  Ids go out in blocks of fixed size, each as one automaton that reads
    a text once, where it lies, for all its ids; texts are neither shuffled nor copied.
    """
    spark = docs.sparkSession
    kept = ids.filter(F.length(F.trim("query_id")) > 0).select("query_id").distinct()
    schema = f"query_id string, row_id {docs.schema['row_id'].dataType.simpleString()}"
    texts = docs.filter(F.col("text").isNotNull()).select("row_id", F.lower("text").alias("_text"))
    parts = []
    for block in query_blocks(kept, "query_id", id_block):
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast(list(block["query_id"]))

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            spelt: dict[str, list[str]] = {}
            for x in sent.value:
                spelt.setdefault(x.lower(), []).append(x)
            automaton = ahocorasick.Automaton()
            for low, names in spelt.items():
                automaton.add_word(low, names)
            automaton.make_automaton()
            for batch in batches:
                take, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for name in {x for _, names in automaton.iter(text) for x in names}:
                        take.append(i)
                        found.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(take, pa.int64()))], ["query_id", "row_id"])

        parts.append(texts.mapInArrow(match, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


# ---- merge -----------------------------------------------------------------------------------------------


def combined_score(vector: Column, bm25: Column, id_match: Column) -> Column:
    """Weighted sum where both scores are there, else the one that is; an identifier match lifts to at least the boost."""
    v, has_v = F.coalesce(vector, F.lit(0.0)), F.coalesce(vector > 0, F.lit(False))
    base = F.when(has_v & bm25.isNotNull(), SETTINGS.vector_weight * v + SETTINGS.bm25_weight * bm25).when(has_v, v).otherwise(F.coalesce(bm25, F.lit(0.0)))
    lifted = F.when(F.coalesce(id_match, F.lit(False)), F.greatest(base, F.lit(SETTINGS.id_match_boost))).otherwise(base)
    return round4(F.least(lifted, F.lit(1.0)))


def merge(scored: DataFrame, k: int = SETTINGS.retrieval_top_k) -> DataFrame:
    """``scored``: query_id, row_id, vector_score, bm25_score, id_match, method, one row per list a pair is on.

    Keeps the best ``k`` per query, and some more where the query has identifier matches.
    """
    one = scored.groupBy("query_id", "row_id").agg(
        F.max("vector_score").alias("vector_score"),
        F.max("bm25_score").alias("bm25_score"),
        F.bool_or("id_match").alias("id_match"),
        F.array_join(F.array_sort(F.collect_set("method")), ",").alias("retrieval_method"),  # three methods at most
    )
    one = one.withColumn("combined_score", combined_score(F.col("vector_score"), F.col("bm25_score"), F.col("id_match")))
    any_id = one.groupBy("query_id").agg(F.bool_or("id_match").alias("_any"))
    w = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), "row_id")
    top = one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + SETTINGS.id_match_extra)
    return top.join(any_id, "query_id").filter(F.col("rank") <= k + F.when(F.col("_any"), SETTINGS.id_match_extra).otherwise(0)).drop("_any")


def hybrid(vector: DataFrame, bm25: DataFrame, ids: DataFrame, k: int = SETTINGS.retrieval_top_k) -> DataFrame:
    """The three result lists (query_id, row_id, score) merged; BM25 scores are brought to 0..1 per query first."""
    none = lambda t: F.lit(None).cast(t)
    v = vector.select("query_id", "row_id", F.col("score").alias("vector_score"), none("double").alias("bm25_score"), F.lit(False).alias("id_match"), F.lit("vector").alias("method"))
    b = min_max(bm25, "query_id", "score", "_s").select("query_id", "row_id", none("double").alias("vector_score"), F.col("_s").alias("bm25_score"), F.lit(False).alias("id_match"), F.lit("bm25").alias("method"))
    i = ids.select("query_id", "row_id", none("double").alias("vector_score"), none("double").alias("bm25_score"), F.lit(True).alias("id_match"), F.lit("id_match").alias("method"))
    return merge(v.unionByName(b).unionByName(i), k)


def retrieve(queries: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], where: Column | None = None, source_types: list[str] | None = None, k: int = SETTINGS.retrieval_top_k, stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Hybrid search of all ``queries`` (query_id, text; an id that texts hold counts as a match) over ``chunks`` (row_id, text and filter columns).

    ``where`` filters vector and identifier matches; keyword search honours ``source_types`` alone, after its statistics.  A
    free-text search is a table of one query, whose id no text holds.  ``stored`` keeps the counted terms (a checkpoint), as they are read three times.
    """
    asked = queries.filter(F.length(F.trim("text")) > 0)
    kinds = F.col("source_type").isin(*source_types) if source_types else None
    both = where if kinds is None else kinds if where is None else where & kinds
    kept = chunks.filter("text is not null")
    seen = kept.filter(both) if both is not None else kept
    vector = vector_top_k(asked.withColumn("vector", embed(F.col("text"))), seen.withColumn("vector", embed(F.col("text"))), k)
    counted = stored(term_counts(kept))
    searched = counted if kinds is None else counted.join(kept.filter(kinds).select("row_id"), "row_id", "left_semi")
    average_over_all = term_statistics(counted)
    bm25 = bm25_top_k(asked, counted, average_over_all, k) if kinds is None else bm25_top_k(asked, counted, average_over_all, k, rows=searched)
    return hybrid(vector, bm25, id_matches(asked, seen), k)
