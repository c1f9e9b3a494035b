"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled rows predicts for every text its posterior over the sources.  It is fitted
in two folds, each predicting the other's texts, and its sharpness is set by the log-likelihood of labels it has not seen.  A
stated source enters as one more observation, wrong with probability ``STATED_ERROR``, so a text's membership is soft whether its
source is stated or not.  Nonnegative rates per text are fitted by projected-gradient least squares, so that the
expected token totals per source match the targets; a rate is the expected number of uses and never exceeds the
allowed repeats.  Rates become whole uses by systematic sampling over texts sorted by length.

Every pass is one aggregation to a row per source over stored memberships.  The gradients so far are a short list on
the driver and a text's rate is a pure function of them and its membership, so nothing is kept per
text between passes and no lineage grows.

Defined results: equal texts are one text, their uses count together and the smallest id stands for
them; source names match but for letter case and outer white space; a text's repeats are bounded by those of its stated source (of several, the least), else of
its likeliest, and it counts for that source in the report (of several, that of the smallest id); texts of a source without target are not drawn, nor are null, blank and token-free texts; a source without texts stays at zero; a source too small for
its share is used as often as allowed and the report shows what it reached; an empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.keys import id_key
from traceloom.llm.tokens import VOCABULARY, token_ids
from traceloom.plans.lineage import checkpoint

FEATURES, LABELLED_PER_SOURCE, MAX_PASSES, TOLERANCE, PART_ROWS = 4096, 1000, 25, 5e-4, 100_000
STATED_ERROR = 0.001  # how often a stated source is taken to be wrong; larger values let the words outvote it, and shares by stated source drift
SHARPNESS = (0.0, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)  # what the mean log-likelihood of a token may be multiplied with


Features = tuple[np.ndarray, np.ndarray]


def _features(ids: list[int]) -> Features:
    """The tokens of a whole text by bucket: (buckets, square roots of how often each occurs)."""
    counts = np.bincount(np.asarray(ids, np.int64) % FEATURES, minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at])


@dataclass
class Sources:
    """Log priors, log-likelihoods per fold, feature and source, and the sharpness that fits unseen labels best."""

    names: list[str]
    prior: np.ndarray
    words: np.ndarray
    sharpness: float = 1.0

    def scores(self, x: Features, fold: int | None) -> np.ndarray:
        """The mean log-likelihood of a token per source, by the fold that did not see the text (None: by both); a mean, so long texts are no surer than they are right."""
        at, n = x
        out = n @ self.words[1 if fold is None else 1 - fold][at]
        out = (out + n @ self.words[0][at]) / 2 if fold is None else out
        return out / max(1.0, n.sum())

    def posterior(self, x: Features, fold: int, stated: str | None) -> np.ndarray:
        score = self.prior + self.sharpness * self.scores(x, None if stated is None else fold)
        if stated is not None:
            score = score + np.log(STATED_ERROR / max(1, len(self.names) - 1))
            score[self.names.index(stated)] += np.log((1 - STATED_ERROR) / STATED_ERROR * max(1, len(self.names) - 1))
        p = np.exp(score - score.max())
        return p / p.sum()


def fit_sources(docs: DataFrame, names: list[str], text: str, per_source: int = LABELLED_PER_SOURCE, path: str = VOCABULARY) -> Sources:
    """A multinomial model of tokens in two folds (``_fold``), fitted on about ``per_source`` labelled texts of each source at most.

    They are chosen by the hash of the text (``_hash``); that bound holds at every size, what comes to the driver is sources x features.  Priors come from all rows.
    """
    labelled = docs.filter(F.col("_label").isin(names))
    sizes = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values()) + len(names)
    model = Sources(names, np.log(np.array([(sizes.get(s, 0) + 1) / total for s in names])), np.full((2, FEATURES, len(names)), 0.1))
    if not sizes:
        model.words = np.log(model.words / model.words.sum(axis=1, keepdims=True))
        return model
    share = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, per_source / n))])
    chance = F.pmod(F.xxhash64("_hash", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(chance < F.try_element_at(share, F.col("_label"))).select("_label", "_fold", F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for label, fold, t in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                at, n = _features(token_ids(t or "", path))
                sums.setdefault((label, fold), np.zeros(FEATURES))[at] += n
        for (label, fold), v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array([fold] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["source", "fold", "feature", "weight"])

    place = {s: i for i, s in enumerate(names)}
    for r in sample.mapInArrow(count, "source string, fold int, feature int, weight double").groupBy("source", "fold", "feature").agg(F.sum("weight").alias("w")).collect():
        model.words[r["fold"], r["feature"], place[r["source"]]] += r["w"]
    model.words = np.log(model.words / model.words.sum(axis=1, keepdims=True))

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(SHARPNESS))
        for batch in batches:
            for label, fold, t in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                score = model.prior[:, None] + np.outer(model.scores(_features(token_ids(t or "", path)), fold), SHARPNESS)
                score -= score.max(axis=0)
                loss += np.log(np.exp(score).sum(axis=0)) - score[place[label]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SHARPNESS)), pa.int32()), pa.array(loss)], ["i", "loss"])

    losses = {r["i"]: r["l"] for r in sample.mapInArrow(held_out, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("l")).collect()}
    model.sharpness = SHARPNESS[min(losses, key=lambda i: (losses[i], i))] if losses else 1.0
    return model


def measured(docs: DataFrame, names: list[str], text: str, per_source: int, path: str) -> DataFrame:
    """Per document (doc_id, _hash, _label, _fold): its tokens and its membership in every source, from one pass over the texts."""
    model = docs.sparkSession.sparkContext.broadcast(fit_sources(docs, names, text, per_source, path))
    rows = docs.select("doc_id", "_hash", "_label", "_fold", F.col(text).alias("_text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, members = [], []
            for label, fold, t in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                ids = token_ids(t, path) if t.strip() else []
                lengths.append(len(ids))
                members.append(model.value.posterior(_features(ids), fold, label))
            flat = pa.array(np.concatenate(members) if members else np.zeros(0))
            ends = pa.array(np.arange(len(members) + 1) * len(names), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "_hash", "_label", "n_tokens", "membership"])

    return rows.mapInArrow(measure, f"doc_id {id_type}, _hash binary, _label string, n_tokens bigint, membership array<double>")


def rates(members: np.ndarray, caps: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    """The rates of texts after the given gradient steps, each projected onto [0, cap]; they start at one use, or the cap if that is less."""
    out = np.minimum(1.0, caps)
    for g in gradients:
        out = np.clip(out - members @ g, 0.0, caps)
    return out


def _columns(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """membership, cap and tokens of a batch whose first columns these are."""
    members = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return members, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)


def _totals(texts: DataFrame, n: int, gradients: list[np.ndarray]) -> np.ndarray:
    """Per source: all tokens and the expected tokens."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, n))
        for batch in batches:
            members, caps, tokens = _columns(batch, n)
            out += np.stack([members.T @ tokens, members.T @ (rates(members, caps, gradients) * tokens)])
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * n), pa.int32()), pa.array(out.ravel())], ["i", "v"])

    out = np.zeros(2 * n)
    for r in texts.select("membership", "cap", "n_tokens").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(2, n)


def fit_rates(texts: DataFrame, targets: list[float], passes: int = MAX_PASSES, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The gradient steps that bring the expected totals to ``targets``; ``texts``: membership, cap, n_tokens.

    One aggregation per pass; the step of a source is scaled by its tokens.  The passes end when in every source the residual
    is below ``tolerance`` of all tokens, or the last step, projected onto what the caps allow, changed it by less than a fifth of that.
    """
    goal = np.array(targets)
    allowed = tolerance * max(goal.sum(), 1.0)
    gradients: list[np.ndarray] = []
    last = np.full(len(goal), np.inf)
    for _ in range(passes + 1):
        have, now = _totals(texts, len(goal), gradients)
        done = (np.abs(now - goal) <= allowed) | (np.abs(now - last) <= allowed / 5)
        last = now
        if done.all() or len(gradients) == passes:
            break
        gradients.append((now - goal) / np.maximum(have, 1.0))
    return gradients


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, per_source: int = LABELLED_PER_SOURCE, path: str = VOCABULARY) -> DataFrame:
    """The drawn texts: doc_id, source_name, n_tokens, n_uses (one or more).

    ``targets`` (source_name, target_share, max_repeats) is a table of settings with a row per source.
    The total defaults to the tokens of all documents, repeats included.
    """
    settings = {r["name"]: r for r in targets.select(id_key(F.col("source_name")).alias("name"), "target_share", "max_repeats").filter("name is not null").distinct().collect()}
    names = sorted(settings)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), id_key(F.col(source)).alias("_label"), F.col(text).alias("_text"))
    rows = rows.filter(F.col("_label").isNull() | F.col("_label").isin(names)).withColumn("_hash", F.unhex(F.sha2("_text", 256)))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("_hash"), F.lit(2)).cast("int"))
    caps = F.create_map(*[F.lit(x) for s in names for x in (s, int(settings[s]["max_repeats"] or 0))]) if names else F.create_map().cast("map<string,int>")
    likeliest = lambda m: F.get(F.array(*[F.lit(s) for s in names]), (F.array_position(m, F.array_max(m)) - 1).cast("int"))
    stored = checkpoint(measured(rows, names, "_text", per_source, path).filter("n_tokens > 0").withColumn("cap", F.try_element_at(caps, F.coalesce("_label", likeliest(F.col("membership"))))))
    mean = F.array(*[F.avg(F.col("membership")[i]) for i in range(len(names))])
    texts = checkpoint(stored.groupBy("_hash").agg(F.min(F.struct(F.col("_label").isNull().alias("_u"), "doc_id", "_label"))["_label"].alias("_label"), F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.min("cap").alias("cap"), mean.alias("membership")))
    size = stored.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total = total_tokens or size["t"] or 0
    gradients = fit_rates(texts, [total * float(settings[s]["target_share"] or 0) for s in names])
    n = len(names)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, limit, _ = _columns(batch, n)
            best = members.argmax(axis=1) if len(members) else np.zeros(0, np.int64)
            named = [label or names[i] for label, i in zip(batch.column(5).to_pylist(), best)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array(named, pa.string()), pa.array(np.round(rates(members, limit, gradients), 9))], ["cap", "n_tokens", "doc_id", "_hash", "source_name", "_rate"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    rated = texts.select("membership", "cap", "n_tokens", "doc_id", "_hash", "_label").mapInArrow(rate, f"cap int, n_tokens bigint, doc_id {id_type}, _hash binary, source_name string, _rate double")
    parts = max(1, -(-(size["n"] or 1) // PART_ROWS))
    rated = rated.withColumn("_whole", F.floor("_rate")).withColumn("_rest", F.col("_rate") - F.floor("_rate")).withColumn("_part", F.pmod(F.xxhash64("_hash"), F.lit(parts)))
    # systematic sampling: along the texts of a source by length, a use falls wherever the running sum passes a whole number
    w = Window.partitionBy("source_name", "cap", "_part").orderBy("n_tokens", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source_name", "_part"), F.lit(1000)) / 1000.0
    run = F.round(F.sum("_rest").over(w) + start, 6)
    drawn = rated.withColumn("_run", run).withColumn("_extra", F.floor("_run") - F.floor(F.round(F.col("_run") - F.col("_rest"), 6)))
    uses = F.least(F.col("_whole") + F.col("_extra"), F.col("cap")).cast("int")
    return drawn.select("doc_id", "source_name", "n_tokens", uses.alias("n_uses")).filter("n_uses > 0")


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the target share, the share reached, its texts, tokens and the most uses of one text."""
    per = mixture.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.max("n_uses").alias("most_uses")
    )
    wanted = targets.select(id_key(F.col("source_name")).alias("source_name"), "target_share", "max_repeats").filter("source_name is not null").distinct()
    out = wanted.join(per, "source_name", "left").na.fill(0, ["n_texts", "tokens", "most_uses"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0))
    return out.withColumn("actual_share", F.round(F.coalesce(share, F.lit(0.0)), 6))
