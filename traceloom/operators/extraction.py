"""Typed rows out of a model's answers: JSON recovery, field rules, provenance, doubtful texts.

Defined results: an answer without readable JSON gives one error row and no evidence; ``[]`` is a
success without rows; a single object counts as a list of one; unknown fields are ignored; the
true source and chunk always replace what an answer claims.
"""

from __future__ import annotations

import json as json_module
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.config import ENTITY_TYPES, SETTINGS
from traceloom.functions.text import strip, word_overlap

_ITEM = "entity_type string, entity_id string, text string, linked_requirement string, author string, timestamp string"
_FENCE = r"(?s)```(?:json)?\s*(\[.*?\]|\{.*?\})\s*```"
_BARE = r"(?s)(\[.*?\]|\{.*?\})"


def recover_json(answer: Column) -> Column:
    """The JSON of an answer: the whole of it, else a fenced block, else the first bracketed part; NULL if none can be read."""
    whole, fenced, bare = strip(answer), F.regexp_extract(answer, _FENCE, 1), F.regexp_extract(answer, _BARE, 1)
    readable = lambda t: F.when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(readable(whole), readable(fenced), readable(bare))


def read_answer(answer: str | None) -> tuple[list[dict] | None, list[str]]:
    """(valid items, errors) of one answer, by the rules of ``validate``; None: no readable JSON.  For loops that ask a model again."""
    text = (answer or "").strip()
    parts = [text] if text[:1] in ("[", "{") else []
    parts += [m.group(1) for p in (_FENCE, _BARE) if (m := re.search(p, answer or ""))]
    for part in parts:
        try:
            read = json_module.loads(part)
        except ValueError:
            continue
        valid, errors = [], []
        for i, x in enumerate(read if isinstance(read, list) else [read]):
            filled = lambda k: str(x.get(k) or "").strip() != ""  # noqa: B023, E731 - used at once
            what = "not an object" if not isinstance(x, dict) else "invalid entity_type" if str(x.get("entity_type") or "").strip().upper() not in ENTITY_TYPES else "empty entity_id" if not filled("entity_id") else "empty text" if not filled("text") else ""
            errors.append(f"item {i}: {what}") if what else valid.append(x)
        return valid, errors
    return None, ["no JSON found"]


def items(json: Column) -> Column:
    """A list of typed items; an object is a list of one."""
    listed = F.when(json.startswith("{"), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json)
    return F.from_json(listed, f"array<struct<{', '.join(x.replace(' ', ':') for x in _ITEM.split(', '))}>>")


def item_error(item: Column) -> Column:
    """What is wrong with an item; NULL if nothing is."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    return (
        F.when(item.isNull(), "not an object")
        .when(~F.coalesce(F.upper(strip(item["entity_type"])).isin(*ENTITY_TYPES), F.lit(False)), "invalid entity_type")
        .when(blank(item["entity_id"]), "empty entity_id")
        .when(blank(item["text"]), "empty text")
    )


def validate(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``answers``: raw_response, source_document, chunk_id, source_text.  (evidence rows, error rows)."""
    read = answers.withColumn("_json", recover_json(F.col("raw_response")))
    none = read.filter("_json is null").select("source_document", "chunk_id", F.lit("no JSON found").alias("error"))
    each = read.filter("_json is not null").withColumn("_item", F.explode(items(F.col("_json")))).withColumn("error", item_error(F.col("_item")))
    bad = each.filter("error is not null").select("source_document", "chunk_id", "error")
    good = each.filter("error is null")
    overlap = word_overlap(F.col("_item.text"), F.coalesce("source_text", F.lit("")))
    rows = good.withColumn("_o", F.round(overlap, 3)).select(
        F.upper(strip(F.col("_item.entity_type"))).alias("entity_type"), strip(F.col("_item.entity_id")).alias("entity_id"), strip(F.col("_item.text")).alias("text"),
        F.when(strip(F.col("_item.linked_requirement")) != "", F.col("_item.linked_requirement")).alias("linked_requirement"),
        "source_document", "chunk_id", F.col("_item.author").alias("author"), F.col("_item.timestamp").alias("timestamp"),
        F.col("_o").alias("word_overlap_ratio"), (F.col("_o") < SETTINGS.min_word_overlap).alias("hallucination_risk"),
    )
    return rows, none.unionByName(bad)


def error_list(errors: Column) -> Column:
    """Errors as a bullet list for the next attempt."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
