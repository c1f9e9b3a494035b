"""Text expressions: tokens, sentences, normal forms, overlaps, marker lists.

All are built-in Column expressions but for Unicode compatibility forms, which Spark lacks; those
go through Arrow, and only rows with characters outside ASCII do.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from traceloom.config import SETTINGS

TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z])"

# Words that mark an evaluation as good or bad, and a claim.
POSITIVE = (
    "excellent", "well-implemented", "well implemented", "good", "satisfactory", "meets expectations", "meets the requirements", "correct", "correctly",
    "complete", "completed", "well-structured", "well structured", "thorough", "impressive", "solid", "strong", "effective", "efficient", "appropriate",
    "demonstrates", "clear understanding", "proficient", "successful", "success",
)
NEGATIVE = (
    "poor", "not implemented", "not complete", "missing", "incomplete", "absent", "unsatisfactory", "inadequate", "lacks", "lacking", "failed", "failure",
    "incorrect", "wrong", "error", "bug", "does not", "didn't", "not found", "not present", "rudimentary", "insufficient", "weak", "minimal",
)
CLAIMS = (
    "we implemented", "we built", "we developed", "we created", "we designed", "was implemented", "was built", "was completed", "was developed", "was created",
    "implemented by", "built by", "is implemented", "has been implemented",
)
CONVERSATIONAL = (".txt", "whatsapp", "chat", "email", ".eml")
SCORE = r"(?i)(\d+(?:\.\d+)?)\s*/\s*10|Score:\s*(\d+(?:\.\d+)?)"


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits and underscores with inner hyphens, in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def word_overlap(part: Column, whole: Column) -> Column:
    """The share of the distinct words of ``part`` that ``whole`` has too; 1 if either has none."""
    a, b = word_set(part), word_set(whole)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def sentences(text: Column) -> Column:
    """Cut after a full stop, question or exclamation mark that an ASCII capital follows; blank ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Cut at blank lines; blank paragraphs dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda s: s != "")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(text: Column) -> Column:
    """Compatibility form, at most one blank line in a row, single spaces within lines, no outer white space."""
    form = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
    return strip(F.regexp_replace(F.regexp_replace(form, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def chunk_id(source_hash: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("::", source_hash, index.cast("string")), 256)


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text holds one of the markers as a substring, whatever the case; null: false."""
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(m) for m in markers)), F.lit(False))


def scores(text: Column) -> Column:
    """The marks written as ``n/10`` or ``Score: n``, from left to right."""
    first = F.regexp_extract_all(text, F.lit(SCORE), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(SCORE), F.lit(2))
    return F.transform(F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b)), lambda x: x.cast("double"))


def round4(value: Column) -> Column:
    """Four decimal places; what lies within 1e-9 below a half rounds up, so that the order of additions does not show."""
    return F.round(value + 1e-9, 4)


def is_positive(text: Column) -> Column:
    return contains_any(text, POSITIVE) | F.coalesce(F.exists(scores(text), lambda s: s >= SETTINGS.negative_score_below), F.lit(False))


def is_negative(text: Column) -> Column:
    return contains_any(text, NEGATIVE) | F.coalesce(F.exists(scores(text), lambda s: s < SETTINGS.negative_score_below), F.lit(False))


def is_claim(text: Column, source: Column) -> Column:
    """A claim of work done that comes from a conversation."""
    return contains_any(text, CLAIMS) & contains_any(source, CONVERSATIONAL)
