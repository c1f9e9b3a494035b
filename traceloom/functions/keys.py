"""Keys that compare equal although they are spelt unevenly."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OUTER_SPACE = r"(?U)^[\s\p{Z}\uFEFF]+|[\s\p{Z}\uFEFF]+$"


def strip(text: Column) -> Column:
    """Without outer white space of any kind (``trim`` removes only U+0020)."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def id_key(text: Column) -> Column:
    """Identifiers equal but for letter case and outer white space share a key; blank ones have none."""
    return F.nullif(F.lower(strip(text)), F.lit(""))


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()))


def person_key(name: Column) -> Column:
    """Names equal but for letter case, accent encoding, blanks or invisible characters share a key; blank: NULL.

    Only names with characters outside ASCII go through Python, as Spark has no Unicode composition.
    """
    seen = F.regexp_replace(name, r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠍︀-️]", "")
    spaced = F.trim(F.regexp_replace(seen, r"(?U)[\s\p{Z}\p{Cc}]+", " "))
    other = _compose(F.when(spaced.rlike(r"[^\x00-\x7f]"), spaced))
    return F.nullif(F.coalesce(other, F.lower(spaced)), F.lit(""))
