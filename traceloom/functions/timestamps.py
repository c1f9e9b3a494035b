"""One UTC instant out of many written forms.

An ordered cascade of anchored patterns rewrites each text into one canonical
``|``-separated record (one regex replacement for the pattern that matched), and a
strict constructor builds the instant.  Everything is a built-in Column expression,
so the whole parse stays inside code generation.

Defined results
* null, blank, damaged or impossible values (30 February, month 13) give NULL;
* a value without zone is local to the given default zone, NULL if that is unknown;
* a local time that occurs twice means the first one (the offset before the change);
* a local time skipped by a change of clocks is moved forward by the length of the
  gap (``gap_policy="shift"``) or gives NULL (``gap_policy="null"``);
* a date alone is the start of that local day, parts that are not written are zero;
* two-digit years 00-69 are 20xx, 70-99 are 19xx.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month words of English, German, French and Spanish, and zone abbreviations.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene",
    2: "feb february februar février fevrier févr fevr febrero",
    3: "mar march märz maerz mrz mär mars marzo",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october okt oktober octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dez dezember décembre decembre déc diciembre dic",
}
ABBREVIATIONS = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "wet": "+00:00", "west": "+01:00", "bst": "+01:00",
    "cet": "+01:00", "mez": "+01:00", "cest": "+02:00", "mesz": "+02:00", "eet": "+02:00", "eest": "+03:00", "msk": "+03:00",
    "ist": "+05:30", "jst": "+09:00", "kst": "+09:00", "aest": "+10:00", "aedt": "+11:00",
    "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00",
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"  # hour, minute, second, fraction
_AMPM = r"(?:\s*([ap])\.?\s?m\.?)?"
_ZONE = r"(?:\s*(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}))?(?:\s*\[([a-z]+(?:[/_+-][a-z0-9]+)*)\])?"
_CLOCK = _TIME + r"(?:\s*uhr|\s*h)?" + _AMPM + r"(?:\s*uhr)?" + _ZONE
_DAYNAME = r"(?:[\p{L}]{2,10}\.?,?\s+)?"
_WORD = r"([\p{L}]{3,10})\.?"


@dataclass(frozen=True)
class Form:
    """An anchored pattern and the canonical record ``kind|year|month|day|h|mi|s|frac|ap|zone|iana`` it becomes."""

    name: str
    pattern: str
    record: str


FORMS = (
    Form("iso", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:(?:t|,?\s+)" + _CLOCK + r")?$", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    Form("compact", r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?" + _ZONE + r")?$", "ymd|$1|$2|$3|$4|$5|$6|||$7|$8"),
    Form("dotted", r"^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4}|\d{2})(?:,?\s+(?:um\s+)?" + _CLOCK + r")?$", "ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    Form("slashed", r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})(?:,?\s+" + _CLOCK + r")?$", "any|$4|$1|$3|$5|$6|$7|$8|$9|$10|$11"),
    Form("ctime", r"^[\p{L}]{2,10}\.?,?\s+" + _WORD + r"\s+(\d{1,2}),?\s+" + _TIME + r"(?:\s+([a-z]{1,5}))?\s+(\d{4})" + _ZONE + r"$", "ymd|$8|$1|$2|$3|$4|$5|$6||$7$9|$10"),
    Form("month_first", r"^" + _DAYNAME + _WORD + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:,?\s+(?:at\s+)?" + _CLOCK + r")?$", "ymd|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    Form("day_first", r"^" + _DAYNAME + r"(\d{1,2})(?:st|nd|rd|th|\.)?(?:\s+|-)(?:de\s+)?" + _WORD + r"(?:\s+|-)(?:de\s+)?(\d{4})(?:,?\s+(?:at\s+|um\s+|à\s+|a\s+las\s+)?" + _CLOCK + r")?$", "ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
)
WRITTEN_ZONE = r"\[([A-Za-z]+(?:[/_+-][A-Za-z0-9]+)*)\][\s\p{Cf}]*$"
EPOCH = r"^@?(\d{10}|\d{13}|\d{16})(?:\.(\d{1,6})\d*)?(?:\s+[+-]\d{4})?$"


def clean(text: Column) -> Column:
    """Lower case, plain single spaces, without marks of writing direction, outer brackets or blanks."""
    plain = F.regexp_replace(F.lower(text), r"\p{Cf}", "")
    plain = F.regexp_replace(plain, r"(?U)[\s\p{Z}]+", " ")
    return F.trim(F.regexp_replace(F.trim(plain), r"^\[([^\[\]]+)\]$", "$1"))


def canonical(text: Column) -> Column:
    """The fields of the first pattern that matches, as an array of 11 strings; NULL if none does."""
    cases = [F.when(text.rlike(f.pattern), F.regexp_replace(text, f.pattern, f.record)) for f in FORMS]
    return F.split(F.coalesce(*cases), r"\|")


def _month(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in words.split() for x in (w, n)])
    return F.coalesce(F.try_element_at(table, word), word.try_cast("int"))


def _zone(written: Column, iana: Column, default: Column) -> Column:
    """``iana``: a zone in brackets, in the letter case it was written in.  An offset wins over a named zone, a named zone over the default; an unknown abbreviation gives NULL."""
    digits = F.regexp_replace(written, r"^(?:utc|gmt)", "")
    offset = F.when(digits.rlike(r"^[+-]\d{1,2}$"), F.concat(F.substring(digits, 1, 1), F.lpad(F.substring(digits, 2, 2), 2, "0"), F.lit(":00"))).when(
        digits.rlike(r"^[+-]\d{2}:?\d{2}$"), F.regexp_replace(digits, r"^(...):?(..)$", "$1:$2")
    )
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    titled = F.concat_ws("/", F.transform(F.split(F.lower(iana), "/"), lambda p: F.regexp_replace(F.initcap(F.regexp_replace(p, "_", " ")), " ", "_")))
    named = F.when(F.upper(iana).isin("UTC", "GMT", "Z"), F.lit("UTC")).when(iana == F.lower(iana), titled).otherwise(iana)
    return F.when(F.length(written) > 0, F.coalesce(offset, F.try_element_at(table, written))).when(F.length(iana) > 0, named).otherwise(default)


def _number(text: Column) -> Column:
    return F.when(F.length(text) > 0, text.try_cast("int")).otherwise(F.lit(0))


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(F.length(text) > 2, y).when(y < 70, y + 2000).otherwise(y + 1900)


def fields(df: DataFrame, text: str, prefix: str = "_ts") -> DataFrame:
    """Adds the cleaned text, its canonical record, and the bracketed zone as written (names of zones keep their letter case); the text is parsed once."""
    out = df.withColumn(f"{prefix}_text", clean(F.col(text))).withColumn(f"{prefix}_iana", F.when(F.col(text).contains("/") & F.col(text).contains("["), F.regexp_extract(text, WRITTEN_ZONE, 1)))
    return out.withColumn(f"{prefix}_rec", canonical(F.col(f"{prefix}_text")))


def instant_micros(df: DataFrame, default_zone: Column, month_first: Column, prefix: str = "_ts", gap_policy: str = "shift") -> Column:
    """Microseconds since the epoch of a record made by ``fields``.

    ``month_first`` decides the order of slashed dates and is looked at only there.
    """
    rec = F.col(f"{prefix}_rec")
    part = lambda i: rec[i]
    swap = (part(0) == "any") & ~F.coalesce(month_first, F.lit(False))
    month = F.when(swap, part(3).try_cast("int")).otherwise(_month(part(2)))
    day = F.when(swap, part(2).try_cast("int")).otherwise(part(3).try_cast("int"))
    hour, ap = _number(part(4)), part(8)
    hour = F.when(F.length(ap) == 0, hour).when(hour.between(1, 12), hour % 12 + F.when(ap == "p", 12).otherwise(0))
    second = F.concat(F.when(F.length(part(6)) > 0, part(6)).otherwise(F.lit("0")), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"))
    second = F.when(_number(part(6)) < 60, second.try_cast("decimal(8,6)"))
    zone = _zone(part(9), F.when(F.length(part(10)) > 0, F.coalesce(F.nullif(F.col(f"{prefix}_iana"), F.lit("")), part(10))).otherwise(part(10)), default_zone)
    build = lambda z: F.try_make_timestamp(_year(part(1)), month, day, hour, _number(part(5)), second, z)
    made = build(zone)
    if gap_policy == "null":
        made = F.when(F.from_utc_timestamp(made, zone) == build(F.lit("UTC")), made)
    text = F.col(f"{prefix}_text")
    whole = F.regexp_extract(text, EPOCH, 1)
    scale = F.when(F.length(whole) == 10, 1_000_000).when(F.length(whole) == 13, 1_000).otherwise(1)
    rest = F.when(F.length(whole) == 10, F.rpad(F.regexp_extract(text, EPOCH, 2), 6, "0").try_cast("bigint")).otherwise(0)
    return F.when(text.rlike(EPOCH), whole.try_cast("bigint") * scale + rest).otherwise(F.unix_micros(made))


def source_conventions(df: DataFrame, text: str, source: str, near: str | None) -> DataFrame:
    """(source, month_first): whether the slashed dates of a source put the month first.

    All lines of a source keep one order.  Evidence is weighed in this order: lines of
    which only one order exists; the order that lies nearer to the time of delivery
    (``near``); the order that gives the shorter total span; a 12-hour clock.  Partial
    aggregates do all of it, so a source of any size shuffles as one row per task.
    """
    slashed = next(f for f in FORMS if f.name == "slashed")
    at = F.datediff(F.to_date(F.col(near)), F.lit("1970-01-01").cast("date")) if near else F.lit(None).cast("int")
    rows = df.select(F.col(source).alias("source"), clean(F.col(text)).alias("t"), at.alias("at")).filter(F.col("t").rlike(slashed.pattern) & F.col("source").isNotNull())
    rows = rows.select("source", "at", F.split(F.regexp_replace("t", slashed.pattern, slashed.record), r"\|").alias("rec"))
    rec = F.col("rec")
    a, b, y = rec[2].try_cast("int"), rec[3].try_cast("int"), _year(rec[1])
    zero = F.lit(0)
    day = lambda m, d: F.datediff(F.to_date(F.try_make_timestamp(y, m, d, zero, zero, zero.cast("decimal(8,6)"), F.lit("UTC"))), F.lit("1970-01-01").cast("date"))
    rows = rows.select("source", "at", day(b, a).alias("dmy"), day(a, b).alias("mdy"), (F.length(rec[8]) > 0).alias("twelve"))
    dmy, mdy, at = F.col("dmy"), F.col("mdy"), F.col("at")
    off_d, off_m = F.abs(at - dmy), F.abs(at - mdy)
    votes = rows.groupBy("source").agg(
        (F.count_if(dmy.isNull() & mdy.isNotNull()) - F.count_if(mdy.isNull() & dmy.isNotNull())).alias("only"),
        (F.count_if(off_m < off_d) - F.count_if(off_d < off_m)).alias("near"),
        ((F.max(dmy) - F.min(dmy)) - (F.max(mdy) - F.min(mdy))).alias("span"),
        F.bool_or("twelve").alias("twelve"),
    )
    sign = F.when(F.col("only") != 0, F.col("only")).when(F.col("near") != 0, F.col("near")).when(F.col("span") != 0, F.col("span"))
    return votes.select("source", F.coalesce(sign > 0, F.col("twelve"), F.lit(False)).alias("month_first"))


def normalise(df: DataFrame, text: str, source: str, zones: DataFrame, near: str | None = None, out: str = "utc_micros", gap_policy: str = "shift") -> DataFrame:
    """``df`` with one more column ``out``, the instant in microseconds (NULL: unreadable).

    ``zones`` has the columns ``filename`` and ``zone_name``.  Rows of a source that it
    does not hold, or with a null source, are read only if they write their own zone.
    The look-up has one row per source and joins by that key; which join is used is left to the
    optimiser, which knows the side's size (adaptive execution splits a hot source).
    """
    p = "_ts"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    parsed = fields(df, text, p)
    orders = source_conventions(df, text, source, near)
    zone = zones.filter(F.col("filename").isNotNull()).groupBy(F.col("filename").alias("source")).agg(F.min("zone_name").alias("zone"))
    look_up = zone.join(orders, "source", "full_outer").select(F.col("source").alias(f"{p}_source"), F.col("zone").alias(f"{p}_zone"), F.col("month_first").alias(f"{p}_month_first"))
    joined = parsed.join(look_up, F.col(source) == F.col(f"{p}_source"), "left")
    made = instant_micros(joined, F.col(f"{p}_zone"), F.col(f"{p}_month_first"), p, gap_policy)
    return joined.withColumn(out, made).drop(*[f"{p}_{c}" for c in ("text", "rec", "iana", "source", "zone", "month_first")])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
