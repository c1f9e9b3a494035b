"""Cutting oversized texts into balanced, overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces is computed, equal-length targets are placed, each is
snapped to the strongest boundary near it, and a piece is added whenever a limit fails
(a piece would be too long, or no natural boundary lies within reach).

Lengths are Unicode code points, as in Spark's ``length``.

Defined results: null, empty and short texts give no pieces (``split_text`` returns the text itself
whole); a text without any boundary is cut between characters, never inside a CR LF pair or before a
combining mark; the pieces without their overlaps join to exactly the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1500, 150

# Boundaries as (strength, pattern); the cut lies at the end of the match.  The kinds are the source types.
_EOL = r"(?:\r\n|\r|\n)"
GENERAL = (
    (5, _EOL + r"(?:[ \t ]*" + _EOL + r")+"),
    (4, _EOL),
    (3, r"[.!?…]+[\"'»”)\]]*\s+|[。！？；]+[”」）]*"),
    (2, r"[;:,]\s+|[，、：]"),
    (1, r"\s+|​"),
)
KINDS = {
    "PYTHON": ((7, _EOL + r"(?=(?:@|async def |def |class )\S)"), (6, _EOL + r"(?=[ \t]+(?:@|async def |def |class )\S)")),
    "MARKDOWN": ((7, _EOL + r"(?=#{1,6}\s)"),),
    "WHATSAPP": ((6, _EOL + r"(?=\[?\d{1,2}[./]\d{1,2}[./]\d{2,4},)"),),
    "EMAIL": ((7, _EOL + r"(?=From: )"), (6, _EOL + r"(?:-{3,}|_{3,}|={3,})[^\r\n]*" + _EOL)),
    "GIT": ((7, _EOL + r"(?=commit [0-9a-f]{7,40}\b|SHA: )"),),
}
_COMPILED = {kind: [(s, re.compile(p)) for s, p in (*KINDS.get(kind, ()), *GENERAL)] for kind in (*KINDS, "")}
_FENCE = re.compile(r"^(?:```|~~~).*?(?:^(?:```|~~~)[^\n]*$|\Z)", re.M | re.S)


def boundaries(text: str, kind: str) -> tuple[list[int], list[int]]:
    """Sorted positions where the text may be cut, with their strengths."""
    found: dict[int, int] = {}
    for strength, pattern in reversed(_COMPILED.get(kind, _COMPILED[""])):
        for m in pattern.finditer(text):
            found[m.end()] = strength
    if kind == "MARKDOWN" and ("```" in text or "~~~" in text):
        for m in _FENCE.finditer(text):
            for p in [p for p in found if m.start() < p < m.end()]:
                found[p] = min(found[p], 4)
    found.pop(len(text), None)
    found.pop(0, None)
    at = sorted(found)
    return at, [found[p] for p in at]


def _parts(text: str, p: int) -> bool:
    """Whether a cut at ``p`` parts a character."""
    return p < len(text) and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍" or text[p - 1 : p + 1] == "\r\n")


def _between_characters(text: str, at: int, least: int) -> int:
    """The nearest position not above ``at`` that parts no character."""
    p = at
    while p > least and _parts(text, p):
        p -= 1
    return p if p > least else at


def _from_character(text: str, at: int, most: int) -> int:
    """The nearest position from ``at`` to ``most`` that parts no character."""
    while at < most and _parts(text, at):
        at += 1
    return at


def _cut(text: str, at: list[int], strength: list[int], n: int, size: int, overlap: int, must: bool) -> list[tuple[int, int]] | None:
    """(start, end) of ``n`` pieces; None if a limit fails.  ``must``: cut between characters where no boundary is in reach."""
    total, start, pieces, done = len(text), 0, [], 0
    for i in range(n - 1):
        length = (total - start + (n - i - 1) * overlap) / (n - i)  # of this and all later pieces, if equal
        target = start + length
        reach = max(40.0, length * 0.35)
        high = min(start + size, int(target + reach), total - 1)
        low = max(done + 1, int(target - reach), total - (n - i - 1) * (size - overlap))
        if low > high:
            return None
        a, b = bisect_left(at, low), bisect_right(at, high)
        best = max(range(a, b), key=lambda j: (strength[j] - 3.0 * abs(at[j] - target) / length, -at[j]), default=None)
        if best is None:
            if not must:
                return None
            end = _between_characters(text, min(high, max(low, int(target))), low)
        else:
            end = at[best]
        pieces.append((start, end))
        done, floor_ = end, max(end - overlap, start + 1)
        a, b = bisect_left(at, floor_), bisect_left(at, end)
        back = max(range(a, b), key=lambda j: (min(strength[j], 3), -at[j]), default=None)
        start = at[back] if back is not None else _from_character(text, floor_, end)
    if total - start > size:
        return None
    return [*pieces, (start, total)]


def _steps(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as long as possible, cut between characters."""
    pieces, start, done = [], 0, 0
    while len(text) - start > size:
        end = _between_characters(text, start + size, max(start, done) + 1)
        pieces.append((start, end))
        done, start = end, _from_character(text, max(end - overlap, start + 1), end)
    return [*pieces, (start, len(text))]


def _added(n: int) -> Iterator[int]:
    """How many pieces more than ``n`` are tried: each number at first, then ever larger steps, to twice the least number."""
    more = 0
    while more < n:
        yield more
        more += max(1, more // 4)


def split_text(text: str, kind: str = "", size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap with the piece before) of each piece."""
    if len(text) <= size:
        return [(0, len(text), 0)]
    at, strength = boundaries(text, kind)
    n = -(-(len(text) - overlap) // (size - overlap))
    strong = dict(zip(at, strength))
    made, mean = None, -1.0
    for more in _added(n):
        if made and more > 1:
            break
        cut = _cut(text, at, strength, n + more, size, overlap, False)
        if not cut and not made and more >= 2:
            cut = _cut(text, at, strength, n + more, size, overlap, True)
        if cut:
            # where the least number leaves no choice of boundaries, one piece more is worth clearly stronger ones
            its = sum(strong.get(e, 0) for _, e in cut[:-1]) / max(1, len(cut) - 1)
            if its >= mean + 1:
                made, mean = cut, its
    # no boundary in reach: balanced targets cut between characters, a piece added as long as a limit fails; fixed steps only where a
    # run of characters that may not be parted fails them all
    for more in _added(n):
        made = made or _cut(text, at, strength, n + more, size, overlap, True)
    made = made or _steps(text, size, overlap)
    return [(s, e, made[i - 1][1] - s if i else 0) for i, (s, e) in enumerate(made)]


SCHEMA = "piece_no int, n_pieces int, piece_text string, start_char int, end_char int, overlap_chars int, char_count int"


def split_oversized(df: DataFrame, key: str, text: str = "chunk_text", kind: str = "source_type", locator: str = "source_locator", size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all texts above ``size``, each with the locator of its text and its true length.

    Short texts are dropped in the scan's stage, before any row goes to Python; there is no shuffle.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the piece")
    rows = df.filter(F.length(text) > size).select(key, F.col(kind).alias("_kind"), F.col(locator).alias("source_locator"), F.col(text).alias("_text"))
    key_type = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, locators, out, take = batch.column(0), batch.column(2), [[] for _ in range(7)], []
            for i, (k, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                pieces = split_text(t, k or "", size, overlap)
                for no, (s, e, o) in enumerate(pieces):
                    take.append(i)
                    for column, value in zip(out, (no, len(pieces), t[s:e], s, e, o, e - s)):
                        column.append(value)
            index = pa.array(take, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [keys.take(index), locators.take(index), *[pa.array(c, t) for c, t in zip(out, kinds)]],
                [key, "source_locator", *[x.split()[0] for x in SCHEMA.split(", ")]],
            )

    return rows.mapInArrow(cut, f"{key} {key_type}, source_locator string, {SCHEMA}")
