"""Documents to ordered chunks.

Packing, joining short pieces and overlapping depend on what came before, so they are folds.  A text of one row is folded in its row;
the element rows of a document are folded by ``ordered_fold``, in as many tasks as their number asks for.

Defined results: null or blank texts give no chunks; indexes run from 0 without gaps; a text without a boundary stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.config import SETTINGS
from traceloom.functions.text import SENTENCE_GAP, strip
from traceloom.operators.folds import ordered_fold

_SENTENCE, _PARAGRAPH = re.compile(SENTENCE_GAP), re.compile(r"\n\s*\n")
_FENCE = re.compile(r"```.*?```|~~~.*?~~~", re.S)


def _filled(parts: list[str]) -> list[str]:
    return [p for p in (x.strip() for x in parts) if p]


def paragraphs(text: str, kind: str = "") -> list[str]:
    """Cut at blank lines; Markdown at empty lines outside fenced code."""
    if kind != "MARKDOWN":
        return _filled(_PARAGRAPH.split(text))
    fences = [m.span() for m in _FENCE.finditer(text)]
    parts, start, at, f = [], 0, text.find("\n\n"), 0
    while at >= 0:
        while f < len(fences) and fences[f][1] <= at:
            f += 1
        if f < len(fences) and fences[f][0] <= at:
            at = text.find("\n\n", fences[f][1])
            continue
        parts.append(text[start:at])
        start = at + 2
        at = text.find("\n\n", at + 1)
    return _filled([*parts, text[start:]]) or [text]


def pack(parts: list[str], size: int = SETTINGS.max_chunk_chars) -> list[str]:
    """Greedy packing: neighbours join with a blank line while they fit; a piece that is too long stays alone."""
    out: list[list[str]] = []
    length = 0
    for p in parts:
        if out and length + len(p) + 2 <= size:
            out[-1].append(p)
            length += len(p) + 2
        else:
            out.append([p])
            length = len(p)
    return ["\n\n".join(x) for x in out]


def split_large(text: str, size: int = SETTINGS.max_chunk_chars, kind: str = "") -> list[str]:
    """Packed paragraphs, or sentences if it is one paragraph; a text within the size stays whole."""
    if len(text) <= size:
        return [text]
    parts = paragraphs(text, kind)
    if len(parts) <= 1:
        parts = _filled(_SENTENCE.split(text))
    return pack(parts, size) if len(parts) > 1 else [text]


# Kinds whose elements are cut once on their own and again with all others, so a long paragraph of theirs ends as sentences.
CUT_TWICE = ("PDF", "PYTHON")


def cut(text: str, size: int, kind: str = "") -> list[str]:
    once = split_large(text, size, kind)
    return [x for p in once for x in split_large(p, size, kind)] if kind in CUT_TWICE else once


class Chunks:
    """The fold: pieces shorter than ``least`` join the one after, the last may stay short; each chunk begins with the end of the one before.

    A join keeps the locator of the first piece, and the later value of a metadata key.  The end is taken of a chunk with its own
    overlap, so short chunks cascade.  State: (open piece, end of the last chunk).
    """

    def __init__(self, size: int, least: int, overlap: int):
        self.size, self.least, self.overlap = size, least, overlap

    def forgets(self, row: dict) -> bool:
        return len(row["text"]) >= max(self.least, self.overlap) and len(cut(row["text"], self.size, row.get("kind") or "")[-1]) >= max(self.least, self.overlap)

    def step(self, state, row: dict) -> tuple:
        opened, tail = state or (None, None)
        made = []
        for text in cut(row["text"], self.size, row.get("kind") or ""):
            locator, metadata = row["locator"], dict(row["metadata"] or [])
            if opened is not None:
                text, locator, metadata = f"{opened[0]}\n\n{text}", opened[1], opened[2] | metadata
            if len(text) < self.least:
                opened = (text, locator, metadata)
                continue
            opened, (tail, out) = None, self._out(tail, text, locator, metadata)
            made.append(out)
        return (opened, tail), made

    def _out(self, tail: str | None, text: str, locator: str, metadata: dict) -> tuple:
        if self.overlap and tail is not None:
            text = f"{tail}\n\n{text}".strip()
        return text[-self.overlap :] if self.overlap else None, (text, locator, list(metadata.items()), len(text))

    def end(self, state) -> list[tuple]:
        opened, tail = state or (None, None)
        return [self._out(tail, *opened)[1]] if opened is not None else []


def chunk_text(text: str, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars, overlap: int = SETTINGS.overlap_chars, kind: str = "") -> list[str]:
    """The chunks of one text."""
    fold = Chunks(size, least, overlap)
    state, made = fold.step(None, {"text": text, "locator": "", "metadata": None, "kind": kind})
    return [x[0] for x in [*made, *fold.end(state)]]


def chunk_documents(docs: DataFrame, key: str, text: str, overlap: bool = True, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars) -> DataFrame:
    """One text per row to (key, chunk_index, chunk_text, char_count); one narrow stage."""
    rows = docs.filter(F.length(strip(F.col(text))) > 0).select(key, F.col(text).alias("_text"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, number, out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, c in enumerate(chunk_text(t, size, least, SETTINGS.overlap_chars if overlap else 0)):
                    take.append(i)
                    number.append(n)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(number, pa.int32()), pa.array(out, pa.string()), pa.array([len(c) for c in out], pa.int32())], [key, "chunk_index", "chunk_text", "char_count"])

    return rows.mapInArrow(chunk, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk_index int, chunk_text string, char_count int")


def chunk_elements(elements: DataFrame, key: str, order: list[str], overlap: bool = True, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars, kind: str = "") -> DataFrame:
    """Element rows (key, order, text, locator, metadata) to chunks of their document, in order: key, chunk_index, chunk_text, source_locator, metadata, char_count."""
    kept = elements.filter(F.length(strip(F.col("text"))) > 0).select(key, *order, strip(F.col("text")).alias("text"), "locator", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.lit(kind).alias("kind"))
    schema = [("chunk_text", "string", pa.string()), ("source_locator", "string", pa.string()), ("metadata", "map<string,string>", pa.map_(pa.string(), pa.string())), ("char_count", "int", pa.int32())]
    made = ordered_fold(kept, key, order, lambda: Chunks(size, least, SETTINGS.overlap_chars if overlap else 0), schema)
    return made.withColumnRenamed("position", "chunk_index")


def base_metadata(document: Column, source_type: str) -> dict[str, Column]:
    """The metadata that all chunks of a document share."""
    return {"filename": document, "source_type": F.lit(source_type)}


def _metadata(**values: Column) -> Column:
    """A map of the given values as strings, nulls left out."""
    whole = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def page_chunks(pages: DataFrame, key: str, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars) -> DataFrame:
    """Pages (key, position, text) to chunks with their page as locator."""
    rows = pages.select(key, "position", "text", F.format_string("page %d", "position").alias("locator"), _metadata(**base_metadata(F.col(key), "PDF"), page_number=F.col("position")).alias("metadata"))
    return chunk_elements(rows, key, ["position"], size=size, least=least, kind="PDF")


def section_chunks(sections: DataFrame, key: str, kind: str = "MARKDOWN", size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars) -> DataFrame:
    """Sections (key, position, heading_level, heading_text, section_text, section_path) to chunks; the locator is the path, else the heading, else the number."""
    name = F.coalesce(F.nullif("section_path", F.lit("")), F.nullif("heading_text", F.lit("")), F.format_string("section %d", F.col("position") + 1) if kind == "MARKDOWN" else F.lit("(body)"))
    rows = sections.select(key, "position", F.col("section_text").alias("text"), name.alias("locator"), _metadata(**base_metadata(F.col(key), kind), heading_text=F.col("heading_text"), heading_level=F.col("heading_level"), section_path=F.col("section_path")).alias("metadata"))
    return chunk_elements(rows, key, ["position"], size=size, least=least, kind=kind)


class Sections:
    """The fold of a word-processor document: body elements join the heading before them.  State: (position, level, heading, path, texts)."""

    def forgets(self, row: dict) -> bool:
        return row["heading_level"] > 0

    def step(self, state, row: dict) -> tuple:
        if row["heading_level"] > 0:
            return (row["position"], row["heading_level"], row["heading_text"], row["section_path"], [row["section_text"]]), self.end(state)
        if state is None:
            return (row["position"], 0, "", "", [row["section_text"]]), []
        state[4].append(row["section_text"])
        return state, []

    def end(self, state) -> list[tuple]:
        text = "\n\n".join(state[4]).strip() if state else ""
        return [(state[1], state[2], text, state[3])] if text else []


def document_sections(elements: DataFrame, key: str) -> DataFrame:
    """Word-processor elements (key, position, heading_level, heading_text, section_text, section_path) joined by heading: key, position, heading_level, heading_text, section_text, section_path.

    The body under one heading is held together, as it is one section; sections, not documents, bound what a task holds.
    """
    schema = [("heading_level", "int", pa.int32()), ("heading_text", "string", pa.string()), ("section_text", "string", pa.string()), ("section_path", "string", pa.string())]
    return ordered_fold(elements.select(key, "position", "heading_level", "heading_text", "section_text", "section_path"), key, ["position"], Sections, schema)


def document_chunks(elements: DataFrame, key: str, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars) -> DataFrame:
    """``document_sections`` to chunks."""
    return section_chunks(document_sections(elements, key), key, "DOCX", size, least)


SLICE = 100_000  # a document's rows are handled in slices of this many order numbers, whatever its length


def trailing_context(messages: DataFrame, key: str, order: str, text: str, n: int = SETTINGS.overlap_messages, width: int = SLICE, between: str = "\n---\n") -> DataFrame:
    """Adds ``context``: up to ``n`` texts before this one in its document, oldest first (NULL for the first).

    ``order`` is an integer.  A document is read in slices: within one, ``lag`` finds what comes before; the last ``n`` texts of each
    slice are carried to the next ones, so a document with any share of the rows is many tasks.
    """
    part = [key, "_slice"]
    rows = messages.withColumn("_slice", F.floor(F.col(order) / width))
    inside, back = Window.partitionBy(*part).orderBy(order), Window.partitionBy(*part).orderBy(F.desc(order))
    last = rows.select(*part, order, F.col(text).alias("_t")).withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= n)
    tails = last.groupBy(*part).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "_t"))), lambda x: x["_t"]).alias("_tail"))  # n texts
    slices = Window.partitionBy(key).orderBy("_slice")
    empty = F.array().cast("array<string>")
    carried = F.concat(*[F.coalesce(F.lag("_tail", i).over(slices), empty) for i in range(n, 0, -1)])
    carry = tails.withColumn("_c", carried).select(*part, F.when(F.size("_c") > n, F.slice("_c", -n, n)).otherwise(F.col("_c")).alias("_carry"))
    here = rows.withColumn("_own", F.array_compact(F.array(*[F.lag(text, i).over(inside) for i in range(n, 0, -1)])))
    both = F.concat(F.coalesce("_carry", empty), F.col("_own"))
    last_n = F.when(F.size("_b") > n, F.slice("_b", -n, n)).otherwise(F.col("_b"))
    joined = here.join(carry, part, "left").withColumn("_b", both)
    return joined.withColumn("context", F.when(F.size("_b") > 0, F.array_join(last_n, between))).drop("_slice", "_own", "_carry", "_b")


def with_context(text: Column, context: Column) -> Column:
    return F.when(context.isNull(), text).otherwise(F.concat(F.lit("[Previous context:]\n"), context, F.lit("\n[End context]\n\n"), text))


def chat_windows(messages: DataFrame, key: str, order: str, micros: str, gap_minutes: int = SETTINGS.chat_gap_minutes, width: int = SLICE) -> DataFrame:
    """Adds ``window_no``: a new window begins where the clock jumped more than the gap since the last readable time.

    The order of the file counts (``order``, an integer), not the clock; a message without readable time never begins a window.
    Two levels: jumps are counted within slices of a document, and each slice's first jump and running number follow
    from one summary row per slice, so a document with any share of the rows is many tasks.
    """
    gap, part = gap_minutes * 60_000_000, [key, "_slice"]
    rows = messages.withColumn("_slice", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*part).orderBy(order)
    before = F.last(micros, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before).withColumn("_jump", F.coalesce(F.col(micros) - F.col("_before") > gap, F.lit(False)).cast("int"))
    timed = F.when(F.col(micros).isNotNull(), F.struct(order, F.col(micros).alias("t")))
    sums = rows.groupBy(*part).agg(F.sum("_jump").alias("_jumps"), F.min(timed)["t"].alias("_first"), F.max(timed)["t"].alias("_last"), F.min(timed)[order].alias("_at"))
    slices = Window.partitionBy(key).orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("_first") - F.last("_last", ignorenulls=True).over(earlier) > gap, F.lit(False)).cast("int")
    sums = sums.withColumn("_opens", opens)
    sums = sums.withColumn("_base", F.coalesce(F.sum(F.col("_jumps") + F.col("_opens")).over(earlier), F.lit(0)))
    joined = rows.join(sums.select(*part, "_opens", "_base", "_at"), part)
    number = F.col("_base") + F.sum("_jump").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col(order) >= F.col("_at"), F.col("_opens")).otherwise(0)
    return joined.withColumn("window_no", number).drop("_before", "_jump", "_opens", "_base", "_at", "_slice")


# How chat exports write their times, in the order in which they are tried (day before month, with and without seconds, 12-hour clocks).
CHAT_TIMES = ("d/M/yyyy, H:m:s", "d/M/yyyy, H:m", "M/d/yyyy, H:m:s", "M/d/yyyy, h:m a", "d/M/yy, H:m:s", "d/M/yy, H:m", "M/d/yy, h:m a", "d/M/yy, h:m a")


def chat_time(written: Column) -> Column:
    """The time a chat line states, in the first form that fits; NULL if none does.  No zone: only the distance to other lines counts."""
    text = F.upper(F.regexp_replace(strip(written), r"\s+", " "))
    shape = r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2}), \d{1,2}:\d{1,2}"
    year4 = text.rlike(r"^\d+/\d+/\d{4},")
    fits = lambda f: (year4 if "yyyy" in f else ~year4) & text.rlike(r" [AP]M$" if " a" in f else r"\d$")
    return F.when(text.rlike(shape), F.coalesce(*[F.when(fits(f), F.try_to_timestamp(text, F.lit(f))) for f in CHAT_TIMES]))


def chat_line() -> Column:
    return F.format_string("[%s] %s: %s", F.coalesce("timestamp", F.lit("")), F.coalesce("sender", F.lit("Unknown")), F.coalesce("message_text", F.lit("")))


PART_CHARS = 1_000_000  # a window's text beyond this is given in parts of about that length, cut between its lines


def chat_chunks(messages: DataFrame, key: str, order: str, width: int = SLICE, most: int = PART_CHARS) -> DataFrame:
    """Windows as texts of lines ``[time] sender: text`` with their participants; input as from ``chat_windows``.

    A window is one row, but for one of more than ``most`` characters, which comes in parts cut between lines, so that a row's text stays
    bounded.  Characters are summed within slices of ``width`` order numbers, and each slice's first sum follows from one summary row
    per window and slice; the result does not depend on ``width``.
    """
    part = [key, "window_no", "_slice"]
    rows = messages.withColumn("_slice", F.floor(F.col(order) / width)).withColumn("_line", chat_line())
    size = F.length("_line") + 1
    earlier = Window.partitionBy(key, "window_no").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*part).agg(F.sum(size).alias("_n")).select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    position = F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    parts = rows.join(base, part).withColumn("part_no", F.floor(position / most))
    item = F.struct(F.col(order).alias("o"), F.col("_line").alias("l"), F.col("timestamp").alias("t"))
    per = parts.groupBy(key, "window_no", "part_no").agg(F.array_sort(F.collect_list(item)).alias("_m"), F.array_sort(F.collect_set(F.coalesce("sender", F.lit("Unknown")))).alias("participants"))
    text = F.array_join(F.transform("_m", lambda m: m["l"]), "\n")
    locator = F.concat(F.coalesce(F.element_at("_m", 1)["t"], F.lit("")), F.lit(" to "), F.coalesce(F.element_at("_m", -1)["t"], F.lit("")))
    return per.select(key, "window_no", "part_no", text.alias("text"), locator.alias("locator"), "participants", F.size("_m").alias("message_count"))


def email_header(sender: Column, timestamp: Column, subject: Column) -> Column:
    return F.format_string("From: %s | Date: %s | Subject: %s", F.coalesce(sender, F.lit("Unknown")), F.coalesce(timestamp, F.lit("")), F.coalesce(subject, F.lit("(no subject)")))


def email_texts(messages: DataFrame, key: str, order: str, width: int = SLICE) -> DataFrame:
    """Messages (sender, timestamp, subject, body) with ``text``: header and body after the two messages before as context; and their ``locator``."""
    kept = messages.filter(F.length(strip(F.col("body"))) > 0)
    raw = kept.withColumn("_raw", F.concat(email_header(F.col("sender"), F.col("timestamp"), F.col("subject")), F.lit("\n\n"), strip(F.col("body"))))
    rows = numbered(trailing_context(raw, key, order, "_raw", width=width), key, order, "message_index", width)
    locator = F.format_string("Message %d from %s", F.col("message_index") + 1, F.coalesce("sender", F.lit("Unknown")))
    return rows.withColumn("text", strip(with_context(F.col("_raw"), F.col("context")))).withColumn("locator", locator).drop("_raw", "context")


def email_chunks(messages: DataFrame, key: str, order: str, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars, width: int = SLICE) -> DataFrame:
    """``email_texts`` within the limits of size."""
    rows = email_texts(messages, key, order, width)
    about = _metadata(**base_metadata(F.col(key), "EMAIL"), sender=F.col("sender"), timestamp=F.col("timestamp"), subject=F.col("subject"), message_index=F.col("message_index"))
    return chunk_elements(rows.select(key, order, "text", "locator", about.alias("metadata")), key, [order], overlap=False, size=size, least=least, kind="EMAIL")


def numbered(rows: DataFrame, key: str, order: str, name: str, width: int = SLICE) -> DataFrame:
    """Adds ``name``: the row's place in its document from 0, counted within slices and shifted by what the slices before hold."""
    part = [key, "_slice"]
    dealt = rows.withColumn("_slice", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy(order))
    return dealt.withColumn("_own", own).join(base, part).withColumn(name, F.col("_base") + F.col("_own") - 1).drop("_own", "_base", "_slice")


def chat_context_texts(messages: DataFrame, key: str, order: str, width: int = SLICE, most: int = PART_CHARS) -> DataFrame:
    """``chat_chunks`` with ``text`` after the last two messages before the window, but for a document's first window."""
    lines = trailing_context(messages.withColumn("_line", chat_line()), key, order, "_line", width=width, between="\n")
    before = lines.groupBy(key, "window_no").agg(F.min(F.struct(F.col(order).alias("o"), "context"))["context"].alias("_context"), F.lit(0).cast("bigint").alias("part_no"))
    rows = chat_chunks(messages, key, order, width, most).join(before, [key, "window_no", "part_no"], "left")
    text = F.when(F.col("_context").isNull(), F.col("text")).otherwise(F.concat(F.lit("[Context:]\n"), "_context", F.lit("\n\n[Current window:]\n"), "text"))
    return rows.withColumn("text", text).drop("_context")


def chat_context_chunks(messages: DataFrame, key: str, order: str, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars, width: int = SLICE, most: int = PART_CHARS) -> DataFrame:
    """``chat_context_texts`` within the limits of size."""
    rows = chat_context_texts(messages, key, order, width, most)
    about = _metadata(**base_metadata(F.col(key), "WHATSAPP"), message_count=F.col("message_count"), participants=F.array_join("participants", ", "))
    return chunk_elements(rows.select(key, "window_no", "part_no", "text", "locator", about.alias("metadata")), key, ["window_no", "part_no"], overlap=False, size=size, least=least, kind="WHATSAPP")


def commit_chunks(commits: DataFrame, files: int = 20) -> DataFrame:
    """A text per commit: identity, author, date, message and the first ``files`` changed files (the reference's number; a parameter, their count is kept whole)."""
    some = F.slice(F.coalesce("changed_files", F.array().cast("array<string>")), 1, files)
    listing = F.when(F.size(some) > 0, F.concat(F.lit("\n\nChanged files:\n"), F.array_join(F.transform(some, lambda f: F.concat(F.lit("- "), f)), "\n"))).otherwise(F.lit(""))
    body = F.format_string("Commit: %s\nAuthor: %s\nDate: %s\n\n%s", F.coalesce("commit_sha", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("date", F.lit("")), F.coalesce("message", F.lit("")))
    return commits.withColumn("text", F.concat(body, listing)).withColumn("locator", F.format_string("commit %s (%s)", F.substring("commit_sha", 1, 8), F.coalesce("date", F.lit(""))))


def commit_metadata(key: str) -> Column:
    n = F.greatest(F.coalesce(F.size("changed_files"), F.lit(0)), F.lit(0))
    return _metadata(**base_metadata(F.col(key), "GIT"), commit_sha=F.col("commit_sha"), author=F.col("author"), date=F.col("date"), changed_files_count=n, is_merge=F.col("is_merge"))


def python_chunks(elements: DataFrame, key: str, order: str, size: int = SETTINGS.max_chunk_chars, least: int = SETTINGS.min_chunk_chars) -> DataFrame:
    """``python_elements_to_pieces`` within the limits of size."""
    return chunk_elements(python_elements_to_pieces(elements, key, order), key, ["piece_order"], overlap=False, size=size, least=least, kind="PYTHON")


def python_elements_to_pieces(elements: DataFrame, key: str, order: str) -> DataFrame:
    """Module and imports as one first piece, each class and function as its own; input for ``chunk_elements``.

    A document's module texts and import lines meet in one row, the overview chunk that they are.
    """
    head = F.col("element_type").isin("module", "import_block")
    group = elements.withColumn("body", strip(F.col("body"))).filter("body <> ''").withColumn("_head", head)
    first = group.filter("_head").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("body").alias("t")))).alias("_e"))
    module = first.select(key, F.lit(-1).cast("bigint").alias("piece_order"), F.concat(F.lit("# File: "), F.col(key), F.lit("\n\n"), F.array_join(F.transform("_e", lambda e: e["t"]), "\n\n")).alias("text"), F.lit("module overview").alias("locator"))
    rest = group.filter(~F.col("_head")).select(key, F.col(order).cast("bigint").alias("piece_order"), F.col("body").alias("text"), F.format_string("lines %d-%d", "line_start", "line_end").alias("locator"))
    return module.unionByName(rest).withColumn("metadata", _metadata(**base_metadata(F.col(key), "PYTHON")))
