"""Parsers: one text per row to its structural elements.

Mail, chat, commit logs and Markdown are cut with built-in expressions inside their row; only Python
source and binary files go through Arrow.  ``PARSERS`` is the registry, by source type; paged and word-processor
files are read by an extractor that the caller may replace.

Defined results: null and blank texts give no elements; a part without recognisable header is dropped.
"""

from __future__ import annotations

import ast
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.text import strip
from traceloom.operators.folds import ordered_fold
from traceloom.sources.files import BY_EXTENSION, BY_MIME, COMMIT_MARK

# Header names, chat line forms, texts of chat programs.
_HEADERS = r"(?im)^(?:From|To|Date|Subject|Cc|Bcc|Reply-To|Message-ID|Content-Type|Content-Transfer-Encoding|MIME-Version|Received|Return-Path|X-\w+):[^\S\n]*.*$"
_CHAT_TIME = r"\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?"
_CHAT_START = rf"^\s*(?:\[({_CHAT_TIME})\]|({_CHAT_TIME})\s+-)\s+(.+?):\s+(.*)$"
_CHAT_SYSTEM = r"(?i)added|removed|left|joined|created|changed|Messages and calls|<Media omitted>|This message was deleted|You deleted this message|Security code changed"


def _lf(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def parse_email(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, sender, timestamp, subject, body, is_forwarded."""
    parts = docs.select(key, F.posexplode(F.split(strip(_lf(F.col(text))), r"\n(?=From:\s)")).alias("position", "_s"))
    field = lambda name: F.trim(F.regexp_extract("_s", rf"(?im)^{name}:[^\S\n]*(.+)$", 1))
    body = strip(F.regexp_replace(strip(F.regexp_replace("_s", _HEADERS, "")), r"(?m)^\s*[-_=]{3,}\s*$", ""))
    out = parts.withColumn("sender", field("From")).withColumn("timestamp", field("Date")).withColumn("subject", field("Subject")).withColumn("body", body)
    known = out.filter((F.col("sender") != "") | (F.col("timestamp") != ""))
    fill = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return known.select(key, "position", fill("sender", "Unknown"), fill("timestamp", "Unknown"), fill("subject", "(no subject)"), "body", F.col("body").rlike(r"(?i)-{5,}\s*Forwarded message\s*-{5,}").alias("is_forwarded"))


def parse_chat(docs: DataFrame, key: str, text: str, strict_system: bool = False) -> DataFrame:
    """key, position, sender, timestamp, message_text, is_media, is_system; lines without a head continue the message before.

    A fold over the lines of a text; lines before the first message are dropped.  ``strict_system`` takes a
    message as the chat program's own only if it begins as one.
    """
    message = "struct<ts:string,sender:string,body:string>"

    def step(acc: Column, line: Column) -> Column:
        stamp = F.coalesce(F.nullif(F.regexp_extract(line, _CHAT_START, 1), F.lit("")), F.regexp_extract(line, _CHAT_START, 2))
        head = F.struct(F.trim(stamp).alias("ts"), F.trim(F.regexp_extract(line, _CHAT_START, 3)).alias("sender"), F.trim(F.regexp_extract(line, _CHAT_START, 4)).alias("body"))
        last = F.element_at(acc, -1)
        longer = F.struct(last["ts"].alias("ts"), last["sender"].alias("sender"), F.concat(last["body"], F.lit("\n"), line).alias("body"))
        kept = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(line.rlike(_CHAT_START), F.array_append(acc, head)).when(F.size(acc) == 0, acc).otherwise(F.array_append(kept, longer))

    # a message starts at every line with a head: cut there first, so the fold runs within one message only
    cut = F.split(F.concat(F.lit("\n"), _lf(F.col(text))), rf"\n(?=\s*(?:\[{_CHAT_TIME}\]|{_CHAT_TIME}\s+-)\s+.+?:\s)")
    parts = docs.select(key, F.posexplode(cut).alias("position", "_s"))
    one = F.aggregate(F.split("_s", "\n"), F.array().cast(f"array<{message}>"), step)
    out = parts.withColumn("_m", F.try_element_at(one, F.lit(1))).filter("_m is not null")
    system = F.col("_m.body").rlike("(?i)^" + _CHAT_SYSTEM[4:].replace("|", "|^") if strict_system else _CHAT_SYSTEM)
    return out.select(key, "position", F.col("_m.sender").alias("sender"), F.col("_m.ts").alias("timestamp"), F.col("_m.body").alias("message_text"), F.col("_m.body").contains("<Media omitted>").alias("is_media"), system.alias("is_system"))


def parse_git_log(docs: DataFrame, key: str, text: str, most: int | None = None, keep: str = "tail") -> DataFrame:
    """key, position, commit_sha, author, date, message, changed_files, is_merge; ``git log`` and separator form.

    All commits stay; with ``most`` (the reference has ``SETTINGS.max_commits``) the last of a longer log (``keep="head"``: the first).
    """
    source = _lf(F.col(text))
    marked = F.array_remove(F.transform(F.split(source, COMMIT_MARK), strip), "")
    plain = F.filter(F.split(source, r"(?m)(?=^commit\s+[0-9a-f]{40}$)"), lambda s: s.rlike(r"^commit\s+[0-9a-f]{40}"))
    # the form goes with each commit: a look at the log again, once per commit, would cost its length squared
    told = lambda commits, is_marked: F.transform(commits, lambda s: F.struct(F.lit(is_marked).alias("m"), s.alias("s")))
    parts = F.when(source.contains(COMMIT_MARK), told(F.filter(marked, lambda s: F.size(F.split(s, "\n")) >= 3), True)).otherwise(told(plain, False))
    kept = parts if most is None else F.when(F.size(parts) <= most, parts).otherwise(F.slice(parts, F.size(parts) - most + 1 if keep == "tail" else F.lit(1), F.lit(most)))
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(kept).alias("position", "_c")).select(key, "position", F.col("_c.m").alias("_m"), F.col("_c.s").alias("_s"))
    lines, field = F.split("_s", "\n"), lambda n: F.trim(F.regexp_extract("_s", rf"(?m)^{n}:[^\S\n]+(.+)$", 1))
    indented = F.regexp_extract_all("_s", F.lit(r"(?m)^    (.*)$"), F.lit(1))
    message = F.when(F.col("_m"), strip(F.array_join(F.slice(lines, 4, F.greatest(F.size(lines) - 3, F.lit(0))), "\n"))).otherwise(strip(F.array_join(indented, "\n")))
    pick = lambda i, other: F.when(F.col("_m"), F.trim(lines[i])).otherwise(other)
    changed = F.regexp_extract_all("_s", F.lit(r"(?m)^ (\S.*?)\s+\|\s+(?:\d+|Bin)\b.*$"), F.lit(1))
    merge = F.when(F.col("_m"), F.lower(message).startswith("merge")).otherwise(F.exists(indented, lambda x: F.lower(x).startswith("merge")))
    return rows.select(key, "position", pick(0, F.regexp_extract("_s", r"^commit\s+([0-9a-f]{40})", 1)).alias("commit_sha"), pick(1, field("Author")).alias("author"), pick(2, field("Date")).alias("date"), message.alias("message"), changed.alias("changed_files"), merge.alias("is_merge"))


def parse_markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, heading_level, heading_text, section_text, section_path; the path is a fold over the headings.

    A leading block between ``---`` lines is not a section (see ``front_matter``).
    """
    plain = F.regexp_replace(_lf(F.col(text)), r"(?s)\A---\n.*?\n---\n", "")
    parts = docs.select(key, F.filter(F.split(plain, r"(?m)(?=^#{1,6}\s+\S)"), lambda s: strip(s) != "").alias("_p"))
    level = lambda s: F.length(F.regexp_extract(s, r"^(#{1,6})\s", 1))
    title = lambda s: F.trim(F.regexp_extract(s, r"^#{1,6}\s+(.+)", 1))
    entry = "struct<level:int,title:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, s: Column) -> Column:
        lower = F.filter(acc["stack"], lambda e: e["level"] < level(s))
        stack = F.when(level(s) == 0, acc["stack"]).otherwise(F.array_append(lower, F.struct(level(s).alias("level"), title(s).alias("title"))))
        return F.struct(stack.alias("stack"), F.array_append(acc["paths"], F.array_join(F.transform(stack, lambda e: e["title"]), " > ")).alias("paths"))

    paths = F.aggregate("_p", start, step, lambda acc: acc["paths"])
    rows = parts.select(key, F.posexplode(F.arrays_zip(F.col("_p").alias("s"), paths.alias("path"))).alias("position", "_z"))
    s = F.col("_z.s")
    body = strip(F.regexp_replace(s, r"^#{1,6}\s+[^\n]*\n?", ""))
    section = F.when(level(s) > 0, strip(F.concat(F.regexp_extract(s, r"^(#{1,6}\s+[^\n]*)", 1), F.lit("\n\n"), body))).otherwise(strip(s))
    return rows.select(key, "position", level(s).alias("heading_level"), title(s).alias("heading_text"), section.alias("section_text"), F.col("_z.path").alias("section_path"))


def front_matter(text: Column) -> Column:
    """The ``name: value`` lines of a leading block between ``---`` lines, as a map."""
    block = F.regexp_extract(_lf(text), r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1), F.trim(F.regexp_extract(x, r"^[\w-]+\s*:\s*(.*)$", 1))))
    return F.map_from_entries(F.array_distinct(entries))


def python_elements(source: str, filename: str = "") -> list[tuple[str, str, str, str, int, int]]:
    """(element_type, element_name, docstring, body, line_start, line_end) of the module, imports, and top-level definitions.

    A source that does not parse is one ``plain_text`` element.
    """
    lines = source.splitlines()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [("plain_text", filename, "", source, 1, max(1, len(lines)))]
    out = []
    if doc := ast.get_docstring(tree):
        out.append(("module", filename, doc, doc, 1, tree.body[0].end_lineno or 1))
    imports = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    if imports:
        first_lines = [lines[n.lineno - 1] for n in imports]  # in the order of the walk, as many as there are statements
        out.append(("import_block", f"{filename}:imports", "", "\n".join(first_lines), 1, len(first_lines)))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            out.append((kind, node.name, ast.get_docstring(node) or "", f"# File: {filename}\n{code}", node.lineno, node.end_lineno))
    return out


def parse_python(docs: DataFrame, key: str, text: str, filename: str) -> DataFrame:
    key_type = docs.schema[key].dataType.simpleString()
    names = ["position", "element_type", "element_name", "docstring", "body", "line_start", "line_end"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, (name, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n, e in enumerate(python_elements(source, name or "")):
                    take.append(i)
                    rows.append((n, *e))
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *columns], [key, *names])

    given = docs.filter(F.length(F.trim(text)) > 0).select(key, F.col(filename).alias("_f"), F.col(text).alias("_t"))
    return given.mapInArrow(parse, f"{key} {key_type}, position int, element_type string, element_name string, docstring string, body string, line_start int, line_end int")


def pages(table: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Paged documents from a page table: empty pages are left out, the others keep their number."""
    return table.withColumn("_t", strip(F.col(text))).filter("_t <> ''").select(key, F.col(page).alias("position"), F.col("_t").alias("text"), F.format_string("page %d", page).alias("locator"))


class HeadingPaths:
    """The fold of headings: each row with the titles open at it.  State: the open (level, title) pairs."""

    def forgets(self, row: dict) -> bool:
        return row["heading_level"] == 1

    def step(self, state, row: dict) -> tuple:
        level, text = row["heading_level"], row["section_text"]
        if level > 0:
            state = [*(x for x in state or [] if x[0] < level), (level, text)]
        return state, [(row["_at"], level, text if level > 0 else "", text, " > ".join(t for _, t in state or []), row["is_table"])]

    def end(self, state) -> list[tuple]:
        return []


def paragraphs(table: DataFrame, key: str, position: str) -> DataFrame:
    """Word-processor documents from a paragraph table (key, position, style, text, perhaps is_table): headings by style name, with their path.

    A document's tables stand after its paragraphs, under the last heading.
    """
    level = F.coalesce(F.regexp_extract("style", r"(?i)^heading\s+([1-9])$", 1).try_cast("int"), F.lit(0))
    of_table = F.coalesce("is_table", F.lit(False)) if "is_table" in table.columns else F.lit(False)
    rows = table.withColumn("section_text", strip(F.col("text"))).filter("section_text <> ''").select(key, F.col(position).cast("bigint").alias("_at"), level.alias("heading_level"), "section_text", of_table.alias("is_table"))
    schema = [("_at", "bigint", pa.int64()), ("heading_level", "int", pa.int32()), ("heading_text", "string", pa.string()), ("section_text", "string", pa.string()), ("section_path", "string", pa.string()), ("is_table", "boolean", pa.bool_())]
    made = ordered_fold(rows, key, ["is_table", "_at"], HeadingPaths, schema)
    return made.select(key, F.col("_at").alias(position) if position != "position" else "position", "heading_level", "heading_text", "section_text", "section_path", "is_table")


# ---- extractors --------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_elements(content: bytes) -> list[tuple[str, str, bool]]:
    """(style, text, is_table) of a word-processor file: its paragraphs in order, and its tables as Markdown; [] for a file that is none."""
    from xml.etree import ElementTree

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    named = {} if styles is None else {x.get(f"{_W}styleId"): x.find(f"{_W}name").get(f"{_W}val") for x in styles.iter(f"{_W}style") if x.find(f"{_W}name") is not None}
    said = lambda e: "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(x.tag.removeprefix(_W), "") for x in e.iter())
    out = []
    for e in () if body is None else body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            mark = style.get(f"{_W}val") if style is not None else ""
            out.append((named.get(mark, mark), said(e), False))
        elif e.tag == f"{_W}tbl":
            rows = ["| " + " | ".join("\n".join(said(p) for p in c.iter(f"{_W}p")).strip().replace("\n", " ") for c in r.findall(f"{_W}tc")) + " |" for r in e.findall(f"{_W}tr")]
            if rows:
                rows.insert(1, "|" + " --- |" * (rows[0].count("|") - 1))
            out.append(("", "\n".join(rows), True))
    return out


_PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|\b(?:Tj|TJ|Td|TD|Tm|ET|BT)\b|['\"]|-?\d+(?:\.\d+)?", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _PDF_ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _pdf_page(stream: bytes) -> str:
    out: list[str] = []
    for token in _PDF_TEXT.findall(stream):
        if token[:1] in (b"(", b"<"):
            out.append(_pdf_string(token))
        elif token in (b"Td", b"TD", b"T*", b"'", b'"', b"ET", b"Tm"):
            out.append("\n")
        elif token[:1] == b"-" and float(token) < -200 and out and not out[-1].endswith((" ", "\n")):  # a wide step inside TJ is a space
            out.append(" ")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page of a plain PDF (simple fonts, streams packed with Flate or not at all); [] for a file that is none.

    Embedded character maps, object streams and encryption need a library: give its function to ``read_pages`` instead.
    """
    if not content.startswith(b"%PDF"):
        return []
    objects = {int(n): body for n, body in _PDF_OBJECT.findall(content)}
    found = []
    for body in (b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)):
        text = []
        for n in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b"", b""])[1]):
            m = _PDF_STREAM.match(objects.get(int(n), b""))
            if m:
                try:
                    text.append(_pdf_page(zlib.decompress(m[2]) if b"FlateDecode" in m[1] else m[2]))
                except zlib.error:
                    continue
        found.append("\n".join(text))
    return found


def _read(files: DataFrame, key: str, content: str, extract: Callable, schema: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """key, position (from 1) and what ``extract`` gives of each file's bytes; a file is read whole in its task, its size is limited."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                rows = [x if isinstance(x, tuple) else (x,) for x in extract(data or b"")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), pa.array(range(1, len(rows) + 1), pa.int32()), *[pa.array([r[c] for r in rows], t) for c, (_, _, t) in enumerate(schema)]], [key, "position", *[n for n, _, _ in schema]])

    return files.select(key, content).mapInArrow(read, f"`{key}` {files.schema[key].dataType.simpleString()}, position int, " + ", ".join(f"{n} {t}" for n, t, _ in schema))


def read_pages(files: DataFrame, key: str, content: str = "content", extract: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """Paged files to ``pages`` rows, with an extractor of the caller's choice."""
    return pages(_read(files, key, content, extract, [("text", "string", pa.string())]), key, "position", "text")


def read_docx(files: DataFrame, key: str, content: str = "content", extract: Callable[[bytes], list[tuple[str, str, bool]]] = docx_elements) -> DataFrame:
    """Word-processor files to ``paragraphs`` rows, with an extractor of the caller's choice."""
    rows = _read(files, key, content, extract, [("style", "string", pa.string()), ("text", "string", pa.string()), ("is_table", "boolean", pa.bool_())])
    return paragraphs(rows, key, "position")


Parser = Callable[..., DataFrame]
PARSERS: dict[str, Parser] = {"PDF": read_pages, "DOCX": read_docx, "EMAIL": parse_email, "WHATSAPP": parse_chat, "GIT": parse_git_log, "MARKDOWN": parse_markdown, "PYTHON": parse_python}


def can_handle(kind: str, mime: str = "", extension: str = "") -> bool:
    """Whether the parser of a source type takes a media type or an ending (without its dot)."""
    return kind in PARSERS and (BY_MIME.get(mime.lower()) == kind or BY_EXTENSION.get(extension.lower()) == kind)
