"""Functions paired with their documentation.

Signatures are found by regular expressions on a copy of the source in which strings and comments
are blanked out, bodies are delimited by a stack of indentations, and comments are attached by line
distance (the comment block that ends on the line above the function or its decorators).  Nothing
is compiled, so files that do not parse give their functions too.

Defined results: null and empty sources give nothing; line ends are unified to line feeds; a
name defined twice gives two rows; documentation that is a placeholder, an unfilled template, only
the words of the name, or at most two words is trivial and its function is dropped.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)
    |(?P<prefix>\b[rRbBuUfFtT]{1,2})?(?P<string>\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)""",
    re.X | re.S,
)
_HEAD = re.compile(r"^([ \t\f]*)(?:(?:async[ \t]+)?(def)[ \t]+(\w+)|(class)[ \t]+(\w+))")
# Documentation that stands for none, and marks of templates that were not filled in.
PLACEHOLDERS = {
    "todo", "tbd", "tba", "fixme", "xxx", "n a", "na", "none", "null", "helper", "internal", "main", "deprecated", "docstring", "documentation", "description",
    "insert docs", "add docs", "add docstring", "add docstring here", "docstring goes here", "write docs", "document me", "placeholder", "pass", "wip", "work in progress",
    "to do", "todo document", "todo add docs", "todo write docs", "to be done", "to be defined", "to be documented", "see code", "self explanatory", "no description", "undocumented",
    "missing docstring", "fill me in", "fill in", "summary", "short description", "lorem ipsum", "description of the function", "function description", "method description", "function docstring",
    "your docstring here", "write docstring here", "insert description here", "add description here", "describe the function here", "this function needs documentation",
}
_TEMPLATE = re.compile(r"_(?:summary|description|type)_|\[(?:summary|description|type|extended_summary)\]|<(?:summary|description|insert|your|add|todo|fill|what|describe|short)[^<>]*>|lorem ipsum|\{(?:name|summary|description|doc|what)\}", re.I)
_BLANK = re.compile(r"\{\{.*?\}\}|\$\{\w+\}|\$[A-Za-z_]\w*")  # a place to fill in, or a variable that real prose speaks of
_OPENING = re.compile(r"^(?:todo|fixme|tbd|xxx)\b", re.I)
_NO_PROSE = re.compile(r"^(?:File:\s|!|-\*-|noqa\b|type:|pylint:|pragma\b|fmt:|isort:|mypy:|ruff:|flake8:|nosec\b|region\b|endregion\b|[-=#*_~\s]*$)")
_FILLER = {"the", "a", "an", "of", "this", "that", "to", "for", "and", "in", "function", "method", "der", "die", "das", "le", "la", "les", "el", "los", "de", "des", "du", "it", "is", "does", "self", "called", "named", "here", "will", "be", "class", "simply", "just"}
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields?|examples?|notes?|attributes|see also)\s*:?\s*$|^\s*:(?:param|return|returns|rtype|type|raises)\b|^\s*-{3,}\s*$|^\s*@(?:param|return)\b", re.I)


@dataclass
class Function:
    name: str
    code: str
    description: str
    line_start: int
    line_end: int


Strings = dict[int, tuple[int, str]]


def _masked(source: str) -> tuple[str, Strings]:
    """The source with strings and comments blanked (line feeds kept), and each string's end and prefix by its start."""
    out, strings, last = [], {}, 0
    for m in _TOKEN.finditer(source):
        out.append(source[last : m.start()])
        text = m.group()
        if m.group("string") is not None:
            strings[m.start()] = (m.end(), m.group("prefix") or "")
            out.append(re.sub(r"[^\n]", "\x01", text))
        else:
            out.append(re.sub(r"[^\n]", " ", text))
        last = m.end()
    out.append(source[last:])
    return "".join(out), strings


def _width(blank: str) -> int:
    return len(blank.expandtabs(8))


def _literal(text: str) -> str:
    try:
        value = ast.literal_eval(text)
        return value if isinstance(value, str) else ""
    except (SyntaxError, ValueError, MemoryError):
        body = re.sub(r"^[rRuU]*", "", text)
        q = 3 if body[:3] in ('"""', "'''") else 1
        return body[q:-q] if body.endswith(body[:q]) and len(body) >= 2 * q else body[q:]


def _dedent(text: str) -> str:
    lines = text.expandtabs(8).split("\n")
    margin = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    return "\n".join([lines[0].strip(), *(x[margin:].rstrip() for x in lines[1:])]).strip()


def _signature_end(mask: str, at: int) -> int:
    """Position after the colon that ends the signature at ``at``; -1 if there is none."""
    depth = 0
    for m in re.compile(r"[()\[\]{}:]|\blambda\b").finditer(mask, at):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return -1
        elif c == ":" and depth == 0:
            return m.end()
    return -1


def _docstring(source: str, mask: str, strings: Strings, begin: int, end: int, indent: int) -> str | None:
    """The literal that is the first statement after a signature; None if the first statement is something else."""
    m = re.compile(r"[\s\\]*").match(mask, begin)
    at = m.end()
    if at >= end or mask[at] != "\x01" and not (mask[at] in "uUrR" and "\x01" in mask[at : at + 3]):
        return None
    line = mask.rfind("\n", 0, at) + 1
    if line >= begin and _width(mask[line:at]) <= indent:
        return None
    parts, here = [], at
    while True:
        hit = strings.get(here)
        if hit is None:
            break
        if set(hit[1].lower()) & set("bft"):
            return None
        parts.append(_literal(source[here : hit[0]]))
        here = hit[0]
        gap = re.compile(r"(?:[ \t\f]|\\\n)*").match(mask, here)
        here = gap.end()
        if here not in strings:
            break
    if not parts or here < len(mask) and mask[here] not in "\n;":
        return None
    return _dedent("".join(parts))


def functions(source: str) -> list[Function]:
    """Every function of a source with its documentation ("" if it has none), in the order of their first lines."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    mask, strings = _masked(source)
    lines, masks = source.split("\n"), mask.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    stack: list[tuple[int, str, dict | None]] = []
    made: list[dict] = []
    depth, previous_open, last_code = 0, False, -1

    def close(entry: tuple[int, str, dict | None], end_line: int) -> None:
        if entry[2] is not None:
            entry[2]["end"] = end_line

    skip_to = 0
    for i, line in enumerate(masks):
        text = line.strip(" \t\f")
        if not text:
            continue
        within = depth > 0 or previous_open or starts[i] < skip_to
        inside_string = line[:1] == "\x01" and starts[i] not in strings
        if not within and not inside_string:
            indent = _width(line[: len(line) - len(line.lstrip(" \t\f"))])
            while stack and indent <= stack[-1][0]:
                close(stack.pop(), last_code)
            head = _HEAD.match(line)
            if head:
                name = head.group(3) or head.group(5)
                path = ".".join([*(e[1] for e in stack), name])
                entry = None
                if head.group(2):
                    colon = _signature_end(mask, starts[i] + head.end())
                    entry = {"name": path, "start": i, "colon": colon, "indent": indent, "end": len(lines) - 1}
                    made.append(entry)
                    if colon > 0:
                        skip_to = colon
                stack.append((indent, name, entry))
        if starts[i] >= skip_to:
            depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
            if within is False and _HEAD.match(line):
                depth = max(0, depth)
        elif starts[i + 1] > skip_to:
            depth = 0
        previous_open = line.rstrip().endswith("\\")
        last_code = i
    while stack:
        close(stack.pop(), last_code)

    out = []
    for f in made:
        doc = None
        if f["colon"] > 0:
            doc = _docstring(source, mask, strings, f["colon"], starts[f["end"] + 1], f["indent"])
        if not (doc or "").strip():
            doc = _comment_above(lines, masks, f["start"], f["indent"])
        first = _first_decorator(lines, masks, f["start"], f["indent"])
        code = "\n".join(lines[first : f["end"] + 1])
        out.append(Function(f["name"], code, doc or "", first + 1, f["end"] + 1))
    return out


def _first_decorator(lines: list[str], masks: list[str], at: int, indent: int) -> int:
    """The line of the first decorator of a function; its own line if it has none (decorators may span lines)."""
    first, i = at, at - 1
    while i >= 0 and lines[i].strip():
        m = masks[i]
        if m.lstrip(" \t").startswith("@") and _width(m[: len(m) - len(m.lstrip(" \t"))]) == indent:
            first = i
        elif m.strip() and not re.search(r"[)\]},(]\s*$|^\s*[\w\x01]+\s*=", m):
            break
        i -= 1
    return first


def _comment_above(lines: list[str], masks: list[str], at: int, indent: int) -> str:
    """The comment lines directly above a function or above (or between) its decorators."""
    block: list[str] = []
    for top in dict.fromkeys((at, _first_decorator(lines, masks, at, indent))):
        block, i = [], top - 1
        while i >= 0 and lines[i].lstrip(" \t").startswith("#") and not masks[i].strip() and _width(lines[i][: len(lines[i]) - len(lines[i].lstrip(" \t"))]) == indent:
            block.append(re.sub(r"^#+:?[ ]?", "", lines[i].strip()))
            i -= 1
        block = [x for x in reversed(block) if not x.strip() or not _NO_PROSE.match(x.strip())]
        if any(x.strip() for x in block):
            break
    return "\n".join(x.rstrip() for x in block).strip()


def _words(text: str) -> list[str]:
    return re.findall(r"[぀-ヿ㐀-鿿가-힯]|[^\W_]+", text)


def _stem(word: str) -> str:
    """A word without its endings (at most two), so that "Applys", "applies" and "apply" are one word."""
    word = word.lower()
    for _ in range(2):
        for end in ("ing", "ies", "es", "ed", "s", "e", "y"):
            if word.endswith(end) and len(word) - len(end) >= 2:
                word = word[: -len(end)]
                break
    return word


def name_words(name: str) -> set[str]:
    parts = re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])", r"\1\3_\2\4", name.replace(".", "_"))
    return {_stem(w) for w in re.findall(r"[^\W_\d]+|\d+", parts)}


def is_trivial(description: str, name: str) -> bool:
    """Whether documentation says nothing; its sections on parameters and the like are not counted as a description."""
    prose = []
    for line in description.split("\n"):
        if _SECTION.match(line):
            break
        prose.append(line)
    text = " ".join(prose).strip()
    words = _words(_BLANK.sub(" ", text))  # what a template says without its blanks
    flat = " ".join(words).lower()
    if len(words) <= 2 or flat in PLACEHOLDERS or _TEMPLATE.search(text) or _OPENING.match(text):
        return True
    return {_stem(w) for w in words if w.lower() not in _FILLER} <= name_words(name)


def extract_pairs(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Columns: key, function_name, code, description, line_start, line_end; only functions with real documentation.

    One narrow stage (Arrow batches in, Arrow batches out), no shuffle.
    """
    rows = df.filter(F.col(body).contains("def")).select(key, F.col(body).alias("_body"))
    key_type = df.schema[key].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], [[], [], [], [], []]
            for i, source in enumerate(batch.column(1).to_pylist()):
                for f in functions(source):
                    if not is_trivial(f.description, f.name.rpartition(".")[2]):
                        take.append(i)
                        for column, value in zip(out, (f.name, f.code, f.description, f.line_start, f.line_end)):
                            column.append(value)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = ["function_name", "code", "description", "line_start", "line_end"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, t) for c, t in zip(out, kinds)]], [key, *names])

    return rows.mapInArrow(extract, f"{key} {key_type}, function_name string, code string, description string, line_start int, line_end int")
