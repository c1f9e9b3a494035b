from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.sources import files, parsers


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")


def test_read_validate_and_type(spark, tmp_path):
    for name, content in {"a.md": b"# T", "b.py": b"x=1", "c.txt": b"From: A\nx", "d.log": b"commit " + b"a" * 40, "e.txt": b"", "f.bin": b"\x00", "g.txt": b"[01/01/2024, 10:00] A: x\n[01/01/2024, 10:01] B: y", "h.txt": "ä".encode("latin-1"), "copy.md": b"# T"}.items():
        (tmp_path / name).write_bytes(content)
    log = spark.createDataFrame([("x", "failed")], "file_hash string, status string")
    read = files.read_files(spark, str(tmp_path)).filter("length > 0")
    empty = spark.createDataFrame([("e.txt", bytearray(), 0, None)], read.schema)
    good, bad = files.ingest(read.unionByName(empty), log)
    assert {r.filename: r.source_type for r in good.collect()} == {"a.md": "MARKDOWN", "b.py": "PYTHON", "c.txt": "EMAIL", "d.log": "GIT", "g.txt": "WHATSAPP", "h.txt": "MARKDOWN"}
    assert {r.filename: r.error_message for r in bad.collect()} == {"e.txt": "empty file", "f.bin": "unsupported type"}
    assert {r.text for r in good.filter("filename = 'h.txt'").collect()} == {"ä"}
    again = log.unionByName(good.select("file_hash", F.lit("success").alias("status")))
    assert files.ingest(files.read_files(spark, str(tmp_path)), again)[0].count() == 0


def test_size_limit_is_inclusive(spark):
    df = spark.createDataFrame([(0,), (50 * 1024 * 1024,), (50 * 1024 * 1024 + 1,)], "n long")
    assert [r.e for r in df.select(files.validation_error(F.col("n")).alias("e")).collect()] == ["empty file", None, "file too large"]


def test_email(spark):
    t = "From: A <a@x>\nDate: Monday\nSubject: S\n\nBody\n---\nmore\n\nFrom: B\nTo: A\n\n----- Forwarded message -----\nOld"
    got = parsers.parse_email(docs(spark, t, None, "no header"), "id", "t").orderBy("position").collect()
    assert [(r.sender, r.timestamp, r.subject, r.is_forwarded) for r in got] == [("A <a@x>", "Monday", "S", False), ("B", "Unknown", "(no subject)", True)]
    assert got[0].body == "Body\n\nmore" or got[0].body.split() == ["Body", "more"]


def test_chat(spark):
    t = "header\n[01/01/2024, 10:00:00] Alice: Hi\nsecond line\n01/01/2024, 10:01 - Bob: <Media omitted>\n1/2/24, 9:05 PM - Alice: I created a file\n[01/01/2024, 11:00] Carl: a: b"
    got = parsers.parse_chat(docs(spark, t, "", None), "id", "t").orderBy("position").collect()
    assert [(r.sender, r.timestamp, r.message_text, r.is_media, r.is_system) for r in got] == [
        ("Alice", "01/01/2024, 10:00:00", "Hi\nsecond line", False, False),
        ("Bob", "01/01/2024, 10:01", "<Media omitted>", True, True),
        ("Alice", "1/2/24, 9:05 PM", "I created a file", False, True),
        ("Carl", "01/01/2024, 11:00", "a: b", False, False),
    ]
    strict = parsers.parse_chat(docs(spark, t), "id", "t", strict_system=True).filter("is_system").collect()
    assert [r.sender for r in strict] == ["Bob"]


def test_git(spark):
    a, b = "a" * 40, "b" * 40
    t = f"commit {a}\nAuthor: A <a@x>\nDate:   Mon\n\n    First line\n    \n    more\n\n f.py | 3 +++\n\ncommit {b}\nAuthor: B\nDate:   Tue\n\n    Merge branch\n"
    got = parsers.parse_git_log(docs(spark, t, None, "nothing"), "id", "t").orderBy("position").collect()
    assert [(r.commit_sha, r.author, r.date, r.message, r.changed_files, r.is_merge) for r in got] == [(a, "A <a@x>", "Mon", "First line\n\nmore", ["f.py"], False), (b, "B", "Tue", "Merge branch", [], True)]
    assert [r.commit_sha for r in parsers.parse_git_log(docs(spark, t), "id", "t", most=1).collect()] == [b]
    assert [r.commit_sha for r in parsers.parse_git_log(docs(spark, t), "id", "t", most=1, keep="head").collect()] == [a]
    marked = "<<<COMMIT_START>>>s1\nA\nMon\nmerge x\nbody\n<<<COMMIT_START>>>short\n"
    got = parsers.parse_git_log(docs(spark, marked), "id", "t").collect()
    assert [(r.commit_sha, r.author, r.date, r.message, r.is_merge) for r in got] == [("s1", "A", "Mon", "merge x\nbody", True)]


def test_markdown(spark):
    t = "---\ntitle: Test\nauthor: Alice\n---\nintro\n# A\ntext a\n## B\ntext b\n### C\n## D\n# E\nlast"
    got = parsers.parse_markdown(docs(spark, t, "plain text", None), "id", "t").orderBy("id", "position").collect()
    assert [(r.heading_level, r.heading_text, r.section_path) for r in got] == [(0, "", ""), (1, "A", "A"), (2, "B", "A > B"), (3, "C", "A > B > C"), (2, "D", "A > D"), (1, "E", "E"), (0, "", "")]
    assert got[1].section_text == "# A\n\ntext a"
    assert docs(spark, t).select(parsers.front_matter(F.col("t")).alias("m")).first().m == {"title": "Test", "author": "Alice"}


def test_python(spark):
    t = '"""Module doc."""\nimport os\nfrom a import (b,\n  c)\n\nclass A:\n    """Doc."""\n    def f(self): pass\n\n@dec\nasync def g():\n    """G."""\n'
    df = spark.createDataFrame([(1, t, "m.py"), (2, "def broken(\n  # unclosed", "x.py"), (3, None, None), (4, " ", "e.py")], "id int, t string, f string")
    got = parsers.parse_python(df, "id", "t", "f").orderBy("id", "position").collect()
    assert [(r.id, r.element_type, r.element_name, r.docstring) for r in got] == [(1, "module", "m.py", "Module doc."), (1, "import_block", "m.py:imports", ""), (1, "class", "A", "Doc."), (1, "function", "g", "G."), (2, "plain_text", "x.py", "")]


def docx(*parts):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = "".join(para(*p) if isinstance(p, tuple) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in p) + "</w:tbl>" for p in parts)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return data.getvalue()


def pdf(*pages):
    import zlib

    out = b"%PDF-1.4\n"
    for i, text in enumerate(pages):
        lines = b"".join(b"(%s) Tj T*\n" % x.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") for x in text.split("\n"))
        data = b"BT /F1 12 Tf 72 700 Td\n" + lines + b"[(sp) -300 (aced)] TJ ET"
        packed = zlib.compress(data) if i % 2 else data
        out += b"%d 0 obj\n<< /Type /Page /Contents %d 0 R >>\nendobj\n" % (10 + 2 * i, 11 + 2 * i)
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\n%s\nendstream\nendobj\n" % (11 + 2 * i, len(packed), b" /Filter /FlateDecode" if i % 2 else b"", packed)
    return out + b"%%EOF"


def test_binary_files(spark):
    assert parsers.pdf_pages(pdf("one (1)\ntwo", "thrée")) == ["one (1)\ntwo\nsp aced", "thrée\nsp aced"] and parsers.pdf_pages(b"no") == []
    made = docx(("Title", "Heading1"), ("body",), [("a", "b"), ("c", "d")], ("more",))
    df = spark.createDataFrame([("w", bytearray(made)), ("x", bytearray(b"no zip")), ("y", None)], "k string, content binary")
    got = parsers.read_docx(df, "k").orderBy("is_table", "position").collect()
    assert [(r.heading_level, r.section_text, r.section_path, r.is_table) for r in got] == [(1, "Title", "Title", False), (0, "body", "Title", False), (0, "more", "Title", False), (0, "| a | b |\n| --- | --- |\n| c | d |", "Title", True)]
    assert parsers.can_handle("PDF", "application/pdf") and parsers.can_handle("PYTHON", extension="PY") and not parsers.can_handle("GIT", extension="md")


def test_files_to_logged_chunks(spark):
    from traceloom.sources.ingestion import ingest_files

    sha = "a" * 40
    texts = {
        "a.md": "# T\n\nSome text that is long enough to stand for itself here.\n## U\nMore of it, which is long enough to stand for itself too.", "b.py": 'import os\n\n\ndef f():\n    """Doc of f."""\n    return os.name * 20  # enough text for a chunk',
        "c.txt": "From: A\nDate: x\nSubject: s\n\nThe body of the first mail.\nFrom: B\nDate: y\n\nThe second.", "d.log": f"commit {sha}\nAuthor: A\nDate:   Mon\n\n    A message\n",
        "g.txt": "[01/01/2024, 10:00] A: hello there\n[01/01/2024, 11:00] B: an hour later", "n.txt": "plain", "empty.txt": "", "z.bin": "?", "copy.md": "plain", "blank.md": "   ",
    }
    data = {k: v.encode() for k, v in texts.items()} | {"p.pdf": pdf("A page of text."), "w.docx": docx(("Head", "Heading1"), ("Text below it.",)), "noend": pdf("Typed by its bytes.")}
    df = spark.createDataFrame([(k, bytearray(v), len(v)) for k, v in data.items()], "filename string, content binary, length long")
    chunks, log, bad = ingest_files(df, spark.createDataFrame([], "file_hash string, status string"))
    kinds = {r.filename: (r.source_type, r.chunk_count) for r in log.collect()}
    assert {k: v[0] for k, v in kinds.items()} == {"a.md": "MARKDOWN", "b.py": "PYTHON", "c.txt": "EMAIL", "d.log": "GIT", "g.txt": "WHATSAPP", "copy.md": "MARKDOWN", "blank.md": "MARKDOWN", "p.pdf": "PDF", "w.docx": "DOCX", "noend": "PDF"}
    assert kinds["blank.md"][1] == 0 and kinds["a.md"][1] == 2 and kinds["g.txt"][1] == 1
    assert {r.filename for r in bad.collect()} == {"empty.txt", "z.bin"}
    rows = {(r.source_document, r.chunk_index): r for r in chunks.collect()}
    assert rows["c.txt", 1].normalized_text.startswith("[Previous context:]\nFrom: A") and rows["c.txt", 1].source_locator == "Message 2 from B" and "[Current window:]" in rows["g.txt", 0].normalized_text
    assert rows["d.log", 0].source_locator == "commit aaaaaaaa (Mon)" and rows["w.docx", 0].source_locator == "Head" and rows["p.pdf", 0].source_locator == "page 1"
    assert all(len(r.chunk_id) == 64 for r in rows.values()) and len({r.chunk_id for r in rows.values()}) == len(rows)
    again = ingest_files(df, log.select("file_hash", "status"))
    assert again[0].count() == 0 and again[1].count() == 0


def test_pages_and_paragraphs(spark):
    got = parsers.pages(spark.createDataFrame([("d", 1, " a "), ("d", 2, " "), ("d", 3, "c")], "k string, n int, t string"), "k", "n", "t").orderBy("position").collect()
    assert [(r.position, r.text, r.locator) for r in got] == [(1, "a", "page 1"), (3, "c", "page 3")]
    rows = [("Heading 1", "A"), ("Normal", "x"), ("Heading 3", "C"), ("Heading 2", "B"), ("Normal", "y"), ("Heading 1", "Z"), (None, "z"), ("Normal", " ")]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "k string, o int, style string, text string")
    got = parsers.paragraphs(df.withColumnRenamed("o", "position"), "k", "position").orderBy("position").collect()
    assert [r.section_path for r in got] == ["A", "A", "A > C", "A > B", "A > B", "Z", "Z"]
