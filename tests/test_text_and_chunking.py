from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from traceloom.functions import text as T
from traceloom.operators import chunking as C


def value(spark, column, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(column.alias("v")).first().v


def sentences(t):
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t) if x.strip()]


def pack(parts, size):
    out, cur = [], ""
    for p in parts:
        if cur and len(cur) + len(p) + 2 > size:
            out.append(cur)
            cur = ""
        cur = f"{cur}\n\n{p}" if cur else p
    return out + [cur] if cur else out


def split_large(t, size):
    if len(t) <= size:
        return [t]
    for parts in ([x.strip() for x in re.split(r"\n\s*\n", t) if x.strip()], sentences(t)):
        if len(parts) > 1:
            return pack(parts, size)
    return [t]


def limits(t, size, least):
    out, cur = [], None
    for p in split_large(t, size):
        cur = p if cur is None else f"{cur}\n\n{p}"
        if len(cur) >= least:
            out.append(cur)
            cur = None
    return out + [cur] if cur is not None else out


def overlap(parts, n):
    out = []
    for p in parts:
        out.append(p if not out else (out[-1][-n:] + "\n\n" + p).strip())
    return out


def documents():
    r = random.Random(8)
    for _ in range(60):
        lines = [" ".join(r.choice(["Alpha", "beta", "Übung", "x" * 20, "17"]) for _ in range(r.randrange(1, 12))) + r.choice([".", "!", "?", ""]) for _ in range(r.randrange(1, 30))]
        yield "".join(line + r.choice([" ", "  ", "\n", "\n\n", "\n \n"]) for line in lines)


def test_chunks_equal_a_plain_fold(spark):
    docs = [d for d in documents() if d.strip()] + ["short", "A. " * 400]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    got = {}
    for r in C.chunk_documents(df, "id", "t", overlap=True, size=200, least=30).collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.chunk_text
        assert r.char_count == len(r.chunk_text)
    for i, d in enumerate(docs):
        assert [got[i][k] for k in sorted(got[i])] == overlap(limits(d, 200, 30), 150)


def test_blank_documents_give_no_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "id int, t string")
    assert C.chunk_documents(df, "id", "t").collect() == []


def test_elements_merge_forward_and_keep_the_first_locator(spark):
    rows = [("d", 1, "tiny", "p1", {"a": "1"}), ("d", 2, "long enough text here", "p2", {"a": "2", "b": "3"}), ("d", 3, "end", "p3", None), ("d", 4, "  ", "p4", None)]
    df = spark.createDataFrame(rows, "k string, o int, text string, locator string, metadata map<string,string>")
    got = C.chunk_elements(df, "k", ["o"], overlap=False, least=10).orderBy("chunk_index").collect()
    assert [(r.chunk_text, r.source_locator, r.metadata) for r in got] == [("tiny\n\nlong enough text here", "p1", {"a": "2", "b": "3"}), ("end", "p3", {})]


def brute_elements(pieces, size, least, n, kind=""):
    """A document's (text, locator) pieces to chunks by a plain loop."""
    out, cur = [], None
    for text, locator in pieces:
        for p in C.cut(text.strip(), size, kind) if text.strip() else []:
            cur = (p, locator) if cur is None else (f"{cur[0]}\n\n{p}", cur[1])
            if len(cur[0]) >= least:
                out.append(cur)
                cur = None
    out += [cur] if cur is not None else []
    texts = overlap([x for x, _ in out], n) if n else [x for x, _ in out]
    return list(zip(texts, [x for _, x in out]))


def test_elements_of_hot_and_small_documents_equal_a_plain_loop(spark):
    r = random.Random(4)
    word = lambda n: " ".join(r.choice(["Alpha.", "beta", "Gamma!"]) for _ in range(n))
    rows = [("hot", i, word(r.choice([1, 1, 2, 9, 40]))) for i in range(700)] + [("short", i, "ok") for i in range(400)] + [(f"d{i % 40}", i, word(r.randrange(0, 30))) for i in range(400)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "k string, o int, text string").selectExpr("*", "concat('p', o) as locator", "map('a', cast(o as string)) as metadata", "1 as position")
    want = {}
    for k in {x[0] for x in rows if x[0]}:
        want[k] = brute_elements([(t, f"p{o}") for kk, o, t in sorted((x for x in rows if x[0] == k)) ], 120, 50, 150)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):  # one part, and several in which documents end and begin
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            got = {}
            for x in C.chunk_elements(df, "k", ["o"], size=120).collect():
                got.setdefault(x.k, {})[x.chunk_index] = (x.chunk_text, x.source_locator)
            assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_chunks_by_type(spark):
    page = spark.createDataFrame([("d", 1, "one short page"), ("d", 2, "another"), ("d", 3, ("A sentence here. " * 40).strip())], "k string, position int, text string")
    got = C.page_chunks(page, "k", size=200).orderBy("chunk_index").collect()
    assert got[0].source_locator == "page 1" and got[0].chunk_text.startswith("one short page\n\nanother\n\nA sentence") and got[0].metadata["page_number"] == "3" and got[0].metadata["source_type"] == "PDF"
    assert all(len(x.chunk_text) <= 200 + 152 + 30 for x in got) and [x.chunk_index for x in got] == list(range(len(got)))
    code = "# T\n\n```\n" + "x = 1\n\n" * 20 + "```\n\n" + "word " * 40
    rows = [("m", 0, 0, "", "", ""), ("m", 1, 1, "T", code, "T"), ("m", 2, 0, "", "tail " * 20, "")]
    sections = spark.createDataFrame(rows, "k string, position int, heading_level int, heading_text string, section_text string, section_path string")
    got = C.section_chunks(sections, "k", size=100).orderBy("chunk_index").collect()
    assert any(x.chunk_text.count("```") == 2 for x in got) and got[-1].source_locator == "section 3" and got[0].metadata["heading_text"] == "T"
    rows = [("w", 0, 0, "", "intro", ""), ("w", 1, 1, "A", "A", "A"), ("w", 2, 0, "", "body one", "A"), ("w", 3, 0, "", "body two", "A"), ("w", 4, 2, "B", "B", "A > B")]
    elements = spark.createDataFrame(rows, "k string, position int, heading_level int, heading_text string, section_text string, section_path string")
    got = C.document_chunks(elements, "k", least=1).orderBy("chunk_index").collect()
    assert [(x.source_locator, x.chunk_text.split("\n\n")[-1]) for x in got] == [("(body)", "intro"), ("A", "body two"), ("A > B", "B")]
    assert "A\n\nbody one\n\nbody two" in got[1].chunk_text


@pytest.mark.parametrize(("t", "want"), [("27/01/2023, 10:00:05", "2023-01-27 10:00:05"), ("01/02/2023, 10:00", "2023-02-01 10:00:00"), ("01/27/2023, 10:00:05", "2023-01-27 10:00:05"), ("1/27/23, 9:05 PM", "2023-01-27 21:05:00"), ("27/1/23, 9:05 pm", "2023-01-27 21:05:00"), ("01/27/2023, 10:00", None), ("soon", None), ("", None), (None, None), ("01/02/23, 7:08", "2023-02-01 07:08:00")])
def test_chat_times(spark, t, want):
    got = value(spark, C.chat_time(F.col("t")), t=t)
    assert (got and str(got)) == want


def test_fences_hide_blank_lines(spark):
    t = "one\n\n```\ncode\n\nmore\n```\n\ntwo\n\n~~~\na\n\nb\n~~~"
    assert C.paragraphs("plain", "MARKDOWN") == ["plain"] and C.paragraphs("a\n \nb\n\n\nc", "MARKDOWN") == ["a\n \nb", "c"]
    assert C.paragraphs(t, "MARKDOWN") == ["one", "```\ncode\n\nmore\n```", "two", "~~~\na\n\nb\n~~~"]


def test_trailing_context(spark):
    df = spark.createDataFrame([("d", i, f"m{i}") for i in range(4)] + [("e", 0, "x")], "k string, o int, t string")
    for width in (1, 2, 3, 100_000):
        got = {(r.k, r.o): r.context for r in C.trailing_context(df, "k", "o", "t", width=width).collect()}
        assert got == {("d", 0): None, ("d", 1): "m0", ("d", 2): "m0\n---\nm1", ("d", 3): "m1\n---\nm2", ("e", 0): None}


def test_chat_windows_split_only_above_the_gap_and_by_readable_times(spark):
    minute = 60_000_000
    rows = [("d", i, us, "t", "s", f"m{i}") for i, us in enumerate([0, 30 * minute, None, 61 * minute, 50 * minute, 200 * minute])]
    df = spark.createDataFrame(rows, "k string, o int, us long, timestamp string, sender string, message_text string")
    for width in (1, 2, 4, 100_000):
        windows = C.chat_windows(df, "k", "o", "us", width=width)
        assert [r.window_no for r in windows.orderBy("o").collect()] == [0, 0, 0, 1, 1, 2], width
    text = C.chat_chunks(windows, "k", "o").orderBy("window_no").first()
    assert text.text == "[t] s: m0\n[t] s: m1\n[t] s: m2" and text.message_count == 3 and text.participants == ["s"]


def test_a_chat_window_is_cut_by_its_own_length_only(spark):
    # 99,998 to 100,003 straddle a multiple of the slice width
    rows = [("d", 99_998 + i, i // 5, f"t{i}", f"s{i % 2}", f"m{i}") for i in range(6)] + [("e", 7, 0, "t", None, None)]
    df = spark.createDataFrame(rows, "k string, o long, window_no long, timestamp string, sender string, message_text string")
    for width in (1, 2, 4, 100_000):
        got = [tuple(r) for r in C.chat_chunks(df, "k", "o", width=width).orderBy("k", "window_no", "part_no").collect()]
        assert got == [
            ("d", 0, 0, "\n".join(f"[t{i}] s{i % 2}: m{i}" for i in range(5)), "t0 to t4", ["s0", "s1"], 5),
            ("d", 1, 0, "[t5] s1: m5", "t5 to t5", ["s1"], 1), ("e", 0, 0, "[t] Unknown: ", "t to t", ["Unknown"], 1),
        ], width
        cut = C.chat_chunks(df.filter("k = 'd' and window_no = 0"), "k", "o", width=width, most=24).orderBy("part_no").collect()
        assert [(r.part_no, r.message_count, r.locator) for r in cut] == [(0, 2, "t0 to t1"), (1, 2, "t2 to t3"), (2, 1, "t4 to t4")], width


def test_mail_and_chat_chunks_hold_their_context_and_limits(spark):
    rows = [("d", i, "s", "t", "u", body) for i, body in enumerate(["one " * 15, " ", "two " * 15, "three " * 15, "four"])]
    df = spark.createDataFrame(rows, "k string, o long, sender string, timestamp string, subject string, body string")
    raw = [f"From: s | Date: t | Subject: u\n\n{b.strip()}" for _, _, _, _, _, b in rows if b.strip()]
    whole = [raw[0]] + ["[Previous context:]\n" + "\n---\n".join(raw[max(0, i - 2) : i]) + f"\n[End context]\n\n{raw[i]}" for i in range(1, 4)]
    want = []
    for piece in [p for t in whole for p in split_large(t, 150)]:
        if want and len(want[-1]) < 50:
            want[-1] += "\n\n" + piece
        else:
            want.append(piece)
    for width in (1, 2, 100_000):
        got = C.email_chunks(df, "k", "o", size=150, width=width).orderBy("chunk_index").collect()
        assert [r.chunk_text for r in got] == want and [r.chunk_index for r in got] == list(range(len(want))), width

    chat = spark.createDataFrame([("d", i, w, f"t{i}", "s", m) for i, (w, m) in enumerate([(0, "x" * 60), (1, "y" * 60), (2, "z" * 60), (2, "long\n\n" + "v" * 200)])], "k string, o long, window_no long, timestamp string, sender string, message_text string")
    line = [f"[t{i}] s: {m}" for i, m in enumerate(["x" * 60, "y" * 60, "z" * 60, "long\n\n" + "v" * 200])]
    texts = [line[0], f"[Context:]\n{line[0]}\n\n[Current window:]\n{line[1]}", f"[Context:]\n{line[0]}\n{line[1]}\n\n[Current window:]\n{line[2]}\n{line[3]}"]
    for width in (1, 2, 4, 100_000):
        got = C.chat_context_chunks(chat, "k", "o", size=200, width=width).orderBy("chunk_index").collect()
        assert [(r.chunk_text, r.source_locator) for r in got] == [(p, loc) for t, loc in zip(texts, ["t0 to t0", "t1 to t1", "t2 to t3"]) for p in split_large(t, 200)], width


def test_commits_list_at_most_twenty_files(spark):
    df = spark.createDataFrame([("a" * 40, "A", "d", "m", [f"f{i}" for i in range(30)]), (None, None, None, None, None)], "commit_sha string, author string, date string, message string, changed_files array<string>")
    rows = C.commit_chunks(df).collect()
    assert rows[0].text.count("\n- ") == 20 and rows[0].locator == "commit aaaaaaaa (d)"
    assert rows[1].text == "Commit: \nAuthor: \nDate: \n\n"


@pytest.mark.parametrize("t", ["a\n\n\n\n\nb", "word1    word2\t\tword3", "  hello  ", "ﬁne  ①\u00a0x", "", "\n \n\n\n x", "e\u0301 ..."])
def test_normalise(spark, t):
    want = re.sub(r"\n{3,}", "\n\n", unicodedata.normalize("NFKC", t))
    want = "\n".join(re.sub(r"[ \t]{2,}", " ", line) for line in want.split("\n")).strip()
    assert value(spark, T.normalise(F.col("t")), t=t) == want


def test_tokens_in_any_script(spark):
    t = "Straße well-known -x- a_b Ünï 模块 c3po 1.5"
    assert value(spark, T.tokens(F.col("t")), t=t) == re.findall(r"\b[\w-]+\b", t.lower())


@pytest.mark.parametrize(
    ("t", "good", "bad"),
    [("Excellent work. Score: 9/10", True, False), ("Poor, incomplete and missing", True, True), ("7/10", True, False), ("4.5/10", False, True), ("debugged", False, True), ("plain", False, False), ("9/100", True, False), ("Score: 3", False, True)],
)
def test_sentiment(spark, t, good, bad):
    assert (value(spark, T.is_positive(F.col("t")), t=t), value(spark, T.is_negative(F.col("t")), t=t)) == (good, bad)


def test_word_overlap(spark):
    assert value(spark, T.word_overlap(F.col("a"), F.col("b")), a="one two", b="Two three") == 0.5
    assert value(spark, T.word_overlap(F.col("a"), F.col("b")), a="", b="x") == 1.0
