from __future__ import annotations

import random
import unicodedata

import pytest

from traceloom.llm.splitting import KINDS, split_oversized, split_text


def check(text, kind="", size=1500, overlap=150):
    pieces = split_text(text, kind, size, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for i, (s, e, o) in enumerate(pieces):
        assert 0 < e - s <= size and 0 <= o <= overlap
        if i:
            assert s == pieces[i - 1][1] - o and s > pieces[i - 1][0] and e > pieces[i - 1][1]
    assert "".join(text[s + o : e] for s, e, o in pieces) == text
    return pieces


def texts():
    r = random.Random(2)
    words = ["alpha", "beta,", "gamma.", "delta;", "Epsilon!", "模块。", "é́", "x" * 30, "\n", "\n\n", "\r\n", "# Title", "def f():", "[17/11/2024, 06:02:34] A: b"]
    yield from (" ".join(r.choice(words) for _ in range(r.randrange(300, 3000))) for _ in range(40))
    yield from ("a" * 50_000, "é" * 9000, "x" * 1501, " " * 4000, "\r\n" * 2000, "词" * 10_000, ("y" * 1499 + " ") * 40, "👍🏽" * 3000)


def test_every_piece_within_limits_and_all_of_the_text():
    for t in texts():
        for kind in ("", *KINDS):
            check(t, kind)
        check(t[:1600], "", 100, 90)
        check(t[:1600], "", 100, 99)
        check(t[:1600], "", 10, 0)


def test_cuts_at_natural_boundaries():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(20))
    pieces = check(text)
    assert all(text[e - 2 : e] == "\n\n" for _, e, _ in pieces[:-1])
    code = "\n\n".join(f"def f{i}():\n" + "    x = 1\n" * 40 for i in range(20))
    assert all(code[e : e + 4] == "def " for _, e, _ in check(code, "PYTHON")[:-1])


def test_pieces_are_balanced():
    lengths = [e - s for s, e, _ in check("word " * 2000)]
    assert max(lengths) - min(lengths) < 200


def test_no_character_is_parted():
    text = "e" + "́" * 3
    pieces = split_text(text * 1000, "", 1500, 150)
    assert all(not unicodedata.combining((text * 1000)[e]) for _, e, _ in pieces[:-1])


def test_a_text_of_two_pieces_without_boundaries_is_balanced_and_parts_no_character():
    for text in ("a" * 2000, "词" * 2500, "e\u0301" * 900, "e\u0301\u0301" * 601, "x" * 1349 + "e\u0301\u0301\u0301" * 200):
        pieces = check(text)
        lengths = [e - s for s, e, _ in pieces]
        assert len(pieces) == 2 and max(lengths) - min(lengths) < 200
        assert all(not unicodedata.combining(text[p]) for s, e, _ in pieces for p in (s, e) if 0 < p < len(text))


def test_table(spark):
    rows = [(1, None, "PDF", "p1"), (2, "", "PDF", None), (3, "s" * 1500, None, "p"), (4, "w " * 900, None, None), (5, "w " * 900, "EMAIL", "loc"), (5, "w " * 900, "EMAIL", "loc")]
    df = spark.createDataFrame(rows, "chunk_uid long, chunk_text string, source_type string, source_locator string").selectExpr("*", "1 as piece_no", "2 as char_count")
    out = split_oversized(df, "chunk_uid").collect()
    assert {r.chunk_uid for r in out} == {4, 5}
    assert all(r.char_count == len(r.piece_text) <= 1500 for r in out)
    assert {r.source_locator for r in out if r.chunk_uid == 5} == {"loc"}
    assert split_oversized(df.limit(0), "chunk_uid").collect() == []
    with pytest.raises(ValueError):
        split_oversized(df, "chunk_uid", size=100, overlap=100)
