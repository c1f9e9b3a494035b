"""Queries over whole tables that SQL cannot follow, against brute force on a small fixture."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from datetime import datetime

import __spark_entry__ as entry

TEXTS = [
    "One. Two! Three?", "Café opened. It’s fine — really. Über alles. Now", "模块完成。 第二句. Then A. B", "para one\n\n“para two”\n \n\npara 3",
    "ﬁne  ① x\n\n\n\ny", "plain\n\nascii", " \n ", "", None,
]


def run(spark, folder, name):
    return entry.queries()[name](spark, str(folder)).collect()


def test_sentences_and_paragraphs_of_all_documents(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    count = lambda gap, t: len([x for x in re.split(gap, t) if x.strip()])
    known = {i: t for i, t in enumerate(TEXTS) if t is not None}
    assert {r.doc_id: r.n_sentences for r in run(spark, tmp_path, "c01_sentences")} == {i: count(r"(?<=[.!?])\s+(?=[A-Z])", t) for i, t in known.items()}
    assert {r.doc_id: r.n_paragraphs for r in run(spark, tmp_path, "c02_paragraphs")} == {i: count(r"\n\s*\n", t) for i, t in known.items()}


def test_normal_forms_of_all_chunks(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "chunk_uid long, chunk_text string").write.parquet(str(tmp_path / "raw_chunks.parquet"))
    want = {}
    for i, t in enumerate(TEXTS):
        form = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", unicodedata.normalize("NFKC", t or ""))).strip()
        if form:
            want[i] = hashlib.sha256(form.encode()).hexdigest()
    assert {r.chunk_uid: r.text_hash for r in run(spark, tmp_path, "n01_normalise")} == want


def test_answers_with_brackets_in_their_texts(spark, tmp_path):
    texts = ["plain", "a ] b", "[x] y", "see {k} now", "open [ only", "close } only"]
    rows = [(i, "REQUIREMENT", f"R{i}", texts[i // 4], None, "d", "c", datetime(2024, 1, 1)) for i in range(4 * len(texts))]
    spark.createDataFrame(rows, "seq long, entity_type string, entity_id string, text string, linked_requirement string, source_document string, chunk_id string, created_at timestamp").write.parquet(str(tmp_path / "evidence.parquet"))

    def readable(i, text):
        answer = json.dumps([{"entity_type": "REQUIREMENT", "entity_id": f"R{i}", "text": text, "linked_requirement": ""}])
        answer = [answer, f"```json\n{answer}\n```", f"Here it is: {answer}", "No entities, sorry."][i % 4]
        for pattern in (None, r"```(?:json)?\s*(\[[\s\S]*?\]|\{[\s\S]*?\})\s*```", r"(\[[\s\S]*?\]|\{[\s\S]*?\})"):
            found = answer if pattern is None else (m := re.search(pattern, answer)) and m.group(1)
            try:
                json.loads(found or "")
                return True
            except ValueError:
                pass
        return False

    want = {i: readable(i, texts[i // 4]) for i in range(len(rows))}
    assert {r.seq: r.readable for r in run(spark, tmp_path, "x05_json_recovery")} == want
    assert Counter(r.entity_type for r in run(spark, tmp_path, "x06_validate")) == Counter(REQUIREMENT=sum(want.values()))


def test_a_long_git_log_keeps_all_its_commits(spark, tmp_path):
    rows = [(i, "log" if i % 3 else None, f"{i:040x}", "A", "d", f"m{i}\nmore") for i in range(1200)]
    spark.createDataFrame(rows, "commit_row long, source_document string, commit_sha string, author string, date string, message string").write.parquet(str(tmp_path / "git_commits.parquet"))
    got = {(r.source_document, r.position): (r.commit_sha, r.message_hash) for r in run(spark, tmp_path, "s18_git_commits")}
    want = {}
    for source in ("log", None):
        own = [r for r in rows if r[1] == source]
        want |= {(source, i): (r[2], hashlib.sha256(r[5].encode()).hexdigest()) for i, r in enumerate(own)}
    assert got == want
