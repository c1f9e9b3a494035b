from __future__ import annotations

import random

import numpy as np
import pytest

from traceloom.llm import abuse

NAMES = [a + b for a in ("Tor", "Mav", "Kel", "Dov", "Yas", "Bre") for b in ("fen", "nes", "vik", "dov", "len")]
PLAIN = ["The {} module returns {} rows.", "{} closed ticket {} on Monday.", "Kill the {} process after {} seconds.", "This stupid build of {} failed {} times.", "I was an idiot and forgot {} again, {} times.", "We discussed the {} moderation rules for {} hours."]
TOXIC = ["You are a brainless maggot, {}, leave now.", "{} is a filthy pig and should disappear.", "I will break your legs, {}, wait for it.", "Nobody likes you, {}, you worthless rat."]


def corpus(n, seed, style=lambda s, r: s):
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        lines = [r.choice(PLAIN).format(r.choice(NAMES), r.randrange(99)) for _ in range(r.randrange(1, 9))]
        bad = r.random() < 0.3
        if bad:
            lines.insert(r.randrange(len(lines) + 1), style(r.choice(TOXIC).format(r.choice(NAMES)), r))
        texts.append(r.choice([" ", "\n"]).join(lines))
        labels.append(bad)
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return abuse.fit(*corpus(500, 1))


def f1(model, texts, labels):
    hit = abuse.score_texts(model, texts) >= model.threshold
    return 2 * (hit & labels).sum() / (hit.sum() + labels.sum())


def test_held_out_accuracy(model):
    assert f1(model, *corpus(400, 2)) > 0.97


@pytest.mark.parametrize(
    "style",
    [
        lambda s, r: s.upper(),
        lambda s, r: s.replace("a", "а").replace("e", "е"),
        lambda s, r: s.replace("i", "1").replace("e", "3"),
        lambda s, r: s.replace("g", "ggg"),
        lambda s, r: s.replace("brainless", "b r a i n l e s s").replace("filthy", "f i l t h y").replace("worthless", "w o r t h l e s s"),
        lambda s, r: s.replace("ag", "*g").replace("pig", "p*g").replace("legs", "l*gs").replace("rat", "r*t"),
        lambda s, r: s.replace("ma", "m.a").replace("il", "i-l").replace("o", "o​"),
    ],
)
def test_spellings(model, style):
    assert f1(model, *corpus(300, 3, style)) > 0.9


def test_words():
    spell = lambda t: abuse.words([t], spell=True).spelt
    assert spell("Étttor A u s l ä n d e r n d3$k R129 42 q.uiero speаk ha*t") == ["etor", "auslandern", "desk", "r129", "42", "quiero", "speak", "ha*t"]
    assert spell("模块。好") == ["模", "块", "好"]
    assert spell("") == spell(" \n ​") == []
    found = abuse.words(["hello world", "", "hello"], spell=True)
    assert found.document.tolist() == [0, 0, 2] and found.hashes[0] == found.hashes[2] == abuse.word_hash("hello")


def test_one_line_in_a_long_text_counts(model):
    texts, _ = corpus(1, 9)
    long = " ".join(PLAIN[0].format(n, 5) for n in NAMES * 20)
    with_line = long + " You are a brainless maggot, Torfen, leave now. " + long
    assert abuse.score_texts(model, [with_line])[0] >= model.threshold > abuse.score_texts(model, [long])[0]


def test_tables(spark, model):
    texts, labels = corpus(200, 4)
    rows = [(i, t, "s1" if i % 2 else " S1", 1.0) for i, t in enumerate(texts)] + [(900, None, None, 1.0), (901, " ", "s2", 1.0), (3, texts[3], "s1", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    marks = [(i, a, "insult" if bad else "none") for i, bad in enumerate(labels) for a in "ab"] + [(i, "c", "unsure") for i in range(50)] + [(5, "d", None), (None, "a", "hate"), (7777, "a", "hate")]
    votes = spark.createDataFrame(marks + marks[:9], "doc_id long, annotator string, category string")
    fitted = abuse.fit_on_labels(docs, votes)
    scored = abuse.score_documents(docs, fitted, also=("source",)).dropDuplicates(["doc_id"])
    got = {r.doc_id: r.found for r in scored.collect()}
    assert got[900] is False and got[901] is False and len(got) == 202
    assert np.mean([got[i] == bool(b) for i, b in enumerate(labels)]) > 0.95
    report = {r.source_name: (r.n_documents, r.n_found) for r in abuse.rate_report(scored).collect()}
    assert report["s1"][0] == 200 and report[None] == (1, 0)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = abuse.fit_on_labels(docs, spark.createDataFrame([], "doc_id long, annotator string, category string"))
    assert none is None and [r.found for r in abuse.score_documents(docs, none).collect()] == [False]
    assert abuse.score_documents(docs.limit(0), none).collect() == []


def test_majority(spark):
    rows = [(1, "a", "hate"), (1, "a", "hate"), (1, "b", "none"), (2, "a", " Insult "), (3, "a", "unsure"), (4, "a", "none"), (4, "b", "none"), (4, "c", "threat")]
    got = abuse.majority(spark.createDataFrame(rows, "doc_id long, annotator string, category string")).collect()
    assert {r.doc_id: r.toxic for r in got} == {2: True, 4: False}
