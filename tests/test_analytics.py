from __future__ import annotations

import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.functions import providers
from traceloom.operators import correlate, extraction, graph, matrix, metrics, retrieval, store, trace

EVIDENCE = "seq long, entity_type string, entity_id string, text string, linked_requirement string, source_document string, chunk_id string, created_at timestamp"
CANDIDATES = "req_id string, chunk_id string, vector_score double, bm25_score double, id_match boolean, combined_score double"
T = datetime(2024, 1, 1)


def evidence(spark, *rows):
    return spark.createDataFrame([(i, *r, T) for i, r in enumerate(rows)], EVIDENCE)


def test_vector_search_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, [0.0] * 8), (901, None), (902, [])], "row_id long, vector array<float>")
    queries = rows.filter("row_id % 20 = 0 or row_id > 899").withColumnRenamed("row_id", "query_id")
    got = {}
    for r in retrieval.vector_top_k(queries, rows.repartition(3), 5, query_block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.row_id
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in range(0, 300, 20):
        s = np.round(np.maximum(u @ u[q], 0), 9)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:5]
        assert [got[q][k] for k in range(1, 6)] == want
    assert set(got) == set(range(0, 300, 20))
    assert retrieval.vector_top_k(queries, rows.limit(0)).count() == 0


def test_bm25_equals_the_formula(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "b", "c", "dd", "e-f", "the", "the"]) for _ in range(r.randrange(1, 30))) for _ in range(60)] + ["the rare word", ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "row_id long, text string")
    counted = retrieval.term_counts(docs.filter("text is not null"))
    queries = spark.createDataFrame([("q1", "a the rare rare"), ("q2", "nothing"), ("q3", "e-f b")], "query_id string, text string")
    got = {(x.query_id, x.row_id): x.score for x in retrieval.bm25_top_k(queries, counted, retrieval.term_statistics(counted), k=100).collect()}
    bags = [Counter(t.split()) for t in texts]
    n, avg = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    want = {}
    for q, words in (("q1", "a the rare rare".split()), ("q3", "e-f b".split())):
        for i, b in enumerate(bags):
            s = sum(idf.get(w, 0) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) for w in words)
            if s > 0:
                want[q, i] = s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_id_matches(spark):
    ids = spark.createDataFrame([("R1",), ("r1",), ("R12",), (" ",), (None,), ("x",)], "query_id string")
    docs = spark.createDataFrame([(1, "see R12."), (2, "nothing"), (3, None), (4, "R1 r1")], "row_id long, text string")
    assert {(r.query_id, r.row_id) for r in retrieval.id_matches(ids, docs, id_block=2).collect()} == {("R1", 1), ("r1", 1), ("R12", 1), ("R1", 4), ("r1", 4)}


def test_merge(spark):
    rows = [("q", "a", 0.8, None, False, "vector"), ("q", "a", None, 1.0, False, "bm25"), ("q", "b", None, 0.5, False, "bm25"), ("q", "c", None, None, True, "id_match"), ("q", "d", 0.0, None, False, "vector")]
    rows += [("q", f"x{i:02}", 0.1, None, False, "vector") for i in range(30)]
    df = spark.createDataFrame(rows, "query_id string, row_id string, vector_score double, bm25_score double, id_match boolean, method string")
    got = retrieval.merge(df).orderBy("rank").collect()
    assert len(got) == 15 and [(r.row_id, r.combined_score, r.retrieval_method) for r in got[:3]] == [("c", 0.95, "id_match"), ("a", 0.86, "bm25,vector"), ("b", 0.5, "bm25")]
    assert len(retrieval.merge(df.filter("not id_match")).collect()) == 10


@pytest.mark.parametrize(
    ("answer", "n_good", "n_bad"),
    [
        ('[{"entity_type":"REQUIREMENT","entity_id":"R1","text":"t","linked_requirement":" "}]', 1, 0),
        ('```json\n[{"entity_type":"requirement","entity_id":"R1","text":"t"}]\n```', 1, 0),
        ('Sure: [{"entity_type":"EVALUATION","entity_id":"E1","text":"t","x":1}] bye', 1, 0),
        ('{"entity_type":"IMPLEMENTATION","entity_id":"I1","text":"t"}', 1, 0),
        ("Not JSON at all, just text.", 0, 1),
        ("[]", 0, 0),
        ('[{"entity_type":"OTHER","entity_id":"R1","text":"t"},{"entity_type":"EVALUATION","entity_id":"E","text":""},{"entity_type":"EVALUATION","entity_id":"E","text":"ok"}]', 1, 2),
        (None, 0, 1),
    ],
)
def test_validation(spark, answer, n_good, n_bad):
    df = spark.createDataFrame([(answer, "doc", "chunk", "the t text ok")], "raw_response string, source_document string, chunk_id string, source_text string")
    good, bad = extraction.validate(df)
    rows = good.collect()
    assert (len(rows), bad.count()) == (n_good, n_bad)
    assert all((r.source_document, r.chunk_id, r.linked_requirement) == ("doc", "chunk", None) for r in rows)


def test_doubtful_texts_are_flagged(spark):
    df = spark.createDataFrame([('[{"entity_type":"EVALUATION","entity_id":"E","text":"alpha beta gamma delta"}]', "d", "c", "alpha only")], "raw_response string, source_document string, chunk_id string, source_text string")
    row = extraction.validate(df)[0].first()
    assert row.word_overlap_ratio == 0.25 and row.hallucination_risk


def test_golden_cases(spark):
    ev = evidence(
        spark,
        ("REQUIREMENT", "R1-jwt-auth", "Login with tokens", None, "a.docx", "c1"), ("IMPLEMENTATION", "I1", "JWT module", "R1-jwt-auth", "a.py", "c2"), ("EVALUATION", "E1", "The module is well-implemented. Score: 9/10", "R1-jwt-auth", "r.pdf", "c3"),
        ("REQUIREMENT", "R2-gnn", "Train a network", None, "a.docx", "c4"), ("IMPLEMENTATION", "I2", "Training loop", "R2-gnn", "b.py", "c5"), ("EVALUATION", "E2", "Results are incomplete, 4/10", "R2-gnn", "r.pdf", "c6"),
        ("REQUIREMENT", "R3-api", "A REST interface", None, "a.docx", "c7"), ("IMPLEMENTATION", "I3", "Endpoints", "R3-api", "c.py", "c8"),
        ("REQUIREMENT", "R4-data", "Clean the data", None, "a.docx", "c9"),
        ("REQUIREMENT", "R5-x", "Another thing", None, "a.docx", "c10"), ("REQUIREMENT", "R6-y", "One more", None, "a.docx", "c11"),
        ("EVALUATION", "E9", "General praise for effort and teamwork overall throughout", None, "r.pdf", "c12"), ("EVALUATION", "E8", "Clean data was good", " ", "r.pdf", "c13"),
    )
    cand = spark.createDataFrame([("R4-data", "k1", None, None, False, 0.05), ("R5-x", "k2", None, None, False, 0.8), ("R5-x", "k2", None, None, False, 0.7), ("R5-x", "k3", None, None, False, float("nan")), ("R6-y", "k4", None, None, False, 0.525)], CANDIDATES)
    got = {r.requirement_id: (r.rule_name, r.status, r.evidence_entity_id) for r in correlate.decide(ev.unionByName(ev.limit(5)), cand).collect()}
    assert got == {
        "R1-jwt-auth": ("exact_requirement_id_match", "IMPLEMENTED_AND_VALIDATED", "I1"),
        "R2-gnn": ("exact_requirement_id_match", "IMPLEMENTED_BUT_NEGATIVELY_EVALUATED", "I2"),
        "R3-api": ("exact_requirement_id_match", "IMPLEMENTED_WITHOUT_EVALUATION", "I3"),
        "R4-data": ("requirement_with_no_evidence", "REQUIREMENT_NOT_IMPLEMENTED", "(none)"),
        "R5-x": ("strong_semantic_match", "IMPLEMENTED_WITHOUT_EVALUATION", "k2"),
        "R6-y": ("ambiguous_with_retrieval_evidence", None, "(none)"),
    }
    orphan = {r.entity_id: r.requirement_id for r in correlate.orphan_evaluations(ev).collect()}
    assert orphan == {"E9": None, "E8": "R4-data"}


def test_the_whole_run(spark):
    ev = evidence(
        spark, ("REQUIREMENT", "R1", "alpha beta", None, "a.docx", "c1"), ("REQUIREMENT", "R2", "gamma", None, "a.docx", "c2"), ("REQUIREMENT", "R3", "delta", None, "a.docx", "c3"), ("REQUIREMENT", "R4", "", None, "a.docx", "c3"),
        ("IMPLEMENTATION", "I1", "We built gamma", "R2", "chat.txt", "c4"), ("IMPLEMENTATION", "I2", "We built it", None, "chat.txt", "c5"), ("IMPLEMENTATION", "I3", "We built it", "R99", "chat.txt", "c5"),
        ("EVALUATION", "E1", "delta is here", " ", "r.pdf", "c6"), ("EVALUATION", "E2", "nothing of that kind", None, "r.pdf", "c7"), ("EVALUATION", "E3", "good", "R2", "r.pdf", "c8"),
    )
    scores = [("R1", f"k{i}", 0.3 + i / 100) for i in range(7)] + [("R1", "k0", 0.5), ("R1", "low", 0.29), ("R1", "nan", float("nan")), ("R2", "a", 0.1), ("R2", "b", 0.2), ("R2", "c", 0.2), ("R2", "d", 0.3), ("R4", "k1", 0.5)]
    cand = spark.createDataFrame([(r, c, None, None, False, s) for r, c, s in scores], CANDIDATES)
    chunks = spark.createDataFrame([("k0", "x.md", "alpha here"), ("k6", "y.md", "beta here"), ("low", "z.md", "beta")], "chunk_id string, source_document string, chunk_text string")
    done = trace.run(ev.unionByName(ev.limit(5)), cand, chunks)
    rows = {r.correlation_id: r for r in done.correlations.collect()}
    assert {k: (r.requirement_entity_id, r.evidence_entity_id, r.status, r.rule_confidence, r.n_supporting) for k, r in rows.items()} == {
        "ambiguous:R1": ("R1", "k0", "IMPLEMENTED_WITHOUT_EVALUATION", 0.0, 5),
        "rule:R2": ("R2", "I1", "IMPLEMENTED_AND_VALIDATED", 0.95, 2),
        "rule:R3": ("R3", "(none)", "REQUIREMENT_NOT_IMPLEMENTED", 0.8, 0),
        "claim:4": ("R2", "d", "IMPLEMENTED_WITHOUT_EVALUATION", 0.0, 4),
        "orphan:7": ("R3", "E1", "IMPLEMENTED_WITHOUT_EVALUATION", 0.0, 1),
        "orphan:8": ("(unlinked)", "E2", "EVALUATION_WITHOUT_REQUIREMENT", 0.8, 1),
    }
    support = {}
    for r in done.support.collect():
        support.setdefault(r.correlation_id, []).append(r.chunk_id)
    assert {k: sorted(v) for k, v in support.items()} == {"ambiguous:R1": ["k0", "k3", "k4", "k5", "k6"], "rule:R2": ["c4", "c8"], "claim:4": ["b", "c", "c4", "d"], "orphan:7": ["c6"], "orphan:8": ["c7"]}
    built = {r.requirement_id: (r.status, r.evidence_count, r.source_documents) for r in done.matrix.collect()}
    assert built["R1"] == ("IMPLEMENTED_WITHOUT_EVALUATION", 9, ["x.md", "y.md"]) and built["R2"][0] == "IMPLEMENTED_AND_VALIDATED" and built["R4"][0] == "REQUIREMENT_NOT_IMPLEMENTED"
    only = trace.run(ev, cand, chunks, factory=None, run_id="7")
    assert only.correlations.count() == 3 and only.correlations.filter("length(correlation_id) = 64").count() == 3
    none = trace.run(ev.limit(0), cand.limit(0), chunks.limit(0))
    assert none.correlations.count() == none.support.count() == none.matrix.count() == 0


def test_an_older_confident_correlation_does_not_count(spark):
    ev, co = small_graph(spark)
    stale = co.filter("correlation_id = 'k1'").withColumn("created_at", F.col("created_at") - F.expr("interval 1 day")).withColumn("correlation_id", F.lit("old")).withColumn("confidence", F.lit(0.99)).withColumn("status", F.lit("IMPLEMENTED_AND_VALIDATED")).withColumn("evidence_entity_id", F.lit("E2"))
    both = co.unionByName(stale.select(co.columns))
    assert {r.requirement_id: r.status for r in matrix.load_latest(ev, both).collect()} == {"R1": "PARTIALLY_IMPLEMENTED", "R2": "PARTIALLY_IMPLEMENTED"}
    assert {r.requirement_id: r.confidence for r in matrix.load_latest(ev, both).collect()}["R1"] == 0.9
    assert "E2" not in {r.dst for r in graph.correlates_to(ev, both).collect()} and graph.correlates_to(ev, co).count() == graph.correlates_to(ev, both).count()
    assert graph.correlates_to(ev, both).filter("correlation_id = 'old'").count() == 0


@pytest.mark.parametrize(("best", "method", "n", "d", "status", "want"), [(0.85, "deterministic_rule", 2, 2, "IMPLEMENTED_AND_VALIDATED", 0.8201), (0.05, "deterministic_rule", 0, 0, "REQUIREMENT_NOT_IMPLEMENTED", 0.254), (0.0, "deterministic_rule", 1, 1, "EVALUATION_WITHOUT_REQUIREMENT", 0.3375)])
def test_confidence_anchors(spark, best, method, n, d, status, want):
    df = spark.createDataFrame([(best, method, n, d, status)], "b double, m string, n int, d int, s string")
    assert df.select(correlate.confidence(*[F.col(c) for c in "bmnds"]).alias("v")).first().v == pytest.approx(want, abs=1e-4)


CORRELATION = "seq long, correlation_id string, requirement_entity_id string, evidence_entity_id string, status string, resolution_method string, rule_name string, confidence double, supporting_chunk_ids array<string>, reasoning string, created_at timestamp"


def small_graph(spark):
    chunk = "a" * 64
    ev = evidence(spark, ("REQUIREMENT", "R1", "t", None, "a.pdf", "c1"), ("REQUIREMENT", "R2", "t", None, "a.pdf", "c1"), ("IMPLEMENTATION", "I1", "t", "R1", "b.py", chunk), ("IMPLEMENTATION", "I1", "newer", "R1", "b.py", chunk), ("EVALUATION", "E1", "t", "R2", "c.pdf", "c4"), ("EVALUATION", "E2", "t", "R9", "c.pdf", "c5"))
    rows = [("k1", "R1", "I1", 0.9), ("k2", "R2", chunk, 0.5), ("k3", "R1", "(none)", 0.1), ("k4", "R1", "b" * 64, 0.2), ("k5", "R7", "I1", 0.3), ("k6", "R1", "E1", 0.9)]
    co = spark.createDataFrame([(i, c, r, e, "PARTIALLY_IMPLEMENTED", "llm_stage2", None, x, [chunk, "c4", chunk], "why", T) for i, (c, r, e, x) in enumerate(rows)], CORRELATION)
    return ev, co


def test_graph(spark):
    ev, co = small_graph(spark)
    node, edge = graph.nodes(ev).cache(), graph.edges(ev, co.unionByName(co)).cache()
    assert {(r.label, r.key): r.text for r in node.filter("label = 'Implementation'").collect()} == {("Implementation", "I1"): "newer"}
    assert {(r.rel_type, r.src, r.dst) for r in edge.filter("rel_type <> 'EXTRACTED_FROM'").collect()} == {("EXPLICITLY_LINKS", "I1", "R1"), ("EVALUATES", "E1", "R2"), ("CORRELATES_TO", "R1", "I1"), ("CORRELATES_TO", "R2", "I1"), ("CORRELATES_TO", "R1", "E1")}
    over = {r.requirement_id: (r.n_evidence, r.n_evaluations, r.confidence) for r in graph.overview(node, edge, co).collect()}
    assert over == {"R1": (2, 0, 0.9), "R2": (1, 1, 0.5)}
    assert {(r.artifact, r.requirement_id, r.n_requirements) for r in graph.shared_artifacts(edge).collect()} == {("I1", "R1", 2), ("I1", "R2", 2)}
    assert [(r.artifact, r.other_id) for r in graph.shared_with(edge, "R1").collect()] == [("I1", "R2")]
    assert [r.key for r in graph.orphans(node, edge, ("EXTRACTED_FROM",)).collect()] == ["E2"] and graph.orphans(node, edge).count() == 0
    assert {(r.kind, r["name"]): r.n for r in graph.statistics(node, edge).collect()}["edge", "CORRELATES_TO"] == 3
    assert graph.visible(node, edge, ["Requirement"]).count() == 0
    assert {(r.hop, r.src, r.dst) for r in graph.ego_network(edge, "R2").filter("hop = 2").collect()} == {(2, "I1", "b.py"), (2, "E1", "c.pdf")}


def test_matrix(spark):
    ev, co = small_graph(spark)
    built = matrix.build(ev, co).cache()
    rows = {r.requirement_id: r for r in built.collect()}
    assert rows["R1"].confidence == 0.9 and rows["R1"].source_documents == ["b.py", "c.pdf"] and rows["R1"].evidence_count == 3
    best = {r.requirement_entity_id: r.correlation_id for r in matrix.best_correlations(co).collect()}
    assert best["R1"] == "k1"
    assert matrix.build(ev, co.limit(0)).first().reasoning == "No correlation computed."
    one = matrix.summary(built).first()
    assert (one.total_requirements, one.implemented, one.coverage_percent, one.classified) == (2, 0, 0.0, 2)
    assert matrix.summary(built.limit(0)).first().coverage_percent == 0.0
    assert {r.source_document: r.n_requirements for r in matrix.coverage_by_source(built).collect()} == {"b.py": 2, "c.pdf": 2}
    assert matrix.latest(co).count() == 6


def test_matrix_names_the_documents_of_the_three_best_candidates(spark):
    ev, co = small_graph(spark)
    ev = ev.unionByName(spark.createDataFrame([(10 + i, "IMPLEMENTATION", f"X{i}", "t", None, f"x{i}.py", f"x{i}", T) for i in range(5)], EVIDENCE))
    scores = [("R2", "x0", 0.4), ("R2", "x0", 0.9), ("R2", "x1", 0.5), ("R2", "x2", 0.5), ("R2", "x3", 0.5), ("R2", "x4", float("nan")), ("R1", "x4", 0.2), ("R1", "gone", 0.1), ("R1", "c4", 0.1)]
    cand = spark.createDataFrame([(r, c, None, None, False, s) for r, c, s in scores], CANDIDATES)
    alone = matrix.build(ev, co.limit(0), cand)
    assert {r.requirement_id: r.source_documents for r in alone.collect()} == {"R1": ["c.pdf", "x4.py"], "R2": ["x0.py", "x1.py", "x2.py"]}
    assert {r.source_document: r.n_requirements for r in matrix.coverage_by_source(alone).collect()} == {"c.pdf": 1, "x0.py": 1, "x1.py": 1, "x2.py": 1, "x4.py": 1}
    both = {r.requirement_id: r.source_documents for r in matrix.build(ev, co, cand).collect()}
    assert both == {"R1": ["b.py", "c.pdf", "x4.py"], "R2": ["b.py", "c.pdf", "x0.py", "x1.py", "x2.py"]}


def test_export(spark, tmp_path):
    ev, co = small_graph(spark)
    matrix.export(matrix.build(ev, co), str(tmp_path / "m"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2
    matrix.export(matrix.build(ev, co), str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_store(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(rows, "k string, o int, v string")
    old, new = df(("a", 1, "x")), df(("a", 2, "y"), ("b", 3, "p"), ("b", 4, "q"), ("b", 3, "p"))
    once = store.insert_if_absent(old, new, ["k"], "o")
    assert [tuple(r) for r in once.collect()] == [("b", 3, "p")]
    assert store.insert_if_absent(old.unionByName(once), new, ["k"], "o").count() == 0
    assert sorted(tuple(r) for r in store.replace_by_key(old, new, "k", ["o"]).collect()) == [("a", 2, "y"), ("b", 4, "q")]
    assert sorted(tuple(r) for r in store.upsert(old, df(("c", 1, "z")), "k").collect()) == [("a", 1, "x"), ("c", 1, "z")]
    assert store.delete_where(df(("a", 1, None), ("b", 1, "x")), "v", "x").count() == 1
    path = str(tmp_path / "t")
    assert store.current_version(spark, path) is None
    store.rewrite(old, path)
    for i in range(4):
        before = store.read_published(spark, path, "rows")
        store.rewrite(store.upsert(before, df(("a", i, "new")), "k"), path)
        assert before.count() == 1  # a reader of the version before can end
        assert [tuple(r) for r in store.read_published(spark, path, "rows").collect()] == [("a", i, "new")]
    assert len(list((tmp_path / "t").glob("*/rows"))) == 2
    tables = str(tmp_path / "tables")
    for _ in range(2):
        store.create_tables(spark, tables)
        assert spark.read.parquet(f"{tables}/evidence").count() == 0


def test_rebuilding_the_graph_changes_nothing(spark, tmp_path):
    ev, co = small_graph(spark)
    seen = [[sorted(map(str, t.collect())) for t in graph.sync(ev, co, str(tmp_path / "g"))] for _ in range(2)]
    assert seen[0] == seen[1] and any("SourceDocument" in x and "PYTHON" in x for x in seen[0][0])
    done = {r["name"]: r.n for r in graph.build_statistics(ev, co, graph.nodes(ev), graph.edges(ev, co)).filter("kind = 'skipped'").collect()}
    assert done == {"placeholder": 1, "chunk without entity": 1}
    drawn = {(r.src, r.dst): (r.src_label, r.dst_label, r.width) for r in graph.layout(graph.nodes(ev), graph.edges(ev, co), co, "R2").collect()}
    assert drawn["R2", "I1"] == ("Requirement", "Implementation", 2.0) and drawn["E1", "R2"] == ("Evaluation", "Requirement", 1.0) and drawn["I1", "b.py"][1] == "SourceDocument"
    assert {(r.source_document, r.entity, r.requirement_id) for r in graph.document_members(graph.edges(ev, co)).collect()} == {("a.pdf", "R1", None), ("a.pdf", "R2", None), ("b.py", "I1", "R1"), ("c.pdf", "E1", "R2"), ("c.pdf", "E2", None)}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "x", 1)], "query_id string, row_id string, rank int")
    wanted = spark.createDataFrame([("q", "b"), ("q", "z"), ("o", "a")], "query_id string, row_id string")
    assert tuple(metrics.ranking_metrics(ranked, wanted, 2).first()) == (2, 0.25, 0.25, 0.25)


def test_providers(spark):
    df = spark.createDataFrame([("R1 was implemented well.", ["head\nimplemented"]), (None, None), ("alpha beta", [])], "t string, e array<string>")
    rows = df.select(providers.embedding(F.col("t")).alias("v"), providers.classify(F.col("t"), F.col("e")).alias("c"), providers.extract_answers(F.col("t"))["answer"].alias("x")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and sum(rows[1].v) == 0
    assert rows[1].c is None and rows[2].c == "REQUIREMENT_NOT_IMPLEMENTED" and "R1" in rows[0].x


class Scripted:
    """A chat model that gives its answers in turn."""

    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def chat(self, messages):
        self.seen.append(messages)
        answer = self.answers[min(len(self.seen), len(self.answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer

    def available(self):
        return True


GOOD = '[{"entity_type": "REQUIREMENT", "entity_id": "R1", "text": "t"}]'


@pytest.mark.parametrize(
    ("answers", "attempts", "n"),
    [([GOOD], 1, 1), (["sorry", GOOD], 2, 1), ([ConnectionError("down"), "[{}]", GOOD], 3, 1), (["no", "no", "no", GOOD], 3, 0), (["[]"], 1, 0), (['[{"entity_type": "X"}, ' + GOOD[1:]], 1, 1)],
)
def test_a_model_is_asked_again_until_its_answer_is_valid(spark, answers, attempts, n):
    df = spark.createDataFrame([("long text " * 1000, "d", "p")], "t string, s string, l string")
    row = df.select(providers.extract_answers(F.col("t"), F.col("s"), F.col("l"), lambda: providers.PromptedExtractor(Scripted(*answers))).alias("x")).first().x
    assert row.attempts == attempts and (row.answer == "[]" if n == 0 else GOOD[1:] in row.answer or row.answer == GOOD) and bool(row.errors) == (answers[-1] == GOOD and n == 0)


def test_prompts_hold_whole_texts_and_the_errors(spark):
    model = Scripted("no", "[{}]", "no")
    for attempt in (1, 2, 3):
        providers.PromptedExtractor(model).extract("word " * 5000 + "end", ["no JSON found"], attempt, "doc.md", "page 3")
    assert all(m[-1]["content"].endswith("end") for m in model.seen) and [len(m) for m in model.seen] == [2, 2, 1]
    assert "- no JSON found" in model.seen[1][1]["content"] and "page 3" in model.seen[0][1]["content"] and "Examples" in model.seen[0][0]["content"] and "Examples" not in model.seen[1][0]["content"]
    assert len(providers.extraction_messages("x" * 9000, attempt=3, max_chars=2000)[0]["content"]) < 2300


@pytest.mark.parametrize(
    ("answer", "want"),
    [('{"status": "PARTIALLY_IMPLEMENTED", "reasoning": "r"}', ("PARTIALLY_IMPLEMENTED", "r")), ('Well: {"status": "it is partially_implemented."} ok', ("PARTIALLY_IMPLEMENTED", "")), ('{"status": "unclear"}', None), ("nothing", None), ("", None), ('["x"]', None), ('{"status": null}', None)],
)
def test_labels(answer, want):
    assert providers.parse_label(answer) == want


def test_classifier_asks_twice():
    label = '{"status": "CLAIMED_BUT_NO_EVIDENCE"}'
    assert providers.PromptedClassifier(Scripted("?", label)).classify("r", ["[Evidence 1]\nt"]) == "CLAIMED_BUT_NO_EVIDENCE"
    assert providers.PromptedClassifier(Scripted("?", "?", label)).classify("r", ["b\nt"]) is None


class ShortEmbedder(providers.HashingEmbedder):
    max_chars = 10

    def embed(self, texts):
        assert all(len(t) <= 10 for t in texts)
        return super().embed(texts)


def test_long_texts_are_embedded_whole(spark):
    long = "alpha beta " * 900 + "omega " * 3000
    df = spark.createDataFrame([(long,), ("omega beta",), ("",), (None,)], "t string")
    want = providers.HashingEmbedder().embed([long])[0]
    rows = df.select(providers.embedding(F.col("t")).alias("v"), providers.embedding(F.col("t"), ShortEmbedder).alias("s")).collect()
    assert rows[0].v == want and rows[0].v != providers.HashingEmbedder().embed([long[:8000]])[0]
    assert abs(sum(x * x for x in rows[0].s) - 1) < 1e-5 and rows[1].s == rows[1].v
    assert not any(rows[2].s) and not any(rows[3].s)


def test_providers_that_answer():
    class Down:
        def available(self):
            raise ConnectionError

    assert providers.available(Scripted("x")) and providers.available(providers.HashingEmbedder()) and not providers.available(Down())


def test_logs_rotate(tmp_path):
    import json
    import logging

    from traceloom.logs import log_to

    path = str(tmp_path / "log")
    for i in range(40):
        log_to(path, "t", file_bytes=1000, files=2).info("step %d", i, extra={"context": {"rows": i}})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log", "log.1", "log.2"]
    last = json.loads((tmp_path / "log").read_text().splitlines()[-1])
    assert (last["message"], last["rows"], last["level"]) == ("step 39", 39, "INFO") and len(logging.getLogger("t").handlers) == 1


def test_stream_inserts_once(spark, tmp_path):
    from traceloom.streaming.pipeline import insert_stream, table_stream

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string").write.parquet(source)
    for n in (1, 2):
        insert_stream(table_stream(spark, source, "k string, o int, v string"), target, ["k"], "o", str(tmp_path / f"c{n}")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [("a", 1, "x")]
