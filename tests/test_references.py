from __future__ import annotations

from datetime import datetime

from traceloom.operators.references import orphan_references, orphan_report

T = lambda day: datetime(2024, 1, day)
REFS = "ref_table string, ref_field string, ref_seq long, kind string, target string, created_at timestamp, valid_from string"
PARENTS = "kind string, key string, entity string, created_at timestamp, _deleted string"
GONE = "entity_id string, deleted_at timestamp, note string"


def run(spark, refs, parents, gone):
    out = orphan_references(
        spark.createDataFrame([("t", "f", i, k, x, at, "extra") for i, (k, x, at) in enumerate(refs)], REFS),
        spark.createDataFrame([(*p, "extra") for p in parents], PARENTS),
        spark.createDataFrame(gone, GONE),
    )
    return {r.ref_seq: r.reason for r in out.collect()}, out


def test_reasons(spark):
    parents = [("r", "r1", "R1", T(5)), ("r", "r2", "R2", T(1)), ("r", "r3", "R3", T(1)), ("r", "r3", "R3", T(9)), ("r", "r4", "R4", None)]
    gone = [(" R2 ", T(3), None), ("r3", T(4), "x"), ("r3", T(4), "x"), ("R1", T(2), None)]
    refs = [
        ("r", " r1 ", T(6)), ("r", "R1", T(4)), ("r", "R2", T(9)), ("r", "R3", T(8)), ("r", "R3", T(9)), ("r", "R9", T(1)),
        ("r", None, T(1)), ("r", "  ", T(1)), ("r", "(none)", T(1)), ("r", "(UNLINKED)", T(1)), ("x", "R1", T(6)), ("r", "R4", T(1)), ("r", "R1", None),
    ]
    got, out = run(spark, refs, parents, gone)
    assert got == {1: "late", 2: "deleted", 3: "late", 5: "missing", 10: "missing"}
    report = {(r.month, r.reason): r.n for r in orphan_report(out).collect()}
    assert report == {("2024-01", "late"): 2, ("2024-01", "deleted"): 1, ("2024-01", "missing"): 2}


def test_repeats_and_empty_tables(spark):
    got, _ = run(spark, [("r", "R1", T(1))] * 2, [], [])
    assert got == {0: "missing", 1: "missing"}
    assert run(spark, [], [], [])[0] == {}


def test_plan_is_one_merge_without_broadcast(spark):
    refs = spark.createDataFrame([("t", "f", 1, "r", "a", T(1), "")], REFS)
    parents = spark.createDataFrame([("r", "a", "a", T(1), "")], PARENTS)
    plan = orphan_references(refs, parents, spark.createDataFrame([], GONE))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
