from __future__ import annotations

import os
from collections import Counter

import pytest

import __spark_entry__ as entry

QUICK = ["m04_matrix", "m13_latest", "g06_edges", "l05_decide", "p7_found", "k02_replace_by_hash", "c13_event_sessions", "q13_merge"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_in_the_core_imports_the_optional_part():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(os.path.join(root, "traceloom")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "traceloom.llm" not in f.read(), name


def test_flagship(spark, data):
    df = entry.entry(spark)
    assert df.count() > 0 and "requirement_id" in df.columns


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, data, name):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    text = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
    df = entry.queries()[name](spark, data)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = Counter(tuple(text(v) for _, v in sorted(zip(names, row))) for row in cursor.fetchall())
    got = Counter(tuple(text(row[c]) for c in sorted(df.columns)) for row in df.collect())
    assert sorted(names) == sorted(df.columns) and got == want
