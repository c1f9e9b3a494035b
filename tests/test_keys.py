from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.keys import id_key, person_key


def keys(spark, fn, *names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r.k for r in df.select("i", fn(F.col("n")).alias("k")).orderBy("i").collect()]


def test_persons_spelt_unevenly_share_a_key(spark):
    same = keys(spark, person_key, "Épel  Dov", "Épel dov", " ‎ÉPEL DOV‬", "​Épel\tDov⁠", "épel　dov﻿", "éPEL ­ dov")
    assert len(set(same)) == 1
    assert len(set(keys(spark, person_key, "Epel Dov", "Épel Dov", "ÉpelDov"))) == 3
    assert keys(spark, person_key, None, "", " ​  ", "Ab") == [None, None, None, "ab"]
    assert len(set(keys(spark, person_key, "STRASSE", "straße"))) == 1


def test_ids(spark):
    assert keys(spark, id_key, " R1 ", "r1", "R 1", "", None, "\t\n") == ["r1", "r1", "r 1", None, None, None]
