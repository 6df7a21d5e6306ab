from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyloom.functions.normal import compose_accents, plain_form
from tallyloom.llm.term_frequency import mark, term_counts

SCHEMA = "id int, rec int, term string, kind string, n int, occurrences string"


def counts(spark, rows, salts=8):
    df = spark.createDataFrame(rows, SCHEMA)
    out = term_counts(df, [F.col("term"), F.col("kind")], F.col("rec"), F.col("n"), [F.col("id"), F.col("term")], salts)
    return {(r.t0, r.t1): (r.occurrences, r.records, r.last_record) for r in out.collect()}


def brute(rows):
    seen, occ, rec = set(), defaultdict(int), defaultdict(set)
    for r in rows:
        if not r[2] or r in seen:
            continue
        seen.add(r)
        occ[r[2], r[3]] += r[4] or 0
        if r[1] is not None:
            rec[r[2], r[3]].add(r[1])
    return {k: (occ[k], len(rec[k]), max(rec[k], default=None)) for k in occ}


def test_against_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([None, 1, 2, 3, 4, 5]), draw.choice(["a", "b", "hot", "hot", "", None]), draw.choice(["x", "y", None]), draw.choice([1, 2, None]), "clash") for i in range(400)]
    rows += draw.sample(rows, 100)
    for salts in (1, 8):
        assert counts(spark, rows, salts) == brute(rows)


def test_empty_and_marks(spark):
    assert counts(spark, []) == {}
    df = spark.createDataFrame([("a", 0), ("b", 2), ("c", 3), ("d", 20), ("e", 21)], "t string, records long")
    got = {r.t: r.freq_mark for r in mark(df, F.lit(100), 3, 0.2).collect()}
    assert got == {"a": "rare", "b": "rare", "c": "useful", "d": "useful", "e": "common"}


def test_plain_form(spark):
    words = ["Mek­iwazi ", "naïveté", "_A.b-9​", "4.0.1", "́", None, "", "ÅÉ", "Å", "ệ", "x" * 100_000]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r[0] for r in df.orderBy("i").select(plain_form(F.col("w"))).collect()]
    assert got[:-1] == ["mekiwazi", "naïveté", "ab9", "401", "", None, "", "åé", "å", "ệ"]
    assert got[-1] == "x" * 100_000
    assert df.where("i = 1").select(compose_accents(F.col("w"))).first()[0] == "naïveté"
