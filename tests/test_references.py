from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.references import find_orphans, lookup_salted, null_mask, null_masks, orphan_report
from tallyloom.plans.data_quality import dangling_references, issue_references, plain_keys

SCHEMA = "id int, a string, b int, extra string"


def brute(refs, targets, match):
    out = []
    for r in refs:
        key = r[1:3]
        nulls = sum(x is None for x in key)
        if nulls == 2 or match == "simple" and nulls:
            continue
        if match == "full" and nulls:
            out.append(r[0])
        elif not any(all(x is None or x == y for x, y in zip(key, t, strict=True)) for t in targets):
            out.append(r[0])
    return sorted(out)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
@pytest.mark.parametrize("salts", [1, 4])
def test_against_brute_force(spark, match, salts):
    draw = random.Random(5)
    refs = [(i, draw.choice(["x", "y", "z", None]), draw.choice([1, 2, 3, None]), "e") for i in range(120)]
    refs += [(200 + i, "hot", 7, "e") for i in range(60)]
    targets = [("x", 1), ("x", 1), ("y", None), ("z", 3), (None, 2)]
    r = spark.createDataFrame(refs, SCHEMA)
    t = spark.createDataFrame([(*x, "clash") for x in targets], "a string, b int, extra string")
    got = find_orphans(r, t, ["a", "b"], match=match, salts=salts)
    assert got.columns == r.columns
    assert sorted(x.id for x in got.collect()) == brute(refs, targets, match)


def test_empty_sides(spark):
    r = spark.createDataFrame([(1, "x", 1, None)], SCHEMA)
    none = r.limit(0)
    assert find_orphans(r, none, ["a", "b"]).count() == 1
    assert find_orphans(none, r, ["a", "b"]).count() == 0
    assert find_orphans(r, r, ["a"], ["extra"], match="partial").count() == 1


def test_masks_follow_the_schema(spark):
    df = spark.range(1).withColumn("b", F.lit(None).cast("int"))
    assert null_masks(df, ["id", "b"]) == [(False, False), (False, True)]
    with pytest.raises(ValueError):
        find_orphans(df, df, ["id"], match="other")


def test_plain_keys(spark):
    cell = "fhx-0012; 'A‑7' https://t.example/browse/VSM-3?focused=1 xA-9y, (B-2) none"
    df = spark.createDataFrame([(cell,), (None,), ("",)], "c string").select(plain_keys(F.col("c")).alias("k"))
    assert [r.k for r in df.collect()] == [["FHX-12", "A-7", "VSM-3", "B-2"], None, []]


def test_report(spark):
    df = spark.createDataFrame([(1, "2020-01-05"), (2, "2020-01-09"), (3, None)], "id int, d string").withColumn("d", F.col("d").cast("date"))
    got = {(r.period, r.orphans) for r in orphan_report(df, "t", F.col("d"), F.col("id")).collect()}
    assert got == {("2020-01", 2), ("unknown", 1)}


def test_long_numbers_and_masks_in_the_query(spark, tmp_path):
    long = "A-" + "9" * 25
    issues = [(1, long, f"{long}, A-0007, A-8, B-{'1' * 30}", "2020-01-01", None), (2, "A-7", None, "2021-01-01", None), (3, "A-08", None, "2019-01-01", None)]
    schema = "id int, issue_key string, related_issues string, created_at string, updated_at string"
    df = spark.createDataFrame(issues, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    df.write.parquet(str(tmp_path / "issues.parquet"))
    spark.createDataFrame([("B-" + "1" * 30,)], "issue_key string").write.parquet(str(tmp_path / "deleted_issues.parquet"))
    got = {(r.issue_id, r.ref_key, r.orphan_kind) for r in dangling_references(spark, str(tmp_path)).collect()}
    assert got == {(1, "A-7", "later"), (1, "B-" + "1" * 30, "deleted")}
    assert len(null_masks(issue_references(spark, str(tmp_path)), ["ref_project", "ref_number"])) == 4


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_a_join(spark, how):
    refs = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(300)] + [(900, None)], "id int, k string")
    facts = spark.createDataFrame([("hot", 1), ("k0", 2), ("k2", 3)], "k string, v int")
    rows = lambda df: sorted(map(tuple, df.select("id", "k", "v").collect()), key=repr)
    assert rows(lookup_salted(refs, facts, ["k"], 4, how=how)) == rows(refs.join(facts, ["k"], how))


def test_null_mask(spark):
    df = spark.createDataFrame([("x", None), (None, None), ("x", 1)], "a string, b int").select(null_mask(["a", "b"]).alias("m"))
    assert [r.m for r in df.collect()] == ["b", "a b", ""]
