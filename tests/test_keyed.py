from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import filters, keyed

S = "id int, v string, at int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([(1, "old", 0)], S)
    new = spark.createDataFrame([(1, "x", 1), (2, "first", 1), (2, "last", 2), (3, None, 1)], S)
    assert rows(keyed.insert_or_ignore(old, new, ["id"], [F.col("at")])) == [(1, "old", 0), (2, "first", 1), (3, None, 1)]
    assert rows(keyed.insert_or_ignore(old, new, ["id"], [F.col("at")], keep="last"))[1] == (2, "last", 2)


def test_update_and_delete(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], S)
    change = spark.createDataFrame([(2, None, 5), (9, "z", 1)], S)
    assert rows(keyed.update_by_key(t, change, ["id"]))[1] == (2, None, 5)
    assert [r.id for r in keyed.unknown_keys(t, change, ["id"]).collect()] == [9]
    assert rows(keyed.delete_by_key(t, change, ["id"])) == [(1, "a", 0)]
    nulls = spark.createDataFrame([(1, None, 0), (2, "b", 0)], S)
    assert [r.id for r in keyed.delete_where(nulls, F.col("v") == "b").collect()] == [1]


def test_promote_first_value_wins(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    facts = spark.createDataFrame([(1, "f", "late", 9), (1, "f", "early", 3), (1, "g", "x", 1), (7, "f", "none", 1)], "k int, field string, value string, id int")
    got = keyed.promote_fields(base, facts, "k", "field", F.col("value"), F.col("id"), {"f": "one", "h": "two"})
    assert sorted(map(tuple, got.collect())) == [(1, "early", None), (2, None, None)]
    assert keyed.unpromoted(facts, "field", ["f"]).count() == 1


def test_conditions(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3), (3, None, 4)], S)
    pick = lambda **k: [r.id for r in filters.matching(df, filters.conditions(**k)).orderBy("id").collect()]
    assert pick() == [1, 2, 3]
    assert pick(equals={"v": "a", "at": None}) == [1]
    assert pick(is_null={"v": True}) == [3]
    assert pick(is_null={"v": False, "at": None}) == [1, 2]
    assert pick(equals={"v": "a"}, compare=[("at", ">=", 4)], any_of=True) == [1, 3]
    assert pick(compare=[("at", "!=", 3)]) == [3]


def test_order_and_pages(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", None), (3, None, 1)], S)
    order = filters.ordering(["v", "at"], "DESC")
    assert [r.id for r in df.orderBy(*order).collect()] == [3, 1, 2]
    assert [r.id for r in filters.page(df, filters.ordering(["id"]), None, 2).collect()] == [1, 2, 3]
    assert [r.id for r in filters.page(df, filters.ordering(["id"]), 1, 2).collect()] == [3]


def test_reconcile_ignores_case(spark):
    a = spark.createDataFrame([("X.html",), ("y.html",)], "p string")
    b = spark.createDataFrame([("x.HTML",), ("z.html",)], "p string")
    assert rows(keyed.reconcile(a, b, "p")) == [("X.html", True, True), ("y.html", True, False), ("z.html", False, True)]
