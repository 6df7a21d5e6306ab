from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom import schema
from tallyloom.operators import keyed, reports
from tallyloom.operators.store import MissingKeys, Store

S = "id int, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_life_of_a_table(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.tables() == []
    store.create("t", S)
    store.create("t", "other int")
    assert store.read("t").columns == ["id", "v"] and store.max_key("t", "id", 7) == 7
    frame = lambda *r: spark.createDataFrame(list(r), S)
    store.insert("t", frame((1, "a"), (2, "b")))
    store.insert("t", frame((2, "late"), (3, "y"), (3, "x")), ["id"], [F.col("v")], ignore_duplicates=True)
    assert rows(store.read("t")) == [(1, "a"), (2, "b"), (3, "x")]
    store.update("t", frame((1, None)), ["id"])
    with pytest.raises(MissingKeys):
        store.update("t", frame((1, "z"), (9, "z")), ["id"])
    store.delete("t", frame((3, "")), ["id"])
    store.delete("t", where=F.col("v") == "b")
    assert rows(store.read("t")) == [(1, None)] and store.max_key("t", "id") == 1
    store.create("u", S)
    assert store.tables() == ["t", "u"]
    store.drop_all()
    assert store.tables() == []
    with pytest.raises(LookupError):
        store.read("t")


def test_half_written_version_is_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("t", S)
    store.insert("t", spark.createDataFrame([(1, "a")], S))
    (tmp_path / "t" / "v9").mkdir()
    (tmp_path / "t" / "v9" / "part.parquet").write_text("broken")
    assert rows(store.read("t")) == [(1, "a")]


def test_reports(spark):
    df = spark.createDataFrame([("B & C", "page", "<x>"), (None, "page", "y"), ("B & C", "art", None)], "g string, k string, t string")
    pages = reports.group_pages(df, "g", "k", "t")
    got = {r.file_name: r.html for r in pages.collect()}
    assert got["b-c.html"] == "<h1>B &amp; C</h1><ul><li>art: </li><li>page: &lt;x&gt;</li></ul>"
    assert set(got) == {"b-c.html", "no-group.html"}
    assert reports.index_page(pages).first().html.index("b-c.html") < reports.index_page(pages).first().html.index("no-group.html")


def test_schemas(spark, sf_dir):
    for name in ("issues", "comments", "issue_keywords", "corpus_keywords", "search_parameters", "artifacts"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        assert df.columns == schema.schema_of(name).fieldNames()
        assert [t for _, t in schema.conform(df, name).dtypes] == [f.dataType.simpleString() for f in schema.schema_of(name).fields]
    df = spark.createDataFrame([("Word",), (None,), ("Odd",)], "keyword_type string")
    assert [r[0] for r in df.select(schema.in_domain("keyword_type")).collect()] == [True, True, False]


def test_append_keeps_old_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.create("words")
    store.insert("words", spark.createDataFrame([("a",)], "word string"))
    before = set(store.read("words").inputFiles())
    store.insert("words", spark.createDataFrame([("a",), ("b",), ("b",)], "word string"), ["word"], [F.col("word")], ignore_duplicates=True)
    assert before <= set(store.read("words").inputFiles())
    assert sorted(r.word for r in store.read("words").collect()) == ["a", "b"]


def test_repeated_changes_of_a_key_give_one_row(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, keyed.update_by_key(old, new, ["id"]).collect())) == [(1, "b"), (2, "y")]
