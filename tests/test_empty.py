"""Empty tables, nulls in every column, repeated rows and clashing names give defined results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import filters, fulltext, metadata, page_words, references, related
from tallyloom.operators.multivalue import Source, infer_all, split_all

ISSUES = "id int, issue_key string, title string, description string, summary string, resolution_description string, project_key string, work_group string, related_issues string, related_artifacts string, related_pages string, related_url string"
KEYWORDS = "id int, issue_id int, keyword string, keyword_type string, bm25_score double"


def test_full_text(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "word", "x"), (2, "word", "word")], "id int, title string, doc_id string")
    index = fulltext.build_index(docs, "id", ["title", "doc_id"])
    assert sorted((r.doc_id or 0) for r in fulltext.matches(index, fulltext.parse("word")).collect()) == [0, 2]
    none = fulltext.build_index(docs.limit(0), "id", ["title"])
    assert fulltext.ranked(none, fulltext.parse("word OR NOT x")).count() == 0
    assert fulltext.ranked(index, fulltext.parse("NOT zz"), limit=5).count() == 2


def test_related(spark):
    issues = spark.createDataFrame([(1, "A-1", *[None] * 10), (2, None, *[None] * 10)], ISSUES)
    index = spark.createDataFrame([(1, 1, None, None, None), (2, 1, "--", "Word", 3.0), (3, None, "--", "Word", 2.0)], KEYWORDS)
    texts = fulltext.build_index(issues, "id", ["title", "description", "summary", "resolution_description"])
    for key in ("A-1", "none"):
        assert related.list_related(issues, index, texts, key).count() == 0
        assert related.find_related(issues, index, key).count() == 0
    assert related.list_related(issues.limit(0), index.limit(0), texts, "A-1").count() == 0


def test_pages_without_dictionaries(spark):
    names = spark.createDataFrame([(None,), ("",), ("--",)], "n string")
    known = page_words.vocabulary([page_words.dictionary_rows(names, "n", page_words.WORD)])
    assert known.count() == 0
    pages = spark.createDataFrame([(1, "Two words", "clash"), (1, "Two words", "clash"), (None, "One", None), (3, None, None)], "id int, t string, word string")
    got = sorted(((r.page_id or 0), r.kind, r.word) for r in page_words.resolve_pages(pages, "id", "t", known).collect())
    assert got == [(0, "unknown", "One"), (1, "unknown", "Two"), (1, "unknown", "words")]
    assert page_words.resolve_pages(pages.limit(0), "id", "t", known).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("b", None, "a", "b", "c")], "v string").repartition(3)
    rows = sorted((r.row_no, r.v) for r in filters.numbered(df, ["v"]).collect())
    assert [n for n, _ in rows] == [1, 2, 3, 4, 5] and [v for _, v in rows] == [None, "a", "b", "b", "c"]
    assert filters.numbered(df.limit(0), ["v"]).count() == 0


def test_many_rows_are_numbered_in_order(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    got = filters.numbered(df, ["v"])
    assert got.agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first() == (1, 20_000, 20_000)
    assert [r.v for r in got.orderBy("row_no").collect()] == sorted(r.v for r in df.collect())


def test_groups_and_pages(spark):
    groups = spark.createDataFrame([], "code string, title string, official_url string, replaced_by string")
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, g string")
    assert {r.code for r in metadata.with_group(df, F.col("g"), groups, "d").collect()} == {"d"}
    artifacts = spark.createDataFrame([(1, "a"), (2, None)], "id int, n string")
    pages = spark.createDataFrame([("a.html",), ("a.html",), (None,)], "page_file_name string")
    rows = metadata.artifact_pages(artifacts, artifacts.select("n"), pages, "n", F.concat("n", F.lit(".html")), F.lit(None).cast("string")).orderBy("id").collect()
    assert [(r.id, r.has_structure, r.intro_page, r.notes_page) for r in rows] == [(1, True, "a.html", None), (2, False, None, None)]


def test_references(spark):
    refs = spark.createDataFrame([(1, None, None), (2, "x", None), (3, "x", 1)], "id int, k string, v int")
    facts = spark.createDataFrame([], "k string, born int")
    assert references.lookup_salted(refs, facts, ["k"], 4).where("born IS NULL").count() == 3
    assert references.lookup_salted(refs.limit(0), facts, ["k"], 4).count() == 0


def test_splitting_several_sources(spark):
    cells = lambda *c: spark.createDataFrame([(i, x) for i, x in enumerate(c)], "row_id int, cell string")
    sources = [(cells(), Source("t", "none")), (cells("a,b", "c"), Source("t", "some")), (cells("   "), Source("t", "blank"))]
    assert sorted((r.field_name, r.row_id, r.item_no, r.item_text) for r in split_all(sources).collect()) == [("some", 0, 1, "a"), ("some", 0, 2, "b"), ("some", 1, 1, "c")]
    chosen, evidence = infer_all(sources)
    assert chosen[1] == ("comma",) and {e.source.field for e in evidence} == {"some"}
