from __future__ import annotations

import pytest
from tallyloom.operators import fulltext as FT

DOCS = [(1, "Stable code system", "an invariant"), (2, "system code", None), (3, "circular invariant", "code system"), (4, "Redundant", ""), (5, None, None)]


def ids(spark, query):
    docs = spark.createDataFrame(DOCS, "id int, title string, body string")
    index = FT.build_index(docs, "id", ["title", "body"])
    return sorted(r.doc_id for r in FT.matches(index, FT.parse(query)).collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ('"code system"', [1, 3]),
        ("code system", [1, 2, 3]),
        ("redund*", [4]),
        ("invariant NOT circular", [1]),
        ("NOT code", [1, 3, 4]),
        ("title:invariant", [3]),
        ("(stable OR circular) AND invariant", [3]),
        ("stable AND invariant", []),
        ("title:stable AND body:invariant", []),
        ('body:"code system" OR redundant', [3, 4]),
        ("stable invariant OR redundant", [4]),
        ("nothing", []),
    ],
)
def test_queries(spark, query, want):
    assert ids(spark, query) == want


@pytest.mark.parametrize("query", ["", "   ", "(a", "a)", "a AND", "NOT", '"--"', "OR a"])
def test_bad_queries(query):
    with pytest.raises(FT.QueryError):
        FT.parse(query)


def test_rank_best_first(spark):
    docs = spark.createDataFrame([(1, "code and much other text here"), (2, "code code"), (3, "none")], "id int, title string")
    rows = FT.search(docs, "id", ["title"], "code").orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1]
    assert rows[0].score > rows[1].score > 0
