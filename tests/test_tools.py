from __future__ import annotations

import pytest

from tallyloom.operators import tools

SCHEMA = "id int, issue_key string, title string, description string, summary string, resolution_description string, project_key string, work_group string, status_name string, priority_id int, created_at string, updated_at string, related_issues string, related_artifacts string, related_pages string, related_url string"


@pytest.fixture(scope="module")
def issues(spark):
    rows = [
        (1, "P-1", "alpha", "server <b>profile</b> text", None, None, "P", "Orders", "Open", 2, "2020-01-01", "2020-02-01", "P-2, P-9 ,P-3", "Patient", None, None),
        (2, "P-2", "beta", "profile only", "server", None, "P", "Orders", "Open", 1, "2020-01-02", None, None, "Patient, Visit", None, None),
        (3, "P-3", "gamma", "nothing", None, None, "P", None, "Done", None, "2020-01-03", "2020-01-01", "", "Claim", None, None),
        (4, "Q-1", "delta", "server", None, None, "Q", "Orders", "Open", 2, None, None, None, "patient", None, None),
        (5, "P-5", "eps", None, None, None, "P", "Orders", "Open", 2, "2020-01-03", None, None, "PATIENT record", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, 1, "server", "Word", 9.0), (2, 1, "profile", "Word", 1.0), (3, 2, "server", "Word", 8.0), (4, 2, "profile", "Word", 2.0), (5, 3, "profile", "Word", 1.0), (6, 4, "server", "Word", float("nan")), (7, 5, "server", "Word", None)]
    return spark.createDataFrame(rows, "id int, issue_id int, keyword string, keyword_type string, bm25_score double")


@pytest.mark.parametrize("limit", [0, -1, 1001, "5", 1.5, True])
def test_limits(issues, limit):
    with pytest.raises(tools.ToolError):
        tools.list_issues(issues, limit=limit)


@pytest.mark.parametrize("key", [None, "", "   "])
def test_key_required(issues, index, key):
    for call in (lambda: tools.issue_details(issues, issues, key), lambda: tools.issue_comments(issues, key), lambda: tools.find_related_issues(issues, index, key), lambda: tools.search_issues_by_keywords(issues, key)):
        with pytest.raises(tools.ToolError):
            call()


def test_related_limit(issues, index):
    for limit in (0, 101):
        with pytest.raises(tools.ToolError):
            tools.list_related_issues(issues, index, "P-1", limit)


def test_list(spark, issues):
    a = tools.list_issues(issues, project="P", limit=2, offset=1, sort="created", order="asc")
    assert [r.id for r in a.rows.collect()] == [2, 3]
    row = spark.range(1).select(a.total.alias("t"), a.has_more.alias("m")).first()
    assert (row.t, row.m) == (4, True)
    every = tools.list_issues(issues, offset=3, sort="nonsense")
    assert [r.id for r in every.rows.collect()] == [5, 4, 3, 2, 1]
    assert every.limit == 0
    assert [r.id for r in tools.list_issues(issues, created_after="2020-01-02", created_before="2020-01-03", project="P").rows.collect()] == [2]
    with pytest.raises(tools.ToolError):
        tools.list_issues(issues, colour="red")
    with pytest.raises(tools.ToolError):
        tools.list_issues(issues, offset=-1)


def test_lists_leave_out_nulls(issues):
    assert [r[0] for r in tools.list_work_groups(issues).collect()] == ["Orders"]
    assert [r[0] for r in tools.list_projects(issues).collect()] == ["P", "Q"]


def test_related(issues, index):
    rows = tools.list_related_issues(issues, index, "P-1").orderBy("part", "place").collect()
    # linked ones apart from the matches: by field, then by the words of its best keywords
    assert [(r.part, r.issue_key) for r in rows] == [(0, "P-2"), (0, "P-3"), (1, "P-5"), (1, "P-2"), (2, "Q-1")]
    few = tools.list_related_issues(issues, index, "P-1", 1).orderBy("part", "place").collect()
    assert [(r.part, r.issue_key) for r in few] == [(0, "P-2"), (0, "P-3"), (1, "P-5")]
    found = tools.find_related_issues(issues, index, "P-1").orderBy("part", "place").collect()
    assert [(r.part, r.issue_key) for r in found] == [(0, "P-2"), (0, "P-3"), (1, "P-2")]
    assert tools.find_related_issues(issues, index, "none").count() == 0
    assert tools.list_related_issues(issues, index, "none").count() == 0


def test_search(issues):
    rows = tools.search_issues_by_keywords(issues, "server AND profile", limit=5).orderBy("rank").collect()
    # record 2 has one word in its description and the other in its summary: no field has both
    assert {r.id for r in rows} == {1}
    assert tools.search_issues_by_keywords(issues, "server", ["summary"]).select("id").collect()[0].id == 2
    with pytest.raises(tools.ToolError):
        tools.search_issues_by_keywords(issues, "x", ["body"])
