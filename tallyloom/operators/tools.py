"""The query tools: checked arguments in, rows and totals out.

Each tool raises ToolError for arguments that are missing, of the wrong form or
out of range, before anything runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import filters, fulltext, related

MAX_LIST, MAX_RELATED = 1000, 100
DEFAULT_RELATED, DEFAULT_SEARCH = 10, 20
SORT_FIELDS = {"key": "issue_key", "created": "created_at", "updated": "updated_at", "priority": "priority_id"}
LIST_FILTERS = {"project": "project_key", "workgroup": "work_group", "resolution": "resolution_name", "status": "status_name", "assignee": "assignee", "type": "type_name", "priority": "priority_name", "reporter": "reporter", "specification": "specification", "vote": "vote_text", "grouping": "grouping"}
SEARCH_FIELDS = ("title", "description", "summary", "resolution_description")


class ToolError(ValueError):
    """An argument a tool cannot work with."""


def required(name: str, value: object) -> str:
    if value is None or not str(value).strip():
        raise ToolError(f"{name} is required")
    return str(value)


def bounded(name: str, value: int | None, most: int) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int):
        raise ToolError(f"{name} must be a whole number")
    if not 1 <= value <= most:
        raise ToolError(f"{name} must lie between 1 and {most}")
    return value


@dataclass(frozen=True)
class Answer:
    """A page of rows; total and has_more are lazy single values over the same filter."""

    rows: DataFrame
    total: Column
    has_more: Column
    limit: int
    offset: int


def list_issues(issues: DataFrame, limit: int | None = None, offset: int | None = None, sort: str | None = None, order: str | None = None, created_after: str | None = None, created_before: str | None = None, **equal: str | None) -> Answer:
    """Issues by optional equality filters, sorted and paged.

    Without a limit all rows come and the offset counts only for has_more; an
    unknown sort field sorts by id; the default order is falling. Filters named
    for columns the table lacks are refused.
    """
    limit = bounded("limit", limit, MAX_LIST)
    if offset is not None and offset < 0:
        raise ToolError("offset must not be negative")
    unknown = [n for n in equal if n not in LIST_FILTERS]
    if unknown:
        raise ToolError(f"unknown filter {unknown[0]}")
    missing = [n for n, v in equal.items() if v is not None and LIST_FILTERS[n] not in issues.columns]
    if missing:
        raise ToolError(f"the table has no column for {missing[0]}")
    cond = filters.conditions(equals={LIST_FILTERS[n]: v for n, v in equal.items() if v is not None}, compare=[("created_at", ">=", created_after), ("created_at", "<", created_before)])
    found = filters.matching(issues, cond)
    by = SORT_FIELDS.get((sort or "").lower(), "id")
    keys = filters.ordering([by], order or "desc")
    shown = filters.page(found, [*keys, F.col("id")], limit, offset)
    total = found.agg(F.count("*").alias("n")).scalar()
    returned = F.least(F.lit(limit), F.greatest(total - (offset or 0), F.lit(0))) if limit else total
    return Answer(shown, total, total > (offset or 0) + returned, limit or 0, offset or 0)


def issue_details(issues: DataFrame, comments: DataFrame, issue_key: str) -> DataFrame:
    key = required("issue_key", issue_key)
    row = issues.where(F.col("issue_key") == key).orderBy("id").limit(1)
    n = comments.where(F.col("issue_key") == key).agg(F.count("*").alias("n")).scalar()
    return row.withColumn("comment_count", n)


def issue_comments(comments: DataFrame, issue_key: str) -> DataFrame:
    key = required("issue_key", issue_key)
    return comments.where(F.col("issue_key") == key).orderBy(F.col("created_at").desc_nulls_last(), "id")


def list_projects(issues: DataFrame) -> DataFrame:
    return filters.distinct_sorted(issues, "project_key")


def list_work_groups(issues: DataFrame) -> DataFrame:
    return filters.distinct_sorted(issues, "work_group")


def search_issues_by_keywords(issues: DataFrame, keywords: str, search_fields: Sequence[str] | None = None, limit: int | None = DEFAULT_SEARCH, index: fulltext.FullTextIndex | None = None) -> DataFrame:
    """The best matches of a full-text query; each field is searched for itself. With a stored index nothing is tokenised."""
    query = required("keywords", keywords)
    fields = list(search_fields or SEARCH_FIELDS)
    bad = [f for f in fields if f not in SEARCH_FIELDS]
    if bad:
        raise ToolError(f"unknown search field {bad[0]}")
    return fulltext.search(issues, "id", fields, query, bounded("limit", limit, MAX_LIST) or DEFAULT_SEARCH, index)


def list_related_issues(issues: DataFrame, index: DataFrame, issue_key: str, limit: int | None = DEFAULT_RELATED, texts: fulltext.FullTextIndex | None = None) -> DataFrame:
    key, limit = required("issue_key", issue_key), bounded("limit", limit, MAX_RELATED) or DEFAULT_RELATED
    return related.list_related(issues, index, texts or fulltext.build_index(issues, "id", SEARCH_FIELDS), key, limit)


def find_related_issues(issues: DataFrame, index: DataFrame, issue_key: str, limit: int | None = DEFAULT_RELATED) -> DataFrame:
    return related.find_related(issues, index, required("issue_key", issue_key), bounded("limit", limit, MAX_RELATED) or DEFAULT_RELATED)
