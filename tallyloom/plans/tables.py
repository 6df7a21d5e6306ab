"""Cleaned views of the test tables, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.keyed import keep_one
from tallyloom.session import stored, table

#: Issues once each: the version touched last (repeated rows are equal and fall together).
ISSUES_SQL = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, status_id DESC NULLS LAST) AS rn FROM issues) WHERE rn = 1)"
COMMENTS_SQL = "(SELECT DISTINCT * FROM comments)"
KEYWORDS_SQL = "(SELECT DISTINCT * FROM issue_keywords)"


def issues(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Issues once each, with the columns named (all without any).

    Cleaned and sorted once; filters of the queries are pushed into its files.
    """

    def cleaned() -> DataFrame:
        once = keep_one(table(spark, sf_dir, "issues"), ["id"], [F.col("updated_at").desc_nulls_last(), F.col("status_id").desc_nulls_last()])
        return once.repartitionByRange("project_key", "id").sortWithinPartitions("project_key", "id")

    df = stored(spark, sf_dir, "issues", ["issues"], cleaned)
    return df.select(*dict.fromkeys([*columns, "id", "updated_at", "status_id"])) if columns else df


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments once each, in the order of their issues."""
    return stored(spark, sf_dir, "comments", ["comments"], lambda: table(spark, sf_dir, "comments").distinct().repartitionByRange("issue_id", "id").sortWithinPartitions("issue_id", "id"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the keyword table once each, in the order of the keywords."""
    return stored(spark, sf_dir, "issue_keywords", ["issue_keywords"], lambda: table(spark, sf_dir, "issue_keywords").distinct().repartitionByRange("keyword", "id").sortWithinPartitions("keyword", "id"))
