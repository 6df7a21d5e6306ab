"""Queries on packed cells (problem 4) and dangling references (problem 2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.multivalue import Source, cells_of, infer_all, known_names, split_all
from tallyloom.operators.references import find_orphans, hot_keys, lookup_salted, null_mask, orphan_report
from tallyloom.plans.registry import Registry
from tallyloom.session import materialise, table

registry = Registry()


def packed_sources(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, Source]]:
    """The cells of the packed columns, each with its source and known names."""
    artifacts = known_names(table(spark, sf_dir, "artifacts"), "artifact_name")
    pages = known_names(table(spark, sf_dir, "spec_pages"), "page_title")
    sources = [
        (Source("issues", "related_issues"), "id"),
        (Source("issues", "related_artifacts", **artifacts), "id"),
        (Source("issues", "related_pages", **pages), "id"),
        (Source("search_parameters", "base_resources"), "param_key"),
    ]
    return [(cells_of(table(spark, sf_dir, s.table), F.col(row_id), F.col(s.field)), s) for s, row_id in sources]


@registry.add("p4_found")
def packed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_all(packed_sources(spark, sf_dir)).distinct()


@registry.add("p4_delimiters")
def packed_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence behind the split: figures of each candidate of each source in every pass, and what was chosen in the last."""
    _, evidence = infer_all(packed_sources(spark, sf_dir))
    rows = [(e.source.table, e.source.field, e.pass_no, e.delimiter, e.cells, round(e.consistency, 6), None if e.regularity is None else round(e.regularity, 6), e.chosen) for e in evidence]
    return spark.createDataFrame(rows, "table_name string, field_name string, pass_no int, delimiter string, cells long, consistency double, regularity double, chosen boolean")


def plain_keys(cell: Column) -> Column:
    """array<string> of the distinct plain keys (ABC-12) written in a cell.

    Case, quotes, links with or without a query part, and any kind of dash make
    no difference; leading zeros of the number are dropped.
    """
    text = F.regexp_replace(F.upper(cell), r"[?#][^\s,;|\"'“”]*", "")
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{Nd}])([A-Z][A-Z0-9]*[-‐-―−]\p{Nd}+)(?![\p{L}\p{Nd}])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda k: F.regexp_replace(k, r"[-‐-―−]0*(?=\p{Nd})", "-")))


def issue_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issue_id, ref_key, ref_project, ref_number, created_at, touched_at), one row per issue and key.

    An issue's rows are merged: its keys united, created_at the earliest,
    touched_at its latest updated_at or else its created_at.
    """
    issues = table(spark, sf_dir, "issues").select("id", "related_issues", "created_at", "updated_at")
    merged = issues.groupBy(F.col("id").alias("issue_id")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce(plain_keys(F.col("related_issues")), F.array().cast("array<string>"))))).alias("keys"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )
    refs = merged.select("issue_id", F.explode("keys").alias("ref_key"), "created_at", F.coalesce("updated_at", "created_at").alias("touched_at"))
    return refs.withColumn("ref_project", F.split_part("ref_key", F.lit("-"), F.lit(1))).withColumn("ref_number", F.split_part("ref_key", F.lit("-"), F.lit(2)))


def _keyed(df: DataFrame, key: str = "issue_key") -> DataFrame:
    """Targets with the two key columns; keys in another form are left out.

    The number stays text, without leading zeros as in plain_keys: it may have any length.
    """
    plain = F.regexp_extract(F.upper(F.trim(key)), r"^([A-Z][A-Z0-9]*-\d+)$", 1)
    number = F.regexp_replace(F.split_part("target_key", F.lit("-"), F.lit(2)), r"^0+(?=\d)", "")
    return df.withColumn("target_key", plain).where("target_key <> ''").withColumn("ref_project", F.split_part("target_key", F.lit("-"), F.lit(1))).withColumn("ref_number", number)


P2_SQL = r"""
WITH one AS (
  SELECT id AS issue_id, min(created_at) AS created_at, max(updated_at) AS updated_at FROM issues GROUP BY id
), keys AS (
  SELECT DISTINCT id AS issue_id, unnest(regexp_extract_all(replace(upper(related_issues), '‑', '-'), '[A-Z][A-Z0-9]*-[0-9]+')) AS ref_key FROM issues
), refs AS (
  SELECT k.issue_id, k.ref_key, o.created_at, coalesce(o.updated_at, o.created_at) AS touched_at FROM keys k JOIN one o USING (issue_id)
), targets AS (
  SELECT issue_key AS ref_key, min(created_at) AS target_created FROM issues GROUP BY issue_key
)
SELECT DISTINCT r.issue_id, r.ref_key,
  CASE WHEN t.ref_key IS NOT NULL THEN 'later' WHEN r.ref_key IN (SELECT issue_key FROM deleted_issues WHERE issue_key IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS orphan_kind,
  coalesce(strftime(r.created_at, '%Y-%m'), 'unknown') AS created_month
FROM refs r LEFT JOIN targets t USING (ref_key)
WHERE t.ref_key IS NULL OR t.target_created > r.touched_at
"""


KEYS = ["ref_project", "ref_number"]
SALTS, HOT_SHARE = 8, 0.01


def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issue_id, ref_key, orphan_kind, created_at) of the references in related_issues."""
    # read by every step below; written once, a few bytes per reference
    refs = materialise(issue_references(spark, sf_dir))
    # one row per key, which the masks and the dates of birth both need
    born = materialise(_keyed(table(spark, sf_dir, "issues").select("issue_key", "created_at")).groupBy(*KEYS).agg(F.min("created_at").alias("target_created")))
    hot = materialise(hot_keys(refs, KEYS, HOT_SHARE))
    absent = find_orphans(refs, born, KEYS, match="partial", salts=SALTS, hot=hot)
    deleted = _keyed(table(spark, sf_dir, "deleted_issues").select("issue_key")).select(*KEYS).distinct().withColumn("deleted", F.lit(True))
    gone = lookup_salted(absent, deleted, KEYS, SALTS, hot=hot).withColumn("orphan_kind", F.when(F.col("deleted"), "deleted").otherwise("missing"))
    later = lookup_salted(refs, born, KEYS, SALTS, how="inner", hot=hot).where(F.col("target_created") > F.col("touched_at")).withColumn("orphan_kind", F.lit("later"))
    columns = ["issue_id", "ref_key", "orphan_kind", "created_at"]
    return gone.select(*columns).unionByName(later.select(*columns))


@registry.add("p2_found", P2_SQL)
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown")).alias("created_month")
    return _dangling(spark, sf_dir).select("issue_id", "ref_key", "orphan_kind", month)


@registry.add(
    "p2_partial",
    """SELECT * FROM (SELECT DISTINCT param_key, split_part(param_expression, '.', 1) AS resource, work_group, concat_ws(' ', CASE WHEN param_expression IS NULL THEN 'resource' END, CASE WHEN work_group IS NULL THEN 'work_group' END) AS null_columns FROM search_parameters) s
    WHERE NOT (resource IS NULL AND work_group IS NULL) AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE (s.resource IS NULL OR a.artifact_name = s.resource) AND (s.work_group IS NULL OR a.work_group = s.work_group))""",
)
def partial_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search parameters whose resource and work group, as far as they are given, belong to no one artifact."""
    keys = ["resource", "work_group"]
    refs = table(spark, sf_dir, "search_parameters").select("param_key", F.split_part("param_expression", F.lit("."), F.lit(1)).alias("resource"), "work_group").distinct()
    found = find_orphans(refs, table(spark, sf_dir, "artifacts"), keys, ["artifact_name", "work_group"], match="partial", salts=SALTS)
    return found.select("param_key", *keys, null_mask(keys).alias("null_columns"))


def _of_children(children: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a child table whose issue_id is no issue, with their kind; children has issue_id and created_at."""
    issues = table(spark, sf_dir, "issues").select(F.col("id").alias("issue_id"))
    absent = find_orphans(children, issues, ["issue_id"], match="partial", salts=SALTS)
    deleted = table(spark, sf_dir, "deleted_issues").select("issue_id").where("issue_id IS NOT NULL").distinct().withColumn("deleted", F.lit(True))
    return lookup_salted(absent, deleted, ["issue_id"], SALTS).withColumn("orphan_kind", F.when(F.col("deleted"), "deleted").otherwise("missing"))


_CHILDREN_SQL = """SELECT '%s' AS table_name, coalesce(strftime(seen, '%%Y-%%m'), 'unknown') AS period, CASE WHEN issue_id IN (SELECT issue_id FROM deleted_issues WHERE issue_id IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS orphan_kind, count(*) AS orphans, count(DISTINCT issue_id) AS keys
FROM (SELECT DISTINCT id, issue_id, %s AS seen FROM %s) WHERE issue_id IS NOT NULL AND issue_id NOT IN (SELECT id FROM issues) GROUP BY ALL"""


@registry.add(
    "p2_report",
    f"SELECT 'issues' AS table_name, created_month AS period, orphan_kind, count(*) AS orphans, count(DISTINCT ref_key) AS keys FROM ({P2_SQL}) x GROUP BY created_month, orphan_kind"
    f" UNION ALL ({_CHILDREN_SQL % ('comments', 'created_at', 'comments')}) UNION ALL ({_CHILDREN_SQL % ('issue_keywords', 'CAST(NULL AS TIMESTAMP)', 'issue_keywords')})",
)
def dangling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of every table that refers to issues, per month and kind."""
    comments = table(spark, sf_dir, "comments").select("id", "issue_id", "created_at").distinct()
    keywords = table(spark, sf_dir, "issue_keywords").select("id", "issue_id", F.lit(None).cast("timestamp").alias("created_at")).distinct()
    parts = [("issues", _dangling(spark, sf_dir), "ref_key"), ("comments", _of_children(comments, spark, sf_dir), "issue_id"), ("issue_keywords", _of_children(keywords, spark, sf_dir), "issue_id")]
    return reduce(DataFrame.unionByName, [orphan_report(df, name, F.col("created_at"), F.col(key), "orphan_kind") for name, df, key in parts])
