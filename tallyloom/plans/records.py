"""Relational queries over the record tables: filters, pages, lookups, links, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import filters, keyed
from tallyloom.plans import tables
from tallyloom.plans.registry import Registry
from tallyloom.plans.tables import COMMENTS_SQL, ISSUES_SQL
from tallyloom.session import table

registry = Registry()
add = registry.add


@add("scan_project", f"SELECT id, issue_key, project_key, type_name, priority_id FROM {ISSUES_SQL}")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.issues(spark, sf_dir, "issue_key", "project_key", "type_name", "priority_id").select("id", "issue_key", "project_key", "type_name", "priority_id")


@add("filter_eq", f"SELECT id, issue_key FROM {ISSUES_SQL} WHERE project_key = 'FHX' AND status_name = 'Triaged'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = filters.conditions(equals={"project_key": "FHX", "status_name": "Triaged", "priority_name": None})
    return filters.select_list(tables.issues(spark, sf_dir, "issue_key", "project_key", "status_name", "priority_name"), ["id", "issue_key"], cond)


@add("filter_numeric_ops", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000.5 AND o_totalprice < 450000 AND o_custkey != 7 AND o_totalprice > 1000 AND o_totalprice <= 449999.5")
def filter_numeric_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = filters.conditions(compare=[("o_totalprice", ">=", 1000.5), ("o_totalprice", "<", 450000), ("o_custkey", "!=", 7), ("o_totalprice", ">", 1000), ("o_totalprice", "<=", 449999.5)])
    return filters.select_list(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], cond)


@add("filter_is_null", f"SELECT id FROM {ISSUES_SQL} WHERE work_group IS NULL AND related_issues IS NOT NULL")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = filters.conditions(is_null={"work_group": True, "related_issues": False, "assignee": None})
    return filters.select_list(tables.issues(spark, sf_dir, "work_group", "related_issues", "assignee"), ["id"], cond)


@add("filter_or_join", f"SELECT id FROM {ISSUES_SQL} WHERE summary IS NULL OR resolution_description IS NULL OR type_name = 'Question'")
def filter_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = filters.conditions(equals={"type_name": "Question"}, is_null={"summary": True, "resolution_description": True}, any_of=True)
    return filters.select_list(tables.issues(spark, sf_dir, "type_name", "summary", "resolution_description"), ["id"], cond)


@add("filter_in", "SELECT DISTINCT id, issue_id, keyword FROM issue_keywords WHERE keyword IN ('binding', 'profile', 'server', 'with')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "issue_keywords").where(F.col("keyword").isin("binding", "profile", "server", "with")).select("id", "issue_id", "keyword").distinct()


@add("filter_ilike_any", f"SELECT id, related_artifacts FROM {ISSUES_SQL} WHERE related_artifacts ILIKE '%patient%' OR related_artifacts ILIKE '%care_eam%'")
def filter_ilike_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.issues(spark, sf_dir, "related_artifacts").where(filters.contains_any_ci("related_artifacts", ["patient", "care_eam"])).select("id", "related_artifacts")


@add("filter_ci_prefix", f"SELECT id, work_group FROM {ISSUES_SQL} WHERE lower(work_group) = 'orders' OR starts_with(lower(work_group), 'ph')")
def filter_ci_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.issues(spark, sf_dir, "work_group").where(filters.equals_ci("work_group", "ORDERS") | filters.starts_ci("work_group", "Ph")).select("id", "work_group")


@add("drop_empty", f"SELECT id, issue_id FROM {COMMENTS_SQL} WHERE body IS NOT NULL AND body <> ''")
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.delete_where(tables.comments(spark, sf_dir), F.col("body").isNull() | (F.col("body") == "")).select("id", "issue_id")


@add("lookup_single", f"SELECT id, issue_key, title FROM {ISSUES_SQL} WHERE project_key = 'VSM' ORDER BY id LIMIT 1")
def lookup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.select_single(tables.issues(spark, sf_dir, "issue_key", "title", "project_key"), "id", F.col("project_key") == "VSM").select("id", "issue_key", "title")


@add("select_dict", f"SELECT id, issue_key || ': ' || title AS row_value FROM {ISSUES_SQL} WHERE project_key = 'TRM'")
def select_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by primary key."""
    return tables.issues(spark, sf_dir, "issue_key", "title", "project_key").where("project_key = 'TRM'").select("id", F.concat_ws(": ", "issue_key", "title").alias("row_value"))


@add("select_dict_numbered", "SELECT keyword, row_number() OVER (ORDER BY keyword) AS row_no FROM (SELECT DISTINCT keyword FROM issue_keywords)")
def select_dict_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table without a key by their running number."""
    return filters.numbered(table(spark, sf_dir, "issue_keywords").select("keyword").distinct(), ["keyword"])


@add("select_count", f"SELECT count(id) AS n FROM {ISSUES_SQL} WHERE project_key = 'FHX' AND priority_id >= 2")
def select_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = filters.conditions(equals={"project_key": "FHX"}, compare=[("priority_id", ">=", 2)])
    return filters.select_count(tables.issues(spark, sf_dir, "project_key", "priority_id"), "id", cond)


@add("max_key", "SELECT coalesce(max(id), 0) AS max_key FROM issues")
def max_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.max_key(table(spark, sf_dir, "issues"), "id")


@add("sort_multi", f"SELECT id, project_key, priority_id, CAST(row_number() OVER (ORDER BY project_key NULLS FIRST, priority_id DESC NULLS LAST, id) AS INTEGER) AS place FROM {ISSUES_SQL} ORDER BY place LIMIT 200")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows in project order, priority falling, with their place."""
    best = tables.issues(spark, sf_dir, "project_key", "priority_id").select("id", "project_key", "priority_id").orderBy(*filters.ordering(["project_key", "priority_id"], "desc"), "id").limit(200)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*filters.ordering(["project_key", "priority_id"], "desc"), "id")))


@add("paginate", f"SELECT id, issue_key FROM {ISSUES_SQL} ORDER BY id LIMIT 25 OFFSET 50")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.page(tables.issues(spark, sf_dir, "issue_key").select("id", "issue_key"), filters.ordering(["id"]), 25, 50)


@add(
    "list_issues",
    f"""SELECT id, issue_key, total, CAST(25 AS INTEGER) AS page_limit, CAST(10 AS INTEGER) AS page_offset, total > 10 + (SELECT count(*) FROM (SELECT 1 FROM {ISSUES_SQL} WHERE project_key = 'FHX' AND resolution_name = 'Persuasive' LIMIT 25 OFFSET 10)) AS has_more
    FROM (SELECT id, issue_key, created_at, count(*) OVER () AS total FROM {ISSUES_SQL} WHERE project_key = 'FHX' AND resolution_name = 'Persuasive') ORDER BY created_at DESC NULLS LAST, id LIMIT 25 OFFSET 10""",
)
def list_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators.tools import list_issues as tool

    answer = tool(tables.issues(spark, sf_dir), project="FHX", resolution="Persuasive", limit=25, offset=10, sort="created", order="desc")
    return answer.rows.select("id", "issue_key", answer.total.alias("total"), F.lit(25).alias("page_limit"), F.lit(10).alias("page_offset"), answer.has_more.alias("has_more"))


@add("list_projects", "SELECT DISTINCT project_key FROM issues WHERE trim(project_key) <> ''")
def list_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.distinct_sorted(table(spark, sf_dir, "issues"), "project_key")


@add("list_work_groups", "SELECT DISTINCT work_group FROM issues WHERE trim(work_group) <> ''")
def list_work_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.distinct_sorted(table(spark, sf_dir, "issues"), "work_group")


@add("title_strip", f"SELECT id, CASE WHEN starts_with(title, '[' || project_key) AND strpos(title, ']') > 0 THEN trim(substring(title, strpos(title, ']') + 1)) ELSE title END AS title FROM {ISSUES_SQL}")
def title_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.issues(spark, sf_dir, "title", "project_key").select("id", T.title_without_key(F.col("title"), F.col("project_key")).alias("title"))


@add(
    "display_labels",
    "SELECT DISTINCT param_key, param_id || ' - ' || coalesce(param_name, '') AS label, '(' || coalesce(search_type, '?') || ', ' || coalesce(param_version, '?') || ')' AS detail, concat_ws('#', unversioned_url, param_code) AS param_identity FROM search_parameters",
)
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = table(spark, sf_dir, "search_parameters")
    return sp.select(
        "param_key",
        F.concat("param_id", F.lit(" - "), F.coalesce("param_name", F.lit(""))).alias("label"),
        F.concat(F.lit("("), F.coalesce("search_type", F.lit("?")), F.lit(", "), F.coalesce("param_version", F.lit("?")), F.lit(")")).alias("detail"),
        F.concat_ws("#", "unversioned_url", "param_code").alias("param_identity"),
    ).distinct()


@add("csv_list", "SELECT DISTINCT param_key, array_to_string(list_filter(list_transform(string_split(reference_targets, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS targets FROM search_parameters WHERE reference_targets IS NOT NULL")
def csv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_parameters").where("reference_targets IS NOT NULL").select("param_key", F.array_join(T.csv_list(F.col("reference_targets")), "|").alias("targets")).distinct()


@add("csv_contains", "SELECT DISTINCT param_key, param_code FROM search_parameters WHERE list_contains(list_transform(string_split(reference_targets, ','), lambda x: lower(trim(x))), 'patient')")
def csv_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_parameters").where(T.csv_has(F.col("reference_targets"), F.lit("PATIENT"))).select("param_key", "param_code").distinct()


@add("url_stem", f"SELECT id, CASE WHEN regexp_matches(related_url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(regexp_extract(regexp_extract(related_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1), '\\.[^.]*$', '') ELSE related_url END AS stem FROM {ISSUES_SQL} WHERE related_url IS NOT NULL")
def url_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.issues(spark, sf_dir, "related_url").where("related_url IS NOT NULL").select("id", T.url_stem(F.col("related_url")).alias("stem"))


@add("json_roundtrip", "SELECT DISTINCT param_key, CASE WHEN len(t) > 0 THEN array_to_string(t, '|') END AS targets FROM (SELECT param_key, list_filter(list_transform(string_split(coalesce(reference_targets, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS t FROM search_parameters)")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists stored as JSON text (an empty list as null) and read back."""
    lists = table(spark, sf_dir, "search_parameters").select("param_key", T.csv_list(F.coalesce("reference_targets", F.lit(""))).alias("t"))
    stored = lists.select("param_key", F.when(F.size("t") > 0, F.to_json("t")).alias("j"))
    return stored.select("param_key", F.array_join(F.from_json("j", "array<string>"), "|").alias("targets")).distinct()


@add(
    "json_result",
    f"SELECT id, concat('{{', concat_ws(',', '\"id\":' || id, '\"issueKey\":\"' || issue_key || '\"', '\"workGroup\":\"' || work_group || '\"'), '}}') AS json FROM {ISSUES_SQL}",
)
def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with camel-case names, nulls left out."""
    return tables.issues(spark, sf_dir, "issue_key", "work_group").select("id", F.to_json(F.struct("id", F.col("issue_key").alias("issueKey"), F.col("work_group").alias("workGroup"))).alias("json"))


@add(
    "format_size",
    "SELECT DISTINCT p_partkey, CASE WHEN s < 1024 THEN printf('%.1f', round(s, 1)) || ' B' WHEN s < 1048576 THEN printf('%.1f', round(s / 1024, 1)) || ' KB' ELSE printf('%.1f', round(s / 1048576, 1)) || ' MB' END AS shown FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * p_partkey * 3 AS s FROM part)",
)
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.file_size(F.col("p_size").cast("double") * F.col("p_partkey") * 3).alias("shown")).distinct()


@add("date_range_gen", "SELECT strftime(d, '%Y-%m-%d') AS day, 'created >= ' || strftime(d, '%Y-%m-%d') || ' AND created < ' || strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') AS query_text, CAST(23 AS INTEGER) AS span_days FROM range(DATE '2015-07-13', DATE '2015-08-05', INTERVAL 1 DAY) t(d)")
def date_range_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of a download range with their query text, newest first."""
    from tallyloom.sources.tracker import day_ranges

    return day_ranges(spark, "2015-07-13", "2015-08-04").withColumn("day", F.date_format("day", "yyyy-MM-dd")).orderBy(F.col("day").desc())


@add("success_rate", "SELECT event_type, count(*) AS attempts, CAST(count_if(value >= 50) AS BIGINT) AS succeeded, CAST(count_if(value < 50 OR value IS NULL) AS BIGINT) AS failed, round(count_if(value >= 50) * 100.0 / count(*), 6) AS success_percent, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(F.col("value") >= 50, F.lit(False))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("attempts"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.count_if(ok) * 100.0 / F.count("*"), 6).alias("success_percent"), F.sum(F.length("props")).alias("bytes"))


@add("union_all", f"SELECT id, issue_key FROM {ISSUES_SQL} WHERE summary IS NULL UNION ALL SELECT id, issue_key FROM {ISSUES_SQL} WHERE resolution_description IS NULL")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.issues(spark, sf_dir, "issue_key", "summary", "resolution_description")
    return df.where("summary IS NULL").select("id", "issue_key").unionByName(df.where("resolution_description IS NULL").select("id", "issue_key"))


@add("join_issue_comments", f"SELECT i.id, i.issue_key, c.id AS comment_id, c.author FROM {ISSUES_SQL} i LEFT JOIN {COMMENTS_SQL} c ON c.issue_id = i.id")
def join_issue_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.comments(spark, sf_dir).select(F.col("issue_id").alias("id"), F.col("id").alias("comment_id"), "author")
    return tables.issues(spark, sf_dir, "issue_key").select("id", "issue_key").join(c, "id", "left")


@add("issue_details", f"SELECT i.id, i.issue_key, i.title, i.status_name, coalesce(c.n, 0) AS comment_count FROM {ISSUES_SQL} i LEFT JOIN (SELECT issue_id, count(*) AS n FROM {COMMENTS_SQL} GROUP BY issue_id) c ON c.issue_id = i.id")
def issue_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.comments(spark, sf_dir).groupBy(F.col("issue_id").alias("id")).agg(F.count("*").alias("n"))
    return tables.issues(spark, sf_dir, "issue_key", "title", "status_name").join(n, "id", "left").select("id", "issue_key", "title", "status_name", F.coalesce("n", F.lit(0)).alias("comment_count"))


@add("issue_comments", f"SELECT issue_id, id, author, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC NULLS LAST, id) AS INTEGER) AS place FROM {COMMENTS_SQL}")
def issue_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of each issue, newest first."""
    newest = Window.partitionBy("issue_id").orderBy(F.col("created_at").desc_nulls_last(), "id")
    return tables.comments(spark, sf_dir).select("issue_id", "id", "author", F.row_number().over(newest).alias("place"))


@add("semi_join", f"SELECT id, issue_key FROM {ISSUES_SQL} i WHERE EXISTS (SELECT 1 FROM comments c WHERE c.issue_id = i.id)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "comments").select(F.col("issue_id").alias("id"))
    return tables.issues(spark, sf_dir, "issue_key").select("id", "issue_key").join(c, "id", "left_semi")


@add("orphan_rows", f"SELECT id, issue_id FROM {COMMENTS_SQL} c WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.id = c.issue_id)")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators.references import anti_join_salted

    ids = table(spark, sf_dir, "issues").select(F.col("id").alias("issue_id"))
    return anti_join_salted(tables.comments(spark, sf_dir).select("id", "issue_id"), ids, ["issue_id"], salts=8)


@add("anti_join_ci", "SELECT DISTINCT param_key, param_code FROM search_parameters s WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE lower(a.artifact_name) = lower(split_part(s.param_expression, '.', 1)))")
def anti_join_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search parameters whose resource is no known artifact, letter case ignored."""
    known = table(spark, sf_dir, "artifacts").select(F.lower("artifact_name").alias("k")).distinct()
    sp = table(spark, sf_dir, "search_parameters").select("param_key", "param_code", F.lower(F.split_part("param_expression", F.lit("."), F.lit(1))).alias("k")).distinct()
    return sp.join(known, "k", "left_anti").select("param_key", "param_code").distinct()


ATTRIBUTES_SQL = "SELECT user_id AS issue_id, event_type AS field_id, props || chr(13) || chr(10) || '&amp;' || CAST(event_id AS VARCHAR) || ' ' AS field_value, event_id AS id FROM events"
FIELDS = {"view": "viewed", "click": "clicked", "purchase": "purchased", "signup": "signed_up", "error": "failed"}


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value rows in the shape of a tracker's custom fields."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("issue_id"), F.col("event_type").alias("field_id"), F.concat("props", F.lit("\r\n&amp;"), F.col("event_id").cast("string"), F.lit(" ")).alias("field_value"), F.col("event_id").alias("id"))


CLEAN_SQL = "coalesce(trim(replace(replace(replace(field_value, chr(10), ''), chr(13), ''), '&amp;', '&')), '')"


@add("eav_clean", f"SELECT issue_id, id, {CLEAN_SQL} AS field_value FROM ({ATTRIBUTES_SQL})")
def eav_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes(spark, sf_dir).select("issue_id", "id", T.clean_field(F.col("field_value")).alias("field_value"))


@add(
    "eav_promote",
    f"SELECT b.c_custkey AS issue_id, {', '.join(f'p.{c}' for c in FIELDS.values())} FROM customer b LEFT JOIN (SELECT issue_id, {', '.join(f'''arg_min({CLEAN_SQL}, id) FILTER (field_id = '{f}') AS {c}''' for f, c in FIELDS.items())} FROM ({ATTRIBUTES_SQL}) GROUP BY issue_id) p ON p.issue_id = b.c_custkey",
)
def eav_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value fields as columns of their record, the first value of each field."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issue_id"))
    return keyed.promote_fields(base, attributes(spark, sf_dir), "issue_id", "field_id", T.clean_field(F.col("field_value")), F.col("id"), FIELDS)


@add("eav_unpromoted", f"SELECT id, field_id FROM ({ATTRIBUTES_SQL}) WHERE NOT coalesce(field_id IN ('view', 'click'), false)")
def eav_unpromoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.unpromoted(attributes(spark, sf_dir), "field_id", ["view", "click"]).select("id", "field_id")


@add(
    "page_reconcile",
    "SELECT coalesce(a, b) AS page_file_name, a IS NOT NULL AS in_known, b IS NOT NULL AS in_listed FROM (SELECT lower(page_file_name) AS k, min(page_file_name) AS a FROM spec_pages GROUP BY 1) FULL JOIN (SELECT lower(fhir_id || '.html') AS k, min(fhir_id || '.html') AS b FROM artifacts GROUP BY 1) USING (k)",
)
def page_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known pages against a list of expected ones, with where each stands."""
    listed = table(spark, sf_dir, "artifacts").select(F.concat("fhir_id", F.lit(".html")).alias("page_file_name"))
    return keyed.reconcile(table(spark, sf_dir, "spec_pages"), listed, "page_file_name")


@add(
    "insert_or_ignore",
    "WITH fresh AS (SELECT issue_id, min(issue_key) AS issue_key, count(*) AS n FROM comments GROUP BY issue_id) SELECT id AS issue_id, min(issue_key) AS issue_key FROM issues GROUP BY id UNION ALL SELECT issue_id, issue_key FROM fresh WHERE issue_id NOT IN (SELECT id FROM issues)",
)
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue ids named only by comments added to the known ones; the first key in order stays."""
    known = table(spark, sf_dir, "issues").groupBy(F.col("id").alias("issue_id")).agg(F.min("issue_key").alias("issue_key"))
    new = table(spark, sf_dir, "comments").select("issue_id", "issue_key")
    return keyed.insert_or_ignore(known, new, ["issue_id"], [F.col("issue_key")])


@add(
    "keep_first_version",
    "SELECT id, status_name FROM (SELECT id, status_name, row_number() OVER (PARTITION BY id ORDER BY updated_at NULLS FIRST, status_id NULLS FIRST) AS rn FROM issues) WHERE rn = 1",
)
def keep_first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_one(table(spark, sf_dir, "issues").select("id", "status_name", "updated_at", "status_id"), ["id"], [F.col("updated_at").asc_nulls_first(), F.col("status_id").asc_nulls_first()]).select("id", "status_name")


@add(
    "update_by_key",
    "SELECT a.id, coalesce(p.maturity, a.maturity) AS maturity, CASE WHEN p.id IS NOT NULL THEN p.work_group ELSE a.work_group END AS work_group FROM (SELECT id, maturity, work_group FROM artifacts) a LEFT JOIN (SELECT id, coalesce(maturity, 0) AS maturity, work_group FROM spec_pages) p USING (id)",
)
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "artifacts").select("id", "maturity", "work_group")
    changed = table(spark, sf_dir, "spec_pages").select("id", F.coalesce("maturity", F.lit(0)).alias("maturity"), "work_group")
    return keyed.update_by_key(base, changed, ["id"])


@add("delete_by_key", f"SELECT id, issue_key FROM {ISSUES_SQL} WHERE id NOT IN (SELECT issue_id FROM deleted_issues)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "deleted_issues").select(F.col("issue_id").alias("id"))
    return keyed.delete_by_key(tables.issues(spark, sf_dir, "issue_key").select("id", "issue_key"), doomed, ["id"])


@add("date_filter", f"SELECT id, issue_key FROM {ISSUES_SQL} WHERE created_at >= TIMESTAMP '2018-01-01' AND created_at < TIMESTAMP '2020-01-01'")
def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = F.lit("2018-01-01").cast("timestamp"), F.lit("2020-01-01").cast("timestamp")
    return tables.issues(spark, sf_dir, "issue_key", "created_at").where((F.col("created_at") >= lo) & (F.col("created_at") < hi)).select("id", "issue_key")


@add("parse_dates", f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS parsed FROM {ISSUES_SQL} WHERE created_at IS NOT NULL")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as in a tracker export, read back."""
    written = F.concat(F.lit("Mon, "), F.date_format("created_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return tables.issues(spark, sf_dir, "created_at").where("created_at IS NOT NULL").select("id", F.date_format(T.parse_date(written), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@add(
    "text_helpers",
    f"""SELECT id, CASE WHEN trim(array_to_string(list_filter(list_transform(string_split(coalesce(related_artifacts, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> ''), ', '), ' ') <> '' THEN array_to_string(list_filter(list_transform(string_split(related_artifacts, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), ', ') END AS joined,
    CAST(nullif(CAST(watches AS INTEGER), 0) AS VARCHAR) AS watches, trim(regexp_replace(description, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS squeezed FROM {ISSUES_SQL}""",
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values joined again, a number of watchers as text, white space squeezed."""
    df = tables.issues(spark, sf_dir, "related_artifacts", "watches", "description")
    return df.select("id", T.join_values(T.csv_list(F.coalesce("related_artifacts", F.lit("")))).alias("joined"), T.watches(F.col("watches")).alias("watches"), T.squeeze(F.col("description")).alias("squeezed"))


@add("replaced_codes", f"SELECT id, CASE WHEN status_name = 'Triaged' THEN 'Submitted' WHEN status_name IN ('Submitted', 'Applied', 'Published') THEN status_name ELSE 'Other' END AS status FROM {ISSUES_SQL}")
def replaced_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replaced code gives its successor, null and unknown ones the default."""
    return tables.issues(spark, sf_dir, "status_name").select("id", T.replaced_code(F.col("status_name"), {"Triaged": "Submitted"}, ["Submitted", "Applied", "Published"], "Other").alias("status"))


@add("download_check", "SELECT doc_id, starts_with(ltrim(text, ' '), '<') AS usable FROM documents WHERE text IS NOT NULL")
def download_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts would pass as a download: markup, not blank."""
    from tallyloom.sources.tracker import usable_download

    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", usable_download(F.col("text")).alias("usable"))
