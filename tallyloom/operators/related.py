"""Records related to a record: by links, by equal fields, by shared keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import fulltext
from tallyloom.operators.keyed import union_ranked

#: Kept of a record's keywords are those that score at most this much less than its best one.
NEAR = 6.0
RELATED_FIELDS = ("related_artifacts", "related_pages", "related_url")


def linked(issues: DataFrame, keys: Column | None = None) -> DataFrame:
    """(id, place, linked_id, linked_key): the records named in each record's list, in list order.

    keys: array of keys; by default the comma-separated items of related_issues.
    Keys without a record are dropped.
    """
    each = issues.select("id", F.posexplode(keys if keys is not None else T.csv_list(F.col("related_issues"))).alias("place", "linked_key"))
    known = issues.select(F.col("id").alias("linked_id"), F.col("issue_key").alias("linked_key"))
    return each.join(known, "linked_key").select("id", "place", "linked_id", "linked_key")


def field_terms(row: dict, fields: tuple[str, ...] = RELATED_FIELDS) -> dict[str, list[str]]:
    """The terms each field of one record is searched by; blank fields are left out."""
    out = {}
    for field in fields:
        terms = [t.strip() for t in (row.get(field) or "").split(",") if t.strip()]
        if terms:
            out[field] = terms
    return out


def like_any(column: Column, term: Column) -> Column:
    """column LIKE '%term%' without regard to case; % and _ in the term are wildcards, a backslash is not."""
    return F.like(F.lower(column), F.concat(F.lit("%"), F.replace(F.lower(term), F.lit("\\"), F.lit("\\\\")), F.lit("%")))


def related_by_field(issues: DataFrame, row: dict, limit: int = 10, fields: tuple[str, ...] = RELATED_FIELDS) -> DataFrame:
    """(issue_key, place): records of the same project and work group that share a term in every field the row has.

    Within a field any term will do. A record without any such field, or without
    project or work group, has no relations. Newest id first.
    """
    terms = field_terms(row, fields)
    if not terms or row["project_key"] is None or row["work_group"] is None:
        return issues.select("issue_key", F.lit(0).alias("place")).limit(0)
    cond = (F.col("project_key") == row["project_key"]) & (F.col("work_group") == row["work_group"]) & (F.col("issue_key") != row["issue_key"])
    for field, wanted in terms.items():
        shown = [T.url_stem(F.lit(t)) if field == "related_url" else F.lit(t) for t in wanted]
        cond = cond & reduce(lambda a, b: a | b, [like_any(F.col(field), t) for t in shown])
    best = issues.where(cond).select("id", "issue_key").orderBy(F.col("id").desc()).limit(limit)
    return best.select("issue_key", F.row_number().over(Window.orderBy(F.col("id").desc())).alias("place"))


def top_keywords_of(index: DataFrame, issue_id: int, k: int = 5, least: float | None = 0.0, near: float | None = NEAR) -> list[str]:
    """A record's k best keywords: above `least`, and within `near` of the best one; best first."""
    own = index.where((F.col("issue_id") == issue_id) & F.col("bm25_score").isNotNull() & ~F.isnan("bm25_score"))
    if least is not None:
        own = own.where(F.col("bm25_score") > least)
    best = own.groupBy("keyword").agg(F.max("bm25_score").alias("s")).orderBy(F.col("s").desc(), "keyword").limit(k).collect()
    return [r.keyword for r in best if near is None or r.s >= best[0].s - near]


def related_by_keywords(index: DataFrame, issues: DataFrame, issue_id: int, limit: int = 10, k: int = 5) -> DataFrame:
    """(issue_id, score, matched): the other records that score best by the record's own best keywords."""
    wanted = top_keywords_of(index, issue_id, k)
    hits = index.where(F.col("keyword").isin(*wanted) & (F.col("issue_id") != issue_id) & (F.col("bm25_score") > 0) & ~F.isnan("bm25_score")) if wanted else index.limit(0)
    scores = hits.groupBy("issue_id").agg(F.round(F.sum("bm25_score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("keyword")), " ").alias("matched"))
    there = scores.join(issues.select(F.col("id").alias("issue_id")), "issue_id", "left_semi")
    return there.orderBy(F.col("score").desc(), "issue_id").limit(limit)


def _row(issues: DataFrame, issue_key: str) -> dict | None:
    found = issues.where(F.col("issue_key") == issue_key).select("id", "issue_key", "project_key", "work_group", "related_issues", *RELATED_FIELDS).orderBy("id").limit(1).collect()
    return found[0].asDict() if found else None


def _links(issues: DataFrame, row: dict) -> DataFrame:
    """(issue_key, place): the keys in the record's own list, in its order."""
    keys = [k.strip() for k in (row["related_issues"] or "").split(",")]
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("issue_key"), F.lit(i).alias("place")) for i, k in enumerate(k for k in keys if k)])) if any(keys) else None
    one = issues.sparkSession.range(1)
    return one.select(listed.alias("x")).select("x.*") if listed is not None else one.select(F.lit("").alias("issue_key"), F.lit(0).alias("place")).limit(0)


def list_related(issues: DataFrame, index: DataFrame, texts: fulltext.FullTextIndex, issue_key: str, limit: int = 10) -> DataFrame:
    """(issue_key, part, place): linked records (part 0), then field matches (1) and full-text matches (2), each once, never the record itself.

    All linked records come; the limit is that of the matches. The full-text
    query is the record's three best keywords joined by OR.
    """
    row = _row(issues, issue_key)
    none = issues.select("issue_key", F.lit(0).alias("part"), F.lit(0).alias("place")).limit(0)
    if row is None:
        return none
    rows = issues.select("id", "issue_key")
    links = _links(issues, row).join(rows.select("issue_key"), "issue_key", "left_semi").groupBy("issue_key").agg(F.min("place").alias("place"))
    words = [w for k in top_keywords_of(index, row["id"], 3, None, None) if (w := fulltext.words_of(k))]
    parts = [related_by_field(issues, row, limit)]
    if words:
        query = fulltext.Node("or", tuple(fulltext.Term(w) for w in words))
        best = fulltext.ranked(texts, query, limit=limit, but=F.lit(row["id"]))
        parts.append(best.select(F.col("doc_id").alias("id"), F.col("rank").alias("place")).join(rows, "id").select("issue_key", "place"))
    matches = union_ranked([p.where(F.col("issue_key") != issue_key) for p in parts], "issue_key", limit)
    return links.select("issue_key", F.lit(0).alias("part"), "place").unionByName(matches.withColumn("part", F.col("part") + 1))


def find_related(issues: DataFrame, index: DataFrame, issue_key: str, limit: int = 10) -> DataFrame:
    """Rows of the linked records (part 0) and of those that share keywords (part 1), with place and score."""
    row = _row(issues, issue_key)
    if row is None:
        return issues.select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(0.0).alias("score"), "id", "issue_key", "title").limit(0)
    rows = issues.select("id", "issue_key", "title")
    links = _links(issues, row).join(rows, "issue_key").select(F.lit(0).alias("part"), "place", F.lit(None).cast("double").alias("score"), "id", "issue_key", "title")
    words = related_by_keywords(index, issues, row["id"], limit)
    ranked = words.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "issue_id")))
    near = ranked.select(F.col("issue_id").alias("id"), "place", "score").join(rows, "id").select(F.lit(1).alias("part"), "place", "score", "id", "issue_key", "title")
    return links.unionByName(near)
