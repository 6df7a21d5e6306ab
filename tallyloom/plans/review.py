"""Queries of related records, page review, metadata checks and prompts.

The test data has no HTML spec pages and no element tables: pages are the
documents' texts, and the metadata checks run over key chains of the order
tables and over the search parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import html_pages, review
from tallyloom.functions import text as T
from tallyloom.operators import metadata, page_words, related, reports, summaries
from tallyloom.plans import tables
from tallyloom.plans.registry import Registry
from tallyloom.plans.tables import COMMENTS_SQL, ISSUES_SQL, KEYWORDS_SQL
from tallyloom.plans.text_index import FTS_SQL, full_text, ranked_sql
from tallyloom.session import stored, table

registry = Registry()
add = registry.add

CSV = "list_filter(list_transform(string_split(%s, ','), lambda x: trim(x)), lambda x: x <> '')"


@add("linked_issues", f"SELECT e.id, CAST(e.place AS INTEGER) AS place, k.id AS linked_id, e.linked_key FROM (SELECT id, unnest(l) AS linked_key, unnest(range(0, len(l))) AS place FROM (SELECT id, {CSV % 'related_issues'} AS l FROM {ISSUES_SQL})) e JOIN {ISSUES_SQL} k ON k.issue_key = e.linked_key")
def linked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related.linked(tables.issues(spark, sf_dir, "issue_key", "related_issues"))


#: The record whose relations are asked for: of those with a linked record the one with most keywords that count.
_SOURCE = f"""(SELECT * FROM {ISSUES_SQL} WHERE id = (SELECT issue_id FROM {KEYWORDS_SQL} WHERE bm25_score > 0 AND NOT isnan(bm25_score)
  AND issue_id IN (SELECT e.id FROM (SELECT id, unnest({CSV % 'related_issues'}) AS k FROM {ISSUES_SQL}) e WHERE e.k IN (SELECT issue_key FROM issues)) GROUP BY issue_id ORDER BY count(*) DESC, issue_id LIMIT 1))"""
#: The record whose field relations are asked for: of the largest project and work group the one with the shortest cell of artifacts and nothing else to relate.
_FIELD_SOURCE = f"""(SELECT * FROM {ISSUES_SQL} WHERE trim(related_artifacts, ' ') <> '' AND coalesce(trim(related_pages, ' '), '') = '' AND coalesce(trim(related_url, ' '), '') = ''
  AND (project_key, work_group) = (SELECT (project_key, work_group) FROM {ISSUES_SQL} WHERE trim(related_artifacts, ' ') <> '' AND work_group IS NOT NULL GROUP BY project_key, work_group ORDER BY count(*) DESC, project_key, work_group LIMIT 1)
  ORDER BY length(trim(related_artifacts, ' ')), id LIMIT 1)"""


def source_key(spark: SparkSession, sf_dir: str) -> str:
    """The key of the first record; '' if there is none."""
    issues = tables.issues(spark, sf_dir, "issue_key", "related_issues")
    linked = related.linked(issues).select("id").distinct()
    counting = tables.keywords(spark, sf_dir).where((F.col("bm25_score") > 0) & ~F.isnan("bm25_score")).groupBy(F.col("issue_id").alias("id")).agg(F.count("*").alias("n"))
    best = counting.join(linked, "id", "left_semi").join(issues.select("id", "issue_key"), "id").orderBy(F.col("n").desc(), "id").first()
    return best.issue_key if best else ""


def field_source(spark: SparkSession, sf_dir: str) -> dict | None:
    """The second record."""
    able = tables.issues(spark, sf_dir, "issue_key", "project_key", "work_group", *related.RELATED_FIELDS).where("trim(related_artifacts) <> ''")
    group = able.where("work_group IS NOT NULL").groupBy("project_key", "work_group").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "project_key", "work_group").first()
    if not group:
        return None
    of_group = able.where((F.col("project_key") == group.project_key) & (F.col("work_group") == group.work_group) & (F.coalesce(F.trim("related_pages"), F.lit("")) == "") & (F.coalesce(F.trim("related_url"), F.lit("")) == ""))
    best = of_group.orderBy(F.length(F.trim("related_artifacts")), "id").first()
    return best.asDict() if best else None


_FIELD = f"(coalesce(trim(s.%s, ' '), '') = '' OR EXISTS (SELECT 1 FROM (SELECT unnest({CSV % 's.%s'}) AS t) x WHERE lower(i.%s) LIKE '%%' || lower(%s) || '%%'))"
_STEM = "CASE WHEN regexp_matches(x.t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(regexp_extract(regexp_extract(x.t, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1), '\\.[^.]*$', '') ELSE x.t END"
_CONDS = " AND ".join(_FIELD % (f, f, f, _STEM if f == "related_url" else "x.t") for f in related.RELATED_FIELDS)
_BY_FIELD = f"""(SELECT issue_key, CAST(row_number() OVER (ORDER BY id DESC) AS INTEGER) AS place FROM (
  SELECT i.id, i.issue_key FROM {ISSUES_SQL} i, %s s
  WHERE i.project_key = s.project_key AND i.work_group = s.work_group AND i.issue_key <> s.issue_key
    AND coalesce(trim(s.related_artifacts, ' '), '') || coalesce(trim(s.related_pages, ' '), '') || coalesce(trim(s.related_url, ' '), '') <> '' AND {_CONDS.replace("%", "%%")}
  ORDER BY i.id DESC LIMIT 10))"""


@add("related_by_field", f"SELECT * FROM {_BY_FIELD % _FIELD_SOURCE}")
def related_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, row = tables.issues(spark, sf_dir), field_source(spark, sf_dir)
    return related.related_by_field(issues, row) if row else issues.select("issue_key", F.lit(0).alias("place")).limit(0)


_BEST = f"SELECT keyword, max(bm25_score) AS s FROM {KEYWORDS_SQL} WHERE NOT isnan(bm25_score) AND issue_id = (SELECT id FROM {_SOURCE}) %s GROUP BY keyword ORDER BY s DESC, keyword LIMIT %d"
_BY_WORD = f"""(SELECT issue_id, round(sum(bm25_score), 6) AS score FROM {KEYWORDS_SQL}
  WHERE bm25_score > 0 AND NOT isnan(bm25_score) AND issue_id <> (SELECT id FROM {_SOURCE}) AND issue_id IN (SELECT id FROM issues)
    AND keyword IN (SELECT keyword FROM ({_BEST % ("AND bm25_score > 0", 5)}) QUALIFY s >= max(s) OVER () - {related.NEAR})
  GROUP BY issue_id ORDER BY 2 DESC, 1 LIMIT 10)"""
_LINKS = f"(SELECT unnest(l) AS key, unnest(range(0, len(l))) AS place FROM (SELECT {CSV % 'related_issues'} AS l FROM {_SOURCE}))"


@add("find_related", f"""
SELECT 0 AS part, CAST(place AS INTEGER) AS place, CAST(NULL AS DOUBLE) AS score, k.id, k.issue_key, k.title FROM {_LINKS} e JOIN {ISSUES_SQL} k ON k.issue_key = e.key
UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY score DESC, issue_id) AS INTEGER), score, i.id, i.issue_key, i.title FROM {_BY_WORD} w JOIN {ISSUES_SQL} i ON i.id = w.issue_id""")
def find_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related.find_related(tables.issues(spark, sf_dir), tables.keywords(spark, sf_dir), source_key(spark, sf_dir))


@add("related_union", f"""
WITH {FTS_SQL}, words AS (SELECT regexp_extract_all(lower(keyword), '[\\p{{L}}\\p{{N}}]+') AS l FROM ({_BEST % ("", 3)})),
hits AS (SELECT DISTINCT doc_id FROM fts, words WHERE len(words.l) > 0 AND contains(t, ' ' || array_to_string(words.l, ' ') || ' ') AND doc_id <> (SELECT id FROM {_SOURCE})),
by_text AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM ({ranked_sql("hits", "term IN (SELECT unnest(l) FROM words)")} ORDER BY score DESC, doc_id LIMIT 10))
SELECT key AS issue_key, 0 AS part, CAST(min(place) AS INTEGER) AS place FROM {_LINKS} WHERE key IN (SELECT issue_key FROM issues) GROUP BY key
UNION ALL SELECT * FROM (SELECT issue_key, CAST(min(part * 1000 + place) // 1000 AS INTEGER) AS part, CAST(min(part * 1000 + place) % 1000 AS INTEGER) AS place FROM (
  SELECT issue_key, 1 AS part, place FROM {_BY_FIELD % _SOURCE} UNION ALL SELECT i.issue_key, 2, place FROM by_text JOIN {ISSUES_SQL} i ON i.id = doc_id
) WHERE issue_key <> (SELECT issue_key FROM {_SOURCE}) GROUP BY issue_key ORDER BY part, place, issue_key LIMIT 10)""")
def related_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related.list_related(tables.issues(spark, sf_dir), tables.keywords(spark, sf_dir), full_text(spark, sf_dir), source_key(spark, sf_dir))


# --- page review ----------------------------------------------------------
def _conformance_sql() -> str:
    out = []
    for w in review.CONFORMANCE:
        n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
        # no look-ahead here: all minus those with NOT behind them
        good, every = f"({n(rf'\b{w}\b')} - {n(rf'\b{w}\s+NOT')})", f"({n(rf'(?i)\b{w}\b')} - {n(rf'(?i)\b{w}\s+NOT')})"
        out += [f"{good} AS {w.lower()}_conformant", f"{every} - {good} AS {w.lower()}_other"]
        out += [f"{n(rf'\b{w}\s+NOT\b')} AS {w.lower()}_not_conformant", f"{n(rf'(?i)\b{w}\s+NOT\b')} - {n(rf'\b{w}\s+NOT\b')} AS {w.lower()}_not_other"]
    return f"SELECT doc_id, {', '.join(out)} FROM documents WHERE text IS NOT NULL"


@add("conformance_counts", _conformance_sql())
def conformance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = review.conformance_columns(F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", *[c.alias(n) for n, c in counts.items()])


_MARKERS = (*review.INCOMPLETE, *review.READER_NOTES)
_MARKER_SQL = rf"regexp_extract_all(text, '(?i)\b({'|'.join(_MARKERS)})\b')"


@add(
    "page_markers",
    f"""SELECT doc_id, array_to_string(list(x ORDER BY low), '; ') AS markers FROM (
    SELECT doc_id, lower(x) AS low, arg_min(x, n) AS x FROM (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS n FROM (SELECT doc_id, {_MARKER_SQL} AS l FROM documents)) GROUP BY doc_id, lower(x)
    ) GROUP BY doc_id""",
)
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of unfinished text and notes to readers, per document that has any: each once, as first spelt, sorted without regard to case."""
    found = review.markers(F.col("text"), _MARKERS)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", found.alias("m")).where(F.size("m") > 0).select("doc_id", F.array_join("m", "; ").alias("markers"))


@add("page_links", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)http[s?]://spec\.example\.org/')) AS spec_links, len(regexp_extract_all(text, '(?i)http[s?]://tracker\.example\.org/')) AS tracker_links, len(regexp_extract_all(text, '(?i)(>\s*Trial\s+Use\s*<|class\s*=\s*[''" + '"' + r"]stu[''" + '"' + r"])')) AS trial_use FROM documents WHERE text IS NOT NULL")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", review.link_count(t, "spec.example.org").alias("spec_links"), review.link_count(t, "tracker.example.org").alias("tracker_links"), review.trial_use_count(t).alias("trial_use"))


_SKIP = " ".join(f"WHEN regexp_matches(token, '{p}') THEN '{n}'" for n, p in review.SKIPPED.items())
_SYMBOL = r"regexp_extract(token, '^[^\p{Lu}\p{Lt}\p{Ll}\p{P}\p{Sm}\p{Sc}\p{So}]*([\p{P}\p{Sm}\p{Sc}\p{So}])', 1)"
SKIP_SQL = f"CASE {_SKIP} WHEN starts_with(token, '[%') OR ends_with(token, '%]') THEN 'markup' WHEN {_SYMBOL} IN ('%', '#') THEN 'symbol' WHEN {_SYMBOL} = '/' AND starts_with(token, '/') THEN 'path' END"


@add("token_skip", f"SELECT reason, count(*) AS n FROM (SELECT {SKIP_SQL} AS reason FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS token FROM documents)) WHERE reason IS NOT NULL GROUP BY reason")
def token_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why review passes over tokens, and how often; each distinct token is judged once."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("k"))
    return tokens.select(review.skip_reason(F.col("token")).alias("reason"), "k").where("reason IS NOT NULL").groupBy("reason").agg(F.sum("k").alias("n"))


#: Hand-made pages, each with faults of its own; the documents' texts are pages beside them.
PAGES = {
    -1: """<html><head><title>no</title></head><body><nav>menu zzmenu</nav><table class="colstu"><tr><td id="wg"><a href="x">[%wgt vocab%]</a> Work Group</td><td id="fmm">Maturity Level: 3</td><td id="ballot">Standards Status:<!--!ns!--><a>Trial Use</a></td></tr></table>
<h1>Stable</h1><p>the Patient .zzpart and teh server<img src="one.png"></p><script>zzscript()</script>[%file newfooter%]<p>zzbehind</p></body></html>""",
    -2: """<body><table class="colsd"><tr><td id="fmm">Maturity Level: 0</td><td id="ballot">Draft</td><td id="wg">Owner [%wg orders%]</td></tr></table><figure><img src="two.png" alt="two"></figure><figure><img src="three.png" alt="  "></figure><p>R4 deprecated R5 zzword/the</p></body>""",
    -3: """<table class="colsn"><tr><td id="fmm">Maturity Level: Normative</td><td id="ballot">Standards Status: </td></tr></table><img src="same.png" alt="x"><figure><img src="same.png"></figure><p>the zzend""",
    -4: """<p>no status here <img src="four.png" alt="four">%41 &amp; B</p><style>p {}</style>""",
    -5: """<table class="other colsi"><tr><td id="fmm">N/A</td><td id="wg">nobody</td></tr></table>""",
}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): the hand-made pages and every document."""
    made = spark.range(1).select(F.explode(F.create_map(*[x for i, page in PAGES.items() for x in (F.lit(i).cast("long"), F.lit(page))])).alias("page_id", "html"))
    return made.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")).where("html IS NOT NULL"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "page_parts", ["documents"], lambda: html_pages.page_parts(_pages(spark, sf_dir), "page_id", "html"))


@add("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every document and hand-made page."""
    return _pages(spark, sf_dir).select("page_id", html_pages.page_text(F.col("html")).alias("visible"))


@add("page_text_made", """SELECT * REPLACE (CAST(page_id AS BIGINT) AS page_id) FROM (VALUES (-1, '[%wgt vocab%] Work Group Maturity Level: 3 Standards Status: Trial Use Stable the Patient .zzpart and teh server'),
  (-2, 'Maturity Level: 0 Draft Owner [%wg orders%] R4 deprecated R5 zzword/the'), (-3, 'Maturity Level: Normative Standards Status: the zzend'), (-4, 'no status here A & B'), (-5, 'N/A nobody')) t(page_id, visible)""")
def page_text_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of the hand-made pages, runs of blanks as one, against texts written out by hand."""
    return page_text(spark, sf_dir).where("page_id < 0").select("page_id", F.trim(F.regexp_replace("visible", r"\s+", " ")).alias("visible"))


@add("page_status", "SELECT * REPLACE (CAST(page_id AS BIGINT) AS page_id) FROM (VALUES (-1, 'Trial Use', 3, 'Trial Use', 'vocab'), (-2, 'Draft', 0, 'Draft', 'orders'), (-3, 'Normative', NULL, NULL, NULL), (-5, 'Informative', NULL, NULL, NULL)) t(page_id, status, maturity, ballot, work_group)")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.page_status(_parts(spark, sf_dir))


@add("page_images", "SELECT * REPLACE (CAST(page_id AS BIGINT) AS page_id) FROM (VALUES (-1, 'one.png', true, true), (-2, 'three.png', true, false), (-3, 'same.png', true, true), (-4, 'four.png', false, true)) t(page_id, source, missing_alt, not_in_figure)")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.page_images(_parts(spark, sf_dir))


TYPOS = {"teh": "the", "recieve": "receive"}


def dictionary_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The dictionaries of review: of the current release artifacts with their class, paths and parameters; of the published one paths; typos; words."""
    artifacts, parameters, corpus = table(spark, sf_dir, "artifacts"), table(spark, sf_dir, "search_parameters"), table(spark, sf_dir, "corpus_keywords")
    typos = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in TYPOS.items() for x in pair])).alias("typo", "correction"))
    rows = page_words.dictionary_rows
    return [
        rows(artifacts, "artifact_name", page_words.STRUCTURE, page_words.CURRENT, F.col("artifact_type"), F.col("id")),
        rows(parameters, "param_expression", page_words.ELEMENT, page_words.CURRENT),
        rows(parameters, "param_name", page_words.PARAMETER, page_words.CURRENT),
        rows(corpus.where("keyword_type = 'FhirElementPath'"), "keyword", page_words.ELEMENT, page_words.PUBLISHED),
        rows(typos, "typo", page_words.TYPO, "", F.col("correction")),
        rows(corpus.where("keyword_type IN ('Word', 'StopWord')"), "keyword", page_words.WORD),
    ]


_FORM = "lower(regexp_replace(%s, '[^\\p{Lu}\\p{Lt}\\p{Ll}\\p{Nd}]', '', 'g'))"
_TYPO_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in TYPOS.items())
DICTIONARY_SQL = f"""
SELECT form, kind, release, arg_max(note, place) AS note FROM (
  SELECT {_FORM % 'artifact_name'} AS form, 'structure' AS kind, 'current' AS release, artifact_type AS note, id AS place FROM artifacts
  UNION ALL SELECT {_FORM % 'param_expression'}, 'element', 'current', NULL, 0 FROM search_parameters
  UNION ALL SELECT {_FORM % 'param_name'}, 'parameter', 'current', NULL, 0 FROM search_parameters
  UNION ALL SELECT {_FORM % 'keyword'}, 'element', 'published', NULL, 0 FROM corpus_keywords WHERE keyword_type = 'FhirElementPath'
  UNION ALL SELECT {_FORM % 'keyword'}, 'word', '', NULL, 0 FROM corpus_keywords WHERE keyword_type IN ('Word', 'StopWord')
  UNION ALL SELECT lower(trim(a)), 'typo', '', b, 0 FROM (VALUES {_TYPO_ROWS}) t(a, b)
) WHERE form <> '' GROUP BY form, kind, release"""


@add("review_dictionaries", DICTIONARY_SQL)
def review_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names review knows, by kind and release, with the class of artifacts and the correction of typos."""
    return reduce(DataFrame.unionByName, dictionary_parts(spark, sf_dir)).drop("place")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "vocabulary", ["artifacts", "search_parameters", "corpus_keywords"], lambda: page_words.vocabulary(dictionary_parts(spark, sf_dir)))


def _resolve_sql(pages: str) -> str:
    """The words of `pages` (page_id, text) resolved, step by step as review does it."""
    parts = r"""[ \t\r\n.:\\/"'';+\-_#*&^%@!,|?={}()\[\]]+"""
    symbol = _SYMBOL.replace("token", "unit")
    return f"""
dict AS MATERIALIZED ({DICTIONARY_SQL}),
arts AS (
  SELECT release, form, arg_min(cls, rank) AS cls, arg_min(names, rank) AS names FROM (
    SELECT release, form, note AS cls, true AS names, 0 AS rank FROM dict WHERE kind = 'structure' UNION ALL SELECT release, 'value' || form, note, false, 1 FROM dict WHERE kind = 'structure'
    UNION ALL SELECT release, form, 'Element', true, 2 FROM dict WHERE kind = 'element') GROUP BY release, form
),
places AS (SELECT page_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS at_no FROM (SELECT page_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n"]+'), lambda x: x <> '') AS l FROM (SELECT DISTINCT page_id, text FROM ({pages})))),
words AS MATERIALIZED (SELECT word FROM (SELECT DISTINCT word, {SKIP_SQL.replace('token', 'word')} AS reason FROM places) WHERE reason IS NULL AND regexp_matches(word, '[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}]')),
units AS (SELECT word, 0 AS no, word AS unit FROM words UNION ALL SELECT word, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT word, list_filter(regexp_split_to_array(word, '{parts}'), lambda x: regexp_matches(x, '[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}]')) AS l FROM words)),
forms AS MATERIALIZED (SELECT DISTINCT unit, {_FORM % 'unit'} AS form, {symbol} AS symbol FROM units),
hits AS MATERIALIZED (
  SELECT f.*, CASE WHEN form LIKE '%s' THEN form[:-2] END AS single,
    regexp_extract(unit, '^\\.*([^.]*)', 1) AS own_name, regexp_extract(unit[:-2], '^\\.*([^.]*)', 1) AS single_name FROM forms f
),
judged AS MATERIALIZED (
  SELECT h.unit, h.form,
    coalesce(co.cls, CASE WHEN symbol = '_' AND po.form IS NOT NULL THEN 'SearchParameter' END) AS own_now, CASE WHEN co.names THEN own_name END AS own_now_name,
    coalesce(cs.cls, CASE WHEN symbol = '_' AND ps.form IS NOT NULL THEN 'SearchParameter' END) AS single_now, CASE WHEN cs.names THEN single_name END AS single_now_name,
    uo.cls AS own_then, CASE WHEN uo.names THEN own_name END AS own_then_name, us.cls AS single_then, CASE WHEN us.names THEN single_name END AS single_then_name,
    w.form IS NOT NULL AS is_word, coalesce(t1.note, t2.note) AS typo
  FROM hits h LEFT JOIN arts co ON co.release = 'current' AND co.form = h.form LEFT JOIN arts cs ON cs.release = 'current' AND cs.form = h.single
    LEFT JOIN arts uo ON uo.release = 'published' AND uo.form = h.form LEFT JOIN arts us ON us.release = 'published' AND us.form = h.single
    LEFT JOIN dict po ON po.kind = 'parameter' AND po.form = h.form LEFT JOIN dict ps ON ps.kind = 'parameter' AND ps.form = h.single
    LEFT JOIN dict w ON w.kind = 'word' AND w.form = h.form LEFT JOIN dict t1 ON t1.kind = 'typo' AND t1.form = lower(h.unit) LEFT JOIN dict t2 ON t2.kind = 'typo' AND t2.form = h.form
),
told AS MATERIALIZED (
  SELECT *, CASE WHEN form IN ('dstu1', 'dstu2', 'r2', 'stu3', 'r3', 'r4', 'r4b', 'r5') THEN 'prior' WHEN form = 'deprecated' THEN 'deprecated' WHEN coalesce(own_now, single_now) IS NOT NULL THEN 'known'
      WHEN coalesce(own_then, single_then) IS NOT NULL THEN CASE WHEN is_word THEN 'known' ELSE 'removed' END WHEN typo IS NOT NULL THEN 'typo' WHEN is_word THEN 'known' END AS kind,
    CASE WHEN form IN ('dstu1', 'dstu2', 'r2', 'stu3', 'r3', 'r4', 'r4b', 'r5', 'deprecated') THEN NULL WHEN own_now IS NOT NULL THEN own_now_name WHEN single_now IS NOT NULL THEN single_now_name
      WHEN is_word THEN NULL WHEN own_then IS NOT NULL THEN own_then_name ELSE single_then_name END AS name
  FROM judged
),
of_word AS MATERIALIZED (SELECT u.word, u.no, t.* FROM units u JOIN told t USING (unit)),
wholes AS MATERIALIZED (SELECT word, max(CASE WHEN no = 0 THEN kind END) AS kind, coalesce(max(CASE WHEN no = 0 AND kind IS NOT NULL THEN coalesce(name, '') END), arg_max(name, no) FILTER (no > 0 AND name IS NOT NULL)) AS name FROM of_word GROUP BY word),
noted AS MATERIALIZED (
  SELECT word, kind, unit AS shown, CASE kind WHEN 'removed' THEN coalesce(own_then, single_then) WHEN 'typo' THEN typo ELSE '' END AS note FROM of_word WHERE no = 0 AND kind IS NOT NULL
  UNION ALL SELECT o.word, coalesce(o.kind, 'unknown'), CASE WHEN o.kind IS NULL THEN o.word ELSE unit END, CASE o.kind WHEN 'removed' THEN coalesce(own_then, single_then) WHEN 'typo' THEN typo ELSE '' END FROM of_word o JOIN wholes w USING (word) WHERE o.no > 0 AND w.kind IS NULL
),
named AS (SELECT p.*, nullif(w.name, '') AS name FROM places p JOIN wholes w USING (word)),
seen AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY at_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM named),
relative AS (
  SELECT s.page_id, s.word, CASE WHEN t.form IN ('dstu1', 'dstu2', 'r2', 'stu3', 'r3', 'r4', 'r4b', 'r5') THEN 'prior' WHEN t.form = 'deprecated' THEN 'deprecated' WHEN coalesce(t.own_now, c.cls, t.single_now) IS NOT NULL THEN 'known'
      WHEN coalesce(t.own_then, u.cls, t.single_then) IS NOT NULL THEN CASE WHEN t.is_word THEN 'known' ELSE 'removed' END ELSE t.kind END AS kind, coalesce(t.own_then, u.cls, t.single_then) AS cls, t.typo
  FROM seen s JOIN told t ON t.unit = s.word LEFT JOIN arts c ON c.release = 'current' AND c.form = {_FORM % 's.last || s.word'} LEFT JOIN arts u ON u.release = 'published' AND u.form = {_FORM % 's.last || s.word'}
  WHERE starts_with(s.word, '.')
),
all_notes AS (
  SELECT s.page_id, n.kind, n.shown AS word, n.note FROM seen s JOIN noted n USING (word) WHERE NOT starts_with(s.word, '.')
  UNION ALL SELECT page_id, kind, word, CASE kind WHEN 'removed' THEN cls WHEN 'typo' THEN typo ELSE '' END FROM relative WHERE kind IS NOT NULL
  UNION ALL SELECT r.page_id, n.kind, n.shown, n.note FROM relative r JOIN noted n USING (word) WHERE r.kind IS NULL
),
resolved AS (
  SELECT page_id, kind, CASE WHEN kind IN ('prior', 'deprecated') THEN '' ELSE word END AS word, CASE WHEN kind IN ('prior', 'deprecated') THEN CAST(count(*) AS VARCHAR) ELSE min(note) END AS note
  FROM all_notes WHERE kind <> 'known' GROUP BY page_id, kind, 3
)"""


@add("token_resolve", f"WITH {_resolve_sql('SELECT doc_id AS page_id, text FROM documents WHERE text IS NOT NULL')} SELECT * FROM resolved")
def token_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return page_words.resolve_pages(docs, "page_id", "text", vocabulary(spark, sf_dir))


@add(
    "page_report",
    """SELECT * REPLACE (CAST(page_id AS BIGINT) AS page_id) FROM (VALUES (-1, 'Trial Use', 3, 'Trial Use', 'vocab', '.zzpart', 'teh', 'one.png'), (-2, 'Draft', 0, 'Draft', 'orders', 'zzword/the', NULL, 'three.png'), (-3, 'Normative', NULL, NULL, NULL, 'zzend', NULL, 'same.png'), (-5, 'Informative', NULL, NULL, NULL, NULL, NULL, NULL)) t(page_id, status, maturity, ballot, work_group, odd_words, typos, image_sources)""",
)
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their status, what looks like a slip in their text (here the words in zz), their typos and their images with faults, each sorted."""
    pages = _pages(spark, sf_dir)
    parts = _parts(spark, sf_dir)
    with_status = pages.join(html_pages.page_status(parts).select("page_id"), "page_id", "left_semi")
    words = page_words.resolve_pages(with_status.select("page_id", html_pages.page_text(F.col("html")).alias("visible")), "page_id", "visible", vocabulary(spark, sf_dir))
    listed = lambda cond, name: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("word")))), "; "), F.lit("")).alias(name)
    per_words = words.groupBy("page_id").agg(listed((F.col("kind") == "unknown") & F.col("word").contains("zz"), "odd_words"), listed(F.col("kind") == "typo", "typos"))
    per_images = html_pages.page_images(parts).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("image_sources"))
    return html_pages.page_status(parts).join(per_words, "page_id", "left").join(per_images, "page_id", "left")


# --- metadata -------------------------------------------------------------
@add(
    "binding_escape_codes",
    """SELECT o_orderkey, coalesce(has_other, false) AS has_other, coalesce(has_unknown, false) AS has_unknown,
    CASE WHEN o_orderstatus <> 'P' THEN '' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'optional - ' ELSE 'required - ' END || CASE WHEN has_other AND has_unknown THEN 'has other and unknown' WHEN has_other THEN 'has other' WHEN has_unknown THEN 'has unknown' ELSE 'neither other nor unknown' END END AS label
    FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(code = 'AF') AS has_other, bool_or(code IN ('NO', 'RF')) AS has_unknown FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS code FROM lineitem) WHERE code IN ('AF', 'NO', 'RF') GROUP BY l_orderkey) c ON c.l_orderkey = o_orderkey""",
)
def binding_escape_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("vs"), F.when(F.col("o_orderstatus") == "P", "Required").otherwise("example").alias("strength"), F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).alias("least"))
    concepts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("vs"), F.concat("l_returnflag", "l_linestatus").alias("code"))
    found = metadata.binding_escapes(elements, concepts, "vs", "code", ["AF"], ["NO", "RF"])
    label = metadata.binding_label(F.col("strength"), F.lit(True), F.col("least"), F.col("has_other"), F.col("has_unknown"))
    return found.select("o_orderkey", "has_other", "has_unknown", label.alias("label"))


@add(
    "codesystem_reuse",
    """WITH named AS (SELECT DISTINCT p_partkey, unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[-1] || '|1']) AS system FROM part),
    bases AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS base FROM part),
    uses AS (SELECT DISTINCT p_partkey, base FROM named JOIN bases ON system = base OR system = base || '|1'),
    bound AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'),
    flagged AS (SELECT p_partkey, base, l_partkey IS NOT NULL AS b FROM uses LEFT JOIN bound ON l_partkey = p_partkey)
    SELECT p_partkey, bool_or(n > 1) AS has_sibling, bool_or(n_bound > CAST(b AS INTEGER)) AS sibling_bound FROM flagged JOIN (SELECT base, count(*) AS n, count_if(b) AS n_bound FROM flagged GROUP BY base) USING (base) GROUP BY p_partkey""",
)
def codesystem_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    sets = part.select("p_partkey", F.concat(words[0], F.lit(", "), F.element_at(words, -1), F.lit("|1")).alias("listed"))
    systems = part.select(F.explode(words).alias("url"), F.lit("1").alias("version")).distinct()
    bound = table(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return metadata.shared_systems(sets, systems, bound, "p_partkey", "listed", "url", "version")


@add(
    "element_flags",
    """SELECT DISTINCT param_key, param_version LIKE '4%' AS is_required, coalesce(status_name = 'draft', false) AS is_trial_use, param_expression IS NOT NULL AS has_fixed, reference_targets IS NOT NULL AS has_pattern,
    CASE WHEN status_name = 'active' AND NOT starts_with(lower(unversioned_url), 'http://spec.example.org/searchparameter/p') THEN unversioned_url END AS external_binding,
    NOT param_version LIKE '4%' AND work_group IS NULL AND contains(param_code, 'code') AS wants_missing_meaning,
    CASE WHEN search_type = 'token' AND coalesce(work_group, '') = '' THEN 'no reason' WHEN search_type = 'token' THEN 'X' ELSE '' END AS modifier_note FROM search_parameters""",
)
def element_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = table(spark, sf_dir, "search_parameters")
    elements = sp.select(
        "param_key",
        F.when(F.col("param_version").startswith("4"), 1).otherwise(0).alias("min_cardinality"),
        F.when(F.col("status_name") == "draft", "Trial-Use").alias("standard_status"),
        F.col("param_expression").alias("fixed_value"),
        F.col("reference_targets").alias("pattern_value"),
        F.when(F.col("status_name") == "active", "Required").alias("binding_strength"),
        F.col("unversioned_url").alias("binding_value_set"),
        F.col("work_group").alias("meaning_when_missing"),
        F.col("param_code").alias("type_literal"),
        F.coalesce(F.col("search_type") == "token", F.lit(False)).alias("is_modifier"),
        F.col("work_group").alias("modifier_reason"),
    )
    flags = metadata.element_flags(elements, "http://spec.example.org/searchparameter/p")
    return flags.select("param_key", "is_required", "is_trial_use", "has_fixed", "has_pattern", "external_binding", "wants_missing_meaning", "modifier_note").distinct()


_TRACKS = {"n": "CoreAsNormative", "ar": "MoveToGuide"}


@add(
    "disposition",
    """SELECT a.id, a.artifact_name, CASE WHEN u AND t = 'n' THEN 'CoreAsNormative' WHEN u AND t = 'ar' THEN 'MoveToGuide' WHEN u THEN 'Unknown' ELSE 'Remove' END AS disposition,
    CASE WHEN u AND t IN ('n', 'ar') THEN coalesce(trim(v), '') <> '' END AS voted, CASE WHEN u AND t IN ('n', 'ar') THEN target END AS relocated_to
    FROM (SELECT *, maturity IS NULL OR maturity < 3 AS u FROM artifacts) a
    LEFT JOIN (SELECT (SELECT artifact_name FROM artifacts x WHERE x.id = spec_pages.id) AS artifact_name, CASE WHEN maturity > 2 THEN 'n' WHEN maturity > 0 THEN 'ar' END AS t, work_group AS v, page_file_name AS target FROM spec_pages) s ON s.artifact_name = a.artifact_name""",
)
def disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = table(spark, sf_dir, "artifacts").select("id", "artifact_name", F.when(F.col("maturity").isNull() | (F.col("maturity") < 3), "Unknown").otherwise("Remove").alias("disposition"))
    names = table(spark, sf_dir, "artifacts").select("id", "artifact_name")
    sheet = table(spark, sf_dir, "spec_pages").select("id", F.when(F.col("maturity") > 2, "N").when(F.col("maturity") > 0, "AR").alias("track"), F.col("work_group").alias("voted_by"), F.col("page_file_name").alias("target")).join(names, "id").drop("id")
    return metadata.dispositions(artifacts, sheet, "artifact_name", "disposition", "track", "voted_by", "target", _TRACKS)


@add("checklist", "SELECT id, array_to_string(list_filter([CASE WHEN work_group IS NULL THEN 'name a work group' END, CASE WHEN maturity IS NULL OR maturity = 0 THEN 'set the maturity' END, CASE WHEN contains(artifact_name, ' ') THEN 'check the name' END], lambda x: x IS NOT NULL), '; ') AS tasks FROM artifacts")
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("work_group").isNull(), "name a work group"), (F.coalesce("maturity", F.lit(0)) == 0, "set the maturity"), (F.contains("artifact_name", F.lit(" ")), "check the name")]
    return table(spark, sf_dir, "artifacts").select("id", F.array_join(metadata.checklist(rules), "; ").alias("tasks"))


@add("group_report", "SELECT work_group, count(*) AS n, array_to_string(list_sort(list(e)), '; ') AS entries FROM (SELECT work_group, 'page: ' || page_title AS e FROM spec_pages UNION ALL SELECT work_group, artifact_type || ': ' || artifact_name FROM artifacts) GROUP BY work_group")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "spec_pages").select("work_group", F.lit("page").alias("kind"), F.col("page_title").alias("title"))
    artifacts = table(spark, sf_dir, "artifacts").select("work_group", F.col("artifact_type").alias("kind"), F.col("artifact_name").alias("title"))
    return metadata.group_report(pages.unionByName(artifacts), "work_group", "kind", "title")


@add(
    "structure_report",
    """SELECT artifact_name, part, CAST(row_number() OVER (PARTITION BY artifact_name, part ORDER BY o, shown) AS INTEGER) AS place, shown FROM (
    SELECT DISTINCT split_part(param_expression, '.', 1) AS artifact_name, 'search' AS part, param_key AS o, param_code || ' (' || coalesce(search_type, '?') || ')' AS shown FROM search_parameters
    UNION ALL SELECT DISTINCT trim(t), 'target', param_key, param_code FROM (SELECT param_key, param_code, unnest(string_split(reference_targets, ',')) AS t FROM search_parameters)
    ) WHERE artifact_name IN (SELECT artifact_name FROM artifacts)""",
)
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each artifact: its search parameters, and those that point to it, in key order."""
    sp = table(spark, sf_dir, "search_parameters")
    own = sp.select(F.split_part("param_expression", F.lit("."), F.lit(1)).alias("a"), "param_key", F.concat("param_code", F.lit(" ("), F.coalesce("search_type", F.lit("?")), F.lit(")")).alias("t")).distinct()
    target = sp.select(F.explode(T.csv_list(F.col("reference_targets"))).alias("a"), "param_key", F.col("param_code").alias("t")).distinct()
    names = table(spark, sf_dir, "artifacts").select("artifact_name").distinct()
    return metadata.structure_report(names, [(n, f, "a", F.col("param_key"), F.col("t")) for n, f in (("search", own), ("target", target))], "artifact_name")


# --- prompts --------------------------------------------------------------
_SAID = f"(SELECT issue_id, string_agg(body, chr(10) || chr(10) ORDER BY coalesce(created_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), id) AS said FROM {COMMENTS_SQL} WHERE trim(body, ' ') <> '' GROUP BY issue_id)"


@add(
    "prompt_build",
    f"""SELECT id, 'issue' AS kind, 'Summarise this request in two or three sentences for the group that decides on it.' || chr(10) || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(description, '') AS prompt FROM {ISSUES_SQL}
    UNION ALL SELECT issue_id, 'comments', 'Summarise what these comments say in two or three sentences.' || chr(10) || chr(10) || said FROM {_SAID} WHERE issue_id IN (SELECT id FROM issues)
    UNION ALL SELECT id, 'resolution', 'Summarise this decision in one or two sentences.' || chr(10) || chr(10) || 'Decision: ' || coalesce(resolution_name, '') || chr(10) || chr(10) || resolution_description FROM {ISSUES_SQL} WHERE trim(resolution_description, ' ') <> ''""",
)
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.prompts(tables.issues(spark, sf_dir, "issue_key", "title", "description", "resolution_name", "resolution_description"), tables.comments(spark, sf_dir))


#: A sheet of groups as it would be read from a file: code, title, address, successor.
GROUPS = (
    ("orders", "Orders and Observations", "http://groups.example.org/orders", None),
    ("pharmacy", "Pharmacy", "http://groups.example.org/pharmacy", None),
    ("finance", "Finance", "http://groups.example.org/finance", None),
    ("devices", "Devices", None, "orders"),
    ("workflow", "Workflow", None, "conformance"),
)
_GROUP_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in g) + ")" for g in GROUPS)


@add(
    "group_lookup",
    f"""WITH g(code, title, official_url, replaced_by) AS (VALUES {_GROUP_ROWS}), named AS (SELECT i.id, i.work_group, coalesce(g.replaced_by, g.code, 'none') AS code FROM {ISSUES_SQL} i LEFT JOIN g ON g.code = lower(trim(i.work_group, ' ')))
    SELECT n.id, n.work_group, n.code, g.title, g.official_url FROM named n LEFT JOIN g ON g.code = n.code""",
)
def group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue with its group's code, title and address; a replaced code means its successor."""
    sheet = F.explode(F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(g, ("code", "title", "official_url", "replaced_by"), strict=True)]) for g in GROUPS])).alias("g")
    return metadata.with_group(tables.issues(spark, sf_dir, "work_group").select("id", "work_group"), F.col("work_group"), spark.range(1).select(sheet).select("g.*"), "none")


@add(
    "artifact_pages",
    """SELECT a.id, a.artifact_name, s.n IS NOT NULL AS has_structure, i.page_file_name AS intro_page, o.page_file_name AS notes_page FROM artifacts a
    LEFT JOIN (SELECT DISTINCT split_part(param_expression, '.', 1) AS n FROM search_parameters) s ON s.n = a.artifact_name
    LEFT JOIN (SELECT DISTINCT page_file_name FROM spec_pages) i ON i.page_file_name = a.fhir_id || '.html' LEFT JOIN (SELECT DISTINCT page_file_name FROM spec_pages) o ON o.page_file_name = lower(a.artifact_type) || 's.html'""",
)
def artifact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with whether a structure of theirs exists, and their introduction and notes page where there is one."""
    structures = table(spark, sf_dir, "search_parameters").select(F.split_part("param_expression", F.lit("."), F.lit(1)).alias("artifact_name"))
    found = metadata.artifact_pages(table(spark, sf_dir, "artifacts"), structures, table(spark, sf_dir, "spec_pages"), "artifact_name", F.concat("fhir_id", F.lit(".html")), F.concat(F.lower("artifact_type"), F.lit("s.html")))
    return found.select("id", "artifact_name", "has_structure", "intro_page", "notes_page")


PROMPTS_SQL = registry.sql["prompt_build"]


@add("summaries", f"SELECT id, kind, split_part(trim(regexp_replace(prompt, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' '), '. ', 1) AS summary, CAST(NULL AS VARCHAR) AS failed FROM ({PROMPTS_SQL})")
def offline_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in summary of every prompt: its first sentence."""
    return summaries.summarise(prompt_build(spark, sf_dir))


# --- report pages ---------------------------------------------------------
def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_REPORT_SQL = f"""
  SELECT grp AS "group", coalesce(nullif(trim(regexp_replace(lower(grp), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), ''), 'none') || '.html' AS file_name,
    '<h1>' || {_escaped("grp")} || '</h1><ul>' || string_agg('<li>' || {_escaped("kind")} || ': ' || {_escaped("title")} || '</li>', '' ORDER BY '<li>' || {_escaped("kind")} || ': ' || {_escaped("title")} || '</li>') || '</ul>' AS html
  FROM (SELECT coalesce(work_group, 'No group') AS grp, 'page' AS kind, page_title AS title FROM spec_pages UNION ALL SELECT coalesce(work_group, 'No group'), artifact_type, artifact_name FROM artifacts) GROUP BY grp"""


@add("report_pages", _REPORT_SQL)
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML page per work group with its pages and artifacts."""
    pages = table(spark, sf_dir, "spec_pages").select("work_group", F.lit("page").alias("kind"), F.col("page_title").alias("title"))
    artifacts = table(spark, sf_dir, "artifacts").select("work_group", F.col("artifact_type").alias("kind"), F.col("artifact_name").alias("title"))
    return reports.group_pages(pages.unionByName(artifacts), "work_group", "kind", "title")


@add("report_index", f"""SELECT 'index.html' AS file_name, '<ul>' || string_agg('<li><a href="' || file_name || '">' || {_escaped('"group"')} || '</a></li>', '' ORDER BY "group") || '</ul>' AS html FROM ({_REPORT_SQL})""")
def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that links them."""
    return reports.index_page(report_pages(spark, sf_dir))


@add("expected_paths", "SELECT id, 'source/' || CASE artifact_type WHEN 'Resource' THEN lower(artifact_name) || '/structuredefinition-' WHEN 'Profile' THEN 'profiles/' WHEN 'Extension' THEN 'extensions/' ELSE '' END || lower(artifact_name) || '.xml' AS path FROM artifacts")
def expected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the source of each artifact is expected."""
    return table(spark, sf_dir, "artifacts").select("id", T.expected_path(F.col("artifact_type"), F.col("artifact_name")).alias("path"))
