"""Queries of the keyword index, ranked search and full-text match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import fulltext
from tallyloom.operators import keyword_index as K
from tallyloom.plans import tables
from tallyloom.plans.registry import Registry
from tallyloom.plans.tables import COMMENTS_SQL, ISSUES_SQL, KEYWORDS_SQL
from tallyloom.session import stored, table

registry = Registry()
add = registry.add

#: A small set of inflections of this domain's own prose.
LEMMAS = {"tests": "test", "copies": "copy", "entries": "entry", "authors": "author", "readers": "reader", "replaces": "replace", "asked": "ask", "raised": "raise", "ran": "run", "designers": "designer", "developers": "developer", "vendors": "vendor", "implementers": "implementer", "reviewers": "reviewer", "questions": "question", "errors": "error", "rows": "row"}
QUERY = "restrict the binding of Patient.contact with the $validate operation on stable servers and copies"
FTS_QUERY = '"code system" OR (invariant AND NOT circular) OR redund*'

CASED = r"\p{Lu}\p{Lt}\p{Ll}"
CLEAN = rf"lower(regexp_replace(%s, '[^{CASED}\p{{Nd}}]', '', 'g'))"
_WORDS = lambda source: f"SELECT DISTINCT w AS word FROM (SELECT {CLEAN % 'keyword'} AS w FROM {source}) WHERE regexp_matches(w, '[{CASED}]')"
_LEMMA_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in LEMMAS.items())
BASE_SQL = f"""
iss AS MATERIALIZED (SELECT * FROM {ISSUES_SQL}),
texts AS (
  SELECT * FROM (
    SELECT id AS issue_id, 0 AS field, 0 AS part, title AS text FROM iss UNION ALL SELECT id, 1, 0, description FROM iss
    UNION ALL SELECT id, 2, 0, summary FROM iss UNION ALL SELECT id, 3, 0, resolution_description FROM iss
    UNION ALL SELECT issue_id, 4, id, body FROM {COMMENTS_SQL} WHERE issue_id IN (SELECT id FROM iss)
  ) WHERE trim(text, ' ') <> ''
),
toks AS (
  SELECT issue_id, field, part, unnest(l) AS token, unnest(range(0, len(l))) AS token_no FROM (
    SELECT issue_id, field, part, list_filter(regexp_split_to_array(regexp_replace(text, '<.*?>', '', 'g'), '[ \\t\\r\\n]+'), lambda x: x <> '') AS l FROM texts)
),
stops AS ({_WORDS("issue_keywords WHERE keyword_type = 'StopWord'")}),
paths AS ({_WORDS("corpus_keywords WHERE keyword_type = 'FhirElementPath'")}),
ops AS ({_WORDS("corpus_keywords WHERE keyword_type = 'FhirOperationName'")}),
lemmas(word, lemma) AS (VALUES {_LEMMA_ROWS}),
shaped AS (
  SELECT *, {CLEAN % 'token'} AS word, regexp_extract(token, '[{CASED}]') AS letter,
    regexp_matches(token, '^[^{CASED}\\p{{P}}\\p{{Sm}}\\p{{Sc}}\\p{{So}}]*\\$') AS dollar, printf('%09d %d %09d %09d', issue_id, field, part, token_no) AS place FROM toks
),
classes AS (
  SELECT s.*, CASE WHEN st.word IS NOT NULL THEN 'StopWord' WHEN p.word IS NOT NULL AND (l.word IS NULL OR regexp_matches(letter, '[\\p{{Lu}}\\p{{Lt}}]')) THEN 'FhirElementPath'
      WHEN o.word IS NOT NULL AND dollar THEN 'FhirOperationName' ELSE 'Word' END AS keyword_type, l.lemma
  FROM shaped s LEFT JOIN stops st USING (word) LEFT JOIN paths p USING (word) LEFT JOIN ops o USING (word) LEFT JOIN lemmas l USING (word)
  WHERE letter <> '' AND length(word) >= 3
),
kw AS (SELECT *, CASE WHEN keyword_type = 'Word' AND lemma IS NOT NULL THEN lemma ELSE word END AS keyword FROM classes),
tf AS MATERIALIZED (SELECT issue_id, keyword, arg_min(keyword_type, place) AS keyword_type, count(*) AS tf, min(place) AS place FROM kw WHERE keyword_type <> 'StopWord' GROUP BY issue_id, keyword),
cf AS (SELECT keyword, arg_min(keyword_type, place) AS keyword_type, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY keyword),
dfs AS (SELECT keyword, keyword_type, count(*) AS df FROM tf GROUP BY keyword, keyword_type),
per AS (
  SELECT issue_id, count(word) AS total_words, CAST(count_if(keyword_type = 'Word' AND lemma IS NOT NULL) AS BIGINT) AS total_lemma_words, CAST(count_if(keyword_type = 'StopWord') AS BIGINT) AS total_stop_words,
    CAST(count_if(keyword_type = 'FhirElementPath') AS BIGINT) AS total_paths, CAST(count_if(keyword_type = 'FhirOperationName') AS BIGINT) AS total_operations
  FROM (SELECT DISTINCT issue_id FROM texts) LEFT JOIN classes USING (issue_id) GROUP BY issue_id
),
stats AS (SELECT count(*) AS documents, coalesce(avg(total_words), 0) AS average_length FROM per),
corpus AS (SELECT cf.keyword, cf.keyword_type, n, coalesce(df, 0) AS df, CASE WHEN documents > 0 AND df > 0 THEN ln((documents - df + 0.5) / (df + 0.5)) ELSE 0 END AS idf FROM cf LEFT JOIN dfs USING (keyword, keyword_type), stats)
"""


def _index_sql(k1: float = K.K1, b: float = K.B) -> str:
    return f"""{BASE_SQL}, idx AS (
  SELECT issue_id, tf.keyword, tf.keyword_type, tf, coalesce(CASE WHEN average_length > 0 THEN c.idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * total_words / average_length)) ELSE 0 END, 0) AS score
  FROM tf LEFT JOIN corpus c ON c.keyword = tf.keyword AND c.keyword_type = tf.keyword_type JOIN per USING (issue_id), stats)"""


SOURCES = ("issues", "comments", "issue_keywords", "corpus_keywords")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, index = table(spark, sf_dir, "corpus_keywords"), table(spark, sf_dir, "issue_keywords")
    of = lambda df, kind: K.clean_words(df.where(F.col("keyword_type") == kind), F.col("keyword"))
    return stored(spark, sf_dir, "dictionary", ["issue_keywords", "corpus_keywords"], lambda: K.dictionary(of(index, K.STOP), of(corpus, K.PATH), of(corpus, K.OPERATION), K.lemma_frame(spark, LEMMAS)))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.texts_of(tables.issues(spark, sf_dir, *K.FIELDS), tables.comments(spark, sf_dir))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classed words of all texts: what every statistic and the index are made of. Written once."""
    return stored(spark, sf_dir, "classes", SOURCES, lambda: K.classify(K.forms(K.tokenize(texts(spark, sf_dir))), dictionary(spark, sf_dir)))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "term_frequency", SOURCES, lambda: K.term_frequency(classes(spark, sf_dir)))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "totals", SOURCES, lambda: K.totals(texts(spark, sf_dir), classes(spark, sf_dir)))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword index in the order of its keywords, so a search reads those it wants. Written once."""

    def build() -> DataFrame:
        total = totals(spark, sf_dir)
        return K.build_index(frequencies(spark, sf_dir), total, K.doc_stats(total)).repartitionByRange("keyword", "issue_id").sortWithinPartitions("keyword", "issue_id")

    return stored(spark, sf_dir, "keyword_index", SOURCES, build)


def full_text(spark: SparkSession, sf_dir: str) -> fulltext.FullTextIndex:
    """The full-text index over the issues' texts. Written once."""
    issues = tables.issues(spark, sf_dir, *K.FIELDS)
    sizes = stored(spark, sf_dir, "fts_lengths", ["issues"], lambda: fulltext.lengths(issues, "id", K.FIELDS))
    return fulltext.FullTextIndex(
        stored(spark, sf_dir, "fts_postings", ["issues"], lambda: fulltext.postings(issues, "id", K.FIELDS)),
        sizes,
        stored(spark, sf_dir, "fts_totals", ["issues"], lambda: fulltext.totals(sizes, K.FIELDS)),
        K.FIELDS,
    )


@add("sanitize", f"SELECT DISTINCT id, {CLEAN % 'keyword'} AS clean, regexp_extract(keyword, '[{CASED}]') AS first_letter, regexp_extract(keyword, '^[^{CASED}\\p{{P}}\\p{{Sm}}\\p{{Sc}}\\p{{So}}]*([\\p{{P}}\\p{{Sm}}\\p{{Sc}}\\p{{So}}])', 1) AS prefix_symbol FROM issue_keywords")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("keyword")
    return table(spark, sf_dir, "issue_keywords").select("id", T.sanitize(k).alias("clean"), T.first_letter(k).alias("first_letter"), T.prefix_symbol(k).alias("prefix_symbol")).distinct()


@add("strip_html", f"SELECT id, regexp_replace(description, '<.*?>', '', 'g') AS joined, trim(regexp_replace(description, '<.*?>', '', 'g'), ' ') AS trimmed, regexp_replace(description, '<.*?>', ' ', 'g') AS spaced FROM {ISSUES_SQL}")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("description")
    return tables.issues(spark, sf_dir, "description").select("id", T.strip_html(d).alias("joined"), T.strip_html_trimmed(d).alias("trimmed"), T.strip_html_spaced(d).alias("spaced"))


@add("tokenize", f"WITH {BASE_SQL} SELECT issue_id, field, part, token_no, token FROM toks")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tokenize(texts(spark, sf_dir))


@add("token_classes", f"WITH {BASE_SQL} SELECT issue_id, keyword, keyword_type, count(*) AS n FROM kw GROUP BY issue_id, keyword, keyword_type")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in K.TYPES]), F.col("type_code") + 1)
    return classes(spark, sf_dir).groupBy("issue_id", "keyword", kind.alias("keyword_type")).agg(F.sum("n").alias("n"))


@add("term_frequency", f"WITH {BASE_SQL} SELECT issue_id, keyword, keyword_type, tf FROM tf")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies(spark, sf_dir)


@add("corpus_frequency", f"WITH {BASE_SQL} SELECT keyword, keyword_type, n FROM cf")
def corpus_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.corpus_frequency(frequencies(spark, sf_dir))


@add("document_frequency", f"WITH {BASE_SQL} SELECT keyword, keyword_type, df FROM dfs")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.document_frequency(frequencies(spark, sf_dir))


@add("total_frequencies", f"WITH {BASE_SQL} SELECT * FROM per UNION ALL SELECT NULL, CAST(sum(total_words) AS BIGINT), CAST(sum(total_lemma_words) AS BIGINT), CAST(sum(total_stop_words) AS BIGINT), CAST(sum(total_paths) AS BIGINT), CAST(sum(total_operations) AS BIGINT) FROM per")
def total_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir)


@add("doc_stats", f"WITH {BASE_SQL} SELECT documents, round(average_length, 6) AS average_length FROM stats")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.doc_stats(totals(spark, sf_dir)).select("documents", F.round("average_length", 6).alias("average_length"))


@add("idf", f"WITH {BASE_SQL} SELECT keyword, keyword_type, n, df, round(idf, 6) AS idf FROM corpus")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.corpus_idf(frequencies(spark, sf_dir), K.doc_stats(totals(spark, sf_dir))).select("keyword", "keyword_type", "n", "df", F.round("idf", 6).alias("idf"))


@add("bm25_index", f"WITH {_index_sql()} SELECT issue_id, keyword, keyword_type, tf, round(score, 6) AS score FROM idx")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).withColumn("score", F.round("score", 6))


@add("fix_scores", f"WITH {_index_sql(1.6, 0.5)} SELECT issue_id, keyword, round(score, 6) AS score FROM idx")
def fix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index scored anew with other constants."""
    total = totals(spark, sf_dir)
    return K.build_index(frequencies(spark, sf_dir), total, K.doc_stats(total), 1.6, 0.5).select("issue_id", "keyword", F.round("score", 6).alias("score"))


_FOUND_SQL = f"""WITH {_index_sql()}, wanted AS (
  SELECT DISTINCT CASE WHEN ty = 'Word' AND lemma IS NOT NULL THEN lemma ELSE word END AS keyword FROM (
    SELECT q.word, l.lemma, CASE WHEN st.word IS NOT NULL THEN 'StopWord' WHEN p.word IS NOT NULL AND (l.word IS NULL OR regexp_matches(letter, '[\\p{{Lu}}\\p{{Lt}}]')) THEN 'FhirElementPath'
      WHEN o.word IS NOT NULL AND starts_with(token, '$') THEN 'FhirOperationName' ELSE 'Word' END AS ty
    FROM (SELECT token, {CLEAN % 'token'} AS word, regexp_extract(token, '[{CASED}]') AS letter FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS token)) q
    LEFT JOIN stops st USING (word) LEFT JOIN paths p USING (word) LEFT JOIN ops o USING (word) LEFT JOIN lemmas l USING (word) WHERE length(q.word) >= 3 AND letter <> ''
  ) WHERE ty <> 'StopWord'
), hits AS (
  SELECT issue_id, round(sum(score), 6) AS score, array_to_string(list_sort(list(DISTINCT keyword)), ' ') AS matched FROM idx WHERE score > 0 AND keyword IN (SELECT keyword FROM wanted) GROUP BY issue_id
  ORDER BY 2 DESC, 1 LIMIT 20
)"""


@add("bm25_search", f"{_FOUND_SQL} SELECT issue_id, score, matched, CAST(row_number() OVER (ORDER BY score DESC, issue_id) AS INTEGER) AS rank FROM hits")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search(index(spark, sf_dir), K.query_keywords(spark, QUERY, dictionary(spark, sf_dir)))


@add("search_statistics", f"{_FOUND_SQL} SELECT count(*) AS hits, max(score) AS highest, min(score) AS lowest, round(avg(score), 6) AS mean FROM hits")
def search_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.statistics(bm25_search(spark, sf_dir))


@add("search_status_histogram", f"{_FOUND_SQL} SELECT status_name, count(*) AS n FROM hits JOIN iss ON iss.id = hits.issue_id GROUP BY status_name")
def search_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked ids joined back to their records, and the records' statuses counted."""
    status = tables.issues(spark, sf_dir, "status_name").select(F.col("id").alias("issue_id"), "status_name")
    return bm25_search(spark, sf_dir).join(status, "issue_id").groupBy("status_name").agg(F.count("*").alias("n"))


@add("search_by_keyword_type", f"SELECT issue_id, round(sum(bm25_score), 6) AS score, count(*) AS n FROM {KEYWORDS_SQL} WHERE keyword_type = 'FhirElementPath' AND bm25_score IS NOT NULL AND NOT isnan(bm25_score) GROUP BY issue_id ORDER BY 2 DESC, 1 LIMIT 20")
def search_by_keyword_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search_by_type(tables.keywords(spark, sf_dir).withColumnRenamed("bm25_score", "score"), K.PATH)


_CORPUS_SQL = "(SELECT DISTINCT * FROM corpus_keywords)"


@add("top_keywords", f"SELECT id, keyword, idf FROM {_CORPUS_SQL} WHERE keyword_type = 'Word' ORDER BY idf DESC NULLS LAST, keyword_count DESC NULLS LAST, keyword, id LIMIT 50")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus_keywords").distinct().withColumnRenamed("keyword_count", "n")
    return K.top_keywords(corpus, 50, K.WORD).select("id", "keyword", "idf")


@add("top_keywords_per_doc", f"SELECT issue_id, id, keyword, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY bm25_score DESC, id) AS r FROM {KEYWORDS_SQL} WHERE bm25_score > 0 AND NOT isnan(bm25_score)) WHERE r <= 3")
def top_keywords_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = tables.keywords(spark, sf_dir).where((F.col("bm25_score") > 0) & ~F.isnan("bm25_score"))
    best = Window.partitionBy("issue_id").orderBy(F.col("bm25_score").desc(), "id")
    return usable.withColumn("place", F.row_number().over(best)).where("place <= 3").select("issue_id", "id", "keyword", "place")


# --- full text ------------------------------------------------------------
#: One row per record and field with text, its terms parted by single blanks.
FTS_SQL = f"""
fts AS MATERIALIZED (
  SELECT doc_id, field, l, ' ' || array_to_string(l, ' ') || ' ' AS t FROM (
    SELECT doc_id, field, regexp_extract_all(lower(regexp_replace(text, '<.*?>', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+') AS l FROM (
      {" UNION ALL ".join(f"SELECT id AS doc_id, '{f}' AS field, {f} AS text FROM {ISSUES_SQL}" for f in K.FIELDS)}
    )) WHERE len(l) > 0
),
fts_terms AS (SELECT doc_id, field, unnest(l) AS term FROM fts),
fts_sizes AS (SELECT id AS doc_id, coalesce(n, 0) AS length FROM {ISSUES_SQL} i LEFT JOIN (SELECT doc_id, sum(len(l)) AS n FROM fts GROUP BY doc_id) f ON f.doc_id = i.id),
fts_totals AS (SELECT count(*) AS total, avg(length) AS average FROM fts_sizes)
"""


def ranked_sql(found: str, positive: str) -> str:
    """(doc_id, score) of the records in the table `found`, scored by the terms that fulfil the condition `positive`."""
    return f"""
    SELECT f.doc_id, coalesce(round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * {fulltext.K1 + 1} / (tf + {fulltext.K1} * (1 - {fulltext.B} + {fulltext.B} * length / average))), 6), 0) AS score
    FROM {found} f LEFT JOIN (SELECT doc_id, term, count(*) AS tf FROM fts_terms WHERE {positive} GROUP BY doc_id, term) p USING (doc_id)
    LEFT JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM fts_terms GROUP BY term) d USING (term) LEFT JOIN fts_sizes s ON s.doc_id = f.doc_id, fts_totals GROUP BY f.doc_id"""


_MATCH = "t LIKE '% code system %' OR (t LIKE '% invariant %' AND NOT t LIKE '% circular %') OR t LIKE '% redund%'"


@add("fts_index", f"WITH {FTS_SQL} SELECT field, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS terms, count(DISTINCT doc_id) AS records FROM (SELECT doc_id, field, term, count(*) AS tf FROM fts_terms GROUP BY doc_id, field, term) GROUP BY field")
def fts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text index is built and written; its figures by field."""
    return full_text(spark, sf_dir).postings.groupBy("field").agg(F.count("*").alias("postings"), F.sum("tf").alias("terms"), F.count_distinct("doc_id").alias("records"))


@add("fts_match", f"WITH {FTS_SQL} SELECT DISTINCT doc_id AS id FROM fts WHERE {_MATCH}")
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records a boolean query with phrase, NOT and prefix matches."""
    return fulltext.matches(full_text(spark, sf_dir), fulltext.parse(FTS_QUERY), K.FIELDS).select(F.col("doc_id").alias("id"))


@add(
    "fts_search",
    f"""WITH {FTS_SQL}, found AS (SELECT DISTINCT doc_id FROM fts WHERE {_MATCH})
    SELECT doc_id AS id, i.issue_key, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ({ranked_sql("found", "term IN ('code', 'system', 'invariant') OR starts_with(term, 'redund')")} ORDER BY score DESC, doc_id LIMIT 20) JOIN {ISSUES_SQL} i ON i.id = doc_id""",
)
def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 records of that query, best first."""
    issues = tables.issues(spark, sf_dir, "issue_key")
    return fulltext.search(issues, "id", K.FIELDS, FTS_QUERY, 20, full_text(spark, sf_dir)).select("id", "issue_key", "score", "rank")
