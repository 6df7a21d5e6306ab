"""Queries of the training-data operators over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.normal import plain_form
from tallyloom.llm.contamination import find_leaks
from tallyloom.llm.packing import CAPACITY, count_tokens, pack, ship_vocabulary
from tallyloom.llm.personal_data import Directory, detect, directory, mask, pseudonymise, replace_spans
from tallyloom.llm.reading_level import reading_bands, reading_levels
from tallyloom.llm.term_frequency import mark, term_counts
from tallyloom.llm.top_items import top_items
from tallyloom.plans.registry import Registry
from tallyloom.session import table

registry = Registry()

RARE_BELOW, COMMON_ABOVE = 3, 0.2
TOP_N = 5
#: Ranks of a public byte-level BPE vocabulary; the session may name another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

PLAIN_SQL = r"lower(regexp_replace(nfc_normalize(regexp_replace(keyword, '[^\p{L}\p{Nd}\p{M}]', '', 'g')), '[^\p{L}\p{Nd}]', '', 'g'))"
TERMS_SQL = f"""
WITH rows AS (
  SELECT DISTINCT 'i' AS src, id, issue_id, keyword, keyword_count, keyword_type FROM issue_keywords
  UNION ALL
  SELECT DISTINCT 'c' AS src, id, NULL AS issue_id, keyword, 0 AS keyword_count, keyword_type FROM corpus_keywords
), terms AS (
  SELECT {PLAIN_SQL} AS keyword, keyword_type, issue_id, keyword_count FROM rows
), counts AS (
  SELECT keyword, keyword_type, CAST(coalesce(sum(keyword_count), 0) AS BIGINT) AS occurrences, count(DISTINCT issue_id) AS records
  FROM terms WHERE keyword <> '' AND regexp_matches(keyword, '\\p{{L}}') GROUP BY keyword, keyword_type
)
SELECT keyword, keyword_type, occurrences, records,
  CASE WHEN records < {RARE_BELOW} THEN 'rare' WHEN records > {COMMON_ABOVE} * (SELECT count(DISTINCT issue_id) FROM issue_keywords) THEN 'common' ELSE 'useful' END AS freq_mark
FROM counts
"""


@registry.add("p1_terms", TERMS_SQL)
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term and type with its occurrences, records and mark."""
    index = table(spark, sf_dir, "issue_keywords").select(F.lit("i").alias("src"), "id", "issue_id", "keyword", "keyword_count", "keyword_type")
    corpus = table(spark, sf_dir, "corpus_keywords").select(F.lit("c").alias("src"), "id", F.lit(None).cast("int").alias("issue_id"), "keyword", F.lit(0).alias("keyword_count"), "keyword_type")
    tokens = index.unionByName(corpus).withColumn("term", plain_form(F.col("keyword"))).where(F.col("term").rlike(r"\p{L}"))
    # what makes a row, in 12 bytes: its id, and a hash of the rest of it
    row = [F.col("id"), F.xxhash64("src", "keyword", "keyword_count")]
    counts = term_counts(tokens, [F.col("term"), F.col("keyword_type")], F.col("issue_id"), F.col("keyword_count"), row)
    records = table(spark, sf_dir, "issue_keywords").agg(F.count_distinct("issue_id").alias("n")).scalar()
    return mark(counts, records, RARE_BELOW, COMMON_ABOVE).select(F.col("t0").alias("keyword"), F.col("t1").alias("keyword_type"), "occurrences", "records", "freq_mark")


@registry.add("p1_found", f"SELECT keyword, keyword_type, freq_mark FROM ({TERMS_SQL}) t WHERE freq_mark <> 'useful'")
def rare_and_common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).where("freq_mark <> 'useful'").select("keyword", "keyword_type", "freq_mark")


@registry.add(
    "p3_found",
    f"""
    SELECT issue_id, id AS keyword_id, CAST(top_no AS INTEGER) AS top_no FROM (
      SELECT issue_id, id, row_number() OVER (PARTITION BY issue_id ORDER BY bm25_score DESC, id) AS top_no
      FROM (SELECT DISTINCT issue_id, id, bm25_score FROM issue_keywords WHERE bm25_score IS NOT NULL AND NOT isnan(bm25_score))
    ) WHERE top_no <= {TOP_N}
    """,
)
def best_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_items(table(spark, sf_dir, "issue_keywords"), F.col("issue_id"), F.col("id"), F.col("bm25_score"), TOP_N)
    return best.select(F.col("group_id").alias("issue_id"), F.col("item_id").alias("keyword_id"), "top_no")


@registry.add("p6_packed")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container, with the piece of it that lies there."""
    vocabulary = ship_vocabulary(spark, spark.conf.get("spark.tallyloom.vocabulary", VOCABULARY))
    sized = table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text"), vocabulary).alias("n_tokens"))
    placed = pack(sized, F.col("doc_id"), F.col("n_tokens"))
    return placed.select(F.col("item_id").alias("doc_id"), "piece_no", "container_id", F.col("start_at").alias("start_token"), F.col("piece_size").alias("n_tokens"))


@registry.add("p6_fill")
def container_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the tokens in them, the share of room unused."""
    per = packed_documents(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    room = F.count("*") * F.lit(CAPACITY)
    return per.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(1 - F.sum("n") / room, 6).alias("unused_share"))


@registry.add("p7_found")
def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


@registry.add("p7_tiles")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they leak, with the tiles that show it."""
    return find_leaks(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), table(spark, sf_dir, "eval_items"), F.col("item_id"), F.col("item_text"))


@registry.add("p7_reordered")
def reordered_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which at least 60 % stands in a document in runs of at least 6 words, in any order."""
    return find_leaks(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), table(spark, sf_dir, "eval_items"), F.col("item_id"), F.col("item_text"), min_match=6, min_coverage=0.6)


@registry.add("p8_found")
def document_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_bands(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


@registry.add("p8_levels")
def document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with prose, with its difficulty and the band the models give it."""
    return reading_levels(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def _free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_id, text) of the free-text fields; repeated rows once."""
    comments = table(spark, sf_dir, "comments").select(F.lit("comments").alias("table_name"), F.col("id").alias("row_id"), F.col("body").alias("text"))
    issues = table(spark, sf_dir, "issues").select(F.lit("issues").alias("table_name"), F.col("id").alias("row_id"), F.col("description").alias("text"))
    return comments.unionByName(issues)


def _people(spark: SparkSession, sf_dir: str) -> Directory:
    return directory(table(spark, sf_dir, "people"), F.col("display_name"))


def _secret(spark: SparkSession) -> bytes:
    """The secret of the surrogates: the session's setting; the test tables, all invented, do with a public one."""
    return spark.conf.get("spark.tallyloom.surrogateSecret", "no secret: test tables").encode()


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(_free_text(spark, sf_dir), F.struct("table_name", "row_id"), F.col("text"), _people(spark, sf_dir), _secret(spark))
    return found.select("row_id.table_name", "row_id.row_id", "start_at", "end_at", "pii_type", "pii_key", "entity_key", "surrogate", "shown")


@registry.add("p5_found")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What detection finds; surrogates are drawn by the queries that show them."""
    found = detect(_free_text(spark, sf_dir), F.struct("table_name", "row_id"), F.col("text"), _people(spark, sf_dir))
    return found.select("row_id.table_name", "row_id.row_id", "pii_type", "pii_key").distinct()


@registry.add("p5_masked")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a typed placeholder in the place of each item, otherwise unchanged."""
    masked = mask(_free_text(spark, sf_dir), F.struct("table_name", "row_id"), F.col("text"), _people(spark, sf_dir))
    return masked.select("row_id.table_name", "row_id.row_id", "masked_text")


@registry.add("p5_surrogates")
def surrogate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct items with the entity each of them means and the replacement that entity gets everywhere."""
    return _findings(spark, sf_dir).select("pii_type", "pii_key", "entity_key", "surrogate").distinct()


@registry.add("p5_replaced")
def texts_with_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold items, each item replaced by its surrogate in the item's own case and format."""
    spans = _findings(spark, sf_dir).groupBy("table_name", "row_id", "start_at", "end_at").agg(F.min("shown").alias("new"))
    per_row = spans.groupBy("table_name", "row_id").agg(F.collect_list(F.struct("start_at", "end_at", "new")).alias("spans"))
    texts = _free_text(spark, sf_dir).groupBy("table_name", "row_id").agg(F.min("text").alias("text"))
    return texts.join(per_row, ["table_name", "row_id"]).select("table_name", "row_id", replace_spans(F.col("text"), F.col("spans")).alias("replaced_text"))
