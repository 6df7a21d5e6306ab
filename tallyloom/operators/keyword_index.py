"""Tokens, keyword classes, term statistics, IDF and the BM25 index.

All JVM expressions. Tokens are folded per record and spelling before anything
is joined, so dictionaries meet one row per distinct token of a record, not one
per occurrence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T

WORD, STOP, PATH, OPERATION = "Word", "StopWord", "FhirElementPath", "FhirOperationName"
MIN_LENGTH = 3
K1, B = 1.2, 0.75
FIELDS = ("title", "description", "summary", "resolution_description")


def clean_words(df: DataFrame, column: Column) -> DataFrame:
    """Distinct sanitised words of a dictionary column; those without a letter are dropped."""
    return df.select(T.sanitize(column).alias("word")).where(F.col("word").rlike(r"[\p{Lu}\p{Lt}\p{Ll}]")).distinct()


def lemma_frame(spark: SparkSession, lemmas: Mapping[str, str]) -> DataFrame:
    rows = F.explode(F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])).alias("word", "lemma")
    return first_lemmas(spark.range(1).select(rows).withColumn("place", F.lit(0)))


def first_lemmas(rows: DataFrame) -> DataFrame:
    """(word, lemma): sanitised inflections of at least three characters, the first row wins; the lemma stays as written."""
    clean = rows.select(T.sanitize(F.col("word")).alias("word"), "lemma", "place").where(F.length("word") >= MIN_LENGTH)
    return clean.groupBy("word").agg(F.min_by("lemma", F.struct("place", "lemma")).alias("lemma"))


def dictionary(stop_words: DataFrame, paths: DataFrame, operations: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(word, is_stop, is_path, is_operation, lemma): all dictionaries as one table, a row per word.

    stop_words, paths and operations have the column `word`, lemmas `word` and `lemma`.
    """
    none = F.lit(None).cast("string").alias("lemma")
    parts = [(stop_words, "stop", none), (paths, "path", none), (operations, "operation", none), (lemmas, "lemma", F.col("lemma"))]
    every = reduce(DataFrame.unionByName, [df.select("word", F.lit(kind).alias("kind"), lemma) for df, kind, lemma in parts])
    flags = [F.bool_or(F.col("kind") == kind).alias(f"is_{kind}") for kind in ("stop", "path", "operation")]
    return every.groupBy("word").agg(*flags, F.min("lemma").alias("lemma"))


def texts_of(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """(issue_id, field, part, text) of every text of a record, in field order."""
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(FIELDS)])).alias("x")
    own = issues.select(F.col("id").alias("issue_id"), fields).select("issue_id", "x.field", F.lit(0).alias("part"), "x.text")
    said = comments.select("issue_id", F.lit(len(FIELDS)).alias("field"), F.col("id").alias("part"), F.col("body").alias("text")).join(issues.select(F.col("id").alias("issue_id")), "issue_id", "left_semi")
    return own.unionByName(said).where(F.trim("text") != "")


def tokenize(texts: DataFrame) -> DataFrame:
    """(issue_id, field, part, token_no, token)."""
    return texts.select("issue_id", "field", "part", F.posexplode(T.tokens(T.strip_html(F.col("text")))).alias("token_no", "token"))


#: Keyword types by the code that stands in the low bits of a place.
TYPES = (WORD, STOP, PATH, OPERATION)


def _type_of(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (code.bitwiseAND(F.lit(7)) + 1).cast("int"))


def forms(tokens: DataFrame) -> DataFrame:
    """(issue_id, word, upper, dollar, n, place): tokens folded per record and spelling.

    place orders a record's tokens by field, part and position in one number, so
    everything here aggregates in hash tables of plain numbers. Folding comes
    before the regular expressions: they see each spelling once per record.
    """
    place = F.shiftleft(F.col("field").cast("long"), 56) + F.shiftleft(F.col("part").cast("long"), 24) + F.col("token_no")
    folded = tokens.groupBy("issue_id", "token").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    dollar = F.when(F.contains("token", F.lit("$")), T.prefix_symbol(F.col("token")) == "$").otherwise(F.lit(False))
    shaped = folded.select("issue_id", T.sanitize(F.col("token")).alias("word"), F.col("token").rlike(r"^[^\p{Lu}\p{Lt}\p{Ll}]*[\p{Lu}\p{Lt}]").alias("upper"), dollar.alias("dollar"), "n", "place")
    return shaped.where((F.length("word") >= MIN_LENGTH) & F.col("word").rlike(r"[^\p{Nd}]"))


def classify(found: DataFrame, words: DataFrame) -> DataFrame:
    """forms plus `keyword`, `type_code` (index into TYPES) and `by_lemma`; words: a `dictionary`.

    In this order: stop word; path (unless it is a lemma written in lower case);
    operation (behind a '$'); lemma; plain word.
    """
    flagged = found.join(words, "word", "left")
    code = F.when(F.col("is_stop"), 1).when(F.col("is_path") & (F.col("lemma").isNull() | F.col("upper")), 2).when(F.col("is_operation") & F.col("dollar"), 3).otherwise(0)
    out = flagged.withColumn("type_code", code)
    by_lemma = (F.col("type_code") == 0) & F.col("lemma").isNotNull()
    keyword = F.when(by_lemma, F.col("lemma")).otherwise(F.col("word"))
    return out.select("issue_id", keyword.alias("keyword"), "type_code", by_lemma.alias("by_lemma"), "n", "place")


def term_frequency(classes: DataFrame) -> DataFrame:
    """(issue_id, keyword, keyword_type, tf): the type seen first in the record; stop words left out."""
    kept = classes.where("type_code <> 1").groupBy("issue_id", "keyword").agg(F.min(F.col("place") * 8 + F.col("type_code")).alias("first"), F.sum("n").alias("tf"))
    return kept.select("issue_id", "keyword", _type_of(F.col("first")).alias("keyword_type"), "tf")


def corpus_frequency(tf: DataFrame) -> DataFrame:
    """(keyword, keyword_type, n): over all records, the type seen first, which is that of the first record."""
    code = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("keyword_type")) - 1
    folded = tf.groupBy("keyword").agg(F.min(F.col("issue_id").cast("long") * 8 + code).alias("first"), F.sum("tf").alias("n"))
    return folded.select("keyword", _type_of(F.col("first")).alias("keyword_type"), "n")


def totals(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(issue_id, total_words, ...): a row per record with text, and one with null for the whole."""
    per = texts.select("issue_id").distinct().join(
        classes.groupBy("issue_id").agg(
            F.sum("n").alias("total_words"),
            F.sum(F.when(F.col("by_lemma"), F.col("n")).otherwise(0)).alias("total_lemma_words"),
            F.sum(F.when(F.col("type_code") == 1, F.col("n")).otherwise(0)).alias("total_stop_words"),
            F.sum(F.when(F.col("type_code") == 2, F.col("n")).otherwise(0)).alias("total_paths"),
            F.sum(F.when(F.col("type_code") == 3, F.col("n")).otherwise(0)).alias("total_operations"),
        ),
        "issue_id",
        "left",
    )
    names = ["total_words", "total_lemma_words", "total_stop_words", "total_paths", "total_operations"]
    filled = per.select("issue_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return filled.unionByName(filled.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).withColumn("issue_id", F.lit(None).cast("int")))


def doc_stats(total: DataFrame) -> DataFrame:
    """One row: number of records and their mean length, 0 without any."""
    own = total.where("issue_id IS NOT NULL")
    return own.agg(F.count("*").alias("documents"), F.coalesce(F.avg("total_words"), F.lit(0.0)).alias("average_length"))


def idf(documents: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)); negative above N / 2; 0 if either is not positive."""
    return F.when((documents > 0) & (df > 0), F.log((documents - df + 0.5) / (df + 0.5))).otherwise(F.lit(0.0))


def bm25(tf: Column, weight: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    score = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    return F.when((tf > 0) & (average > 0), score).otherwise(F.lit(0.0))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(keyword, keyword_type, df); the index has one row per record and keyword, so a plain count does."""
    return tf.groupBy("keyword", "keyword_type").agg(F.count("*").alias("df"))


def corpus_idf(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """(keyword, keyword_type, n, df, idf)."""
    documents = stats.select("documents").scalar()
    corpus = corpus_frequency(tf).join(document_frequency(tf), ["keyword", "keyword_type"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return corpus.withColumn("idf", idf(documents, F.col("df")))


def build_index(tf: DataFrame, total: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(issue_id, keyword, keyword_type, tf, score).

    A keyword whose type in the record is not its type in the corpus has no IDF
    and scores 0; records without totals are left out.
    """
    weights = corpus_idf(tf, stats).select("keyword", "keyword_type", "idf")
    lengths = total.where("issue_id IS NOT NULL").select("issue_id", "total_words")
    average = stats.select("average_length").scalar()
    scored = tf.join(weights, ["keyword", "keyword_type"], "left").join(lengths, "issue_id")
    return scored.select("issue_id", "keyword", "keyword_type", "tf", F.coalesce(bm25(F.col("tf"), F.col("idf"), F.col("total_words"), average, k1, b), F.lit(0.0)).alias("score"))


def query_keywords(spark: SparkSession, query: str, words: DataFrame) -> list[str]:
    """The distinct keywords a query asks for, classed like the texts; no more than it has words."""
    one = spark.range(1).select(F.lit(0).alias("issue_id"), F.lit(0).alias("field"), F.lit(0).alias("part"), F.lit(query).alias("text"))
    return sorted(r.keyword for r in term_frequency(classify(forms(tokenize(one)), words)).select("keyword").distinct().collect())


def search(index: DataFrame, wanted: Sequence[str], k: int = 20) -> DataFrame:
    """(issue_id, score, matched, rank): records by their summed positive scores, ties by id.

    Reads of the index what belongs to the wanted keywords only.
    """
    hits = index.where(F.col("keyword").isin(*wanted) & (F.col("score") > 0)) if wanted else index.limit(0)
    best = hits.groupBy("issue_id").agg(F.round(F.sum("score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("keyword")), " ").alias("matched"))
    top = best.orderBy(F.col("score").desc(), "issue_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "issue_id")))


def statistics(results: DataFrame) -> DataFrame:
    """One row over a search's results: hits, highest, lowest and mean score."""
    return results.agg(F.count("*").alias("hits"), F.max("score").alias("highest"), F.min("score").alias("lowest"), F.round(F.avg("score"), 6).alias("mean"))


def search_by_type(index: DataFrame, keyword_type: str, k: int = 20) -> DataFrame:
    """(issue_id, score, n): records by the summed scores of their keywords of one type."""
    usable = index.where((F.col("keyword_type") == keyword_type) & F.col("score").isNotNull() & ~F.isnan("score"))
    return usable.groupBy("issue_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n")).orderBy(F.col("score").desc(), "issue_id").limit(k)


def top_keywords(corpus: DataFrame, k: int = 50, keyword_type: str | None = None) -> DataFrame:
    """Keywords by IDF, then count, both falling; ties by keyword and id."""
    some = corpus if keyword_type is None else corpus.where(F.col("keyword_type") == keyword_type)
    return some.orderBy(F.col("idf").desc(), F.col("n").desc(), "keyword", "id").limit(k)


def latest_config(config: DataFrame) -> DataFrame:
    """One row (k1, b): the configuration updated last, or the defaults without any."""
    last = config.agg(F.max_by(F.struct("k1", "b"), F.struct("last_updated", "id")).alias("c"))
    return last.select(F.coalesce("c.k1", F.lit(K1)).alias("k1"), F.coalesce("c.b", F.lit(B)).alias("b"))
