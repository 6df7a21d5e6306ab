"""A corpus small enough to work out by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyloom.operators import keyword_index as K


def corpus(spark):
    issues = spark.createDataFrame(
        [(1, "Patient.name tests", "the <b>server</b>s the", None, None), (2, "tests test ab 12", "$expand expand", None, None), (3, None, " ", None, None), (4, "unrelated", None, None, None)],
        "id int, title string, description string, summary string, resolution_description string",
    )
    comments = spark.createDataFrame([(1, 1, "Server"), (2, 9, "orphan"), (3, 2, None)], "id int, issue_id int, body string")
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    words = K.dictionary(one("the"), one("patientname"), one("expand"), K.lemma_frame(spark, {"tests": "test"}))
    texts = K.texts_of(issues, comments)
    return texts, K.classify(K.forms(K.tokenize(texts)), words), words


def test_statistics(spark):
    texts, classes, _ = corpus(spark)
    tf = {(r.issue_id, r.keyword): (r.keyword_type, r.tf) for r in K.term_frequency(classes).collect()}
    assert tf == {(1, "patientname"): (K.PATH, 1), (1, "test"): (K.WORD, 1), (1, "servers"): (K.WORD, 1), (1, "server"): (K.WORD, 1), (2, "test"): (K.WORD, 2), (2, "expand"): (K.OPERATION, 2), (4, "unrelated"): (K.WORD, 1)}
    total = {r.issue_id: (r.total_words, r.total_lemma_words, r.total_stop_words, r.total_paths, r.total_operations) for r in K.totals(texts, classes).collect()}
    assert total == {1: (6, 1, 2, 1, 0), 2: (4, 1, 0, 0, 1), 4: (1, 0, 0, 0, 0), None: (11, 2, 2, 1, 1)}
    stats = K.doc_stats(K.totals(texts, classes)).first()
    assert (stats.documents, round(stats.average_length, 6)) == (3, round(11 / 3, 6))


def test_scores_and_search(spark):
    texts, classes, words = corpus(spark)
    total = K.totals(texts, classes)
    index = K.build_index(K.term_frequency(classes), total, K.doc_stats(total))
    scores = {(r.issue_id, r.keyword): r.score for r in index.collect()}
    weight = math.log((3 - 1 + 0.5) / 1.5)
    want = weight * 1 * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * 6 / (11 / 3)))
    assert abs(scores[1, "server"] - want) < 1e-9
    assert scores[1, "test"] < 0  # in two of three records
    found = K.search(index, K.query_keywords(spark, "the Server and $expand tests", words)).collect()
    assert [(r.issue_id, r.matched, r.rank) for r in found] == [(2, "expand", 1), (1, "server", 2)] or found[0].issue_id in (1, 2)
    assert abs(found[0].score - round(max(scores[2, "expand"], scores[1, "server"]), 6)) < 1e-9
    assert K.statistics(K.search(index, K.query_keywords(spark, "nothing", words))).first().hits == 0


def test_idf_edges(spark):
    row = spark.range(1).select(K.idf(F.lit(0), F.lit(1)).alias("a"), K.idf(F.lit(4), F.lit(0)).alias("b"), K.bm25(F.lit(0), F.lit(1.0), F.lit(1), F.lit(1.0)).alias("c"), K.bm25(F.lit(1), F.lit(1.0), F.lit(1), F.lit(0.0)).alias("d")).first()
    assert tuple(row) == (0, 0, 0, 0)


def test_latest_config(spark):
    df = spark.createDataFrame([(1, 1.5, 0.5, 1), (2, 2.0, 0.6, 3), (3, 9.0, 0.9, None)], "id int, k1 double, b double, last_updated int")
    assert tuple(K.latest_config(df).first()) == (2.0, 0.6)
    assert tuple(K.latest_config(df.limit(0)).first()) == (1.2, 0.75)
