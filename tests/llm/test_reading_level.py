from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import prose
from tallyloom.llm import reading_level as R

EASY = "The cat sat on the mat. We had a red cup. Did he see it? Do not run!"
HARD = "Notwithstanding comprehensive standardization considerations, interoperability specifications establish probabilistic synchronization methodologies whose interpretation remains contingent upon harmonization agreements established by epidemiological registries throughout successive consultation periods. "
MIDDLE = "The group agreed to split the header and to align the internal example at the next working meeting. "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One here. Two there", ["One here.", "Two there"]),
        ("See e.g. Version 4.0.1 of it, i.e. all. Next one.", ["See e.g. Version 4.0.1 of it, i.e. all.", "Next one."]),
        ("Ask Dr. J. Smith at 3 p.m. today. Yes!", ["Ask Dr. J. Smith at 3 p.m. today.", "Yes!"]),
        ("h2. Head line\n\nText one.\nStill two.", ["Text one.", "Still two."]),
        ("# Head\nBody here.", ["Body here."]),
        ("<h1>Head. Line</h1><p>Body.</p><table><tr><td>No. Prose</td></tr></table>", ["Body."]),
        ("{code:json}\nA. B. C.\n{code}\nReal.", ["Real."]),
        ("```\nA. B.\n```\nReal.", ["Real."]),
        ("|| a || b ||\n| c. D | e |\nReal.", ["Real."]),
        ("2024-01-02T03:04:05Z INFO x: Bad. Thing\nReal.", ["Real."]),
        ("https://a.example/x.y Z", ["Z"]),
        ("Quoted:\n> It is so. It is\n> not.", ["Quoted: It is so.", "It is not."]),
        ("* point one\n\n* point two.", ["point one", "point two."]),
        ("", []),
        (None, []),
        ("```\nx\n```", []),
    ],
)
def test_sentences(text, want):
    assert [s.strip() for s in prose.sentences(text)] == want


def test_measures():
    assert prose.measures(["It is 4.0.1 of 'well-made' -- things."]) == (1, 6, 20)


def corpus(n, seed):
    draw = random.Random(seed)
    make = {"easy": lambda: EASY + " " + EASY, "hard": lambda: HARD * 2, None: lambda: MIDDLE * 3, "mixed": lambda: EASY + MIDDLE + HARD}
    kinds = [draw.choice(list(make)) for _ in range(n)]
    return [make[k]() for k in kinds]


def test_held_out_accuracy():
    model = R.fit(corpus(160, 1))
    docs = [prose.sentences(t) for t in corpus(80, 2)]
    flat = [s for d in docs for s in d]
    p = R.softmax(model.scores(R.features(flat)))
    assert (p.argmax(1) == [R._level([s]) for s in flat]).mean() > 0.95
    assert (model.bands(R.distributions(model, docs)).argmax(1) == [R._level(d) for d in docs]).mean() > 0.95
    assert np.allclose(p.sum(1), 1)


def test_text_weights_carry_the_decision(spark):
    texts = corpus(160, 1)
    model = R.fit(texts)
    assert min(model.thresholds) > 0
    rows = frame(spark, list(enumerate(texts)))
    full = R.reading_bands(rows, F.col("doc_id"), F.col("text"), model=model).count()
    blind = R.LevelModel(np.zeros_like(model.chars), np.zeros_like(model.words), model.bias, model.documents, model.temperature, model.thresholds)
    assert R.reading_bands(rows, F.col("doc_id"), F.col("text"), model=blind).count() < full
    levels = lambda m: R.reading_levels(rows, F.col("doc_id"), F.col("text"), model=m)
    assert levels(blind).select("reading_band").distinct().count() == 1 < levels(model).select("reading_band").distinct().count()


def test_sample_is_the_same_in_every_run(spark):
    rows = frame(spark, list(enumerate(corpus(50, 4))) + [(99, None), (98, ""), (97, "x" * 30_000)])
    draw = lambda df: R.sample_texts(df, F.col("doc_id"), F.col("text"), 20, 25_000)
    assert draw(rows) == draw(rows.repartition(7)) and len(draw(rows)) == 20
    assert "x" * 30_000 not in R.sample_texts(rows, F.col("doc_id"), F.col("text"), 100, 25_000)


def test_chunks_give_the_same_result(spark, monkeypatch):
    rows, model = frame(spark, list(enumerate(corpus(30, 5)))), R.fit(corpus(160, 1))
    whole = sorted(map(tuple, R.reading_levels(rows, F.col("doc_id"), F.col("text"), model=model).collect()))
    docs = [prose.sentences(t) for t in corpus(30, 5)]
    each = [R.difficulty(model.bands(R.distributions(model, [d])))[0] for d in docs]
    assert np.allclose([r[2] for r in whole], each, atol=1e-5)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, reading_band string")


def test_bands(spark):
    rows = [(i, t) for i, t in enumerate(corpus(60, 3))] + [(100, None), (101, ""), (102, "```\nx\n```"), (103, EASY), (103, EASY), (104, HARD * 400), (105, "h2. " + HARD + "\n\n" + EASY)]
    got = {r.doc_id: r.reading_band for r in R.reading_bands(frame(spark, rows), F.col("doc_id"), F.col("text")).collect()}
    want = {i: b for i, t in rows if (b := R.band_of(*prose.measures(prose.sentences(t))))}
    assert got == want
    assert got[103] == "easy" and got[104] == "hard" and got[105] == "easy"
    levels = {r.doc_id: r for r in R.reading_levels(frame(spark, rows), F.col("doc_id"), F.col("text")).collect()}
    assert not {100, 101, 102} & set(levels)
    assert levels[103].difficulty < 0.2 < 0.8 < levels[104].difficulty


def test_empty_tables_and_untrained(spark):
    none = frame(spark, [(1, None)]).limit(0)
    assert R.reading_bands(none, F.col("doc_id"), F.col("text")).count() == 0
    one = frame(spark, [(1, EASY)])
    assert [r.reading_band for r in R.reading_bands(one, F.col("doc_id"), F.col("text"), model=R.fit([])).collect()] == ["easy"]


@pytest.mark.parametrize("absent", ["easy", "hard"])
def test_band_absent_from_the_sample(spark, absent):
    seen = [HARD * 2 if absent == "easy" else EASY + " " + EASY, MIDDLE * 3]
    model = R.fit(seen * 40)
    assert model.thresholds[0 if absent == "easy" else 1] == 0
    rows = [(1, EASY), (2, HARD * 2), (3, MIDDLE * 3)]
    got = {r.doc_id: r.reading_band for r in R.reading_bands(frame(spark, rows), F.col("doc_id"), F.col("text"), model=model).collect()}
    assert got == {1: "easy", 2: "hard"}


def test_features_of_odd_texts():
    f = R.features(["a", "é b", "x" * 1000, "\u3042", "-- 1"])
    assert len(f.char_at) == len(f.word_at) == 5
    assert np.isfinite(R.fit(["One. Two."]).scores(f)).all()
