from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.contamination import find_leaks, rolling, words_of

ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
HALF = " ".join(ITEM.split()[:12])


def leaks(spark, docs, items, **k):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id int, item_text string")
    return find_leaks(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("item_text"), **k)


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_against_brute_force(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(30))) for i in range(8)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(4):
            words = draw.choice(items)[1].split()
            s = draw.randrange(20)
            parts += words[s : s + draw.choice([5, 7, 8, 9, 14])] + ["zz"]
        docs.append((d, " ".join(parts)))
    want = {(d, i) for d, t in docs for i, x in items if longest(words_of(t), words_of(x)) >= 8}
    for block in (10_000, 60):
        got = leaks(spark, docs, items, min_match=8, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        for r in got:
            assert r.longest_run == longest(words_of(dict(docs)[r.doc_id]), words_of(dict(items)[r.item_id]))
            assert r.longest_run <= r.covered_words <= r.item_words == 30


@pytest.mark.parametrize(
    "dress",
    [
        lambda t: t.upper(),
        lambda t: t.replace(" ", "&nbsp;\n> "),
        lambda t: " ".join(f"<b>{w}</b>," for w in t.split()),
        lambda t: re.sub("e", "e­​", t),
        lambda t: t.replace("three", "th<i>r</i>ee").replace(" ", "<br/>"),
        lambda t: t.replace(" ", " {color:red}", 3),
        lambda t: "“" + t.replace(" ", " - ") + "”",
    ],
)
def test_dressed(spark, dress):
    assert leaks(spark, [(1, "before " + dress(HALF) + " after")], [(5, ITEM)]).count() == 1


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " ".join(HALF.split()[:11])), (4, HALF), (4, HALF), (5, ("x " * 60_000) + HALF), (6, HALF.replace("six", "sixx"))]
    got = leaks(spark, docs, [(5, ITEM), (5, ITEM), (6, "too short"), (None, ITEM), (7, None)])
    assert sorted((r.doc_id, r.item_id, r.longest_run) for r in got.collect()) == [(4, 5, 12), (5, 5, 12)]
    assert leaks(spark, [], [(5, ITEM)]).count() == 0
    assert leaks(spark, docs, []).count() == 0


def test_run_never_crosses_documents(spark):
    w = ITEM.split()
    assert leaks(spark, [(1, " ".join(w[:8])), (2, " ".join(w[8:])), (3, " ".join(w[:11])), (4, " ".join(w[11:]))], [(1, ITEM)]).count() == 0


def test_reordered_parts_are_covered(spark):
    w = ITEM.split()
    row = leaks(spark, [(1, " ".join([*w[8:], "x", *w[:8]]))], [(1, ITEM)], min_match=4, min_coverage=0.9).first()
    assert (row.tile_count, row.covered_words, row.coverage) == (2, 16, 1.0)
    assert leaks(spark, [(1, " ".join(w[:8]))], [(1, ITEM)], min_match=4, min_coverage=0.6).count() == 0


def test_rolling_values():
    import numpy as np

    codes = np.array([3, 1, 4, 1, 5, 1, 4, 1, 5], np.uint64)
    v = rolling(codes, 4)
    assert len(v) == 6 and v[1] == v[5] and len(set(v.tolist())) == 5
    assert len(rolling(codes[:3], 4)) == 0


def test_linear_tiling_equals_tiling_from_seeds():
    import numpy as np

    from tallyloom.llm.contamination import ItemIndex, tiles, tiles_linear

    draw = random.Random(9)
    for _ in range(150):
        words = "a b c".split()[: draw.choice([1, 2, 3])]
        item = [draw.choice(words) for _ in range(draw.randrange(5, 40))]
        doc = [draw.choice([*words, "zz"] if draw.random() < 0.5 else words) for _ in range(draw.randrange(5, 60))]
        index = ItemIndex([(1, " ".join(item))], 4)
        codes = np.array([index.vocabulary.get(w, 0) for w in doc], np.uint64)
        at, _, place = index.seeds(*index.hits(codes))
        assert tiles_linear(codes, index.items[0][1], 4) == tiles(codes, index.items[0][1], at, place, 4)


def test_repeated_words_take_linear_memory(spark):
    import time

    for n in (20_000, 40_000):
        began = time.perf_counter()
        got = leaks(spark, [(1, "same " * n), (2, "same " * 20)], [(5, "same " * n)]).collect()
        assert {(r.doc_id, r.covered_words) for r in got} == {(1, n), (2, 20)}
        assert time.perf_counter() - began < 20


def test_winnowing_keeps_every_common_run():
    from tallyloom.llm.contamination import _hashed_windows, winnowed

    draw = random.Random(3)
    for _ in range(100):
        shared = [f"s{draw.randrange(50)}" for _ in range(12)]
        doc = [f"d{draw.randrange(9)}" for _ in range(draw.randrange(40))] + shared + [f"d{draw.randrange(9)}" for _ in range(draw.randrange(40))]
        assert set(winnowed(doc, 12)) & set(_hashed_windows(shared, 6))


def test_join_keeps_rows_without_an_id(spark):
    for block in (10_000, 3):
        got = leaks(spark, [(None, f"x {ITEM} y"), (2, None), (3, "")], [(1, ITEM), (1, ITEM), (None, ITEM), (4, "short")], block_words=block).collect()
        assert [(r.doc_id, r.item_id, r.covered_words) for r in got] == [(None, 1, 16)]
