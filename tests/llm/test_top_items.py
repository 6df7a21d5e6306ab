from __future__ import annotations

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyloom.llm.top_items import top_items

SCHEMA = "g int, i int, s double, score string, salt int, top_no int"


def top(spark, rows, n=3, salts=4):
    df = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA)
    return sorted((r.group_id if r.group_id is not None else -1, r.top_no, r.item_id) for r in top_items(df, F.col("g"), F.col("i"), F.col("s"), n, salts).collect())


def brute(rows, n):
    best = defaultdict(dict)
    for g, i, s in rows:
        if s is not None and not math.isnan(s):
            best[g][i] = max(s, best[g].get(i, -math.inf))
    return sorted((g if g is not None else -1, k + 1, i) for g, x in best.items() for k, i in enumerate(sorted(x, key=lambda i: (-x[i], i))[:n]))


def test_against_brute_force(spark):
    draw = random.Random(1)
    rows = [(draw.choice([1, 2, None]), i, draw.choice([None, float("nan"), 1.0, 2.0, 2.0, -1.0, float("inf"), 0.0, -0.0])) for i in range(300)]
    rows += draw.sample(rows, 80)
    for salts in (1, 4, 32):
        assert top(spark, rows, 3, salts) == brute(rows, 3)


def test_recurring_ids_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(draw.choice([1, 2, None]), draw.randrange(12), float(draw.randrange(40))) for _ in range(300)]
    for salts in (1, 4, 32):
        assert top(spark, rows, 3, salts) == brute(rows, 3)
    assert top(spark, [(1, 7, float(s)) for s in (9, 8, 7, 6, 5)] + [(1, 8, 4.0)], n=5, salts=1) == [(1, 1, 7), (1, 2, 8)]


def test_edges(spark):
    assert top(spark, []) == []
    assert top(spark, [(1, 1, None), (1, 2, float("nan"))]) == []
    assert top(spark, [(1, 1, 5.0)], n=0) == []
    assert top(spark, [(1, 2, 0.0), (1, 1, -0.0)], n=1) == [(1, 1, 1)]
    # a row repeated very often pushes out nothing
    assert top(spark, [(1, 9, 9.0)] * 500 + [(1, 2, 1.0), (1, 1, 1.0)]) == [(1, 1, 9), (1, 2, 1), (1, 3, 2)]
