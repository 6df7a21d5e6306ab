from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.packing import CAPACITY, count_tokens, first_fit_decreasing, pack, ship_vocabulary
from tallyloom.llm.queries import VOCABULARY


def plain_ffd(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[i]
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tree_is_first_fit(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 1, 5, 30, 50, 51, 99, 100, draw.randrange(101)]) for _ in range(draw.choice([0, 1, 2, 77, 300]))]
    assert first_fit_decreasing(sizes, 100) == plain_ffd(sizes, 100)


def packed(spark, rows, **k):
    df = spark.createDataFrame(rows, "i long, n int, size string, g int")
    return pack(df, F.col("i"), F.col("n"), **k).collect()


def test_every_item_whole_and_within(spark):
    draw = random.Random(2)
    sizes = {i: draw.choice([0, 3, 70, 100, 130, 260, draw.randrange(1, 100)]) for i in range(500)}
    rows = packed(spark, [(i, n, "clash", 0) for i, n in sizes.items()], capacity=100, group_items=64)
    fill, got = {}, {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.piece_size
        got.setdefault(r.item_id, []).append((r.piece_no, r.start_at, r.piece_size))
    assert max(fill.values()) <= 100
    for i, n in sizes.items():
        pieces = sorted(got[i])
        assert sum(p[2] for p in pieces) == n
        assert len(pieces) == max(1, -(-n // 100))
        assert [p[1] for p in pieces] == [100 * k for k in range(len(pieces))]
    assert len(fill) <= 1.12 * sum(sizes.values()) / 100 + 9


def test_edges(spark):
    assert packed(spark, []) == []
    rows = packed(spark, [(1, None, "", 0), (1, 7, "", 0), (None, 3, "", 0), (2, None, None, None)])
    assert sorted((r.item_id is None, r.item_id, r.piece_size) for r in rows if r.item_id is not None) == [(False, 1, 7), (False, 2, 0)]
    assert sum(r.item_id is None for r in rows) == 1
    with pytest.raises(ValueError):
        packed(spark, [(1, 1, "", 0)], capacity=0)


def test_null_ids_are_items_of_their_own(spark):
    large = (1 << 53) + 1
    sizes = [n % 7 * 20 for n in range(100)]
    rows = [(None, n, "", 0) for n in sizes] + [(large, 30, "", 0), (large, 10, "", 0)]
    got = packed(spark, rows, capacity=100, group_items=16)
    assert sum(r.piece_size for r in got) == sum(sizes) + 30
    assert sum(r.piece_no == 0 and r.item_id is None for r in got) == 100
    assert [(r.item_id, r.piece_size) for r in got if r.item_id is not None] == [(large, 30)]
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.piece_size
    assert max(fill.values()) <= 100 and len({c >> 32 for c in fill}) > 2
    assert sorted(map(str, got)) == sorted(map(str, packed(spark, rows[::-1], capacity=100, group_items=16)))


def test_same_in_every_run(spark):
    rows = [(i, i % 97, "", 0) for i in range(300)]
    one = sorted(map(tuple, packed(spark, rows, capacity=100, group_items=50)))
    assert one == sorted(map(tuple, packed(spark, rows[::-1], capacity=100, group_items=50)))


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",), ("naïve " * 3000,)], "t string")
    got = [r[0] for r in df.select(count_tokens(F.col("t"), ship_vocabulary(spark, VOCABULARY))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1 and got[4] > CAPACITY
