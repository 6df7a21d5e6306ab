"""Documents packed into containers of a fixed number of tokens.

First-fit decreasing: items by falling size, each into the first container that
still has room. A tournament tree over the containers' free room finds that
container in logarithmic time. Groups of documents drawn by a hash of the id
are packed independently, so no task holds more than about `group_items` items;
the space lost at a group's end is less than one container.

An item longer than a container is cut into full containers and a remainder;
only such items are cut. Defined results: a null or empty text has no tokens
and lies in the first container of its group; repeated rows of an id count
once, with the longest text; an empty table gives no rows; every row with a null
id is an item of its own, packed in groups of such rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How byte-level BPE splits text before its ranks apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
GROUP_ITEMS = 8192
SEED = 17


@cache
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """The name under which executors find the driver's vocabulary file; where the driver has none, the path itself, which they must have."""
    if not os.path.exists(path):
        return path
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def count_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens of each text under a file of byte-level BPE ranks (a path, or what `ship_vocabulary` gave); 0 for null."""

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary if os.path.isabs(vocabulary) else SparkFiles.get(vocabulary)).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return counted(text)


class TournamentTree:
    """Free room of containers 0, 1, 2, ...; finds the first with enough of it."""

    def __init__(self, containers: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, containers):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first container with room for size, which is taken from it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; sizes must not exceed the capacity."""
    tree, out = TournamentTree(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = tree.place(sizes[i])
    return out


def pack(items: DataFrame, item: Column, size: Column, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = SEED) -> DataFrame:
    """(item_id, piece_no, container_id, start_at, piece_size), one row per piece."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = items.select(item.alias("item_id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    no_id = F.col("item_id").isNull()
    total = rows.agg(F.count("*").alias("n")).scalar()
    nulls = rows.agg(F.count_if(no_id).alias("n")).scalar()
    groups = F.greatest(F.lit(1), F.ceil(total / F.lit(group_items)))
    null_groups = F.greatest(F.lit(1), F.ceil(nulls / F.lit(group_items)))
    # repeats of an id are folded before the groups are formed, else they would all meet in one;
    # rows without an id are counted by size and dealt out again one by one
    once = rows.groupBy("item_id", F.when(no_id, F.col("size")).alias("null_size")).agg(F.max("size").alias("size"), F.count("*").alias("n"))
    every = once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.when(no_id, F.col("n")).otherwise(1))))
    own = F.pmod(F.xxhash64(F.lit(seed), "item_id"), groups)
    dealt = groups + F.pmod(F.xxhash64(F.lit(seed), "size", "copy"), null_groups)
    grouped = every.select("item_id", "size", F.when(no_id, dealt).otherwise(own).cast("int").alias("g"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (g,) = key
        pdf = pdf.sort_values(["size", "item_id"], ascending=[False, True], kind="stable", na_position="first")
        ids, pieces, starts, sizes = [], [], [], []
        for i, n in zip(pdf["item_id"], pdf["size"], strict=True):
            for k, start in enumerate(range(0, max(n, 1), capacity)):
                ids.append(i)
                pieces.append(k)
                starts.append(start)
                sizes.append(min(capacity, n - start))
        where = first_fit_decreasing(sizes, capacity)
        out = pd.DataFrame({"item_id": pd.Series(ids, dtype=pdf["item_id"].dtype), "piece_no": pieces, "container_id": where, "start_at": starts, "piece_size": sizes})
        out["container_id"] += int(g) << 32
        return out

    schema = f"item_id {kind}, piece_no int, container_id long, start_at long, piece_size long"
    return grouped.groupBy("g").applyInPandas(packed, schema)
