"""The N best items of every group, ranked in two salted stages.

Stage one hashes each group into subgroups by item id, folds each id to its best
score and keeps the best N ids of each subgroup; the fold comes first, so every
row travels once, and an id with many scores takes one place only. Stage two
ranks the survivors (at most N x salts per group) by score, ties by smaller id;
Spark applies its limit before that shuffle too.

Defined results: null and not-a-number scores are no candidates, infinite and
negative ones are; -0.0 equals 0.0; rows equal in group, id and score are one
candidate, and an id that recurs with other scores keeps its best; a null group
is a group of its own, a null id comes before all ids among equal scores; n < 1
or an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_items(df: DataFrame, group: Column, item: Column, score: Column, n: int, salts: int = SALTS) -> DataFrame:
    """(group_id, item_id, score, top_no) of the best n items of each group."""
    value = score.cast("double") + F.lit(0.0)
    rows = df.select(group.alias("group_id"), item.alias("item_id"), value.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(salts)))
    best = [F.col("score").desc(), F.col("item_id").asc()]
    within = Window.partitionBy("group_id", "salt").orderBy(*best)
    # spread by subgroup first: the fold and the ranking then share this one shuffle
    once = salted.repartition("group_id", "salt").groupBy("group_id", "salt", "item_id").agg(F.max("score").alias("score"))
    kept = once.withColumn("r", F.row_number().over(within)).where(F.col("r") <= n)
    final = Window.partitionBy("group_id").orderBy(*best)
    return kept.withColumn("top_no", F.row_number().over(final)).where(F.col("top_no") <= n).select("group_id", "item_id", "score", "top_no")
