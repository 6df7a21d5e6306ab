"""Inserts, updates and deletes by key, as whole-table rewrites.

Each function returns the table after the change; writing it (to a new
directory, then swapped) is the caller's step, so a lost executor only repeats
tasks. Keys are compared null-safe where they decide uniqueness.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def unseen(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: str = "first") -> DataFrame:
    """The new rows of keys that are not there yet; of those with one key the first (or last) in arrival order."""
    arrival = list(order) if keep == "first" else [o.desc() for o in order]
    fresh = new.join(existing.select(*keys), list(keys), "left_anti")
    return keep_one(fresh, keys, arrival).select(*existing.columns)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: str = "first") -> DataFrame:
    """Existing rows plus the `unseen` new ones."""
    return existing.unionByName(unseen(existing, new, keys, order, keep))


def update_by_key(existing: DataFrame, changed: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of the same key replaced as a whole; unknown keys are ignored.

    Of several changes of one key the last in `order` counts (by default the one
    that sorts last by its own columns), so no row is ever doubled.
    """
    rest = [c for c in existing.columns if c not in keys]
    last = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or [])], *[F.col(c) for c in rest])
    marked = changed.groupBy(*keys).agg(F.max(last).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(f"__{c}") for c in rest], F.lit(True).alias("__hit"))
    joined = existing.join(marked, list(keys), "left")
    return joined.select(*[F.col(c) if c in keys else F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in existing.columns])


def unknown_keys(existing: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of an update that hit no row (an error for the caller to raise)."""
    return changed.join(existing.select(*keys), list(keys), "left_anti").select(*keys)


def delete_by_key(existing: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.join(doomed.select(*keys).distinct(), list(keys), "left_anti").select(*existing.columns)


def delete_where(existing: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (null counts as not true)."""
    return existing.where(~F.coalesce(condition, F.lit(False)))


def promote_fields(base: DataFrame, attributes: DataFrame, key: str, field: str, value: Column, order: Column, columns: dict[str, str]) -> DataFrame:
    """Key/value rows turned into columns of the base; the first value in order wins.

    columns: field name -> column name. One conditional aggregate over the
    attributes and one join, however many columns are promoted.
    """
    first = attributes.where(F.col(field).isin(list(columns))).groupBy(key).agg(*[F.min_by(F.when(F.col(field) == f, value), F.when(F.col(field) == f, order)).alias(c) for f, c in columns.items()])
    return base.join(first, key, "left")


def unpromoted(attributes: DataFrame, field: str, columns: Sequence[str]) -> DataFrame:
    """Key/value rows that stay behind once the named fields are columns."""
    return attributes.where(~F.coalesce(F.col(field).isin(list(columns)), F.lit(False)))


def reconcile(known: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, in_known, in_listed): both sides, keys compared without letter case."""
    a = known.select(F.lower(key).alias("k"), F.col(key).alias("a")).groupBy("k").agg(F.min("a").alias("a"))
    b = listed.select(F.lower(key).alias("k"), F.col(key).alias("b")).groupBy("k").agg(F.min("b").alias("b"))
    return a.join(b, "k", "full_outer").select(F.coalesce("a", "b").alias(key), F.col("a").isNotNull().alias("in_known"), F.col("b").isNotNull().alias("in_listed"))


def union_ranked(parts: Sequence[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """Set union in order of the parts: each key once, with its first part's number and place."""
    every = reduce(DataFrame.unionByName, [p.select(F.col(key), F.lit(i).alias("part"), F.col("place")) for i, p in enumerate(parts)])
    once = every.groupBy(key).agg(F.min(F.struct("part", "place")).alias("at")).select(key, "at.part", "at.place")
    return once.orderBy("part", "place", key).limit(limit) if limit else once
