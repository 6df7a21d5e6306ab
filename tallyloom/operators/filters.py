"""Typed filters, ordering, paging, counts and lookups over one table.

Every filter is a Column, so it reaches the scan. Names of compare operators:
=, !=, >, >=, <, <=.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialise

COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def conditions(
    equals: Mapping[str, object] | None = None,
    compare: Sequence[tuple[str, str, object]] = (),
    is_null: Mapping[str, bool | None] | None = None,
    any_of: bool = False,
) -> Column | None:
    """One condition from optional parts; None where no part is given.

    equals: None values add nothing; comparison is binary (case matters).
    is_null: True asks for nulls, False for values, None adds nothing.
    any_of joins everything with OR instead of AND.
    """
    parts = [F.col(c) == F.lit(v) for c, v in (equals or {}).items() if v is not None]
    for column, op, value in compare:
        if op not in COMPARE:
            raise ValueError(f"unknown comparison {op}")
        if value is not None:
            parts.append(COMPARE[op](F.col(column), F.lit(value)))
    for column, wanted in (is_null or {}).items():
        if wanted is not None:
            parts.append(F.col(column).isNull() if wanted else F.col(column).isNotNull())
    if not parts:
        return None
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), parts)


def matching(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def ordering(columns: Sequence[str], direction: str | None = None) -> list[Column]:
    """Sort columns; the direction binds to the last one only, 'd...' means falling.

    Nulls come first when rising and last when falling.
    """
    falling = (direction or "").lower().startswith("d")
    return [F.col(c).desc() if falling and i == len(columns) - 1 else F.col(c).asc() for i, c in enumerate(columns)]


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Sorted rows limit by limit; without a positive limit the offset is ignored."""
    out = df.orderBy(*order) if order else df
    if limit and limit > 0:
        if offset and offset > 0:
            out = out.offset(offset)
        out = out.limit(limit)
    return out


def select_list(df: DataFrame, columns: Sequence[str], condition: Column | None = None, order_by: Sequence[str] = (), direction: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    return page(matching(df, condition).select(*columns), ordering(order_by, direction), limit, offset)


def select_single(df: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """At most one row: the match with the smallest key."""
    return matching(df, condition).orderBy(key).limit(1)


def select_count(df: DataFrame, key: str | None = None, condition: Column | None = None) -> DataFrame:
    """One row `n`: matches whose key is there, or all matches without a key."""
    return matching(df, condition).agg((F.count(key) if key else F.count("*")).alias("n"))


def max_key(df: DataFrame, key: str, default: int = 0) -> DataFrame:
    return df.agg(F.coalesce(F.max(key), F.lit(default)).alias("max_key"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct values without null and blank ones, sorted."""
    return df.select(column).where(F.col(column).isNotNull() & (F.trim(column) != "")).distinct().orderBy(column)


def contains_any_ci(column: str, terms: Sequence[str]) -> Column:
    """LIKE '%term%' for any term, letter case ignored; % and _ keep their meaning."""
    return reduce(lambda a, b: a | b, [F.col(column).ilike(f"%{t}%") for t in terms], F.lit(False))


def equals_ci(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.lower()


def starts_ci(column: str, prefix: str) -> Column:
    return F.lower(F.col(column)).startswith(prefix.lower())


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """df with running numbers from 1 in the given order, for tables without a key.

    The rows are sorted by range and written once; each partition then needs only
    how many rows the partitions before it hold, so no task sees the whole table.
    `order` should tell all rows apart, or equal ones are numbered as they come.
    """
    # the id of a row is its partition's number times 2**33 plus its place there
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
