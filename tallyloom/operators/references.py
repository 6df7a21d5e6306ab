"""References to records that do not exist, over keys of one or more columns.

A reference key may be partly null. References are grouped by their null mask
(which key columns are null) and each group is anti-joined with the targets on
its non-null columns only, under a declared match rule:

* "simple"  - a reference with any null column is not checked (never an orphan);
* "partial" - the non-null columns must all equal those of one target;
* "full"    - all columns null is fine, all set is checked, a mix is an orphan.

An all-null reference is never an orphan. Columns whose schema says they hold
no null add no mask. Targets are reduced to their distinct keys before the
join, so a target repeated millions of times costs one row; a hot reference key
is split by the salt: the references of one key spread over `salts` partitions
and only the keys found hot (held by more than `hot_share` of all references,
hence at most 1/hot_share of them) are copied per salt on the target side.

Defined results: a reference is returned as often as it occurs; an empty target
table makes every checked reference an orphan; key columns are compared as they
are (callers normalise spelling first).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = ("simple", "partial", "full")
SALT = "__salt"


def null_masks(refs: DataFrame, keys: list[str]) -> list[tuple[bool, ...]]:
    """Masks that can occur by the schema; True marks a null column."""
    may = {f.name: f.nullable for f in refs.schema.fields}
    return [m for m in product((False, True), repeat=len(keys)) if all(may[k] or not null for k, null in zip(keys, m, strict=True))]


def _of_mask(keys: list[str], mask: tuple[bool, ...]) -> Column:
    cond = F.lit(True)
    for key, null in zip(keys, mask, strict=True):
        cond = cond & (F.col(key).isNull() if null else F.col(key).isNotNull())
    return cond


def hot_keys(refs: DataFrame, keys: list[str], hot_share: float) -> DataFrame:
    """Keys that hold more than hot_share of all references (so at most 1/hot_share rows)."""
    counts = refs.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = refs.agg(F.count("*").alias("__all"))
    return counts.where(F.col("__n") > total.scalar() * hot_share).select(*keys)


def _spread(refs: DataFrame, targets: DataFrame, keys: list[str], salts: int, hot_share: float, hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: rows of hot reference keys are spread over `salts` values, their targets copied to each.

    hot: the hot keys, if they are known; it must not be larger than `hot_keys` makes it.
    """
    hot = (hot if hot is not None else hot_keys(refs, keys, hot_share)).select(*keys, F.lit(True).alias("__hot"))
    spread = refs.join(F.broadcast(hot), keys, "left").withColumn(
        SALT, F.when(F.col("__hot"), F.pmod(F.xxhash64(*[F.col(c) for c in refs.columns]), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = targets.join(F.broadcast(hot), keys, "left").select(*targets.columns, F.explode(copies).alias(SALT))
    return spread.drop("__hot"), copied


def anti_join_salted(refs: DataFrame, targets: DataFrame, keys: list[str], salts: int = 16, hot_share: float = 0.01, hot: DataFrame | None = None) -> DataFrame:
    """refs without a target of the same (non-null) key; hot reference keys are split.

    Everything but the hot keys is joined as it is: their salt is 0 on both sides.
    """
    distinct = targets.select(*keys).dropna().distinct()
    if salts <= 1:
        return refs.join(distinct, keys, "left_anti").select(*refs.columns)
    spread, copied = _spread(refs, distinct, keys, salts, hot_share, hot)
    return spread.join(copied, [*keys, SALT], "left_anti").select(*refs.columns)


def lookup_salted(refs: DataFrame, facts: DataFrame, keys: list[str], salts: int = 16, hot_share: float = 0.01, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """refs with the other columns of facts, which has one row per key; hot reference keys are split."""
    rest = [c for c in facts.columns if c not in keys]
    spread, copied = _spread(refs, facts, keys, salts, hot_share, hot)
    return spread.join(copied, [*keys, SALT], how).select(*refs.columns, *rest)


def null_mask(keys: list[str]) -> Column:
    """The key columns that are null, by name, '' for none: how a reference is grouped."""
    return F.concat_ws(" ", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    keys: list[str],
    target_keys: list[str] | None = None,
    match: str = "simple",
    salts: int = 1,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The references without a target, with all their columns.

    hot: the hot keys of the references without a null, if they are known.

    With salts > 1, references whose key is hot are split before the join; with
    1 the skew is left to adaptive execution, which splits the reference side of
    an anti join as well.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    wanted = targets.select(*[F.col(t).alias(k) for k, t in zip(keys, target_keys or keys, strict=True)])
    parts = []
    for mask in null_masks(refs, keys):
        there = [k for k, null in zip(keys, mask, strict=True) if not null]
        group = refs.where(_of_mask(keys, mask))
        if not there or (match == "simple" and any(mask)):
            continue
        if match == "full" and any(mask):
            parts.append(group)
        else:
            parts.append(anti_join_salted(group, wanted.select(*there), there, salts, hot=None if any(mask) else hot))
    if not parts:
        return refs.limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphan_report(orphans: DataFrame, table: str, at: Column, key: Column, *kinds: str) -> DataFrame:
    """(table_name, period, *kinds, orphans, keys): orphan references per table, month and kind, and their distinct keys."""
    period = F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown")).alias("period")
    return orphans.groupBy(F.lit(table).alias("table_name"), period, *kinds).agg(F.count("*").alias("orphans"), F.count_distinct(key).alias("keys"))
