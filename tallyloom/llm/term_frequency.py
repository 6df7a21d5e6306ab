"""How often every term occurs and in how many records, by last-seen counters.

Tokens are hash-partitioned by term and sorted by record inside the partition.
A term then needs three values only - occurrences, records, the record seen
last - because a record is new exactly where it differs from the one before it;
no set of records per term is ever kept.

A hot term (a stop word may hold a third of all tokens) is split: the partition
key is the term plus a salt of the *record*, so all tokens of one record meet
in one place and the counts of the salted parts simply add up.

Defined results: tokens whose term is null or '' are no terms; a token without
a record makes its term appear but counts no record; a row repeated in all of
`row` columns counts once; null occurrences count 0; an empty input gives no
rows. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def term_counts(tokens: DataFrame, term: list[Column], record: Column, occurrences: Column, row: list[Column], salts: int = SALTS) -> DataFrame:
    """(t0, t1, ..., occurrences, records, last_record), one row per term.

    term: the columns that make up a term, the first its text. row: what makes
    two rows the same row (repeated rows count once); must not be empty.
    """
    names = [f"t{i}" for i in range(len(term))]
    same = [f"r{i}" for i in range(len(row))]
    flat = tokens.select(*[c.alias(n) for c, n in zip(term, names, strict=True)], record.alias("record"), occurrences.cast("long").alias("n"), *[c.alias(n) for c, n in zip(row, same, strict=True)])
    flat = flat.where("t0 IS NOT NULL AND t0 <> ''")
    by_record, by_row = F.xxhash64("record"), F.xxhash64(*same)
    salted = flat.withColumn("salt", F.pmod(F.when(F.col("record").isNotNull(), by_record).otherwise(by_row), F.lit(salts)))
    seen = Window.partitionBy(*names, "salt").orderBy("record", *same)
    last = F.lag("record").over(seen)
    # a repeated row stands right behind its first copy
    repeats = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(seen)) for c in ["record", *same]], F.row_number().over(seen) > 1)
    counted = salted.withColumn("repeat", repeats).withColumn("new", F.col("record").isNotNull() & (last.isNull() | (last != F.col("record"))))
    return (
        counted.where(~F.col("repeat"))
        .groupBy(*names)
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("occurrences"), F.count_if("new").alias("records"), F.max("record").alias("last_record"))
    )


def mark(counts: DataFrame, all_records: Column, rare_below: int, common_above: float) -> DataFrame:
    """counts plus freq_mark: 'rare', 'common' or 'useful'; rare wins over common."""
    return counts.withColumn("freq_mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * all_records, "common").otherwise("useful"))
