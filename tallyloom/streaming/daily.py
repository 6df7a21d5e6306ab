"""Daily tracker drops ingested as a stream: new files, first version of a key wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tallyloom.operators.keyed import unseen


def read_drops(spark: SparkSession, path: str, schema: S.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of new Parquet files below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each key once within the watermark; state older than the delay is forgotten."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


#: How many folders a target is parted into by a hash of the key.
PARTS = 64
PART = "__part"


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """What has been taken in so far."""
    return spark.read.parquet(target).drop(PART)


def merge_into(spark: SparkSession, target: str, keys: list[str], order: list[str], keep: str = "first", parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of keys that the target doesn't have yet are appended.

    The target lies in folders by a hash of the key, so a batch is held against
    those folders only that its own keys belong to. A batch that is run again
    after a failure finds its keys there and adds nothing, so the result doesn't
    depend on repeats. `parts` must stay the same for a target.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r[0] for r in placed.select(PART).distinct().collect()]  # at most `parts` numbers
        try:
            existing = spark.read.schema(placed.schema).parquet(target).where(F.col(PART).isin(touched))
            existing.limit(0).collect()
        except AnalysisException:
            existing = spark.createDataFrame([], placed.schema)
        unseen(existing, placed, keys, [F.col(c).asc() for c in order], keep).repartition(PART).write.mode("append").partitionBy(PART).parquet(target)

    return merge


def ingest_available(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], keep: str = "first") -> None:
    """Takes in everything that is there now and stops."""
    query = stream.writeStream.foreachBatch(merge_into(stream.sparkSession, target, keys, order, keep)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
