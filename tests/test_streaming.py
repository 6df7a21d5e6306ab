from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.streaming import daily

SCHEMA = "id int, v string, at timestamp"


def test_daily_drops(spark, tmp_path):
    drop = lambda name, rows: spark.createDataFrame(rows, "id int, v string, d string").select("id", "v", F.col("d").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in" / name))
    frame = spark.createDataFrame([], SCHEMA)
    run = lambda: daily.ingest_available(daily.read_drops(spark, str(tmp_path / "in" / "*"), frame.schema), str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], ["at"])
    drop("d1", [(1, "a", "2020-01-01"), (2, "b", "2020-01-01"), (2, "c", "2020-01-02")])
    run()
    drop("d2", [(1, "later", "2020-01-03"), (3, None, "2020-01-03")])
    run()
    assert sorted((r.id, r.v) for r in daily.read_target(spark, str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b"), (3, None)]


def test_repeated_batch_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a")], "id int, v string")
    merge = daily.merge_into(spark, str(tmp_path / "t"), ["id"], ["v"])
    merge(batch, 0)
    merge(batch, 0)
    assert [tuple(r) for r in daily.read_target(spark, str(tmp_path / "t")).collect()] == [(1, "a")]


def test_batches_meet_their_own_folders(spark, tmp_path):
    merge = daily.merge_into(spark, str(tmp_path / "t"), ["id"], ["v"], parts=4)
    for start in (0, 5, 10):
        merge(spark.createDataFrame([(i, f"{start}") for i in range(start, start + 10)], "id int, v string"), start)
    got = {r.id: r.v for r in daily.read_target(spark, str(tmp_path / "t")).collect()}
    assert got == {i: "0" if i < 10 else "5" if i < 15 else "10" for i in range(20)}
    assert len(list((tmp_path / "t").glob(f"{daily.PART}=*"))) <= 4


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2020-01-01"), (1, "b", "2020-01-01")], "id int, v string, d string").select("id", "v", F.col("d").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = daily.first_seen(daily.read_drops(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema), "id", "at")
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1
