"""Streams give the same as batches, however the files are cut."""

import pytest
from pyspark.sql import functions as F

from fabula.streaming import logs


def test_hysteresis_keeps_its_state(spark, tmp_path):
    values = [84.0, 86.0, 80.0, 76.0, 85.0, 74.0, 90.0, None, 60.0]
    rows = [(1, i, v) for i, v in enumerate(values)]
    for k in range(3):
        part = spark.createDataFrame(rows[3 * k : 3 * k + 3], "user_id long, event_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    schema = spark.read.parquet(str(tmp_path / "e.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e.parquet"))
    out = logs.finish(logs.hysteresis(stream, 85, 75), "append").collect()
    assert sum(r.events for r in out) == 9 and sum(r.pauses for r in out) >= 2


@pytest.mark.parametrize("files", [1, 3])
def test_last_rows_of_a_folder_of_files(spark, tmp_path, files):
    """A table is streamed whole, be it one file or a folder of files."""
    from fabula.plans import streams

    rows = [("a", i, i // 2, float(i), i) for i in range(12)]
    table = spark.createDataFrame(rows, "run_id string, line long, step long, loss double, loaded_at long")
    table.repartition(files).write.parquet(str(tmp_path / "made"))
    if files == 1:
        next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "train_log.parquet")
    else:
        (tmp_path / "made").rename(tmp_path / "train_log.parquet")
    got = sorted(tuple(r) for r in streams.stream_last_rows(spark, str(tmp_path)).collect())
    assert got == [("a", k, 2.0 * k + 1, 2 * k + 1) for k in range(6)]


def test_resumed_stream(spark, tmp_path):
    """A stream with a place of its own goes on where it stopped, and refuses other data or settings."""
    source, place = tmp_path / "in", str(tmp_path / "state")
    spark.range(5).coalesce(1).write.parquet(str(source))
    read = lambda: spark.readStream.schema("id long").parquet(str(source))
    bound = {"data": logs.digest(spark.range(5)), "limit": 3}
    assert logs.finish(read(), "append", place, bound).count() == 5
    spark.range(5, 9).coalesce(1).write.mode("append").parquet(str(source))
    assert sorted(r.id for r in logs.finish(read(), "append", place, bound).collect()) == list(range(9))
    with pytest.raises(ValueError):
        logs.finish(read(), "append", place, bound | {"limit": 4})


def test_a_batch_that_is_run_again_is_not_doubled(spark, tmp_path):
    import shutil

    source, place = tmp_path / "in", tmp_path / "state"
    spark.range(7).coalesce(1).write.parquet(str(source))
    read = lambda: spark.readStream.schema("id long").parquet(str(source))
    assert logs.finish(read(), "append", str(place)).count() == 7
    shutil.rmtree(place / "progress" / "commits")  # as if it had stopped before the batch was noted
    assert logs.finish(read(), "append", str(place)).count() == 7


def test_digest_does_not_depend_on_order(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as k")
    assert logs.digest(df) == logs.digest(df.orderBy(F.desc("id")).repartition(7)) != logs.digest(df.limit(99))


def test_stages_are_bound(spark, tmp_path):
    stages = {"a": lambda s, done: s.range(3)}
    assert logs.run_stages(spark, stages, str(tmp_path), {"v": 1}) == ["a"] and logs.run_stages(spark, stages, str(tmp_path), {"v": 1}) == []
    with pytest.raises(ValueError):
        logs.run_stages(spark, stages, str(tmp_path), {"v": 2})
