"""Structured Streaming over logs and events: last rows, windows with late data, hysteresis state, resumable stages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fabula.session import scratch


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, one file or a folder of files, as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    target, files = _file(spark, path)
    if files.getFileStatus(target).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def finish(stream: DataFrame, mode: str = "complete", place: str | None = None, binding: dict | None = None) -> DataFrame:
    """Run a stream over all that is there and return its result as a table: the last state in complete mode, all
    rows in append mode.

    Progress and result are kept in `place`, so that a later call with the same place goes on where the last one
    stopped; without it they are in a new folder of the shared one. A batch that is run again replaces what it wrote
    before. binding: what the result depends on (settings, digests of data); a place that was begun with another one
    is refused.
    """
    spark = stream.sparkSession
    place = place or scratch(spark, "stream")
    bind(spark, place, binding or {})
    bounded = mode == "complete"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out" if bounded else f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out" if bounded else f"{place}/out/batch=*")


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def bind(spark: SparkSession, place: str, binding: dict) -> None:
    """Note in the folder what its content depends on; raises if something else is noted there already."""
    body = json.dumps(binding, sort_keys=True)
    target, files = _file(spark, f"{place}/binding")
    if files.exists(target):
        noted = spark.read.text(f"{place}/binding", wholetext=True).first()[0]
        if noted != body:
            raise ValueError(f"{place} was begun with other data or settings: {noted}")
        return
    out = files.create(target, False)
    out.write(bytearray(body.encode()))
    out.close()


def digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order or partitions: the sum of their hashes, and their number."""
    hashed = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"))
    row = hashed.agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("s")).first()
    return f"{row.n}-{row.s}"


def last_rows(stream: DataFrame) -> DataFrame:
    """The last logged row of each step of a run, as a running aggregate."""
    return stream.where("step is not null").groupBy("run_id", "step").agg(F.max_by("loss", F.struct("line", "loaded_at")).alias("loss"), F.max("line").alias("line"))


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of events by type in tumbling windows of event time; rows later than `late` may be dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "value")


_STATE = "paused boolean, turn long"
_OUT = "user_id long, turn long, events long, pauses long, paused boolean"


def hysteresis(stream: DataFrame, limit: float, resume: float) -> DataFrame:
    """Per user and micro-batch (turn): events seen, new pauses, and whether the guard is paused after them.

    The guard pauses at `limit` and resumes at `resume`; its state is kept from batch to batch.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paused, turn = state.get if state.exists else (False, 0)
        rows = pd.concat([b[["ts", "event_id", "value"]] for b in batches]).sort_values(["ts", "event_id"])
        value = rows["value"].to_numpy(float)
        # 1 where the guard would pause, 0 where it would resume, and between the two (or without a value) as before
        mark = np.where(value >= limit, 1.0, np.where(value <= resume, 0.0, np.nan))
        after = pd.Series(np.append(float(paused), mark)).ffill().to_numpy()
        pauses = int(((after[1:] == 1) & (after[:-1] == 0)).sum())
        state.update((bool(after[-1]), turn + 1))
        yield pd.DataFrame([(key[0], turn, len(value), pauses, bool(after[-1]))], columns=["user_id", "turn", "events", "pauses", "paused"])

    rows = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rows.groupBy("user_id").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_stages(spark: SparkSession, stages: dict, folder: str, binding: dict | None = None) -> list[str]:
    """Run the stages whose output isn't complete yet, in order; returns the names of those that ran.

    stages: name -> function of (spark, paths of earlier outputs) that gives a DataFrame. A finished output has Spark's
    success mark; an interrupted one is written again. binding: as in finish.
    """
    bind(spark, folder, binding or {})
    done, ran = {}, []
    for name, stage in stages.items():
        path = f"{folder}/{name}"
        mark, files = _file(spark, f"{path}/_SUCCESS")
        if not files.exists(mark):
            stage(spark, dict(done)).write.mode("overwrite").parquet(path)
            ran.append(name)
        done[name] = path
    return ran
