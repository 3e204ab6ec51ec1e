"""Byte n-gram language models: counts, add-one losses, windowed held-out losses.

Counts are made by np.bincount on Arrow batches, 256 or 65,536 counters a task, and summed by a groupBy; the bytes of
a text never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = 256


def _stream(texts: list[str | None]) -> Iterator[np.ndarray]:
    for t in texts:
        if t:
            yield np.frombuffer(t.encode(), np.uint8).astype(np.int64)


def unigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """token, n of the bytes of all texts; only those that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for ids in _stream(batch.column(0).to_pylist()):
                total += np.bincount(ids, minlength=VOCABULARY)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["token", "n"])

    return df.select(text).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def bigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """previous, token, n of successive bytes within texts; only those that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY * VOCABULARY, np.int64)
        for batch in batches:
            codes = [ids[:-1] * VOCABULARY + ids[1:] for ids in _stream(batch.column(0).to_pylist()) if len(ids) > 1]
            if codes:
                total += np.bincount(np.concatenate(codes), minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some // VOCABULARY, pa.int32()), pa.array(some % VOCABULARY, pa.int32()), pa.array(total[some], pa.int64())], names=["previous", "token", "n"])

    return df.select(text).mapInArrow(run, "previous int, token int, n long").groupBy("previous", "token").agg(F.sum("n").alias("n"))


def boundary_counts(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """previous, token, n of the pairs that stand across texts when these are joined in ascending order: with
    bigram_counts, the counts of the stitched stream. Empty texts are passed over."""
    from fabula.operators.order import row_numbers

    ends = df.where(f"{text} <> ''").select(order, F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 1)), 16, 10).cast("int").alias("first"), F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), -1, 1)), 16, 10).cast("int").alias("last"))
    numbered = row_numbers(ends, [order], "i")
    following = numbered.select((F.col("i") - 1).alias("i"), F.col("first").alias("token"))
    return numbered.select("i", F.col("last").alias("previous")).join(following, "i").groupBy("previous", "token").agg(F.count("*").alias("n"))


def unigram_loss(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """targets, uniform, unigram: mean nats of the held-out bytes under the add-one model of the training counts.
    Both are unigram_counts."""
    total = train.agg(F.sum("n").alias("total"))  # one row
    p = heldout.withColumnRenamed("n", "m").join(train, "token", "left").join(F.broadcast(total), F.lit(True))
    nats = -F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + VOCABULARY))
    return p.agg(F.sum("m").alias("targets"), F.ln(F.lit(float(VOCABULARY))).alias("uniform"), (F.sum(F.col("m") * nats) / F.sum("m")).alias("unigram"))


def bigram_loss(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """targets, bigram: mean nats of held-out pairs under the add-one model of the training pairs. Both are
    bigram_counts; a pair that training lacks counts as one."""
    rows = train.groupBy("previous").agg(F.sum("n").alias("total"))  # at most 256 rows
    p = heldout.withColumnRenamed("n", "m").join(train, ["previous", "token"], "left").join(F.broadcast(rows), "previous", "left")
    nats = -F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + VOCABULARY))
    return p.agg(F.sum("m").alias("targets"), (F.sum(F.col("m") * nats) / F.sum("m")).alias("bigram"))


def windowed_loss(heldout: DataFrame, train: DataFrame, id_column: str, context: int, text: str = "text") -> DataFrame:
    """id, window, targets, nats: the summed loss of each non-overlapping window of `context` bytes, the last one
    shorter, under the add-one unigram model; every byte is a target once."""
    n = np.zeros(VOCABULARY)
    for r in train.collect():  # at most 256 rows
        n[r.token] = r.n
    nats = -np.log((n + 1) / (n.sum() + VOCABULARY))
    out = f"{id_column} long, window int, targets int, nats double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, window, targets, loss = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer((text or "").encode(), np.uint8)
                for w, start in enumerate(range(0, len(own), context)):
                    part = nats[own[start : start + context]]
                    ids.append(doc), window.append(w), targets.append(len(part)), loss.append(float(part.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(window, pa.int32()), pa.array(targets, pa.int32()), pa.array(loss, pa.float64())], names=[c.split()[0] for c in out.split(", ")])

    return heldout.select(F.col(id_column).cast("long"), text).mapInArrow(run, out)
