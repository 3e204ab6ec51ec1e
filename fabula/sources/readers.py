"""Readers of corpora, records, logs, results, shards and tokenizers. Schemas are explicit, never inferred."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import text
from fabula.operators.order import keyed_scan
from fabula.session import materialize

SEPARATOR = "<|endoftext|>"
RECORD = "id string, summary string, words array<string>, features array<string>, sentence string, story string"
SAMPLE = "id string, sample int, story string, finished boolean"
LOG = "step long, loss double, lr double, tokens_per_second double, val_loss double"
REQUEST = "array<struct<id: string, status: string, reason: string, prompt_tokens: int, output_tokens: int, queue_wait_ms: double, ttft_ms: double>>"
RESULT = f"environment map<string, string>, runs array<struct<policy: string, workload: string, arrival_rate: double, seed: int, per_request: {REQUEST}>>"
TOKENIZER = "format string, pattern string, merges array<array<int>>, special map<string, int>"


def read_stories(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """text of each story of separated text files: split anywhere at the separator, stripped, blanks dropped. The
    file is read in splits, whatever its size."""
    rows = spark.read.option("lineSep", separator).text(path).select(text.strip("value").alias("text"))
    return rows.where("text <> ''")


def read_separated(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """text of each record of separated text files; a separator counts only if it is alone on its line.

    The reader splits everywhere, and pieces whose separator stood inside a line are joined again: a piece begins a
    record if the piece before ends, and it begins, with the line. Row order is that of the files. Pieces are numbered
    along one line of all files, so a file of any size is many tasks; only the two marks of a piece are moved for
    that, and only pieces that belong together are grouped.
    """
    rows = spark.read.option("lineSep", separator).text(path)
    blank = f"[{text.SPACE}&&[^\n]]*"
    ends = (F.col("value").rlike(rf"(^|\n){blank}\z") | (F.col("value") == "")).cast("int")
    begins = F.col("value").rlike(rf"^{blank}(\n|\z)").cast("int")
    placed = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), ends.alias("ends"), begins.alias("begins"), "value")
    placed = materialize(placed, "pieces")  # the numbers must not be made twice
    marks = keyed_scan(placed.drop("value"), ["file"], ["block", "n"], "ends", "before", how="last", exclusive=True)
    new = F.when(F.col("before").isNull() | (F.col("before") == 1) & (F.col("begins") == 1), 1).otherwise(0)
    numbered = keyed_scan(marks.select("file", "block", "n", new.cast("long").alias("new")), ["file"], ["block", "n"], "new", "record")
    pieces = placed.select("file", "block", "n", "value").join(numbered.select("n", "record"), "n")
    grouped = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("v"))
    joined = grouped.select("file", "record", text.strip(F.array_join("v.value", separator)).alias("text"))
    return joined.where("text <> ''").select("file", F.col("record").cast("long").alias("record"), "text")


def read_records(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """Instruction records of separated, labelled text; those without a story are dropped."""
    parsed = read_separated(spark, path, separator).where(F.col("text").contains("Story:")).select("file", "record", text.parse_record("text").alias("r"))
    return parsed.where("r is not null").select("file", "record", "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Rows of JSON lines; a byte-order mark and blank lines are passed over."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(text.strip("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_jsonl_chosen(spark: SparkSession, path: str, chosen: DataFrame, schema: str = RECORD, key: str = "id") -> DataFrame:
    """Only the JSON lines whose key is in `chosen`; the rest is dropped before it is parsed."""
    lines = spark.read.text(path).select(F.get_json_object(F.regexp_replace("value", "^﻿", ""), f"$.{key}").alias(key), "value")
    kept = lines.join(chosen.select(key).distinct(), key, "left_semi")
    return kept.select(F.from_json(F.regexp_replace("value", "^﻿", ""), schema).alias("r")).select("r.*")


def read_parquet_text(spark: SparkSession, *paths: str) -> DataFrame:
    """The non-empty texts of Parquet files; only this column is read."""
    return spark.read.parquet(*paths).select("text").where("text <> ''")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The runs of nested benchmark results, one row for each run, with the file's name."""
    results = spark.read.schema(RESULT).option("multiLine", True).json(path)
    return results.select(F.col("_metadata.file_path").alias("file"), F.explode("runs").alias("run")).select("file", "run.*")


def read_log(spark: SparkSession, path: str, schema: str = LOG, stream: bool = False) -> DataFrame:
    """file, line and the fields of training logs in JSON lines; lines that are no JSON object are left out. line is the
    place of the line among those of its file. stream: the files as a stream, without lines' places."""
    if stream:
        rows = spark.readStream.text(path)
        parsed = rows.select(F.from_json("value", schema).alias("r"), "value")
        return parsed.where(F.col("value").rlike(r"^\s*\{") & F.col("r").isNotNull()).select("r.*")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.lit(1).cast("long").alias("one"), "value")
    placed = keyed_scan(rows, ["file"], ["block", "n"], "one", "line", exclusive=True)
    parsed = placed.where(F.col("value").rlike(r"^\s*\{")).select("file", "line", F.from_json("value", schema).alias("r"))
    return parsed.where("r is not null").select("file", "line", "r.*")


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """file, at, n: byte ranges of `size` bytes of all files; their content isn't read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    parts = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("at"))
    return parts.select("file", "at", F.least(F.lit(size).cast("long"), F.col("length") - F.col("at")).alias("n"))


def read_shard(spark: SparkSession, path: str, dtype: str = "<u2", rows: int = 1 << 16) -> DataFrame:
    """file, pos, tokens: flat binary files of tokens as blocks of `rows` tokens, each read as a range of bytes, so a
    file of any size is many tasks. With dtype "u1" the raw bytes of a file are its tokens. An incomplete last token
    is left out."""
    kind = np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n"))):
                system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_file(place) as f:
                    raw = f.read_at(n, at)
                tokens = np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], kind).astype(np.int32)
                if len(tokens):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at // kind.itemsize], pa.int64()), pa.array([tokens], pa.list_(pa.int32()))], names=["file", "pos", "tokens"])

    parts = _ranges(spark, path, rows * kind.itemsize)
    return parts.repartition(F.col("file"), F.col("at")).mapInArrow(run, "file string, pos long, tokens array<int>")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """file, length, sha256 of raw files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def read_tokenizer(spark: SparkSession, path: str, expected: str = "byte-bpe-v1") -> list[tuple[int, int]]:
    """The merges of a tokenizer file, with its format checked."""
    row = spark.read.schema(TOKENIZER).option("multiLine", True).json(path).first()
    if row is None or row.format != expected:
        raise ValueError(f"{path} is no tokenizer of format {expected}")
    return [(m[0], m[1]) for m in row.merges]


def merges_from_ranks(ranks: dict[bytes, int]) -> list[tuple[int, int]]:
    """The merge list of a public vocabulary given as ranks of byte strings, single bytes first."""
    order = sorted(ranks, key=ranks.get)
    number = {bytes([i]): i for i in range(256)}
    merges: list[tuple[int, int]] = []
    for token in order:
        if len(token) == 1:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        merges.append((number[parts[0]], number[parts[1]]))
        number[token] = 255 + len(merges)
    return merges
