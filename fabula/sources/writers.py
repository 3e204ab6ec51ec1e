"""Writers of records, shards, manifests and reports. Spark's committer makes each write complete or absent."""

from __future__ import annotations

import hashlib
import json
import os
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import text
from fabula.operators.order import running_total
from fabula.sources.readers import read_bytes


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, column: str = "text") -> None:
    """Non-empty texts, one after another."""
    df.select(column).where(F.col(column) != "").write.mode("overwrite").text(path)


def write_tokens(df: DataFrame, path: str, id_column: str) -> None:
    """Token arrays as Parquet, in order of the id over all files."""
    df.repartitionByRange(id_column).sortWithinPartitions(id_column).write.mode("overwrite").parquet(path)


def write_examples(records: DataFrame, path: str, encode, id_column: str = "id") -> DataFrame:
    """Fine-tuning examples: tokens, mask (loss on story and end token only) and start in the packed stream.

    encode: function of a Column of text to a Column of array<int>. The end token is the number 0. Records without a
    story are left out. Returns the rows as written.
    """
    rows = records.where("story <> ''").select(id_column, encode(text.render_prompt()).alias("head"), F.concat(encode(F.col("story")), F.array(F.lit(0))).alias("body"))
    sized = rows.select(id_column, F.concat("head", "body").alias("tokens"), F.concat(F.array_repeat(F.lit(0), F.size("head")), F.array_repeat(F.lit(1), F.size("body"))).cast("array<tinyint>").alias("mask"))
    placed = running_total(sized.withColumn("n", F.size("tokens").cast("long")), [id_column], "n", "start").drop("n")
    write_tokens(placed, path, id_column)
    return records.sparkSession.read.parquet(path)


def write_tokenizer(merges: list[tuple[int, int]], path: str, special: dict[str, int], format: str = "byte-bpe-v1") -> None:
    """A tokenizer file; the ids of merges must be contiguous, with the special tokens after them."""
    known = 256
    for left, right in merges:
        if not (0 <= left < known and 0 <= right < known):
            raise ValueError("a merge uses a token that is not known yet")
        known += 1
    if sorted(special.values()) != list(range(known, known + len(special))):
        raise ValueError("special tokens must follow the merges")
    part = f"{path}.{os.getpid()}.part"  # complete or absent: written beside its place, then renamed
    with open(part, "w", encoding="utf-8") as f:
        json.dump({"format": format, "merges": merges, "special": special}, f)
    os.replace(part, path)


def manifest(row: dict) -> str:
    """Canonical JSON of a one-row summary, with a digest of itself."""
    body = json.dumps(row, sort_keys=True, separators=(",", ":"))
    return json.dumps(row | {"manifest_sha256": hashlib.sha256(body.encode()).hexdigest()}, sort_keys=True, indent=2)


def file_manifest(spark: SparkSession, path: str, **more) -> str:
    """Canonical JSON of the files of a folder with their sizes and SHA-256 digests, further fields, and a digest of
    itself. One entry a file."""
    files = read_bytes(spark, path).orderBy("file").collect()
    entries = [{"file": os.path.basename(f.file), "bytes": f.length, "sha256": f.sha256} for f in files]
    return manifest(more | {"files": entries, "bytes": sum(f["bytes"] for f in entries)})


def checked_manifest(body: str) -> dict:
    """The fields of a manifest; raises if its digest isn't that of its content."""
    row = json.loads(body)
    said = row.pop("manifest_sha256", None)
    if json.loads(manifest(row))["manifest_sha256"] != said:
        raise ValueError("the manifest was changed after it was written")
    return row


def environment(spark: SparkSession) -> dict:
    """What a result was made with: versions, master, parallelism and the settings that shape plans."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")
    context = spark.sparkContext
    return {"spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "master": context.master, "parallelism": context.defaultParallelism} | {k: spark.conf.get(k, None) for k in keys}


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; raises if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
