"""Queries that write files into the shared folder and read them again: every source and sink beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import text
from fabula.plans import sql as Q
from fabula.plans.corpus import _ONCE, _RENDER, records
from fabula.plans.registry import Registry
from fabula.session import scratch
from fabula.sources import readers, writers
from fabula.tables import table

registry = Registry()
query = registry.add


@query("SELECT step, loss, lr, tokens_per_second, val_loss FROM train_log")
def log_file_roundtrip(spark, d):
    """The training log as JSON lines, read back with a fixed schema."""
    path = scratch(spark, "log")
    writers.write_jsonl(table(spark, d, "train_log").select("step", "loss", "lr", "tokens_per_second", "val_loss"), path)
    return readers.read_log(spark, path).select("step", "loss", "lr", "tokens_per_second", "val_loss")


@query(f"SELECT t AS text, CAST(count(*) AS BIGINT) AS n FROM (SELECT {Q.strip('p')} AS t FROM (SELECT unnest(string_split(text, '{readers.SEPARATOR}')) AS p FROM documents WHERE text <> '')) WHERE t <> '' GROUP BY t")
def stories_from_separated_files(spark, d):
    """All texts in files with a separator after each, split at every separator, also those inside texts."""
    path = scratch(spark, "stories")
    rows = table(spark, d, "documents").select("text").where("text <> ''")
    rows.write.option("lineSep", readers.SEPARATOR).text(path)
    return readers.read_stories(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT id, summary, array_to_string(words, '|') AS words, sentence, story FROM instruct_records")
def record_file_roundtrip(spark, d):
    """Records as JSON lines without null fields, read back."""
    path = scratch(spark, "records")
    writers.write_jsonl(table(spark, d, "instruct_records").select("id", "summary", "words", "features", "sentence", "story"), path)
    return readers.read_jsonl(spark, path).select("id", "summary", F.array_join("words", "|").alias("words"), "sentence", "story")


@query("SELECT id, story FROM instruct_records WHERE id IN (SELECT id FROM instruct_records WHERE id LIKE 'valid-%')")
def chosen_records_from_file(spark, d):
    """Only the lines of wanted ids are parsed."""
    path = scratch(spark, "records")
    rows = table(spark, d, "instruct_records").select("id", "summary", "words", "features", "sentence", "story")
    writers.write_jsonl(rows, path)
    return readers.read_jsonl_chosen(spark, path, rows.where("id like 'valid-%'")).select("id", "story")


@query("""SELECT CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS token, CAST(count(*) AS BIGINT) AS n FROM (SELECT h, unnest(range(length(h) // 2)) AS i FROM (SELECT hex(encode(text || chr(10))) AS h FROM documents WHERE text <> '')) GROUP BY 1""")
def raw_byte_tokens(spark, d):
    """The bytes of text files as tokens, read range by range."""
    path = scratch(spark, "lines")
    writers.write_lines(table(spark, d, "documents"), path)
    blocks = readers.read_shard(spark, f"{path}/*.txt", "u1")
    return blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT id, length({_RENDER}) AS head, length(story) + 1 AS body FROM {_ONCE} WHERE story <> '')
    SELECT id, CAST(head + body AS INTEGER) AS tokens, CAST(body AS BIGINT) AS loss_tokens, CAST(coalesce(sum(head + body) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r""")
def packed_examples(spark, d):
    """Fine-tuning examples written in order of their ids: tokens (here characters), those that count for the loss, and
    each example's start in the packed stream."""
    encode = lambda c: F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), 1), lambda x: F.ascii(x))
    rows = writers.write_examples(records(spark, d), scratch(spark, "examples"), encode)
    loss = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", F.size("tokens").alias("tokens"), loss.alias("loss_tokens"), F.col("start").cast("long").alias("start"))
