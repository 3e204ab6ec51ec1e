"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.operators import bpe
from fabula.sources import readers, writers
from fabula.streaming import logs

CORPUS = "\nOne day.\n<|endoftext|>\n\n   \n<|endoftext|>\nCafé ✓\nline<|endoftext|>last"
RECORDS = "Summary: s\nWords: a, b\nStory: One.\n<|endoftext|>\nStory: x <|endoftext|> y\nSummary: t\n  <|endoftext|>  \nWords: none\n<|endoftext|>\nStory: end"


@pytest.mark.parametrize("size", ["16", "128m"])
def test_stories(spark, tmp_path, size):
    (tmp_path / "c.txt").write_text(CORPUS, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert sorted(r.text for r in readers.read_stories(spark, str(tmp_path / "c.txt")).collect()) == ["Café ✓\nline", "One day.", "last"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records(spark, tmp_path):
    (tmp_path / "r.txt").write_text(RECORDS, encoding="utf-8")
    rows = readers.read_records(spark, str(tmp_path / "r.txt")).orderBy("record").collect()
    assert [(r.summary, r.story) for r in rows] == [("s", "One."), ("t", "x <|endoftext|> y"), (None, "end")]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("﻿" + json.dumps({"id": "a", "words": ["w"], "story": "s"}) + "\n\n" + json.dumps({"id": "b"}) + "\n", encoding="utf-8")
    rows = readers.read_jsonl(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.words, r.story) for r in rows] == [("a", ["w"], "s"), ("b", None, None)]
    chosen = spark.createDataFrame([("b",)], "id string")
    assert [r.id for r in readers.read_jsonl_chosen(spark, str(path), chosen).collect()] == ["b"]
    writers.write_jsonl(readers.read_jsonl(spark, str(path)), str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out")).count() == 2


def test_shards_and_tokenizer(spark, tmp_path):
    np.arange(70_000, dtype="<u2")[:70_000].tofile(tmp_path / "t.bin")
    rows = readers.read_shard(spark, str(tmp_path / "t.bin")).orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 65536] and sum(len(r.tokens) for r in rows) == 70_000
    merges = [(97, 98), (256, 99)]
    writers.write_tokenizer(merges, str(tmp_path / "tok.json"), {"<|endoftext|>": 258})
    assert readers.read_tokenizer(spark, str(tmp_path / "tok.json")) == merges
    with pytest.raises(ValueError):
        writers.write_tokenizer([(97, 300)], str(tmp_path / "bad.json"), {})
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    assert readers.merges_from_ranks(ranks) == merges


def test_examples(spark, tmp_path):
    records = spark.createDataFrame([("b", "S", "xy"), ("a", None, "z"), ("c", None, "")], "id string, summary string, story string").selectExpr("*", "array('w') AS words", "cast(null as array<string>) AS features", "cast(null as string) AS sentence")
    encode = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    rows = writers.write_examples(records, str(tmp_path / "e"), encode).orderBy("id").collect()
    assert [r.id for r in rows] == ["a", "b"] and rows[0].start == 0 and rows[1].start == len(rows[0].tokens)
    for r, story in zip(rows, ["z", "xy"]):
        assert sum(r.mask) == len(story) + 1 and r.tokens[-1] == 0 and len(r.mask) == len(r.tokens)


def test_results_and_digest(spark, tmp_path):
    doc = {"environment": {"cpu": "x"}, "runs": [{"policy": "static", "per_request": [{"id": "r1", "status": "completed"}]}, {"policy": "chunked", "per_request": None}]}
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=1))
    assert [r.policy for r in readers.read_results(spark, str(tmp_path / "b.json")).collect()] == ["static", "chunked"]
    assert len(readers.read_bytes(spark, str(tmp_path / "b.json")).first().sha256) == 64


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double").orderBy("k")
    assert writers.markdown(df) == "| k | v |\n|---|---|\n| a | 0.5000 |\n| b |  |\n"
    with pytest.raises(ValueError):
        writers.markdown(df, most=1)
    assert writers.environment(spark)["spark"] == spark.version
    assert json.loads(writers.manifest({"b": 1, "a": 2}))["a"] == 2


def test_stages_resume(spark, tmp_path):
    stages = {"one": lambda s, done: s.range(3), "two": lambda s, done: s.read.parquet(done["one"]).where("id > 0")}
    assert logs.run_stages(spark, stages, str(tmp_path)) == ["one", "two"]
    assert logs.run_stages(spark, stages, str(tmp_path)) == []
    (tmp_path / "two" / "_SUCCESS").unlink()
    assert logs.run_stages(spark, stages, str(tmp_path)) == ["two"]
    assert spark.read.parquet(str(tmp_path / "two")).count() == 2


def test_encoded_counts_agree(spark):
    df = spark.createDataFrame([(1, "the cat the hat"), (2, None), (3, "")], "doc_id long, text string")
    merges = bpe.learn_merges(bpe.chunk_counts(df), 10)
    long = bpe.encoded(df, merges, "doc_id").select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = bpe.encoded_counts(bpe.chunk_counts(df), merges)
    assert {(r.token, r[1]) for r in long.collect()} == {(r.token, r.n) for r in counts.collect()}
    assert bpe.learn_merges(bpe.chunk_counts(df), 10, most_bytes=1) == merges  # the bound of one process changes nothing


def test_log(spark, tmp_path):
    lines = ['{"step": 1, "loss": 2.5}', "started", '{"step": 2, "loss": 2.25, "val_loss": 3.0}', '{"step": 2, "loss": 2.0}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    rows = readers.read_log(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.line, r.step, r.loss, r.val_loss) for r in rows] == [(0, 1, 2.5, None), (2, 2, 2.25, 3.0), (3, 2, 2.0, None)]
    from fabula.streaming import logs

    assert logs.finish(readers.read_log(spark, str(tmp_path), stream=True), "append").count() == 3


@pytest.mark.parametrize("dtype,width", [("u1", 1), ("<u2", 2)])
def test_shard_of_many_ranges(spark, tmp_path, dtype, width):
    body = bytes(range(256)) * 5 + b"\x07" * width
    (tmp_path / "x.bin").write_bytes(body)
    rows = readers.read_shard(spark, str(tmp_path), dtype, rows=100).orderBy("pos").collect()
    assert [t for r in rows for t in r.tokens] == np.frombuffer(body, dtype).tolist() and len(rows) > 5
    assert rows[1].pos == 100


def test_manifest_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    body = writers.file_manifest(spark, str(tmp_path), split="train")
    row = writers.checked_manifest(body)
    assert row["bytes"] == 6 and [f["sha256"] for f in row["files"]] == [hashlib.sha256(x).hexdigest() for x in (b"one", b"two")]
    with pytest.raises(ValueError):
        writers.checked_manifest(body.replace("train", "valid"))


def test_separators_of_a_file_in_many_splits(spark, tmp_path):
    """A separator inside a line is text, wherever the reader cuts the file."""
    sep = readers.SEPARATOR
    stories = [f"story {i} with {sep} inside\nand a second line {i}" if i % 7 == 0 else f"story {i}\nmore" for i in range(200)]
    (tmp_path / "s.txt").write_text(f"\n{sep}\n".join(stories))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = readers.read_separated(spark, str(tmp_path / "s.txt")).orderBy("record").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.text for r in rows] == stories
