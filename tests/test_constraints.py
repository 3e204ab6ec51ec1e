"""Joins and reports of the constraint engine on small tables with nulls and clashing names."""

import pytest
from pyspark.sql import functions as F

from fabula.functions import constraints as C
from fabula.functions import text
from fabula.functions.inflection import forms
from fabula.plans import constraints as P

PROMPT = "id string, words array<string>, features array<string>, sentence string"


def test_strict_join_raises_at_an_unknown_id(spark):
    prompts = spark.createDataFrame([("a", ["dog"], [], None)], PROMPT)
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    assert [r.n for r in P.known(prompts, rows).collect()] == [1]
    assert [r.n for r in P.known(prompts, rows.where("n = 1"), "raise").collect()] == [1]
    for bad in ("n = 2", "n = 3"):
        with pytest.raises(Exception, match="no prompt has the id"):
            P.known(prompts, rows.where(bad), "raise").collect()


def test_missing_stories(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = spark.createDataFrame([("r", "a", "text"), ("r", "b", None), ("s", "b", "text"), (None, "a", "text")], "run_id string, id string, story string")
    got = {(r.run_id, r.id) for r in P.missed(rows, prompts).collect()}
    assert got == {("r", "b"), ("s", "a"), (None, "b")}
    assert P.missed(rows.limit(0), prompts).count() == 0


def test_forms_of_lists(spark):
    """Every row keeps its words and gets their forms, in order, also for null and empty lists and entries."""
    rows = [(1, ["dog", "Run"]), (2, None), (3, []), (4, ["", None, "fly"]), (5, ["dog", "Run"])]
    df = spark.createDataFrame(rows, "k int, words array<string>")
    got = {r.k: (r.words, r.forms) for r in C.with_forms(df).collect()}
    assert {k: w for k, (w, _) in got.items()} == dict(rows)
    assert len(got[1][1]) == 2 and "ran" in got[1][1][1] and got[2][1] == got[3][1] == [] and "flown" in got[4][1][0] and got[1][1] == got[5][1]


def test_check_is_the_same_with_forms_made_before(spark):
    rows = [(["dog", "x-ray", None], ["Dialogue"], "He ran home.", '"Dogs," he said. He  ran home! X-rays.'), ([], None, "", None), (["fly"], [], None, "It flew.")]
    df = spark.createDataFrame(rows, "words array<string>, features array<string>, sentence string, story string").withColumn("forms", F.transform(text.filled("words"), forms))
    columns = C.check("words", "features", "sentence", "story"), C.check("words", "features", "sentence", "story", "forms")
    for r in df.select(*(c.alias(n) for c, n in zip(columns, "ab"))).collect():
        assert r.a == r.b
    mentions = df.select(C.word_mentions("words", "story").alias("a"), C.word_mentions("words", "story", "forms").alias("b")).collect()
    assert all(m.a == m.b for m in mentions) and mentions[2].a == 1.0


def test_short_sizes(spark):
    df = spark.createDataFrame([(950,), (1500,), (2_000_000,), (3_100_000_000,), (None,)], "n long")
    assert [r.s for r in df.select(text.short_size("n").alias("s")).collect()] == ["950", "1.5k", "2.0M", "3.1G", None]


def test_gram_hashes_repeat_where_grams_do(spark):
    df = spark.createDataFrame([("a b c d a b c d",), ("a b",), ("",), (None,)], "t string")
    got = [r.r for r in df.select(text.repetition("t").alias("r")).collect()]
    assert got == [pytest.approx(0.2), 0.0, 0.0, None]
