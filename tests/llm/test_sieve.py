"""The sieve before the search loses no pair and leaves out most texts without a partner."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.functions.words import split_words
from fabula.llm import overlap, sieve

HELD = "not startswith(id, 'train')"


def grams(text):
    w = split_words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def collection(seed, n=400):
    """Texts of sentences out of few patterns, a sixth of them edited copies of others, a few very short or repeated."""
    r = random.Random(seed)
    patterns = [[f"w{r.randrange(300)}" for _ in range(12)] for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.17:
            w = r.choice(texts).split()
            for _ in range(r.randrange(8)):
                w[r.randrange(len(w))] = f"w{r.randrange(300)}"
            w = w[: r.randrange(len(w) * 2 // 3, len(w)) + 1] if r.random() < 0.3 else w
        else:
            w = [x if r.random() < 0.7 else f"w{r.randrange(300)}" for _ in range(r.choice([1, 3, 8, 16])) for x in r.choice(patterns)]
        texts.append(" ".join(w))
    texts += ["w1 w2 w3", "w1 w2 w3 w4", "w1 w2 w3 " * 40, "w1 w2", ""]
    return [(f"{r.choice(['train', 'train', 'train', 'valid', 'test'])}-{i}", t, 1) for i, t in enumerate(texts * 2)]


@pytest.mark.parametrize("seed,least,places,texts", [(1, 0.7, 10**6, 10**6), (2, 0.7, 300, 10**6), (3, 0.55, 300, 40), (4, 0.9, 10**6, 25)])
def test_no_pair_is_lost(spark, seed, least, places, texts):
    rows = spark.createDataFrame(collection(seed), "id string, text string, v int").repartition(3)
    got = collection(seed)
    sides = rows.select(F.xxhash64("text").alias("h"), "text", F.expr(HELD).alias("held"))
    prepare = overlap._prepare(3, 50)
    held = sides.where("held").mapInArrow(prepare, overlap._TEXT).dropDuplicates(["h"]).cache()
    found = sieve.partners(sides.where("not held"), held, prepare, 3, least, places, texts)
    found = {(x.kind, x.h) for x in found.collect()}
    h = dict(sides.select("text", "h").distinct().collect())
    g = {t: grams(t) for _, t, _ in got}
    want = set()
    for a in {t for i, t, _ in got if i.startswith("train")}:
        for b in {t for i, t, _ in got if not i.startswith("train")}:
            if g[a] and g[b] and len(g[a] & g[b]) >= least * len(g[a] | g[b]) - 1e-9:
                want |= {(1, h[a]), (0, h[b])}
    assert want and want <= found and len(found) < 1.5 * len(want) + 20


@pytest.mark.parametrize("shard,most_ids", [(10**6, 10), (2000, 10), (2000, 10**6)])
def test_search_behind_the_sieve(spark, monkeypatch, shard, most_ids):
    """Beyond one shard only texts that can have a partner are indexed; the pairs are the same."""
    rows = collection(7)
    texts = {i: grams(t) for i, t, _ in rows}
    want = {(a, b) for a in texts for b in texts if a.startswith("train") and not b.startswith("train") and texts[a] and texts[b] and len(texts[a] & texts[b]) >= 0.7 * len(texts[a] | texts[b]) - 1e-9}
    called = []
    real = sieve.partners
    monkeypatch.setattr(sieve, "partners", lambda *a: called.append(1) or real(*a))
    got = overlap.overlapping_ids(spark.createDataFrame(rows, "id string, text string, v int").repartition(3), HELD, id_column="id", text_column="text", version="v", size=3, least=0.7, shard_words=shard, most_ids=most_ids).collect()
    assert {(x.train_id, x.held_id) for x in got} == want and len(got) == len(want) and bool(called) == (shard < 10**6)


def test_order_is_that_of_held_out_counts(spark):
    held = spark.createDataFrame([(f"a b c d{i}",) for i in range(50)], "words string").repartition(4)
    level = sieve.levels(held, 3, 16)
    doc, h = sieve._shingles(["a b c d1"], 3)
    some = level[(h & np.uint64(0xFFFF)).astype(int)].tolist()
    assert some == [round(8 * np.log2(51)), 8]
