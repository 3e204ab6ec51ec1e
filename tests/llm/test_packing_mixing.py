"""Packing and mixing: nothing is lost, split or repeated too often, and the shares are met."""

import datetime as dt
import random

import numpy as np
import pytest

from fabula.llm import hilbert, mixing, packing

NOW = dt.datetime(2025, 1, 1)


def check_packing(rows, sizes, capacity):
    fill, pieces = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.size
        pieces.setdefault(r.item, []).append(r.size)
    assert {k: sum(v) for k, v in pieces.items()} == sizes
    assert max(fill.values(), default=0) <= capacity
    assert all(r.container_fill == fill[r.container] for r in rows)
    for item, parts in pieces.items():
        assert len(parts) == max(1, -(-sizes[item] // capacity)), item
    return fill


@pytest.mark.parametrize("per_partition", [50, 10_000])
def test_packing(spark, per_partition):
    r = random.Random(1)
    rows = [(f"i{k}", NOW, r.choice([1, 3, 40, 55, 99, 100, 101, 250]), f"w{k % 7} x") for k in range(400)]
    sizes = {i: s for i, _, s, _ in rows}
    rows += [rows[0], (None, NOW, 5, "x"), ("z", NOW, 0, "x"), ("n", NOW, None, None)]
    df = spark.createDataFrame(rows, "item string, v timestamp, size long, text string").repartition(5)
    got = packing.packed_items(df, 100, items_per_partition=per_partition).collect()
    fill = check_packing(got, sizes, 100)
    assert len(fill) <= 1.1 * sum(sizes.values()) / 100 + 400 / per_partition + 1
    assert packing.packed_items(df.limit(0), 100).count() == 0


def test_fill_of_many_small_items(spark):
    r = random.Random(2)
    rows = [(f"i{k}", NOW, r.randint(1, 60), f"w{k % 50}") for k in range(3000)]
    got = packing.packed_items(spark.createDataFrame(rows, "item string, v timestamp, size long, text string"), 512)
    report = packing.packing_report(got, 512).first()
    assert report.mean_fill > 0.99 and report.pieces == 3000


def test_items(spark):
    records = spark.createDataFrame([("a", "é", NOW, 3), ("a", "éé", NOW + dt.timedelta(1), 3), ("b", None, NOW, 3), (None, "x", NOW, 3)], "id string, story string, loaded_at timestamp, size long")
    assert [(r.item, r.size) for r in packing.packed_items(packing.story_items(records), 2048).collect()] == [("a", 4)]
    request = "array<struct<id: string, status: string, prompt_tokens: int>>"
    runs = spark.createDataFrame([(1, "p", "w", [("r1", "completed", 5), ("r1", "completed", 5), ("r2", None, None), ("r3", "x", 0)]), (1, "p", "w", [("r1", "completed", 5)]), (2, None, None, [("r1", "completed", 600)]), (3, "p", "w", None)], f"bench_id long, policy string, workload string, per_request {request}")
    got = packing.packed_items(packing.request_items(runs), 512).collect()
    assert sorted((r.item, r.piece, r.size) for r in got) == [("1:r1", 0, 5), ("2:r1", 0, 512), ("2:r1", 1, 88)]


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert(dimensions, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    key = hilbert.hilbert_key(points, bits).astype(int)
    assert sorted(key) == list(range(len(points)))
    path = points[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # neighbours on the curve are neighbours in space


def documents(spark, n=600, seed=4):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        s = r.choices(["a", "b", "c", "x"], [6, 3, 0.3, 1])[0]
        s = r.choice([s, s.upper(), f" {s} "])
        rows.append((k, " ".join(r.choices("the cat sat on a mat und der Hund war nicht hier longword another".split(), k=r.randint(1, 60))), "en", s, "source"))
    rows += [(9001, None, None, "a", ""), (9002, "", None, "a", ""), (9003, "text", None, None, ""), (None, "text", None, "a", ""), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string")


def test_mixture(spark):
    targets = spark.createDataFrame([("A", 0.5, 1), ("b ", 0.3, 2), ("c", 0.1, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares, _ = mixing.mixture(documents(spark), targets)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b", "c"}
    most = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.repeats <= most[r.source] for r in rows)
    got = {r.source: r for r in shares.collect()}
    assert got["gone"].actual_share == 0 and got["gone"].reachable_share == 0
    for s in "abc":
        assert got[s].actual_share == pytest.approx(got[s].reachable_share, abs=0.02)
        assert got[s].taken_tokens == sum(r.tokens * r.repeats for r in rows if r.source == s)
    again = mixing.mixture(documents(spark).repartition(7), targets)[0].collect()
    assert {(r.doc_id, r.repeats) for r in again} == {(r.doc_id, r.repeats) for r in rows}


def test_mixture_beyond_what_is_there(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("c", 0.5, 3), ("b", 0.3, 0), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    chosen, shares, _ = mixing.mixture(documents(spark), targets, total_tokens=10_000)
    got = {r.source: r for r in shares.collect()}
    assert got["c"].taken_tokens == 3 * got["c"].available_tokens and got["c"].actual_share < 0.5
    empty = mixing.mixture(documents(spark).limit(0), targets)
    assert empty[0].count() == 0 and {r.actual_share for r in empty[1].collect()} == {0.0}


def cells(seed):
    r = np.random.default_rng(seed)
    labels = tuple(x.ravel() for x in np.meshgrid(np.arange(3), np.arange(2), np.arange(4)))
    return r, labels, r.uniform(1, 9, len(labels[0]))


@pytest.mark.parametrize("most", [100.0, 1.35])
def test_raking(most):
    """All goals are met, with caps that bind or not; and the weights aren't those that sources alone would give."""
    r, labels, tokens = cells(1)
    true = r.uniform(0.5, 2, 3)[labels[0]] * r.uniform(0.5, 2, 2)[labels[1]] * r.uniform(0.5, 2, 4)[labels[2]]
    true = np.minimum(true, most)
    goals = tuple(np.bincount(x, weights=true * tokens) for x in labels)
    got = mixing.rake(tokens, labels, goals, np.full(len(tokens), most))
    for x, goal in zip(labels, goals):
        assert np.bincount(x, weights=got * tokens) == pytest.approx(goal, rel=1e-6)
    assert got.max() <= most + 1e-12 and (most > 2 or np.isclose(got, most).any())
    alone = (goals[0] / np.bincount(labels[0], weights=tokens))[labels[0]]
    assert np.abs(got / alone - 1).max() > 0.2


def test_raking_beyond_the_caps():
    r, labels, tokens = cells(2)
    goals = tuple(np.bincount(x, weights=r.uniform(1, 3) * tokens) for x in labels)
    got = mixing.rake(tokens, labels, goals, np.full(len(tokens), 1.0))
    assert got == pytest.approx(np.ones(len(tokens)))


def test_mixture_by_language_and_topic(spark):
    """Asked shares of languages and topics come out beside those of the sources."""
    r = random.Random(6)
    rows = []
    for k in range(3000):
        source = r.choices(["a", "b"], [3, 1])[0]
        lang = r.choices(["en", "de"], [4, 1] if source == "a" else [1, 1])[0]
        words = "the dog and the cat were with her".split() if lang == "en" else "der Hund und die Katze waren nicht hier".split()
        words += r.choice([["cake", "bread", "soup", "milk"], ["river", "forest", "rain", "snow"]])
        rows.append((k, " ".join(words * r.randint(1, 4)), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    languages = spark.createDataFrame([("en", 0.6), ("de", 0.4), ("fi", 0.2)], "lang string, target_share double")
    chosen, _, marginals = mixing.mixture(docs, targets, 40_000, languages=languages)
    got = {(m.kind, m.name): m for m in marginals.collect()}
    assert got["lang", "en"].target_share == pytest.approx(0.6)
    for m in got.values():
        assert m.fitted_share == pytest.approx(m.target_share, abs=1e-6) and m.actual_share == pytest.approx(m.target_share, abs=0.03)
    assert chosen.agg({"repeats": "max"}).first()[0] <= 3


def test_topics():
    assert mixing.topic("the baker had a cake and bread".split()) == "food" and mixing.topic([]) == "other"
