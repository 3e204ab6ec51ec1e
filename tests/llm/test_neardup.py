"""Near-duplicates, overlaps across splits and leaks against brute force; signatures against exact similarity."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.functions.words import split_words
from fabula.llm import bagminhash, components, fmindex, leak, neardup, overlap

NOW = dt.datetime(2025, 1, 1)
SCHEMA = "id string, story string, source string, loaded_at timestamp, h long, text string"


def story(r, n=80, pool=400):
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def edit(r, text, edits):
    w = text.split()
    for _ in range(edits):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], ["new%d" % r.randrange(99)], [w[i], "more"]])
    return " ".join(w)


def collection(seed, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = rows[r.randrange(len(rows))][1] if rows and r.random() < 0.5 else None
        text = story(r) if base is None else r.choice([base, base.upper(), edit(r, base, 1), edit(r, base, 4), edit(r, base, 12)])
        rows.append((f"{r.choice(['train', 'train', 'valid', 'test'])}-{i:04d}", text, r.choice(["a", " A", None]), NOW, 1, "clash"))
    rows += [("train-8001", None, None, NOW, 1, ""), ("valid-8002", "", "a", NOW, 1, ""), ("valid-8003", "one two", "a", NOW, 1, ""), ("train-8004", "one two", "a", NOW, 1, "")]
    rows += [(None, rows[0][1], "a", NOW, 1, ""), rows[1], ("other-1", rows[2][1], "a", NOW, 1, "")]
    return rows


def grams(text, size):
    w = split_words(text)
    return set(zip(*(w[i:] for i in range(size))))


def sim(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def bag_sim(a, b):
    """Similarity of the multisets of all runs of three words."""
    x, y = (Counter(zip(*(split_words(t)[i:] for i in range(3)))) for t in (a, b))
    return (x & y).total() / (x | y).total() if x and y else 0.0


def brute_groups(rows, size, least, measure=None):
    texts = {i: grams(t, size) for i, t, *_ in rows if i and t is not None}
    label = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    if measure:
        texts = {i: t for i, t, *_ in rows if i and t is not None}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (measure or sim)(texts[a], texts[b]) >= least]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    linked = {x for l in links for x in l}
    return {(i, label[i]) for i in linked}


@pytest.mark.parametrize("seed,size,least", [(1, 3, 0.5), (2, 5, 0.8), (3, 3, 0.5)])
def test_groups(spark, seed, size, least):
    rows = collection(seed)
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size, least=least, flush=40)
    want = brute_groups([r for r in rows if r[0]], size, least)
    assert {(r.id, r.group_id) for r in got.collect()} == want


def looping(r, n):
    """Texts that repeat a passage, more or less often; between two of them sets and multisets differ."""
    out = []
    for i in range(n):
        head, loop = story(r, 40), story(r, 12)
        out += [head + (" " + loop) * k for k in r.sample([1, 2, 6, 7, 30], 3)]
    return [(f"train-5{i:04d}", t, "a", NOW, 1, "") for i, t in enumerate(out)]


@pytest.mark.parametrize("multisets", [False, True])
def test_groups_of_multisets_and_sets(spark, multisets):
    rows = looping(random.Random(8), 40) + collection(4, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_groups([r for r in rows if r[0]], 3, 0.6, bag_sim if multisets else None)
    got = {(r.id, r.group_id) for r in neardup.near_duplicate_groups(df, size=3, least=0.6, multisets=multisets, most_bytes=0).collect()}
    assert got == want


def test_groups_of_nothing(spark):
    df = spark.createDataFrame(collection(4, 3), SCHEMA)
    assert neardup.near_duplicate_groups(df.limit(0)).count() == 0


def test_overlaps_of_sets_and_multisets():
    r = random.Random(2)
    texts = [t for _, t, *_ in looping(r, 6)] + ["", "one two"]
    pairs = np.array([[i, j] for i in range(len(texts)) for j in range(i)])
    bag, set_ = neardup.overlaps(pairs, texts, 3)
    for (i, j), x, y in zip(pairs.tolist(), bag, set_):
        assert x == pytest.approx(bag_sim(texts[i], texts[j])) and y == pytest.approx(sim(grams(texts[i], 3), grams(texts[j], 3)))


@pytest.mark.parametrize("seed,size,least,shard", [(1, 3, 0.7, 10**6), (2, 3, 0.7, 500), (3, 5, 0.8, 2000)])
def test_overlaps(spark, seed, size, least, shard):
    rows = collection(seed)
    held = "case substring_index(id, '-', 1) when 'train' then false when 'valid' then true when 'test' then true end"
    got = overlap.overlapping_ids(spark.createDataFrame(rows, SCHEMA).repartition(3), held, size=size, least=least, shard_words=shard, block_bytes=20_000).collect()
    texts = {i: grams(t, size) for i, t, *_ in rows if i and t}
    want = {(a, b) for a in texts for b in texts if a.startswith("train") and b[:4] in ("vali", "test") and sim(texts[a], texts[b]) >= least}
    assert {(r.train_id, r.held_id) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.similarity == pytest.approx(sim(texts[r.train_id], texts[r.held_id])) and r.longest_run <= r.shared_words


def test_overlap_report(spark):
    df = spark.createDataFrame(collection(1), SCHEMA)
    held = "not startswith(id, 'train')"
    pairs = overlap.overlapping_ids(df, held, size=3, least=0.7)
    report = overlap.overlap_report(df, held, "substring_index(id, '-', 1)", "source", size=3, least=0.7).collect()
    assert sum(r.pairs for r in report) == pairs.count() and {r.source for r in report} <= {"a", "(none)"}
    assert overlap.overlapping_ids(df.limit(0), held).count() == 0
    assert overlap.overlap_report(df.limit(0), held, "substring_index(id, '-', 1)", "source").count() == 0


def test_hot_class_of_overlaps(spark):
    """A text that many ids of both parts have is several keys, and loses no pair."""
    pairs = spark.createDataFrame([(1, 2, 1.0), (3, 4, 0.8)], "train long, held long, similarity double")
    members = spark.createDataFrame([(f"t{i}", 1) for i in range(40)] + [("u", 3)], "id string, h long")
    got = overlap._spread(pairs, members, "train", 7).collect()
    assert {(r.train_id, r.held) for r in got} == {(f"t{i}", 2) for i in range(40)} | {("u", 4)} and len(got) == 41


@pytest.mark.parametrize("small", [10**6, 0])
def test_leaks(spark, small):
    r = random.Random(7)
    items = [(i, story(r, r.choice([8, 12, 30]), 60)) for i in range(30)] + [(98, None), (None, "a b c d e f g h i j"), (99, "")]
    docs = []
    for k in range(60):
        text = story(r, 40, 60)
        if k % 2:
            w = items[r.randrange(30)][1].split()
            n = r.choice([9, 10, len(w)])
            i = r.randrange(max(1, len(w) - n + 1))
            text = text + " " + " ".join(w[i : i + n]).upper() + ". " + story(r, 5, 60)
        docs.append((k, text, "x"))
    docs += [(500, None, None), (501, "", None), (502, "short", None), docs[1], (None, items[0][1], None)]
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.run_words for x in leak.leaked_items(a, b, small=small).collect()}
    want = {(d, i) for d, t, _ in docs if d is not None for i, u in items if i is not None and grams(t, 10) & grams(u, 10)}
    assert set(got) == want and min(got.values(), default=10) >= 10
    assert leak.leaked_items(a.limit(0), b).count() == 0 and leak.leaked_items(a, b.limit(0)).count() == 0


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    n, m = 40, 4096
    for shared, weights in ((60, False), (20, True), (90, True)):
        a = np.concatenate([np.arange(shared), 1000 + np.arange(n)]).astype(np.uint64)
        b = np.concatenate([np.arange(shared), 2000 + np.arange(n)]).astype(np.uint64)
        wa, wb = (r.integers(1, 9, len(a)), r.integers(1, 9, len(b))) if weights else (np.ones(len(a), np.int64), np.ones(len(b), np.int64))
        low = np.minimum(wa[:shared], wb[:shared]).sum()
        exact = low / (wa.sum() + wb.sum() - low)
        doc = np.repeat([0, 1], [len(a), len(b)])
        hashes = np.concatenate([a, b]) * np.uint64(0x9E3779B97F4A7C15)
        s = bagminhash.signatures(doc, hashes, np.concatenate([wa, wb]), 2, m)
        plain = bagminhash.set_signatures(doc, hashes, 2, m)
        assert weights or (plain == s).all()
        assert (s <= plain).all()
        assert bagminhash.similarity(s[0], s[1]) == pytest.approx(exact, abs=4 * (exact * (1 - exact) / m) ** 0.5)


def test_full_text_index():
    r = random.Random(2)
    docs = [np.array([r.randrange(6) for _ in range(r.randint(0, 30))], np.uint64) for _ in range(20)]
    built = fmindex.FMIndex(docs)
    index = fmindex.FMIndex.load(built.dump())
    assert all((index.document(i) == d).all() for i, d in enumerate(docs))
    for k in (1, 2, 3, 5):
        pattern = np.array([[r.randrange(7) for _ in range(k)] for _ in range(60)], np.uint64)
        low, high = index.search(index.symbols(pattern.ravel()).reshape(-1, k))
        for p, lo, hi in zip(pattern, low, high):
            want = sorted((i, j) for i, d in enumerate(docs) for j in range(len(d) - k + 1) if (d[j : j + k] == p).all())
            assert sorted(index.owner[lo:hi].tolist()) == [i for i, _ in want]
    empty = fmindex.FMIndex.load(fmindex.FMIndex([]).dump())
    assert [x.tolist() for x in empty.search(empty.symbols(np.array([1, 2], np.uint64)).reshape(1, 2))] == [[0], [0]]


def test_index_is_compressed():
    r = random.Random(4)
    docs = [np.array([hash(w) for w in story(r, 150, 900).split()], np.int64).view(np.uint64) for _ in range(300)]
    docs += [d.copy() for d in docs]
    assert len(fmindex.FMIndex(docs).dump()) < 3 * sum(map(len, docs))


def test_overlaps_come_from_backward_search(monkeypatch):
    texts = [story(random.Random(i)) for i in range(20)]
    held = [(i, len(grams(t, 3)), " ".join(t.lower().replace(",", "").replace(".", "").split())) for i, t in enumerate(texts)]
    shard = overlap.Shard(overlap.Shard.dump(held), 3, 0.7, 0.06)
    train = [(100 + h, w, n) for h, n, w in held]
    assert {(a, b) for a, b, *_ in shard.search(train)} >= {(100 + i, i) for i in range(20)}
    monkeypatch.setattr(fmindex.FMIndex, "search", lambda self, p: (np.zeros(len(p), np.int64),) * 2)
    assert list(shard.search(train)) == []


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}
    for a, b in links:
        if a is not None:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in links:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_group(spark):
    """A third of all rows copies of one text, a third small edits of another."""
    r = random.Random(9)
    one, two = story(r), story(r)
    rows = [(f"train-{i:05d}", one if i % 3 == 0 else edit(r, two, 2) if i % 3 == 1 else story(r), "a", NOW, 1, "") for i in range(900)]
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(6), size=3, least=0.5, flush=60)
    groups = got.groupBy("group_id").agg(F.count("*").alias("n")).collect()
    assert sorted(g.n for g in groups) == [300, 300]


@pytest.mark.parametrize("whole,block", [(8, 5000), (64, 90)])
def test_links_inside_a_hot_template(spark, whole, block):
    """A third of all rows share a template, unlike one another, but for some pairs that are alike."""
    r = random.Random(11)
    template = story(r, 50, 4000)
    hot = [template + " " + story(r, 30, 40_000) for _ in range(500)]
    for k in range(0, 400, 2):
        w = hot[k].split()
        hot[k + 1] = " ".join(w[:60]) + " " + story(r, 20, 40_000)
    texts = hot + [story(r) for _ in range(1000)]
    rows = [(f"train-{i:05d}", t, "a", NOW, 1, "") for i, t in enumerate(texts)]
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA).repartition(6), size=3, least=0.5, flush=500, whole=whole, block=block)
    want = brute_groups(rows, 3, 0.5)
    assert len(want) == 400 and {(x.id, x.group_id) for x in got.collect()} == want


def test_overlaps_give_all_shared_words_and_the_longest_run(spark):
    """The rarest shingles lie in the short run; the longest run holds only frequent ones."""
    r = random.Random(5)
    common, rare = story(r, 50, 4000).split(), story(r, 48, 4000).split()
    a = " ".join(common + ["left"] + rare)
    b = " ".join(rare + ["right"] + common)
    rows = [("train-1", a, "a", NOW, 1, ""), ("valid-2", b, "a", NOW, 1, "")]
    rows += [(f"valid-{i}", " ".join(common), "a", NOW, 1, "") for i in range(10, 11)]
    rows += [(f"test-{i}", " ".join(common + story(r, 20, 4000).split()), "a", NOW, 1, "") for i in range(20, 30)]
    held = "not startswith(id, 'train')"
    got = {x.held_id: (x.shared_words, x.longest_run) for x in overlap.overlapping_ids(spark.createDataFrame(rows, SCHEMA), held, size=3, least=0.7).collect()}
    assert got["valid-2"] == (98, 50)


def test_runs_of_leaks_do_not_depend_on_the_size(spark):
    r = random.Random(3)
    item = story(r, 60, 900)
    docs = spark.createDataFrame([(1, story(r, 30) + " " + item + " " + story(r, 20)), (2, " ".join(item.split()[5:40]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for small in (10**6, 0):
        assert {(x.doc_id, x.run_words) for x in leak.leaked_items(docs, items, small=small).collect()} == {(1, 60), (2, 35)}


def test_both_ways_of_leaks_agree(spark):
    """Items that repeat passages, several runs on one diagonal, a passage that a third of all texts hold, copies."""
    r = random.Random(12)
    items = [(i, story(r, 40, 30)) for i in range(8)]
    w = items[0][1].split()
    items.append((8, " ".join(w[:12] + ["gap"] + w[13:30] + ["gap"] + w[31:])))
    docs = [(k, story(r, 10) + " " + (items[r.randrange(9)][1] if k % 3 else items[0][1]) + " " + story(r, 10)) for k in range(90)]
    docs += [(1000 + k, t) for k, t in docs[:20]] + [(docs[0][0], docs[1][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    one, two = ({tuple(x) for x in leak.leaked_items(a, b, small=small).collect()} for small in (10**6, 0))
    assert one == two and len(one) > 100
