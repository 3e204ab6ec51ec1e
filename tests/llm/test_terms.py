"""Term counts against a plain count, with bursting and emptying forced."""

import datetime as dt
import random
import string

import pytest

from fabula.llm import terms

SCHEMA = "id string, words array<string>, features array<string>, loaded_at timestamp, term string"


def plain(rows):
    last = {}
    for i, w, f, v, _ in rows:
        key = (v is not None, v, w is not None, w or [], f is not None, f or [])
        if i not in last or key > last[i][0]:
            last[i] = (key, w, f)
    out = {}
    for _, w, f in last.values():
        for field, entries in (("words", w), ("features", f)):
            own = {}
            for e in entries or []:
                t = terms.normal_term(e)
                if t:
                    own[t] = own.get(t, 0) + 1
            for t, n in own.items():
                a, b = out.get((field, t), (0, 0))
                out[field, t] = (a + n, b + 1)
    return out


@pytest.mark.parametrize("container,bound,parts", [(1, 5, 3), (3, 10_000, 1), (512, 40, 7)])
def test_counts(spark, container, bound, parts):
    r = random.Random(container)
    word = lambda: "".join(r.choices("ab ÄＢ", k=r.randint(0, 4)))
    entries = lambda: [word() for _ in range(r.randint(0, 5))]
    now = dt.datetime(2025, 1, 1)
    rows = [(f"i{k % 80}", entries(), entries(), now + dt.timedelta(days=k), "x") for k in range(120)] + [(None, ["Null"], None, None, None), ("e", None, [""], now, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {(c.field, c.term): (c.occurrences, c.records) for c in terms.term_counts(df, ["words", "features"], container=container, bound=bound).collect()}
    assert got == plain(rows)


def test_marks_and_empty(spark):
    counts = spark.createDataFrame([("words", "a", 2, 2), ("words", "b", 9, 3), ("words", "c", 9, 9)], "field string, term string, occurrences long, records long")
    assert {c.term: c.mark for c in terms.mark_terms(counts, 200).collect()} == {"a": "rare", "b": None, "c": "common"}
    assert terms.term_counts(spark.createDataFrame([], SCHEMA), ["words"]).count() == 0


@pytest.mark.parametrize("raw,term", [(None, ""), ("  A b\tC ", "a b c"), ("x​y", "xy"), ("Ｆｕｌｌ", "full"), ("​ ", "")])
def test_normal_form(raw, term):
    assert terms.normal_term(raw) == term


def test_trie_is_a_map():
    r = random.Random(5)
    trie, want = terms.BurstTrie(2), {}
    for _ in range(3000):
        t = "".join(r.choices(string.ascii_lowercase[:3], k=r.randint(0, 6)))
        trie.add(t, 1, 1)
        want[t] = want.get(t, 0) + 1
    got = {p + rest: c[0] for p, inside in trie.subtrees() for rest, c in inside.items()}
    assert got == want and trie.size == len(want)


@pytest.mark.parametrize("seed", range(8))
def test_subtrees_merge_to_the_same_counts(seed):
    """Tries that have burst to different depths, merged subtree by subtree."""
    r = random.Random(seed)
    merged, want = terms.BurstTrie(r.choice([1, 3, 9])), {}
    for _ in range(4):
        trie = terms.BurstTrie(r.choice([1, 4, 30]))
        for _ in range(200):
            t = "".join(r.choices("abc", k=r.randint(0, 6)))
            trie.add(t, 2, 1)
            a, b = want.get(t, (0, 0))
            want[t] = (a + 2, b + 1)
        for prefix, inside in trie.subtrees():
            merged.graft(prefix, inside)
    assert {p + rest: c for p, inside in merged.subtrees() for rest, c in inside.items()} == want and merged.size == len(want)
