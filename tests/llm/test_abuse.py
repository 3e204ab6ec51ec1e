"""Segments against a recursive search, disguises, the operator, and held-out accuracy on a made-up language."""

import random

import pytest

from fabula.llm import abuse


def brute(scores):
    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (best is None or total > best[0]):
                    best = (total, a, b)
        return go(lo, best[1]) + [(best[1], best[2] + 1)] + go(best[2] + 1, hi) if best else []

    return go(0, len(scores))


@pytest.mark.parametrize("seed", range(200))
def test_maximal_segments(seed):
    r = random.Random(seed)
    s = [r.choice([-3, -2, -1, 1, 2, 3.5]) + r.random() * 1e-3 for _ in range(r.randint(0, 14))]
    assert [(a, b) for a, b, _ in abuse.maximal_segments(s)] == brute(s)


@pytest.mark.parametrize("raw,token", [("w0rthle$$", "worthless"), ("st​upid", "stupid"), ("раthetic", "pathetic"), ("s.t.u.p.i.d", "stupid"), ("r-a-t", "rat"), ("paaaarasite", "parasite"), ("IDIOT", "idiot"), ("m***n", "*"), ("imbécile", "imbecile"), ("s t u p i d", "stupid")])
def test_disguises(raw, token):
    assert abuse.read_tokens(f"you {raw}, go") == ["you", token, "go"]


@pytest.mark.parametrize("text", [None, "", " ", "...", "★"])
def test_no_tokens(text):
    assert abuse.read_tokens(text) == []


def corpus(n, seed):
    r = random.Random(seed)
    neutral = [f"n{k}" for k in range(300)]
    nasty = ["gruk", "blarg", "snivel", "drok", "fnord"]
    out = []
    for k in range(n):
        words = r.choices(neutral, k=r.randint(10, 80))
        bad = r.random() < 0.2
        if r.random() < 0.3:  # a harmless use
            i = r.randrange(len(words))
            words[i:i] = ["a", "tame", r.choice(nasty)]
        if bad:
            i = r.randrange(len(words))
            words[i:i] = ["you", "are", "a", r.choice(nasty), r.choice(nasty), "and", "a", "liar"]
        out.append((k, " ".join(words), bad))
    return out


def test_held_out_accuracy_and_operator(spark):
    rows = corpus(1200, 1)
    r = random.Random(2)
    docs = spark.createDataFrame([(k, t, " Src" if k % 2 else None, 1.0) for k, t, _ in rows] + [(9998, None, "s", 1.0), (9999, "", "s", 1.0)], "doc_id long, text string, source string, score double").repartition(4)
    labels = [(k, int(bad != (r.random() < 0.05))) for k, _, bad in rows if k % 2] + [(None, 1), (1, 7), (12345, 1)]
    got = {x.doc_id: x for x in abuse.scored_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == 1202 and got[9998].score == 0 and got[9999].passages == 0
    held = [(bad, got[k].passages > 0) for k, _, bad in rows if k % 2 == 0]
    hit = sum(a and b for a, b in held)
    assert hit / sum(a for a, _ in held) > 0.95 and hit / sum(b for _, b in held) > 0.95
    rates = abuse.rates_per_source(spark.createDataFrame(list(got.values()))).collect()
    assert {x.source for x in rates} == {"src", "s", "(none)"} and all(x.rate == pytest.approx(x.flagged / x.documents) for x in rates)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "You are a worthless, filthy idiot.", "s"), (2, "A quiet day.", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in abuse.scored_documents(docs, none).collect()}
    assert got[1] > got[2] == 0
    assert abuse.scored_documents(docs.limit(0), none).count() == 0


def test_long_text():
    model = abuse.fit([(["good"] * 20, 0.0), (["vile", "bad"] * 3 + ["good"] * 5, 1.0)])
    assert len(model.passages(["good"] * 200_000 + ["vile"])) <= 200_000
