"""Abusive, hateful and sexual passages (problem 8), by maximum-scoring segments.

* Tokens are read through disguises: letters of other scripts that look alike, digits and signs for letters, letters
  drawn out or set apart, masked letters.
* A token's score is its log-odds, given the one and two tokens before it, under Dirichlet priors: the prior of a
  trigram is its bigram, that of a bigram (or of a pair with any token between) its last token, that of a token a
  seed list or the base rate. The counts come from a bounded sample of labelled documents; as only documents are
  labelled, the passages inside them are found by repeating segment search and counting.
* Every maximal segment of positive score is found in one linear scan (Ruzzo and Tompa).
* A segment's score is calibrated as an extreme value: the best segment of a clean text of n tokens exceeds x with
  probability 1 - exp(-K n exp(-lambda x)). lambda and K are fitted to documents labelled clean, each scored by a model
  that has not seen it. As some of these labels are wrong, as many of the greatest values as may be wrong count as not
  observed (truncated maximum likelihood), so that it makes no difference what they are.

n-grams are 64-bit hashes, and a model is a sorted array of them; all texts of a batch are scored at once in NumPy.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.words import hash_words, mix

# fixed values: letters that look like Latin ones
_LOOKS = str.maketrans("авеёзікмнорстухцјѕԁһӏցυοαεικνρτχγβηωκΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХУІЈЅ", "abeezikmhopctyxujsdhlgyoaeikvptxybhwkABEZHIKMNOPTYXABEKMHOPCTXYIJS")
_LEET = str.maketrans("430157@$!|8+", "aeoistasilbt")
_TOKEN = regex.compile(r"[.!?…\n\u2028\u2029]+(?![\p{L}\p{N}*])|\n+|[\p{L}\p{N}@$]+(?:[-._*@$!|+#'’^~]+[\p{L}\p{N}@$]+)*\*{0,12}|\*{2,}[\p{L}]+")
_ASCII_TOKEN = re.compile(r"[.!?\n]+(?![a-z0-9*])|\n+|[a-z0-9@$]+(?:[-._*@$!|+#'^~]+[a-z0-9@$]+)*\*{0,12}|\*{2,}[a-z]+")
_APART = regex.compile(r"(?:[\p{L}\p{N}@$][-._~+]+){2,}[\p{L}\p{N}@$]")
_RUNS = re.compile(r"([^\W\d_])\1{2,}")
_SPELT = re.compile(r"(?<!\w)(?:[a-z] ){3,}[a-z](?!\w)")
_SIMPLE = regex.compile(r"[\p{L}\p{N}]+")
MASK, BREAK = "*", "."
LEAST, MOST = -1.5, 4.0
SEED = 0.3  # the prior of a word of the seed list
# fixed values: words that start with a raised prior, in four languages
_SEEDS = """
    idiot moron imbecile stupid dumb dumbass scum worthless pathetic disgusting filthy vermin brainless useless loser bastard jerk parasite dirtbag trash
    naked sex erotica undress orgasm orgasms moaned lovers nude porn bitch whore slut fuck fucking shit asshole cunt retard kill hang choke
    idiota imbécil asqueroso basura inútil imbécile sale connard ordure vermine débile inutile schwein vollidiot dreck ungeziefer klappe widerlich widerliches dummes nackt nackte sexe nue desnuda desnudos
"""


def read_tokens(text: str | None) -> list[str]:
    """The tokens of a text, in lower case and without disguise; a word with masked letters is `*`, and `.` stands
    between sentences and lines."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf").translate(_LOOKS)
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("ß", "ss")
    text = _RUNS.sub(r"\1", _SPELT.sub(lambda m: m[0].replace(" ", ""), text))
    out: list[str] = []
    for token in (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text):
        if not token.isalpha():
            if token[0] in ".!?…\n\u2028\u2029":
                if out and out[-1] != BREAK:
                    out.append(BREAK)
                continue
            if "*" in token or "#" in token and any(c.isalpha() for c in token):
                if any(c.isalpha() for c in token):
                    out.append(MASK)
                continue
            if _APART.fullmatch(token):
                token = "".join(c for c in token if c.isalnum() or c in "@$")
            if any(c.isalpha() for c in token) and any(c in "430157@$!|8+" for c in token):
                token = token.translate(_LEET)
            if not token.isalpha():
                out.extend(_SIMPLE.findall(token))
                continue
            token = _RUNS.sub(r"\1", token)
        out.append(token)
    if out and out[-1] == BREAK:
        out.pop()
    return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, past the end, score) of all maximal segments of positive score, in linear time."""
    found: list[list] = []  # start, end, sum before the start, sum at the end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in found]


_U = np.uint64
_KINDS = 4  # token, bigram, pair with any token between, trigram


def _grams(documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes (kinds, tokens), number of tokens of each document) of all places of all documents in a row."""
    lengths = np.array([len(t) for t in documents], np.int64)
    h = mix(hash_words([w for t in documents for w in t]))
    ahead = np.zeros((2, len(h)), _U)  # the tokens before, 0 before the beginning
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k in (1, 2):
        ahead[k - 1, k:] = np.where(place[k:] >= k, h[:-k], _U(0))
    one, two = ahead
    pair = mix(one * _U(0x9E3779B97F4A7C15) + h)
    return np.stack([h, pair, mix(two * _U(0xD6E8FEB86659FD93) + h), mix(two * _U(0xC2B2AE3D27D4EB4F) + pair)]), lengths


class _Sums:
    """Running sums of the scores of documents in a row."""

    def __init__(self, scores: np.ndarray, lengths: np.ndarray):
        self.scores, self.lengths = scores, lengths
        self.end = np.cumsum(lengths)
        self.begin = self.end - lengths
        self.sum = np.append(0.0, np.cumsum(scores))

    def best(self) -> np.ndarray:
        """The greatest sum of a run of scores of each document, 0 if none is positive."""
        n = len(self.lengths)
        doc = np.repeat(np.arange(n), self.lengths)
        step = 1.0 + np.ptp(self.sum)  # documents further on lie lower, so that minima don't reach across
        lowest = np.minimum.accumulate(self.sum[:-1] - step * doc) + step * doc
        out = np.zeros(n)
        np.maximum.at(out, doc, self.sum[1:] - lowest)
        return out

    def segments(self, i: int) -> list[tuple[int, int, float]]:
        """All maximal segments of a document."""
        a, b = int(self.begin[i]), int(self.end[i])
        up = np.flatnonzero(self.scores[a:b] > 0)
        return _segments(up.tolist(), self.sum[a + up].tolist(), self.sum[a + up + 1].tolist())


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, past the end, score) of all maximal segments of positive score, in linear time."""
    return _Sums(np.array(scores, float), np.array([len(scores)])).segments(0)


def _segments(places: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """The same from the places of the positive scores, and the running sums before and after them."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before the start, sum at the end
    for i, low, high in zip(places, before, after):
        start, end = i, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in found]


class Model:
    """Scores of n-grams up to three tokens, and the calibration of segment scores."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, floor: float, rate: float = 0.7, size: float = 0.1):
        order = np.argsort(keys)
        self.keys, self.values, self.floor, self.rate, self.size = keys[order], values[order], floor, rate, size

    def score(self, documents: list[list[str]]) -> _Sums:
        """The score of every token: that of its longest known n-gram."""
        grams, lengths = _grams(documents)
        scores = np.full(grams.shape[1], self.floor)
        left = np.arange(grams.shape[1]) if len(self.keys) else np.empty(0, np.int64)
        for kind in (3, 1, 2, 0):
            h = grams[kind, left]
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == h
            scores[left[known]] = self.values[at[known]]
            left = left[~known]
        return _Sums(scores, lengths)

    def chance(self, score: float, n: int) -> float:
        """The probability that a clean text of n tokens has a segment of this score."""
        return -math.expm1(-self.size * max(n, 1) * math.exp(-min(self.rate * score, 700)))

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        return self.score([tokens]).segments(0)


def _sentence(tokens: list[str], a: int, b: int) -> tuple[int, int]:
    """The segment from a to b, widened to whole sentences."""
    while a > 0 and tokens[a - 1] != BREAK:
        a -= 1
    while b < len(tokens) and tokens[b] != BREAK:
        b += 1
    return a, b


class _Sample:
    """The n-grams of the labelled documents as numbers, with the number of clean documents that hold each.

    An n-gram of one document shows nothing and has the number -1; single tokens have theirs always.
    """

    def __init__(self, documents: list[tuple[list[str], float]]):
        self.tokens = [t for t, _ in documents]
        self.toxic = np.array([y > 0.5 for _, y in documents], bool)
        grams, self.lengths = _grams(self.tokens)
        self.doc = np.repeat(np.arange(len(documents), dtype=np.int32), self.lengths)
        self.gram = np.empty(grams.shape, np.int32)
        keys, kinds, priors, size = [], [], [], 0
        for kind in (0, 1, 2, 3):
            key, first, gram = np.unique(grams[kind], return_index=True, return_inverse=True)
            kept = np.full(len(key), kind == 0) | (self._documents(gram, len(key), self.doc) > 1)
            number = np.where(kept, np.cumsum(kept) - 1 + size, -1).astype(np.int32)
            self.gram[kind] = number[gram]
            # the n-gram that is the prior of each: the bigram of a trigram, the last token of a pair
            priors.append(self.gram[1 if kind == 3 else 0, first[kept]])
            keys.append(key[kept])
            kinds.append(np.full(len(keys[-1]), kind, np.int8))
            size += len(keys[-1])
        self.keys, self.kind, self.prior = np.concatenate(keys), np.concatenate(kinds), np.concatenate(priors)
        ours = self.toxic[self.doc]
        self.clean = self._count(~ours)
        self.ours = self._count(ours)

    def _documents(self, gram: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
        """Number of documents that hold each of n n-grams."""
        pair = np.sort(gram.astype(np.int64) * len(self.tokens) + doc)
        pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
        return np.bincount(pair // max(len(self.tokens), 1), minlength=n)

    def _count(self, chosen: np.ndarray) -> np.ndarray:
        """Number of documents that hold each n-gram at a chosen place."""
        total = np.zeros(len(self.keys), np.int64)
        for gram in self.gram:
            some = chosen & (gram >= 0)
            total += self._documents(gram[some], len(total), self.doc[some])
        return total

    def scores(self, marked: np.ndarray, base: float, strength: float, even: float, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, log-odds) of all n-grams over those of a token that is marked with the share `even`; each n-gram has
        the shorter one as its prior. Scores are kept between LEAST and MOST, so that no single token decides or
        forbids."""
        yes = self._count(marked)
        no = self.clean + self.ours - yes
        share = np.where(np.isin(self.keys, seeds), max(base, SEED), base)
        for kinds in ((0,), (1, 2), (3,)):
            mine = np.isin(self.kind, kinds)
            prior = share if kinds == (0,) else share[self.prior]
            share = np.where(mine, (yes + strength * prior) / (no + yes + strength), share)
        # words of the seed list that the sample doesn't hold keep their prior
        unseen = np.setdiff1d(seeds, self.keys[self.kind == 0])
        keys, share = np.append(self.keys, unseen), np.append(share, np.full(len(unseen), SEED))
        return keys, np.clip(np.log(share / (1 - share)) - math.log(even / (1 - even)), LEAST, MOST)


def fit(documents: list[tuple[list[str], float]], strength: float = 1.0, turns: int = 3, held_out: bool = True) -> Model:
    """documents: tokens and label (0 to 1) of each document of the sample.

    An n-gram counts once for a document. At first all tokens of a document that is labelled toxic count as marked;
    then only the sentences of its best segments. held_out: the calibration scores each half of the clean documents
    by a model of the other half.
    """
    seeds = np.unique(mix(hash_words(sorted({t for w in _SEEDS.split() for t in read_tokens(w)}))))
    model = Model(seeds, np.full(len(seeds), 2.0), LEAST)
    if not any(y > 0.5 and t for t, y in documents):
        return model
    rate, size = _held_out(documents, strength, turns) if held_out else (0.7, 0.1)
    sample = _Sample(documents)
    toxic = np.flatnonzero(sample.toxic)
    begin = np.cumsum(sample.lengths) - sample.lengths
    marked = sample.toxic[sample.doc]
    for turn in range(turns):
        share = len(np.unique(sample.doc[marked])) / len(documents)
        base = min(max(share, 0.002), 0.4) * (0.1 if turn else 1.0)
        model = Model(*sample.scores(marked, base, strength, 0.5 if turn else 0.6, seeds), LEAST)
        sums = model.score([sample.tokens[i] for i in toxic])
        marked = np.zeros(len(sample.doc), bool)
        for k, i in enumerate(toxic.tolist()):
            segments = sums.segments(k)
            best = max((x for _, _, x in segments), default=0.0)
            for a, b, x in segments:
                if x >= max(3.0, 0.3 * best):
                    a, b = _sentence(sample.tokens[i], a, b)
                    marked[begin[i] + a : begin[i] + b] = True
    model.rate, model.size = rate, size
    return model


def _held_out(documents: list[tuple[list[str], float]], strength: float, turns: int) -> tuple[float, float]:
    """(lambda, K) of each half of the clean documents under the model of the other half."""
    scores, lengths, toxic = [], [], []
    for half in (0, 1):
        other = fit(documents[half::2], strength, turns, False)
        clean = other.score([t for t, y in documents[1 - half :: 2] if y <= 0.5 and t])
        scores.append(clean.scores)
        lengths.append(clean.lengths)
        toxic.append(other.score([t for t, y in documents[1 - half :: 2] if y > 0.5 and t]).best())
    sums, toxic = _Sums(np.concatenate(scores), np.concatenate(lengths)), np.concatenate(toxic)
    best = sums.best()
    # wrong labels among the clean: half of them lie above the middle of the toxic ones, where hardly a right one is
    middle = float(np.median(toxic)) if len(toxic) else 0.0
    wrong = 2 * float(np.mean(best > middle)) if middle > 0 and len(best) else 0.0
    return calibrated(sums, best, min(max(1 - 1.5 * wrong, 0.8), 0.99))


def calibrated(sums: _Sums, best: np.ndarray, high: float = 0.99) -> tuple[float, float]:
    """(lambda, K) of the scores, and best segments, of clean texts.

    The texts above the quantile `high` are taken as not observed, as wrong labels may be among them. lambda is the root
    of mean exp(lambda * score) = 1 over tokens, which is 1 for exact log-odds; K is the maximum-likelihood value, in
    which texts without a positive segment count as such (censored) and the unobserved ones by truncation.
    """
    top = float(np.quantile(best, high)) if len(best) else 0.0
    seen = best <= top
    tokens = sums.scores[np.repeat(seen, sums.lengths)]
    low, rate = 0.3, 1.0
    for _ in range(30 if len(tokens) and np.mean(np.exp(tokens)) > 1 else 0):
        middle = (low + rate) / 2
        low, rate = (middle, rate) if np.mean(np.exp(middle * tokens)) < 1 else (low, middle)
    positive = max(int((best[seen] > 0).sum()), 1)
    mass = float(np.sum(sums.lengths[seen] * (np.exp(-rate * best[seen]) - (np.exp(-rate * top) if top > 0 else 0))))
    return rate, positive / max(mass, 1.0)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, y of at most `most` labelled documents, chosen by a hash of their id; y is the mean of the labels 0 and 1.

    The ids are chosen first, so that no text is shuffled; of several texts with one id the greatest is taken.
    """
    y = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    there = documents.where("text is not null").select("doc_id")
    chosen = y.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")).select("doc_id", "text", "y")


def fit_model(documents: DataFrame, labels: DataFrame, most: int = 24_000) -> Model:
    """A model of the sample of labelled documents; without labels only the seed list speaks."""
    rows = sorted(labelled_sample(documents, labels, most).collect(), key=lambda r: r.doc_id)  # at most `most`
    one: dict[str, str] = {}  # each token is kept once
    return fit([([one.setdefault(t, t) for t in read_tokens(r.text)], r.y) for r in rows])


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score, chance, n, share = [], [], [], []
            tokens = [read_tokens(t) for t in batch.column("text").to_pylist()]
            sums = model.score(tokens)
            for i, t in enumerate(tokens):
                segments = sums.segments(i)
                best = max((s for _, _, s in segments), default=0.0)
                heavy = [(a, b) for a, b, s in segments if model.chance(s, len(t)) <= threshold]
                score.append(best)
                chance.append(model.chance(best, len(t)) if segments else 1.0)
                n.append(len(heavy))
                share.append(sum(b - a for a, b in heavy) / len(t) if t else 0.0)
            arrays = [batch.column("doc_id"), batch.column("source"), pa.array(score, pa.float64()), pa.array(chance, pa.float64()), pa.array(n, pa.int32()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "source", "score", "chance", "passages", "share"])

    return run


def scored_documents(documents: DataFrame, labels: DataFrame, threshold: float = 1e-4, most: int = 24_000) -> DataFrame:
    """doc_id, source, score, chance, passages, share: one row per row of documents.

    score: that of the best passage; chance: the probability that a clean text of this length has one as good;
    passages, share: number and share of tokens of the passages whose chance is at most `threshold`. A null or empty
    text has score 0 and chance 1. source is trimmed and lower-cased; null stays null. most: bound of the labelled
    sample. Repeated rows are scored each.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fit_model(documents, labels, most))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))).alias("source"), "text")
    return rows.mapInArrow(_score(shared, threshold), "doc_id long, source string, score double, chance double, passages int, share double")


def rates_per_source(scored: DataFrame) -> DataFrame:
    """source, documents, flagged, rate, mean_share of scored documents; a null source is '(none)'."""
    rows = scored.groupBy(F.coalesce("source", F.lit("(none)")).alias("source"))
    flagged = F.count_if(F.col("passages") > 0)
    return rows.agg(F.count("*").alias("documents"), flagged.alias("flagged"), (flagged / F.count("*")).alias("rate"), F.avg("share").alias("mean_share"))
