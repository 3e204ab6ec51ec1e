"""Test items inside corpus documents (problem 6), by a prefix-filtered set join.

An item leaks into a document if `window` successive words of it stand there without gaps. Each window of an item is
a set of `window - size + 1` shingles that the document must hold too, so one shingle of each window is a necessary
token; the rarest in the corpus is taken. The shingles of documents meet these tokens in a join; length and position
bounds drop hits whose window would not fit into the document, and an exact comparison of the words around the hit
verifies it. The tokens are broadcast below a stated size, and joined by shuffle above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.words import distinct, hash_words, shingle_hashes, split_words
from fabula.session import materialize


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([split_words(t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], names=["item", "words"])


def _grams(words: list[str], size: int) -> np.ndarray:
    return shingle_hashes(hash_words(words), size).view(np.int64)


def _held(keys: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of g's entries that keys has, their places in keys)."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(keys, g)
    at[at == len(keys)] = 0
    here = np.nonzero(keys[at] == g)[0]
    return here, at[here]


def _count(size: int, wanted):
    """Number of documents for each wanted shingle, within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = wanted.value
        seen = np.zeros(len(keys), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                g = distinct(_grams(split_words(text), size))
                seen[_held(keys, g)[1]] += 1
        some = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), pa.array(seen[some], pa.int64())], names=["gram", "n"])

    return run


def _count_all(size: int):
    """(gram, 1) of every distinct shingle of a document: the way without a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [distinct(_grams(split_words(t), size)) for t in batch.column("text").to_pylist()]
            g = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(np.ones(len(g), np.int64))], names=["gram", "n"])

    return run


def _item_tokens(size: int, window: int):
    """(item, words, counts of its shingles) to its necessary tokens: (gram, item, offset, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, words, grams, ns in zip(*(batch.column(c).to_pylist() for c in ("item", "words", "grams", "ns"))):
                own = _grams(words, size)
                rarity = dict(zip(grams or [], ns or []))
                span = window - size + 1
                for start in dict.fromkeys(min(range(i, i + span), key=lambda j: (rarity.get(int(own[j]), 0), j)) for i in range(len(words) - window + 1)):
                    out.append((int(own[start]), item, start, words))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["gram", "item", "at", "item_words"])

    return run


def run_length(words: list[str], i: int, item: list[str], j: int) -> tuple[int, int]:
    """(start in the document, length) of the longest equal run through words[i] and item[j]."""
    back = 0
    while back < i and back < j and words[i - back - 1] == item[j - back - 1]:
        back += 1
    ahead = 0
    while i + ahead < len(words) and j + ahead < len(item) and words[i + ahead] == item[j + ahead]:
        ahead += 1
    return i - back, back + ahead


def _probe(size: int, window: int, tokens):
    """Documents against broadcast tokens; one row per document and item, with the longest run of equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, entries, items = tokens.value
        for batch in batches:
            best: dict[tuple, int] = {}
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                words = split_words(text)
                if len(words) < window:
                    continue
                g = _grams(words, size)
                for i in _held(keys, g)[0].tolist():
                    for number, j in entries[int(g[i])]:
                        item, item_words = items[number]
                        if min(i, j) + min(len(words) - i, len(item_words) - j) < window:  # position bound
                            continue
                        n = run_length(words, i, item_words, j)[1]
                        if n >= window:
                            best[doc, item] = max(n, best.get((doc, item), 0))
            yield _found(best)

    return run


def _found(best: dict[tuple, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in best], pa.int64()), pa.array([k[1] for k in best], pa.int64()), pa.array(best.values(), pa.int32())], names=["doc_id", "item_id", "run_words"])


def _places(size: int, window: int, keep: int = 200_000):
    """(h, text) to (h, gram, i, n): the shingles of each text with their places, and its number of words; copies within
    a task go out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, owners, lengths = [], [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                if h in seen:
                    continue
                if len(seen) >= keep:
                    seen.clear()
                seen.add(h)
                words = split_words(text)
                if len(words) >= window:
                    parts.append(_grams(words, size))
                    owners.append(h)
                    lengths.append(len(words))
            if parts:
                n = np.array([len(g) for g in parts])
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                columns = [np.repeat(np.array(owners, np.int64), n), np.concatenate(parts), i.astype(np.int32), np.repeat(np.array(lengths, np.int32), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "gram", "i", "n"])

    return run


def _verify(window: int):
    """(h, text, item, item_words, hits) to (h, item, run_words): the longest run through any of the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            words: dict[int, list[str]] = {}
            for h, text, item, item_words, hits in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "item", "item_words", "hits"))):
                if h not in words:
                    words[h] = split_words(text)
                n = max(run_length(words[h], x["i"], item_words, x["at"])[1] for x in hits)
                if n >= window:
                    out.append((h, item, n))
            kinds = (pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["h", "item", "run_words"])

    return run


def _joined_hits(docs: DataFrame, split: DataFrame, tokens: DataFrame, size: int, window: int, salts: int = 16) -> DataFrame:
    """doc_id, item_id, run_words without a broadcast: shingles meet tokens by hash and place only, and the words of a
    text are fetched once for all its hits. A token that very many texts hold is several keys."""
    classed = docs.select("doc", F.xxhash64("text").alias("h"), "text")
    version = F.xxhash64("item_words").alias("version")
    wide = tokens.select("gram", "item", "at", F.size("item_words").alias("m"), version, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    places = classed.select("h", "text").mapInArrow(_places(size, window), "h long, gram long, i int, n int").withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    fits = F.least("i", "at") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("at")) >= window  # position bound
    # hits of one run lie on one diagonal, and those of different runs at least a shingle apart; one of each is enough
    hits = places.join(wide, ["gram", "salt"]).where(fits).groupBy("h", "item", "version", (F.col("i") - F.col("at")).alias("diagonal"), F.floor(F.col("i") / size).alias("part")).agg(F.min(F.struct("i", "at")).alias("hit"))
    per_pair = materialize(hits.groupBy("h", "item", "version").agg(F.collect_list("hit").alias("hits")), "hits")
    texts = classed.select("h", "text").join(per_pair.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    words = split.select(F.xxhash64("words").alias("version"), F.col("words").alias("item_words")).dropDuplicates(["version"])
    found = per_pair.join(texts, "h").join(words, "version").select("h", "text", "item", "item_words", "hits").mapInArrow(_verify(window), "h long, item long, run_words int")
    return classed.select(F.col("doc").alias("doc_id"), "h").join(found, "h").select("doc_id", F.col("item").alias("item_id"), "run_words")


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, window: int = 10, small: int = 200_000) -> DataFrame:
    """doc_id, item_id, run_words: every document that holds `window` successive words of an item, with the length of
    the longest common run (at least `window`).

    A null or short text has no window and is never found; repeated rows count once; an item or document id of null
    is left out. small: number of item shingles up to which tokens are broadcast (a few dozen bytes each); beyond it all joins
    shuffle. Both ways give the same rows.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    texts = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    split = texts.mapInArrow(_item_words, "item long, words array<string>").where(F.size("words") >= window)
    grams = split.mapInArrow(_explode(size), "item long, words array<string>, gram long")
    n_grams = grams.count()
    if n_grams <= small:
        wanted = np.unique(np.array([r.gram for r in grams.select("gram").collect()], np.int64))
        counts = docs.select("text").mapInArrow(_count(size, spark.sparkContext.broadcast(wanted)), "gram long, n long")
    else:
        counts = docs.select("text").mapInArrow(_count_all(size), "gram long, n long").join(grams.select("gram").distinct(), "gram", "left_semi")
    counts = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    known = grams.join(counts, "gram", "left").groupBy("item", "words").agg(F.collect_list(F.struct("gram", F.coalesce("n", F.lit(0)).alias("n"))).alias("c"))
    tokens = known.select("item", "words", F.col("c.gram").alias("grams"), F.col("c.n").alias("ns")).mapInArrow(_item_tokens(size, window), "gram long, item long, at int, item_words array<string>")
    if n_grams <= small:
        # an item id may stand for several texts, so texts are numbered
        entries: dict[int, list] = {}
        numbers: dict[tuple, int] = {}
        for r in tokens.toLocalIterator():  # at most `small`
            number = numbers.setdefault((r.item, tuple(r.item_words)), len(numbers))
            entries.setdefault(r.gram, []).append((number, r.at))
        keys = np.array(sorted(entries), np.int64)
        found = docs.mapInArrow(_probe(size, window, spark.sparkContext.broadcast((keys, entries, [(i, list(w)) for i, w in numbers]))), "doc_id long, item_id long, run_words int")
    else:
        found = _joined_hits(docs, split, tokens, size, window)
    return found.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"))


def _explode(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(item, words, g) for item, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()) for g in np.unique(_grams(words, size)).tolist()]
            kinds = (pa.int64(), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["item", "words", "gram"])

    return run
