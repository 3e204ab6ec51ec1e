"""Same or near-same records across splits (problem 3), by compressed full-text indexes of the evaluation texts.

The evaluation texts are cut into shards by their number of shingles and, within a range of sizes, by hash. Each shard
is indexed once, and its compressed index is sent to the tasks that stream training texts through it: those whose
sizes can reach the similarity. In a task:

* backward search gives every shingle of a training text its range of rows, and so its number of places in the shard;
* a partner of similarity s holds at least s of the text's n shingles, so of its n - ceil(s * n) + k rarest shingles
  it holds at least k: only these few are located, and only evaluation texts met k times become candidates (exact);
* the matches of a candidate are joined along diagonals into maximal matches, and these merged: the shingles they hold
  decide the similarity, their spans give the shared words and the longest run.

If the evaluation texts are more than one shard, texts that can have no partner are left out first (sieve). Copies of a
text are sent once by each task; ids are joined to the pairs of texts at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.words import distinct, flat_shingles, hash_words, shingle_hashes, split_words
from fabula.llm import sieve
from fabula.llm.fmindex import FMIndex
from fabula.session import materialize

_TEXT = "h long, size int, words string"
_PAIR = "train long, held long, similarity double, shared_words int, longest_run int"


def _prepare(size: int, keep: int):
    """(h, text) to (h, number of distinct shingles, words); copies within a task go out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            new: dict[int, str] = {}
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                if h not in seen:
                    if len(seen) >= keep:
                        seen.clear()
                    seen.add(h)
                    new[h] = " ".join(split_words(text))
            for i in range(0, len(new), 8192):
                h, words = list(new)[i : i + 8192], list(new.values())[i : i + 8192]
                total = np.bincount(flat_shingles(words, size)[0], minlength=len(h))
                some = np.nonzero(total)[0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([h[j] for j in some], pa.int64()), pa.array(total[some], pa.int32()), pa.array([words[j] for j in some], pa.string())], names=["h", "size", "words"])

    return run


def common_runs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[int, int, int]:
    """The maximal matches of at least `size` words of two texts of word hashes, merged: the number of distinct
    shingles they hold, the words of the first text they cover, and the length of the longest."""
    ga, gb = shingle_hashes(a, size), shingle_hashes(b, size)
    order = np.argsort(gb, kind="stable")
    low, high = np.searchsorted(gb[order], ga), np.searchsorted(gb[order], ga, "right")
    width = high - low
    if not width.any():
        return 0, 0, 0
    i = np.repeat(np.arange(len(ga)), width)
    j = order[np.arange(width.sum()) + np.repeat(low - (np.cumsum(width) - width), width)]
    by = np.lexsort((i, i - j))
    i, diagonal = i[by], (i - j)[by]
    new = np.append(True, (np.diff(i) != 1) | (np.diff(diagonal) != 0))
    longest = int(np.diff(np.append(np.nonzero(new)[0], len(i))).max()) + size - 1
    covered = np.zeros(len(a), bool)
    for k in range(size):
        covered[i + k] = True
    return len(distinct(ga[width > 0])), int(covered.sum()), longest


class Shard:
    """The index of a shard's evaluation texts, and the search of training texts in it."""

    def __init__(self, raw: bytes, size: int, least: float, extra: float):
        self.size, self.least, self.extra = size, least, extra
        n = int.from_bytes(raw[:8], "little")
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        self.sizes = np.frombuffer(raw, np.int32, n, 8 + 8 * n).astype(np.int64)
        self.index = FMIndex.load(raw[8 + 12 * n :])

    @staticmethod
    def dump(held: list[tuple[int, int, str]]) -> bytes:
        """The stored form of evaluation texts, given as class, number of distinct shingles and words."""
        ids, sizes = np.array([h for h, _, _ in held], np.int64), np.array([n for _, n, _ in held], np.int32)
        return len(held).to_bytes(8, "little") + ids.tobytes() + sizes.tobytes() + FMIndex([hash_words(w.split()) for _, _, w in held]).dump()

    def search(self, train: list[tuple[int, str, int]]) -> Iterator[tuple]:
        """train: class, words and number of distinct shingles of the training texts."""
        index, size = self.index, self.size
        words = [w.split() for _, w, _ in train]
        total = np.array([n for _, _, n in train], np.int64)
        lengths = np.array([len(w) for w in words])
        flat = hash_words([x for w in words for x in w])
        start = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(train)), lengths)
        at = np.nonzero(np.arange(len(flat)) + size <= (start + lengths)[doc])[0]
        symbol = index.symbols(flat)
        low, high = index.search(np.stack([symbol[at + k] for k in range(size)], 1))
        some = high > low
        d, low, width = doc[at[some]], low[some], (high - low)[some]
        need = np.ceil(self.least * total - 1e-9).astype(np.int64)
        hits = np.minimum(need, 1 + (self.extra * total).astype(np.int64))
        # at most as many distinct shingles are held here as were found; if they are too few the text has no partner
        some = (np.bincount(d, minlength=len(train)) >= need)[d]
        d, low, width = d[some], low[some], width[some]
        if not len(d):
            return
        order = np.lexsort((low, width, d))  # equal shingles have equal rows
        d, low, width = d[order], low[order], width[order]
        one = np.append(True, (d[1:] != d[:-1]) | (low[1:] != low[:-1]))
        d, low, width = d[one], low[one], width[one]
        found = np.bincount(d, minlength=len(train))
        # rank among all shingles of the text, those that occur nowhere in the index first
        rank = np.arange(len(d)) - np.repeat(np.cumsum(found) - found, found) + (total - found)[d]
        prefix = rank < (total - need + hits)[d]
        d, low, width = d[prefix], low[prefix], width[prefix]
        for lo, hi in self._slices(d, width):
            yield from self._candidates(train, flat, start, lengths, d[lo:hi], low[lo:hi], width[lo:hi], hits, total)

    @staticmethod
    def _slices(d: np.ndarray, width: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
        """Ranges of entries with about `most` places, cut between texts."""
        cuts = np.append(np.nonzero(np.diff(d))[0] + 1, len(d))
        done = np.cumsum(width)
        lo, base = 0, 0
        for i, cut in enumerate(cuts.tolist()):
            if done[cut - 1] - base >= most or i == len(cuts) - 1:
                yield lo, cut
                lo, base = cut, done[cut - 1]

    def _candidates(self, train, flat, begins, lengths, d, low, width, hits, total) -> Iterator[tuple]:
        index, size = self.index, self.size
        row = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
        who, texts = index.owner[row].astype(np.int64), len(self.ids)
        # a text that holds a shingle twice is met twice: that can only make more candidates
        key = np.sort(np.repeat(d, width) * texts + who)
        new = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        n, key = np.diff(np.append(new, len(key))), key[new]
        enough = n >= hits[key // texts]
        a, b = key[enough] // texts, key[enough] % texts
        small, large = np.minimum(total[a], self.sizes[b]), np.maximum(total[a], self.sizes[b])
        ok = small >= self.least * large - 1e-9
        for i, j in zip(a[ok].tolist(), b[ok].tolist()):
            shared, covered, longest = common_runs(flat[begins[i] : begins[i] + lengths[i]], index.document(j), size)
            similarity = shared / (total[i] + self.sizes[j] - shared)
            if similarity >= self.least - 1e-9:
                yield train[i][0], int(self.ids[j]), float(similarity), covered, longest


_PIECE = 4 << 20


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The evaluation texts (shard, h, size, words), sorted by shard, to the stored index of each shard in pieces."""
    here, held = None, []

    def built() -> Iterator[pa.RecordBatch]:
        if held:
            raw = Shard.dump(held)
            for i in range(0, len(raw), _PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([i // _PIECE], pa.int64()), pa.array([raw[i : i + _PIECE]], pa.binary())], names=["shard", "piece", "body"])

    for batch in batches:
        for shard, h, n, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "h", "size", "words"))):
            if shard != here:
                yield from built()
                here, held = shard, []
            held.append((h, n, words))
    yield from built()


def _stream(size: int, least: float, extra: float, at_once: int):
    """The rows of each (shard, salt), the pieces of the index first, to pairs."""
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, raw, train, shard, last = None, [], [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal raw, train, shard
            if train and (raw or shard):
                if shard is None:
                    shard, raw = Shard(b"".join(raw), size, least, extra), []
                rows = list(shard.search(train))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["train", "held", "similarity", "shared_words", "longest_run"])
            train = []

        for batch in batches:
            for block, body, h, words, n in zip(*(batch.column(c).to_pylist() for c in ("block", "body", "h", "words", "size"))):
                if block != here:
                    yield from flush()
                    here, raw, shard, last = block, [], None, None
                if body is not None:
                    raw.append(body)
                elif h != last:
                    last = h
                    train.append((h, words, n))
                    if len(train) >= at_once:
                        yield from flush()
        yield from flush()

    return run


def overlapping_texts(records: DataFrame, held: str, id_column: str = "id", text_column: str = "story", version: str | None = "loaded_at", size: int = 5, least: float = 0.8, shard_words: int = 8_000_000, block_bytes: int = 32_000_000, extra: float = 0.06, most_ids: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of texts in and outside the held-out splits with a similarity of at least `least`.

    held: SQL expression over `id` that is true for held-out ids and false for training ids. pairs: classes train and
    held, similarity on distinct shingles of `size` words, words of the training text in common runs, longest common
    run. members: id, held, h (class) of every id. shard_words: words in an index; block_bytes: training text that one
    task at least streams through an index; extra: the further share of shingles that raises the hits a candidate needs;
    most_ids: classes of training texts that are broadcast. None of them changes the pairs.
    """
    spark = records.sparkSession
    v = F.col(version) if version else F.lit(0)
    rows = records.select(F.col(id_column).alias("id"), v.alias("v"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    rows = rows.withColumn("held", F.expr(held)).withColumn("h", F.xxhash64("text"))
    last = rows.groupBy("id", "held").agg(F.max(F.struct("v", "h")).alias("c")).select("id", "held", F.col("c.h").alias("h"))
    members = materialize(last.where("held is not null"), "members")
    texts = lambda part: part.mapInArrow(_prepare(size, 200_000), _TEXT)
    training = rows.where("not held").select("h", "text")
    evaluation = materialize(texts(rows.where("held").select("h", "text")).groupBy("h").agg(F.first("size").alias("size"), F.first("words").alias("words")), "held")
    n_words = F.sum(F.length("words") / 6)
    counted = lambda: evaluation.agg(n_words.alias("words"), F.avg(F.length("words")).alias("mean")).first()
    stats, streamed = counted(), None
    if (stats.words or 0) > shard_words:
        # beyond one shard, only texts that can have a partner are indexed and searched
        few = sieve.partners(training, evaluation, _prepare(size, 200_000), size, least)
        evaluation = materialize(evaluation.join(few.where("kind = 0").select("h"), "h", "left_semi"), "held")
        chosen = few.where("kind = 1").select("h")
        n_chosen = chosen.count()
        training = training.join(F.broadcast(chosen) if n_chosen <= most_ids else chosen, "h", "left_semi")
        stats = counted()
        streamed = n_chosen * (stats.mean or 0)
    # ranges of sizes, each cut into as many shards by hash as its words need
    ranges = min(24, max(1, math.ceil((stats.words or 0) / shard_words)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(evaluation.agg(F.percentile_approx("size", shares, 10_000).alias("q")).first().q or [])) if shares else []
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<int>")
    of = lambda x: F.size(F.filter(bounds, lambda c: c < x))
    weights = {r.r: r.w for r in evaluation.groupBy(of(F.col("size")).alias("r")).agg(n_words.alias("w")).collect()}  # at most 24 rows
    inner = [max(1, math.ceil(weights.get(r, 0) / shard_words)) for r in range(len(cuts) + 1)]
    begin = np.cumsum([0, *inner]).tolist()
    at = lambda values, r: F.element_at(F.array(*map(F.lit, values)), r + 1)
    shards = begin[-1]
    place = at(begin, of(F.col("size"))) + F.pmod("h", at(inner, of(F.col("size")))).cast("int")
    sorted_ = evaluation.select(place.alias("shard"), "h", "size", "words").repartitionById(shards, "shard").sortWithinPartitions("shard", "h")
    index = materialize(sorted_.mapInArrow(_build, "shard int, piece long, body binary"), "index")
    if streamed is None:
        streamed = members.where("not held").count() * (stats.mean or 0)
    # loading an index takes as long as searching some 16 bytes of text a word, so a task streams more than that
    block_bytes = max(block_bytes, 20 * min(shard_words, math.ceil(stats.words or 0)))
    salts = max(1, math.ceil(spark.sparkContext.defaultParallelism / shards), math.ceil(streamed / block_bytes))
    none = lambda kind: F.lit(None).cast(kind)
    copies = index.select(F.explode(F.sequence(F.col("shard") * salts, F.col("shard") * salts + salts - 1)).alias("block"), F.lit(0).alias("kind"), F.col("piece").alias("h"), "body", none("string").alias("words"), none("int").alias("size"))
    low, high = F.ceil(F.col("size") * least - 1e-9).cast("int"), F.floor(F.col("size") / least + 1e-9).cast("int")
    visits = F.explode(F.sequence(at(begin, of(low)), at(begin[1:], of(high)) - 1)).alias("shard")
    stream = texts(training).select(visits, "h", "words", "size").select((F.col("shard") * salts + F.pmod(F.shiftright("h", 7), F.lit(salts))).cast("int").alias("block"), F.lit(1).alias("kind"), "h", none("binary").alias("body"), "words", "size")
    placed = copies.unionByName(stream).repartitionById(shards * salts, "block").sortWithinPartitions("block", "kind", "h")
    pairs = placed.mapInArrow(_stream(size, least, extra, 2000), _PAIR)
    return materialize(pairs, "overlaps"), members


def _spread(pairs: DataFrame, members: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """pairs with the ids of the class in `key`. A class of more than `most` ids is one of several keys, so that the
    copies of one text are no single task."""
    ids = members.select(F.col("id").alias(f"{key}_id"), F.col("h").alias(key))
    linked = ids.join(pairs.select(key).distinct(), key, "left_semi")
    parts = linked.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    salted = linked.join(parts, key, "left").withColumn("salt", F.pmod(F.xxhash64(f"{key}_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    wide = pairs.join(parts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return wide.join(salted, [key, "salt"]).drop("salt")


def overlapping_ids(records: DataFrame, held: str, **more) -> DataFrame:
    """train_id, held_id, similarity, shared_words, longest_run: all pairs of a training and a held-out id that overlap.

    Null ids or texts, ids that are in neither part (held is null) and texts of fewer than `size` words give no
    pair. An id delivered several times takes part once, with its last text. An empty table gives no rows.
    """
    pairs, members = overlapping_texts(records, held, **more)
    both = _spread(_spread(pairs, members.where("not held"), "train"), members.where("held"), "held")
    return both.select("train_id", "held_id", "similarity", "shared_words", "longest_run")


def overlap_report(records: DataFrame, held: str, split: str, source: str, **more) -> DataFrame:
    """split, source, pairs, ids of the held-out ids that overlap with training: counts per split and source.

    split: SQL expression over id; source: column, trimmed and lower-cased, null as '(none)'. Pairs of ids are counted
    by their classes, without being made.
    """
    found, members = overlapping_texts(records, held, **more)
    copies = members.where("not held").groupBy(F.col("h").alias("train")).agg(F.count("*").alias("copies"))
    per_class = found.join(copies, "train").groupBy(F.col("held").alias("h")).agg(F.sum("copies").alias("pairs"))
    per_id = members.where("held").select("id", "h").join(per_class, "h").select("id", "pairs")
    names = records.where("id is not null").groupBy("id").agg(F.max(F.lower(F.trim(F.col(source)))).alias("source"))
    joined = per_id.join(names, "id").select(F.expr(split).alias("split"), F.coalesce("source", F.lit("(none)")).alias("source"), "pairs")
    return joined.groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("ids"))
