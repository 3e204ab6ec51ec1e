"""Which texts of two sides can have a partner of a given similarity: an exact sieve that comes before the search.

The shingles of a text are put into one order for all texts, those that few held-out texts hold first. Of two texts of
n and m shingles with a similarity of at least s, the first shingle they share stands early enough in both for the rest
to reach the overlap that s needs; so a shingle at place i of one text tells the greatest size its partner may have,
and only texts whose sizes are within one another's bounds are met. Of these, 256 bits of parity tell how many shingles
two texts have at least that the other lacks. What is left are the texts of pairs that are alike, and few others.

The shingles are cut into ranges of hashes and, beyond `texts` held-out texts, these by size; each unit of both is one
table of places in a task, through which the training texts that have shingles there are streamed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.words import hash_words, shingle_hashes
from fabula.session import materialize

_U, _CAP, _SLICE = np.uint64, 0xFFFF, 1 << 16
_UNIT = "unit int, kind int, n int, body binary"


def _shingles(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 48-bit hash) of every shingle of at most 256 texts of words, as often as it stands there."""
    parts = [w.split() for w in words]
    lengths = np.array([len(p) for p in parts], np.int64)
    hashes = shingle_hashes(hash_words([x for p in parts for x in p]), size)
    doc, ends = (np.repeat(x, lengths)[: len(hashes)] for x in (np.arange(len(words)), np.cumsum(lengths)))
    inside = np.arange(len(hashes)) + size <= ends
    return doc[inside], hashes[inside] >> _U(16)


def _count(size: int, bits: int):
    """Texts to how often shingles fall into each of 2**bits bins, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            words = batch.column("words").to_pylist()
            for i in range(0, len(words), 256):
                bins = np.sort(_shingles(words[i : i + 256], size)[1] & _U((1 << bits) - 1))
                new = np.nonzero(np.append(True, bins[1:] != bins[:-1])[: len(bins)])[0]
                count[bins[new].astype(np.int64)] += np.diff(np.append(new, len(bins))).astype(np.uint32)
        for i in range(0, len(count), _SLICE):
            if (part := count[i : i + _SLICE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // _SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "body"])

    return run


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by slice, sorted by slice, to their sums' logarithms in eighths of a power of two."""
    here, total = None, np.empty(0)

    def done() -> Iterator[pa.RecordBatch]:
        if here is not None:
            level = np.rint(8 * np.log2(1 + total)).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "body"])

    for batch in batches:
        for k, body in zip(batch.column("slice").to_pylist(), batch.column("body").to_pylist()):
            if k != here:
                yield from done()
                here, total = k, np.zeros(len(body) // 4)
            total += np.frombuffer(body, np.uint32)
    yield from done()


def levels(held: DataFrame, size: int, bits: int) -> np.ndarray:
    """For each bin of shingles how often held-out texts hold them, in 256 steps. It makes the order of the shingles."""
    few = held.select("words").coalesce(min(16, held.sparkSession.sparkContext.defaultParallelism))
    slices = few.mapInArrow(_count(size, bits), "slice int, body binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(_level, "slice int, body binary")
    out = np.zeros(1 << bits, np.uint8)
    for k, body in slices.collect():  # 2**bits bytes together
        out[k * _SLICE : (k + 1) * _SLICE] = np.frombuffer(body, np.uint8)
    return out


def _reach(n: np.ndarray, place: np.ndarray, least: float) -> np.ndarray:
    """The greatest size of a partner whose first common shingle stands at `place` of a text of n."""
    return np.floor((n - place) * (1 + least) / least - n + 1e-6).astype(np.int64)


def early(words: list[str], size: int, level: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(text number, hash << 16 | greatest size of a partner) of the shingles that can be the first common ones; for
    each text its number of distinct shingles and 256 bits of parity."""
    docs, keys, sizes, bits = [], [], [], []
    for i in range(0, len(words), 256):
        some = words[i : i + 256]
        doc, h = _shingles(some, size)
        packed = np.sort(doc.astype(_U) << _U(56) | level[(h & _U(len(level) - 1)).astype(np.int64)].astype(_U) << _U(48) | h)
        packed = packed[np.append(True, packed[1:] != packed[:-1])[: len(packed)]]
        doc, h = (packed >> _U(56)).astype(np.int64), packed & _U((1 << 48) - 1)
        n = np.bincount(doc, minlength=len(some))
        parity = np.bincount(doc * 256 + (h & _U(255)).astype(np.int64), minlength=256 * len(some)) & 1
        reach = _reach(n[doc], np.arange(len(doc)) - (np.cumsum(n) - n)[doc], least)
        ok = reach >= np.ceil(least * n[doc] - 1e-6)
        docs.append(doc[ok] + i)
        keys.append(h[ok] << _U(16) | np.minimum(reach[ok], _CAP).astype(_U))
        sizes.append(n)
        bits.append(np.packbits(parity.astype(np.uint8).reshape(-1, 256), axis=1))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(sizes), np.concatenate(bits)


def _emit(size: int, level, least: float, parts: int, cuts: list[int], salts: int, kind: int, prepare=None):
    """(h, words) to bodies for the units: classes, sizes, bits, numbers of shingles, shingles of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in prepare(batches) if prepare else batches:
            classes, words = batch.column("h").to_numpy(zero_copy_only=False), batch.column("words").to_pylist()
            for i in range(0, len(words), 8192):
                turn += 1
                h = classes[i : i + 8192]
                doc, key, n, bits = early(words[i : i + 8192], size, level.value, least)
                part = ((key >> _U(32)) * _U(parts) >> _U(32)).astype(np.uint16)
                by = np.argsort(part, kind="stable")
                doc, key, ends = doc[by], key[by], np.cumsum(np.bincount(part, minlength=parts))
                edges = np.array([0, *cuts, 1 << 40])  # chunk c holds the sizes above edges[c], up to edges[c + 1]
                low, high = (n, n) if kind == 0 else (np.ceil(least * n - 1e-6), np.floor(n / least + 1e-6))
                out = []
                for c in range(len(edges) - 1):
                    there = (high > edges[c]) & (low <= edges[c + 1])
                    for p in range(parts):
                        d, k = doc[ends[p - 1] if p else 0 : ends[p]], key[ends[p - 1] if p else 0 : ends[p]]
                        k, d = k[there[d]], d[there[d]]
                        if len(d):
                            count = np.bincount(d, minlength=len(n))
                            own = np.nonzero(count)[0]
                            body = b"".join(x.tobytes() for x in (h[own], n[own].astype(np.int32), bits[own], count[own].astype(np.int32), k))
                            unit = (c * parts + p) * salts
                            out += [(unit + s, kind, len(own), body) for s in (range(salts) if kind == 0 else [turn % salts])]
                for row in out:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["unit", "kind", "n", "body"])

    return run


def _read(n: int, body: bytes) -> tuple[np.ndarray, ...]:
    h, sizes = np.frombuffer(body, np.int64, n), np.frombuffer(body, np.int32, n, 8 * n)
    bits, count = np.frombuffer(body, _U, 4 * n, 12 * n).reshape(n, 4), np.frombuffer(body, np.int32, n, 44 * n)
    return h, sizes, bits, count, np.frombuffer(body, _U, -1, 48 * n)


class Places:
    """The early shingles of the held-out texts of a unit, by hash and size of the text."""

    def __init__(self, bodies: list[tuple[int, bytes]], least: float):
        self.least = least
        self.h, self.sizes, self.bits, count, key = (np.concatenate(x) for x in zip(*(_read(n, b) for n, b in bodies)))
        text = np.repeat(np.arange(len(self.h), dtype=np.int32), count)
        at = (key & ~_U(_CAP)) | np.minimum(self.sizes, _CAP).astype(_U)[text]
        by = np.argsort(at)
        self.at, self.text, self.reach = at[by], text[by], (key[by] & _U(_CAP)).astype(np.int32)
        self.met = np.zeros(len(self.h), bool)

    def meet(self, n: int, body: bytes, most: int = 1 << 20) -> np.ndarray:
        """The classes of training texts that meet a held-out text here; those are noted in `met`."""
        h, sizes, bits, count, key = _read(n, body)
        low = np.minimum(np.ceil(self.least * sizes - 1e-6), _CAP).astype(_U)
        who = np.repeat(np.arange(n, dtype=np.int32), count)
        by = np.argsort(key)
        who, key = who[by], key[by]
        first = np.searchsorted(self.at, (key & ~_U(_CAP)) | low[who])
        some = np.nonzero(first < len(self.at))[0]
        some = some[self.at[first[some]] <= key[some]]
        who, first, width = who[some], first[some], np.searchsorted(self.at, key[some], "right") - first[some]
        seen, done, lo = np.zeros(n, bool), np.cumsum(width), 0
        share = (1 - self.least) / (1 + self.least)
        while lo < len(who):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] - width[lo] + most)))
            w = width[lo:hi]
            a = np.repeat(who[lo:hi], w)
            j = np.arange(w.sum()) + np.repeat(first[lo:hi] - (np.cumsum(w) - w), w)
            ok = np.minimum(sizes, _CAP)[a] <= self.reach[j]
            a, b = a[ok], self.text[j[ok]]
            apart = np.bitwise_count(bits[a] ^ self.bits[b]).sum(1)
            ok = apart <= (sizes[a] + self.sizes[b]) * share + 1e-6
            seen[a[ok]] = self.met[b[ok]] = True
            lo = hi
        return h[seen]


def _meet(least: float):
    """The bodies of each unit, those of the held-out texts first, to (kind, class) of the texts that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, bodies, places = None, [], None
        row = lambda kind, h: pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind), pa.int32()), pa.array(h, pa.int64())], names=["kind", "h"])
        for batch in batches:
            for unit, kind, n, body in zip(*(batch.column(c) for c in ("unit", "kind", "n", "body"))):
                if unit.as_py() != here:
                    if places:
                        yield row(0, places.h[places.met])
                    here, bodies, places = unit.as_py(), [], None
                if kind.as_py() == 0:
                    bodies.append((n.as_py(), body.as_py()))
                elif bodies or places:
                    if places is None:
                        places, bodies = Places(bodies, least), []
                    yield row(1, places.meet(n.as_py(), body.as_py()))
        if places:
            yield row(0, places.h[places.met])

    return run


def partners(train: DataFrame, held: DataFrame, prepare, size: int, least: float, places: int = 8_000_000, texts: int = 2_000_000) -> DataFrame:
    """(kind, h): the classes of held-out (0) and training texts (1) that can have a partner; none that has one is missing.

    train: columns that `prepare` makes (h, size, words) of; held: (h, size, words). places, texts: how many early
    shingles and held-out texts a unit has, about. None of them changes that no partner is lost.
    """
    spark = held.sparkSession
    stats = held.agg(F.count("*").alias("texts"), F.coalesce(F.sum("size"), F.lit(0)).alias("shingles")).first()
    chunks = max(1, math.ceil(stats.texts / texts))
    cuts = sorted(set(held.agg(F.percentile_approx("size", [i / chunks for i in range(1, chunks)], 10_000).alias("q")).first().q or [])) if chunks > 1 else []
    parts = min(_CAP, max(1, math.ceil((stats.shingles * (1 - least) + stats.texts) / (len(cuts) + 1) / places)))
    units = parts * (len(cuts) + 1)
    salts = max(1, math.ceil(spark.sparkContext.defaultParallelism / units))
    level = spark.sparkContext.broadcast(levels(held, size, min(24, max(10, int(stats.shingles).bit_length()))))
    one = held.select("h", "words").mapInArrow(_emit(size, level, least, parts, cuts, salts, 0), _UNIT)
    two = train.mapInArrow(_emit(size, level, least, parts, cuts, salts, 1, prepare), _UNIT)
    placed = one.unionByName(two).repartitionById(units * salts, "unit").sortWithinPartitions("unit", "kind")
    return materialize(placed.mapInArrow(_meet(least), "kind int, h long").distinct(), "partners")
