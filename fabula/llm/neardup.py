"""Groups of near-same records (problem 4): BagMinHash, banding, verification, connected components.

1. A text is the multiset of its shingles, weighted by their frequency. Its class is the hash of its raw text; every
   row is signed, but copies within a task are signed once.
2. A task buckets its documents by band key and sends every entry, in blobs of sorted keys, to the task that owns the
   key. Entries that differ only in copies are one. The signature of a multiset holds that of its set (its first
   interval), so where texts are to be linked by their sets, bands in which the two differ are keyed by both.
3. The owner of a bucket of up to `whole` classes pairs all of them; a 128-bit sketch that travels with the entries
   drops pairs that are far apart (below). A larger bucket is first reduced to stars around its smallest and its
   greatest class, and its entries are kept.
4. The pairs are verified on their exact shingles: the overlap of their multisets and that of their sets are counted,
   and one of them, as asked, decides. The verified links are merged into components.
5. A kept bucket that now lies in one component needs nothing more, which is so for copies and small edits. The others
   are searched exactly, block by block: all links between their classes that join components are found through the
   rarest shingles of the smaller text (a pair that reaches the bound shares one of them). So a hot group of texts that
   share boilerplate without being alike loses no link to its size, and no task holds more than two blocks of it.

Recall of a pair of similarity s with b bands of r rows: 1 - (1 - s**r)**b. With r = 4 and b = 64 it is 0.998 at
0.55 and above 0.9999 at 0.6; the sketch loses less than 2 in 100,000 of such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.words import flat_shingles, mix
from fabula.llm.bagminhash import bag_signatures, band_keys, bit_sketch, set_signatures
from fabula.llm.components import components
from fabula.session import materialize

_U = np.uint64
_BLOB = "part int, keys binary, owner binary, classes binary, sketches binary"
_PAIR = "a long, b long"


def _bucket_pairs(key: np.ndarray, cls: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of entries that share a bucket: all pairs in a bucket of up to `whole` classes, and those with the
    smallest and the greatest class in a larger one; the bucket and the index of each entry of the larger ones, of which
    those with the same classes are given once."""
    order = np.lexsort((cls, key))
    k, c = key[order], cls[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    order, k, c = order[fresh], k[fresh], c[fresh]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    starts = np.nonzero(new)[0]
    lengths = np.diff(np.append(starts, len(k)))
    first, length = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    here = np.arange(len(k))
    left, right = [], []
    some = here[(length > 1) & (length <= whole)]
    for distance in range(1, whole):
        some = some[some + distance < first[some] + length[some]]
        if not len(some):
            break
        left.append(some), right.append(some + distance)
    large = length > whole
    last = first + length - 1
    up, down = large & (here != first), large & (here != first) & (here != last)
    left += [first[up], here[down]]
    right += [here[up], last[down]]
    # equal sets of classes get one name; two sets of one name would be searched together, which loses nothing
    names = np.add.reduceat(mix(c.view(_U)), starts).view(np.int64)
    once = np.zeros(len(starts), bool)
    once[np.nonzero(lengths > whole)[0][np.unique(names[lengths > whole], return_index=True)[1]]] = True
    kept = np.repeat(once, lengths)
    return np.stack([order[np.concatenate(left)], order[np.concatenate(right)]], 1), np.repeat(names, lengths)[kept], order[kept]


def _near(pairs: np.ndarray, sketch: np.ndarray, most: int) -> np.ndarray:
    """Pairs whose sketches differ in at most `most` bits."""
    differ = np.bitwise_count(sketch[pairs[:, 0]] ^ sketch[pairs[:, 1]]).sum(1)
    return pairs[differ <= most]


def _pairs_of(pairs: np.ndarray, cls: np.ndarray) -> np.ndarray:
    both = np.sort(cls[pairs], axis=1)
    both = both[both[:, 0] != both[:, 1]]
    return np.unique(both, axis=0) if len(both) else both


def _sign(size: int, bands: int, rows: int, parts: int, multisets: bool, flush: int):
    """Rows (h, text) to blobs for the owners of key ranges."""
    registers = bands * rows

    def work(texts: dict[int, str]) -> Iterator[pa.RecordBatch]:
        cls = np.fromiter(texts, np.int64, len(texts))
        bodies = list(texts.values())
        keys, sketches, owners, places = [], [], [], []
        docs, grams, counts = [], [], []
        for i in range(0, len(bodies), 4096):
            d, g, w = flat_shingles(bodies[i : i + 4096], size, counted=True)
            docs.append(d + i), grams.append(g), counts.append(w)
        doc, gram, count = np.concatenate(docs), np.concatenate(grams), np.concatenate(counts)
        have, starts, lengths = np.unique(doc, return_index=True, return_counts=True)
        done = 0
        for block in np.array_split(np.argsort(lengths, kind="stable"), max(1, len(have) // 256)):
            if not len(block):
                continue
            take = np.concatenate([np.arange(starts[j], starts[j] + lengths[j]) for j in block])
            local = np.repeat(np.arange(len(block)), lengths[block])
            plain = set_signatures(local, gram[take], len(block), registers)
            bag = bag_signatures(plain, local, gram[take], count[take])
            here, mine = np.broadcast_to(np.arange(done, done + len(block))[:, None], (len(block), bands)), band_keys(bag, rows)
            keys.append(mine.ravel()), places.append(here.ravel())
            if not multisets:
                others = band_keys(plain, rows)
                keys.append(others[others != mine]), places.append(here[others != mine])
            sketches.append(bit_sketch(bag if multisets else plain)), owners.append(have[block])
            done += len(block)
        if not keys:
            return
        owner = np.concatenate(owners)
        sketch = np.concatenate(sketches)
        key, who = np.concatenate(keys), np.concatenate(places)
        mine = cls[owner]
        out = []
        part = (key >> _U(20)) % _U(parts)
        for p in range(parts):
            chosen = np.nonzero(part == p)[0]
            if len(chosen):
                chosen = chosen[np.argsort(key[chosen], kind="stable")]
                docs_here, index = np.unique(who[chosen], return_inverse=True)
                out.append((p, np.ascontiguousarray(_squeeze(key[chosen])), index.astype(np.uint32 if len(docs_here) > 65535 else np.uint16).tobytes(), mine[docs_here].tobytes(), sketch[docs_here].tobytes()))
        yield _blob(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, str] = {}
        volume = 0
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                if h not in texts:
                    texts[h] = text
                    volume += len(text)
            if len(texts) >= flush or volume > 64_000_000:
                yield from work(texts)
                texts, volume = {}, 0
        if texts:
            yield from work(texts)

    return run


def _squeeze(key: np.ndarray) -> bytes:
    """The low 40 bits of keys whose upper bits choose the part."""
    raw = (key ^ (key >> _U(24))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return raw.tobytes()


def _widen(raw: bytes) -> np.ndarray:
    full = np.zeros((len(raw) // 5, 8), np.uint8)
    full[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return full.view("<u8").ravel()


def _blob(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array([bytes(r[i]) if i else r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "owner", "classes", "sketches"])


def _collide(most: int, whole: int):
    """Blobs to candidate pairs, with a null bucket, and to the entries (bucket, class) of buckets of more than `whole`
    classes. The blobs of one part, and only these, are in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cls, sketch, who = [], [], [], []
        total = 0
        for batch in batches:
            for k, o, c, s in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                n = len(k) // 5
                keys.append(_widen(k))
                who.append(np.frombuffer(o, np.uint16 if len(o) == 2 * n else np.uint32).astype(np.int64) + total)
                cls.append(np.frombuffer(c, np.int64))
                sketch.append(np.frombuffer(s, _U).reshape(len(cls[-1]), -1))
                total += len(cls[-1])
        if not keys:
            return
        key, own, k, s = np.concatenate(keys), np.concatenate(who), np.concatenate(cls), np.concatenate(sketch)
        pairs, names, kept = _bucket_pairs(key, k[own], whole)
        pairs = _pairs_of(_near(own[pairs], s, most), k)
        none = pa.nulls(len(pairs), pa.int64())
        yield _found_batch(none, pairs[:, 0], pairs[:, 1])
        if len(kept):
            yield _found_batch(names, k[own[kept]], pa.nulls(len(kept), pa.int64()))

    return run


def _found_batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=["bucket", "a", "b"])


def _search(size: int, least: float, multisets: bool):
    """The rows (bucket, block, other, own, a, label, ta) of two blocks of a bucket to links that join its labels; every
    two classes that reach `least`, one of each block, are connected by the links and labels afterwards."""
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()), ("overlap", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        h, texts = table.column("a").to_numpy(), table.column("ta").to_pylist()
        own, two = table.column("own").to_numpy(), table.column("block")[0].as_py() != table.column("other")[0].as_py()
        doc, gram, times = flat_shingles(texts, size, counted=True)
        label = table.column("label").to_numpy().copy()
        lengths = np.bincount(doc, minlength=len(texts))
        _, gram, count = np.unique(gram, return_inverse=True, return_counts=True)
        begins = np.cumsum(lengths) - lengths
        place, begin = doc[np.argsort(gram, kind="stable")], np.append(0, np.cumsum(count))
        order = np.lexsort((h, lengths))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found = []
        for i in order.tolist():
            if (label == label[0]).all():
                break
            codes = gram[begins[i] : begins[i] + lengths[i]]
            if not len(codes):
                continue
            # a partner of at least this size shares 2 s / (1 + s) of the shingles, so one of the rarest of the others
            need = int(np.ceil(2 * least / (1 + least) * len(codes) - 1e-9))
            if multisets:  # frequencies may make up for missing shingles, so each shingle may be the only common one
                need = 1
            rare = codes[np.argsort(count[codes], kind="stable")][: len(codes) - need + 1]
            near = np.unique(np.concatenate([place[begin[g] : begin[g + 1]] for g in rare]))
            near = near[(rank[near] > rank[i]) & (label[near] != label[i])]
            if two:
                near = near[own[near] != own[i]]
            if not multisets:
                near = near[lengths[i] >= least * lengths[near]]
            if not len(near):
                continue
            bag, set_ = overlaps(np.stack([np.zeros(len(near), np.int64), np.arange(1, len(near) + 1)], 1), [texts[i], *(texts[j] for j in near.tolist())], size)
            for j, s, o in zip(near.tolist(), (bag if multisets else set_).tolist(), bag.tolist()):
                if s >= least and label[j] != label[i]:
                    found.append((min(h[i], h[j]), max(h[i], h[j]), s, o))
                    label[label == label[j]] = label[i]
        return pa.Table.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds.types)], schema=kinds)

    return run


def overlaps(pairs: np.ndarray, texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(overlap of the multisets, overlap of the sets) of the shingles of pairs of texts, given by their numbers: the
    sum of the smaller frequencies by that of the greater ones, and the number of common shingles by that of all."""
    doc, gram, count = flat_shingles(texts, size, counted=True)
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    kinds, total = np.diff(begin), np.bincount(doc, count, len(texts))
    set_, bag = np.zeros(len(pairs)), np.zeros(len(pairs))
    for lo in range(0, len(pairs), 4096):
        some = pairs[lo : lo + 4096].ravel()
        n = kinds[some]
        at = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = (np.repeat(np.arange(len(some)) // 2, n).astype(_U) << _U(48)) | gram[at]
        by = np.argsort(key, kind="stable")
        key, times = key[by], count[at][by]
        same = np.nonzero(key[1:] == key[:-1])[0]
        pair = (key[same] >> _U(48)).astype(np.int64)
        m = len(some) // 2
        set_[lo : lo + m] = np.bincount(pair, minlength=m)
        bag[lo : lo + m] = np.bincount(pair, np.minimum(times[same], times[same + 1]), m)
    either = np.maximum(kinds[pairs].sum(1) - set_, 1)
    return bag / np.maximum(total[pairs].sum(1) - bag, 1), set_ / either


def _verify(size: int, least: float, multisets: bool):
    """(a, b, ta, tb) to (a, b, similarity, overlap) of pairs that reach `least`: similarity is that of their sets, or
    of their multisets as asked, overlap that of their multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            texts = dict(zip(a.tolist(), batch.column("ta").to_pylist())) | dict(zip(b.tolist(), batch.column("tb").to_pylist()))
            number = {h: i for i, h in enumerate(texts)}
            pairs = np.array([[number[i], number[j]] for i, j in zip(a.tolist(), b.tolist())], np.int64).reshape(-1, 2)
            bag, set_ = overlaps(pairs, list(texts.values()), size)
            s = bag if multisets else set_
            ok = s >= least
            yield pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64()), pa.array(s[ok], pa.float64()), pa.array(bag[ok], pa.float64())], names=["a", "b", "similarity", "overlap"])

    return run


def text_members(records: DataFrame, id_column: str, text_column: str, version: str | None = None) -> DataFrame:
    """id, h: each id once with the class of its text: that of the last delivery, of equal ones the greatest class.
    Rows with a null id or text are left out."""
    v = F.col(version) if version else F.lit(0)
    rows = records.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.struct(v.alias("v"), F.xxhash64(F.col(text_column)).alias("h")).alias("c"))
    return rows.groupBy("id").agg(F.max("c").alias("c")).select("id", F.col("c.h").alias("h"))


def near_duplicate_links(records: DataFrame, id_column: str = "id", text_column: str = "story", version: str | None = "loaded_at", size: int = 5, least: float = 0.8, bands: int = 64, rows: int = 4, multisets: bool = False, flush: int = 20_000, most_bytes: int = 64_000_000, whole: int = 64, block: int = 5_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, copied): a, b, similarity, overlap of verified pairs of text classes; id, h of all ids; h of
    classes of two or more ids whose text has shingles.

    size: words in a shingle; least: the similarity from which texts are linked; multisets: it is that of the
    multisets of shingles, otherwise that of the sets; bands, rows: of the signature; whole: classes up to which a
    bucket is paired at once; block: classes of a larger one that are searched against as many others in one task;
    most_bytes: size up to which the ids of texts to verify, as measured, are broadcast. Links are not all pairs:
    classes that are alike are connected through them, directly or through others. A text of fewer than `size` words
    has no shingles and no link.
    """
    spark = records.sparkSession
    members = materialize(text_members(records, id_column, text_column, version), "members")
    n = members.count()
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), n * bands // 4_000_000)
    # Two texts of similarity s differ in 64 * (1 - s) bits of 128 on average; five deviations are allowed.
    p = (1 - least) / 2
    most = int(128 * p + 5 * (128 * p * (1 - p)) ** 0.5)
    texts = records.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.xxhash64(F.col(text_column)).alias("h"), F.col(text_column).alias("text"))
    blobs = texts.mapInArrow(_sign(size, bands, rows, parts, multisets, flush), _BLOB)
    placed = blobs.repartitionById(parts, F.pmod(F.col("part"), F.lit(parts)))
    found = materialize(placed.mapInArrow(_collide(most, whole), "bucket long, " + _PAIR).distinct(), "pairs")
    pairs, large = found.where("bucket is null").select("a", "b"), found.where("bucket is not null").select("bucket", "a")
    wanted = found.select(F.explode(F.array("a", "b")).alias("h")).where("h is not null").distinct().withColumn("paired", F.lit(True))
    classes = members.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(wanted, "h", "left").where("paired or n > 1")
    chosen = materialize(classes.select("h", "id", "n"), "chosen")
    in_memory = chosen.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 64).alias("s")).first().s or 0
    ids = chosen if in_memory > most_bytes else F.broadcast(chosen)
    with_text = records.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(ids, "id").where(F.xxhash64("text") == F.col("h"))
    bodies = materialize(with_text.select("h", "n", "text").dropDuplicates(["h"]), "bodies")
    left, right = bodies.select(F.col("h").alias("a"), F.col("text").alias("ta")), bodies.select(F.col("h").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    kind = _PAIR + ", similarity double, overlap double"
    links = materialize(joined.mapInArrow(_verify(size, least, multisets), kind), "links")
    if not large.isEmpty():
        known = components(links.select("a", "b")).select(F.col("node").alias("a"), "label")
        entries = large.join(known, "a", "left").select("bucket", "a", F.coalesce("label", "a").alias("label"))
        mixed = entries.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
        placed = entries.join(mixed.where("low <> high").select("bucket", "blocks"), "bucket").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        groups = placed.join(left, "a").select("bucket", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"), "own", "a", "label", "ta")
        more = groups.groupBy("bucket", "block", "other").applyInArrow(_search(size, least, multisets), kind)
        links = materialize(links.unionByName(more), "links")
    copied = bodies.where("n > 1").select("h", "text").mapInArrow(_long_enough(size), "h long")
    return links, members, copied


def near_duplicate_groups(records: DataFrame, id_column: str = "id", text_column: str = "story", version: str | None = "loaded_at", size: int = 5, least: float = 0.8, **more) -> DataFrame:
    """id, group_id, class: one row per id that is linked to another, directly or through others.

    group_id is the smallest id of the group; copies of one text share a class. A null or blank text, or one of fewer
    than `size` words, is in no group. An empty table gives no rows. Other columns are ignored.
    """
    links, members, copied = near_duplicate_links(records, id_column, text_column, version, size, least, **more)
    nodes = links.select("a", "b").unionByName(copied.select(F.col("h").alias("a"), F.col("h").alias("b")))
    label = components(nodes)
    keyed = members.join(label.select(F.col("node").alias("h"), "label"), "h").select("id", F.col("h").alias("class"), "label")
    least_id = keyed.groupBy("label").agg(F.min("id").alias("group_id"))
    return keyed.join(least_id, "label").select("id", "group_id", "class")


def _long_enough(size: int):
    from fabula.functions.words import split_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, text = batch.column("h").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([i for i, t in zip(h, text) if len(split_words(t)) >= size], pa.int64())], names=["h"])

    return run
