"""Filling containers of fixed capacity (problem 5), along a space-filling curve.

Items become points: hashed term vectors, projected to a few dimensions by random signs. The items are range-sorted by
their Hilbert key, so neighbours on the curve are alike, and every partition packs its stretch of the curve from a
window of successive items: a container begins with the window's largest item and is filled up by the largest that
fit, and at last by the item or the pair of items that leaves the least room. A part of the window always waits for
the items to come, so that there is a choice. An item above the capacity is split into full containers and a rest,
which is packed like any other item. Only a partition's last containers may stay poorly filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.words import hash_words, mix, split_words
from fabula.llm.hilbert import hilbert_key
from fabula.session import materialize

_ITEM = "item string, v timestamp, size long, curve long"
_PLACE = "item string, piece int, size long, container string, container_fill long"
DIMENSIONS, BITS = 4, 15


def project(texts: list[str | None], dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Curve positions of texts: hashed word counts, random signs, and the rank of a normal variable on each axis."""
    lengths, parts = [], []
    for text in texts:
        words = split_words(text)
        lengths.append(len(words))
        parts.extend(words)
    hashes = hash_words(parts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    axes = np.zeros((len(texts), dimensions))
    for i in range(dimensions):
        sign = 1.0 - 2.0 * ((mix(hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)) & np.uint64(1)).astype(float)
        axes[:, i] = np.bincount(owner, weights=sign, minlength=len(texts))
    axes /= np.sqrt(np.maximum(np.array(lengths), 1))[:, None]
    cells = np.clip((axes + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64)
    return hilbert_key(cells, bits).astype(np.int64)


def _curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("v"), batch.column("size"), pa.array(project(batch.column("text").to_pylist()), pa.int64())], names=["item", "v", "size", "curve"])


def _fill(sizes: np.ndarray, capacity: int) -> list[int]:
    """Places, in an ascending array of sizes, of the items of one container; the last (largest) is among them."""
    chosen = [len(sizes) - 1]
    room = capacity - int(sizes[-1])
    free = np.ones(len(sizes), bool)
    free[-1] = False
    while room > 0:
        places = np.nonzero(free[: np.searchsorted(sizes, room, "right")])[0]
        if not len(places):
            break
        here = sizes[places]
        if len(places) > 1 and room < 3 * int(here[-1]):
            # of each item with the largest other one that still fits
            other = np.minimum(np.searchsorted(here, room - here, "right") - 1, np.arange(len(here)) - 1)
            total = np.where(other >= 0, here + here[other], 0)
            best = int(total.argmax())
            if total[best] > here[-1]:
                take = [int(places[best]), int(places[other[best]])]
            else:
                take = [int(places[-1])]
        else:
            take = [int(places[-1])]
        chosen.extend(take)
        free[take] = False
        room -= int(sizes[take].sum())
    return chosen


def _pack(capacity: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{TaskContext.get().partitionId():06d}-"
        number = 0
        done: list[tuple] = []

        def place(items: list[tuple[int, str, int]], keep: int) -> list[tuple[int, str, int]]:
            """Fill containers from items (size, item, piece) until at most `keep` are left, which are returned."""
            nonlocal number
            items.sort()
            sizes = np.array([i[0] for i in items], np.int64)
            names = np.arange(len(items))
            while len(sizes) > keep:
                chosen = _fill(sizes, capacity)
                number += 1
                total = int(sizes[chosen].sum())
                for i in names[chosen].tolist():
                    size, item, piece = items[i]
                    done.append((item, piece, size, f"{name}{number:09d}", total))
                sizes, names = np.delete(sizes, chosen), np.delete(names, chosen)
            return [items[i] for i in names.tolist()]

        def out() -> Iterator[pa.RecordBatch]:
            if done:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=["item", "piece", "size", "container", "container_fill"])
                done.clear()

        waiting: list[tuple[int, str, int]] = []
        for batch in batches:
            for item, size in zip(batch.column("item").to_pylist(), batch.column("size").to_pylist()):
                piece = 0
                while size > capacity:
                    number += 1
                    done.append((item, piece, capacity, f"{name}{number:09d}", capacity))
                    size -= capacity
                    piece += 1
                waiting.append((size, item, piece))
                if len(waiting) >= window:
                    waiting = place(waiting, window // 2)
            yield from out()
        place(waiting, 0)
        yield from out()

    return run


def packed_items(items: DataFrame, capacity: int, window: int = 2048, items_per_partition: int = 25_000) -> DataFrame:
    """item, piece, size, container, container_fill: where every item of (item string, v timestamp, size long,
    text string) goes.

    Rows with a null item, or a size that is null or not above zero, are left out. An item that comes several times
    is packed once: its last row by v, among ties that with the greatest size. text places an item on the curve; null
    or empty texts lie together at one point. Ties on the curve are broken by item, so the packing of a stretch
    doesn't depend on the order of rows. window: items from which containers are filled, half of which wait for the
    next ones; items_per_partition: partitions follow from the number of items.
    """
    rows = items.where("item is not null and size > 0").select("item", F.col("v").cast("timestamp").alias("v"), F.col("size").cast("long").alias("size"), "text")
    once = rows.mapInArrow(_curve, _ITEM).groupBy("item").agg(F.max(F.struct("v", "size", "curve")).alias("c"))
    placed = materialize(once.select("item", "c.size", "c.curve"), "curve")
    n = max(1, -(-placed.count() // items_per_partition))
    ordered = placed.repartitionByRange(n, "curve", "item").sortWithinPartitions("curve", "item")
    return ordered.mapInArrow(_pack(capacity, window), _PLACE)


def story_items(records: DataFrame, id_column: str = "id", text_column: str = "story", version: str | None = "loaded_at") -> DataFrame:
    """item, v, size (UTF-8 bytes), text of every row; null ids and texts are left out by packed_items."""
    v = F.col(version) if version else F.lit(None)
    return records.select(F.col(id_column).alias("item"), v.cast("timestamp").alias("v"), F.octet_length(text_column).cast("long").alias("size"), F.col(text_column).alias("text"))


def request_items(runs: DataFrame) -> DataFrame:
    """item (bench_id:request id), v, size (prompt tokens), text (policy, workload, status, size class) of every
    request; a bench_id and request id that comes several times is packed once, with the greatest of its sizes."""
    each = runs.select("bench_id", "policy", "workload", F.explode("per_request").alias("r")).where("bench_id is not null and r.id is not null and r.prompt_tokens > 0")
    words = F.concat_ws(" ", "policy", "workload", "r.status", F.concat(F.lit("size"), F.floor(F.log2("r.prompt_tokens")).cast("string")))
    item = F.concat_ws(":", F.col("bench_id").cast("string"), "r.id")
    return each.select(item.alias("item"), F.lit(None).cast("timestamp").alias("v"), F.col("r.prompt_tokens").cast("long").alias("size"), words.alias("text"))


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """containers, items, pieces, size, least possible containers, mean fill of a packing: one row."""
    each = packed.groupBy("container").agg(F.sum("size").alias("fill"), F.count("*").alias("n"))
    total = F.sum("fill")
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), total.alias("size"), F.ceil(total / capacity).alias("least_containers"), F.round(total / (F.count("*") * capacity), 6).alias("mean_fill"))
