"""Frequency of every distinct term, by burst-trie counting (problem 2).

Each worker routes its terms by prefixes into small containers; a container that grows too large bursts into one
container for each next character, so that prefixes adapt to the data. The containers travel as compact subtrees
keyed by (field, prefix); the worker that owns a prefix merges the subtrees of all workers into one trie. As workers
may have burst the same region to different depths, the merged counters of a term are added up once more, which
makes the result independent of where and when a container burst, and lets every trie be emptied whenever it reaches
its memory bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.words import fold

_SPACE = re.compile(r"\s+")


def normal_term(text: str | None) -> str:
    """NFKC, without format characters, lower-cased, trimmed, inner white space as one space; null gives ''."""
    if not text:
        return ""
    folded = fold(text)
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", folded) if not folded.isascii() else folded).strip()


class BurstTrie:
    """Occurrence and record counters of terms, in containers that burst when they hold too many terms."""

    def __init__(self, limit: int = 512):
        self.limit, self.root, self.size = limit, {}, 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        """A node is a dict with '' -> counters of the term that ends there and char -> node; a container is a
        list holding one dict, rest of term -> counters."""
        node, depth, parent = self.root, 0, None
        while isinstance(node, dict):
            parent = node
            if depth == len(term):
                if (own := node.get("")) is None:
                    node[""] = (occurrences, records)
                    self.size += 1
                else:
                    node[""] = (own[0] + occurrences, own[1] + records)
                return
            if (node := parent.get(term[depth])) is None:
                node = parent[term[depth]] = [{}]
            depth += 1
        inside, rest = node[0], term[depth:]
        if (own := inside.get(rest)) is None:
            inside[rest] = (occurrences, records)
            self.size += 1
            if len(inside) > self.limit:
                parent[term[depth - 1]] = self._burst(inside)
        else:
            inside[rest] = (own[0] + occurrences, own[1] + records)

    def graft(self, prefix: str, inside: dict) -> None:
        """Merge a subtree {rest: counters} where it belongs: as a whole where nothing or a container hangs at its
        prefix, and term by term where the two tries have burst to different depths."""
        node = self.root
        for char in prefix[:-1]:
            if isinstance(node, list):
                break
            node = node.setdefault(char, {})
        below = node.get(prefix[-1], [{}]) if prefix and isinstance(node, dict) else None
        if not isinstance(below, list):
            for rest, (n, k) in inside.items():
                self.add(prefix + rest, n, k)
            return
        held = below[0]
        before = len(held)
        for rest, (n, k) in inside.items():
            own = held.get(rest, (0, 0))
            held[rest] = (own[0] + n, own[1] + k)
        self.size += len(held) - before
        node[prefix[-1]] = self._burst(held) if len(held) > self.limit else below

    @staticmethod
    def _burst(inside: dict) -> dict:
        node: dict = {}
        for rest, counters in inside.items():
            if rest:
                node.setdefault(rest[0], [{}])[0][rest[1:]] = counters
            else:
                node[""] = counters
        return node

    def subtrees(self) -> Iterator[tuple[str, dict]]:
        """(prefix, {rest: counters}) of every container and of every term that ends at a node."""
        stack: list[tuple[str, object]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if isinstance(node, list):
                yield prefix, node[0]
                continue
            for char, below in node.items():
                if char:
                    stack.append((prefix + char, below))
                else:
                    yield prefix, {"": below}


def _pack(inside: dict) -> bytes:
    rests = sorted(inside)
    return zlib.compress(json.dumps([rests, [inside[r][0] for r in rests], [inside[r][1] for r in rests]]).encode(), 1)


_SUBTREE = "field string, prefix string, subtree binary"
_COUNTS = "field string, term string, occurrences long, records long"


def _count(fields: list[str], limit: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {f: BurstTrie(limit) for f in fields}
        normal: dict[str, str] = {}

        def empty() -> Iterator[pa.RecordBatch]:
            rows = [(f, p, _pack(inside)) for f, t in tries.items() for p, inside in t.subtrees()]
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.binary())],
                    names=["field", "prefix", "subtree"],
                )

        for batch in batches:
            for field in fields:
                trie = tries[field]
                for entries in batch.column(field).to_pylist():
                    if not entries:
                        continue
                    own: dict[str, int] = {}
                    for raw in entries:
                        if raw is None:
                            continue
                        if (term := normal.get(raw)) is None:
                            if len(normal) > 500_000:
                                normal.clear()
                            term = normal[raw] = normal_term(raw)
                        if term:
                            own[term] = own.get(term, 0) + 1
                    for term, n in own.items():
                        trie.add(term, n, 1)
            if sum(t.size for t in tries.values()) > bound:
                yield from empty()
                tries = {f: BurstTrie(limit) for f in fields}
        yield from empty()

    return run


def _merge(limit: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}

        def empty() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for field, trie in tries.items():
                for prefix, inside in trie.subtrees():
                    rows.extend((field, prefix + rest, n, k) for rest, (n, k) in inside.items())
            for i in range(0, len(rows), 16384):
                columns = zip(*rows[i : i + 16384])
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["field", "term", "occurrences", "records"])

        for batch in batches:
            for field, prefix, subtree in zip(*(batch.column(c).to_pylist() for c in ("field", "prefix", "subtree"))):
                trie = tries.setdefault(field, BurstTrie(limit))
                rests, occurrences, records = json.loads(zlib.decompress(subtree))
                trie.graft(prefix, dict(zip(rests, zip(occurrences, records))))
            if sum(t.size for t in tries.values()) > bound:
                yield from empty()
                tries.clear()
        yield from empty()

    return run


def term_counts(records: DataFrame, fields: list[str], id_column: str = "id", version: str | None = "loaded_at", container: int = 512, bound: int = 2_000_000) -> DataFrame:
    """field, term, occurrences, records of every distinct term of the array columns `fields`.

    A record is a distinct id (null ids form one record); of several deliveries of an id the last by `version`
    counts, and among ties the one with the greatest content, so the result doesn't depend on row order. Null arrays
    and null, blank or format-only entries give nothing. `container`: terms that a container holds before it bursts.
    `bound`: terms that a worker keeps before its tries are sent on. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    content = F.struct(*([F.col(version).alias("v")] if version else []), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    once = records.select(F.col(id_column).alias("id"), content.alias("c")).groupBy("id").agg(F.max("c").alias("c"))
    lists = once.select(*(F.col(f"c.f{i}").alias(f) for i, f in enumerate(fields)))
    subtrees = lists.mapInArrow(_count(fields, container, bound), _SUBTREE)
    merged = subtrees.repartition("field", "prefix").mapInArrow(_merge(container, bound), _COUNTS)
    return merged.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.02) -> DataFrame:
    """counts with mark: `rare` for fewer than `rare_below` records, `common` for more than the share `common_above`
    of all records, else null. A term that is both is `rare`."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.lit(n_records), "common")
    return counts.withColumn("mark", mark)
