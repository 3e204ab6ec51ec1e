"""Connected components of a table of links, by label propagation with pointer jumping.

Each task first reduces its links to stars, one link for each of its nodes. Every round writes its labels to the shared
folder, so lineage stays short; nothing of the graph reaches the driver but the number of labels that changed. A node
with very many links only costs a partial minimum in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import materialize


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to links from each node to the smallest that a batch connects it with."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of the links (a, b): label is the smallest node of its component.

    Null ends are ignored, repeated links and loops do no harm. No links give no rows.
    """
    stars = links.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_stars, "a long, b long")
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")
    both = materialize(stars.select(ends).select("l.a", "l.b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:  # labels only fall, so this ends
        # the smallest label among the neighbours, then the label of that label
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(seen, labels.node == seen.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = lower.join(up, "label", "left").select("node", "old", F.least(F.col("label"), F.coalesce("top", "label")).alias("label"))
        done = materialize(new, "labels")
        changed = done.where("old <> label").count()
        labels = done.select("node", "label")
        if not changed:
            return labels
