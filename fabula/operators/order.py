"""Row numbers and running sums over a global order, in two levels.

The rows are range-partitioned by the order and written once; the sum of each partition is small, and a running sum
of these, joined back, lets every partition number its own rows. No single task ever sees all rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.session import materialize


def running_total(df: DataFrame, order: list[str], value: str, into: str) -> DataFrame:
    """df with the sum of `value` over all rows before this one (exclusive), in ascending order of the columns.

    The order must be unique, or the result within ties is arbitrary. A null value counts as 0. An empty table stays
    empty.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    amount = F.coalesce(F.col(value), F.lit(0))
    parts = ranged.groupBy("__part").agg(F.sum(amount).alias("__sum"))  # one row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), "__part").withColumn(into, F.col("__base") + F.col("__local")).drop("__part", "__base", "__local")


def row_numbers(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with the number of rows before this one, from 0."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", into).drop("__one")


def keyed_scan(df: DataFrame, keys: list[str], order: list[str], value: str, into: str, how: str = "sum", exclusive: bool = False) -> DataFrame:
    """df with the running sum, or the last value that isn't null, of `value` within each key, in ascending order.

    The rows are range-partitioned by key and order together, so a key with a third of all rows is spread over many
    tasks; what a partition's first key brings along from earlier partitions comes from one row for each partition.
    exclusive: without the row itself. Nulls count as 0 in sums and are passed over otherwise; where there is nothing
    yet, a sum is 0 and a last value null. Null keys are a key. The order should be unique within a key.
    """
    key = F.struct(*(F.col(k) for k in keys))
    ranged = materialize(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "keyed")
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    amount = F.coalesce(F.col(value), F.lit(0)) if how == "sum" else F.col(value)
    scan = F.coalesce(F.sum(amount).over(inside), F.lit(0)) if how == "sum" else F.last(amount, ignorenulls=True).over(inside)
    ends = ranged.groupBy("__part").agg(F.min(key).alias("__first"), F.max(key).alias("__last"))  # one row for each partition
    of_last = ranged.join(F.broadcast(ends), "__part").where(key.eqNullSafe(F.col("__last")))
    total = F.sum(amount) if how == "sum" else F.max_by(amount, F.when(F.col(value).isNotNull(), F.struct(*order)))
    # per partition: what it leaves to later ones for its last key, and (earlier in the line) its question for its first
    left = of_last.groupBy("__part").agg(F.first("__last").alias("__key"), total.alias("__value")).select("__part", F.lit(1).alias("__turn"), "__key", "__value")
    asks = ends.select("__part", F.lit(0).alias("__turn"), F.col("__first").alias("__key"), F.lit(None).cast(left.schema["__value"].dataType).alias("__value"))
    line = Window.partitionBy("__key").orderBy("__part", "__turn").rowsBetween(Window.unboundedPreceding, -1)
    brought = F.sum("__value").over(line) if how == "sum" else F.last("__value", ignorenulls=True).over(line)
    carry = asks.unionByName(left).withColumn("__carry", brought).where("__turn = 0 and __carry is not null").select("__part", F.col("__key").alias("__first"), "__carry")
    joined = ranged.withColumn("__scan", scan).join(F.broadcast(carry), "__part", "left")
    own = F.when(key.eqNullSafe(F.col("__first")), F.col("__carry"))
    result = F.col("__scan") + F.coalesce(own, F.lit(0)) if how == "sum" else F.coalesce("__scan", own)
    return joined.withColumn(into, result).drop("__part", "__scan", "__first", "__carry")


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and, for each name, the percentile of `value` within the key, interpolated between ranks.

    The rows are ranked along the global order of (keys, value), so a key with a third of all rows is no single task;
    of each key two rows a percentile are picked. Nulls don't count; a key with nothing else has no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), F.lit(1).cast("long").alias("__one"))
    ranked = keyed_scan(rows, keys, ["__v"], "__one", "__i", exclusive=True)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    of_key = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__n")
    both = ranked.join(of_key, reduce(and_, same))
    places = {name: (F.col("__n") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    near = both.where(reduce(or_, ((F.col("__i") == end(p)) for p in places.values() for end in (F.floor, F.ceil))))
    at = lambda p, end: F.max(F.when(F.col("__i") == end(p), F.col("__v")))
    part = lambda p: F.max(p - F.floor(p))
    return near.groupBy(*keys).agg(*((at(p, F.floor) + (at(p, F.ceil) - at(p, F.floor)) * part(p)).alias(name) for name, p in places.items()))
