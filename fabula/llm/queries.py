"""The queries of the training-data operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import abuse, leak, mixing, neardup, overlap, packing, pairs, sql, terms
from fabula.tables import table

_HELD = "case substring_index(id, '-', 1) when 'train' then false when 'valid' then true when 'test' then true end"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    judged = pairs.judged_pairs(table(spark, folder, "samples"), table(spark, folder, "heldout_prompts"))
    return judged.where("defect is not null")


def p1_defect_rates(spark: SparkSession, folder: str) -> DataFrame:
    judged = pairs.judged_pairs(table(spark, folder, "samples"), table(spark, folder, "heldout_prompts"))
    total = F.count("*")
    return judged.groupBy("run_id").agg(total.alias("pairs"), *(F.round(F.count_if(F.col("defect") == d) / total, 6).alias(d) for d in pairs.DEFECTS))


def _marked_terms(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "instruct_records")
    n = records.select("id").distinct().count()
    return terms.mark_terms(terms.term_counts(records, ["words", "features"]), n)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked_terms(spark, folder).where("mark is not null").select("field", "term", "mark")


def p2_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _marked_terms(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = overlap.overlapping_ids(table(spark, folder, "instruct_records"), _HELD, size=3, least=0.7)
    return found.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"))


def p3_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(table(spark, folder, "instruct_records"), _HELD, "substring_index(id, '-', 1)", "source", size=3, least=0.7)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(table(spark, folder, "instruct_records"), size=3, least=0.5)
    return groups.select("id", "group_id")


def p5_story_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_items(packing.story_items(table(spark, folder, "instruct_records")), 2048)


def p5_request_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_items(packing.request_items(table(spark, folder, "bench_runs")), 512)


def p5_packing_report(spark: SparkSession, folder: str) -> DataFrame:
    stories = packing.packing_report(p5_story_packing(spark, folder), 2048).withColumn("kind", F.lit("stories"))
    requests = packing.packing_report(p5_request_packing(spark, folder), 512).withColumn("kind", F.lit("requests"))
    return stories.unionByName(requests)


def _packing_check(items: DataFrame, packed: DataFrame, capacity: int, kind: str) -> DataFrame:
    fill = packed.groupBy("container").agg(F.sum("size").alias("fill"), F.max("container_fill").alias("said"))
    good = fill.agg((F.max("fill") <= capacity).alias("within_capacity"), F.min(F.col("fill") == F.col("said")).alias("fills_right"), (F.sum("fill") / (F.count("*") * capacity) > 0.9).alias("nine_tenths_full"))
    sizes = packed.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"))
    whole = sizes.agg(F.count("*").alias("items"), F.sum("size").alias("size"), F.count_if((F.col("size") <= capacity) & (F.col("pieces") > 1)).alias("split_without_need"))
    return whole.withColumn("kind", F.lit(kind)).join(good.withColumn("kind", F.lit(kind)), "kind")  # one row each


def p5_packing_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all items are placed once, whole, within the capacity, with little room unused."""
    stories, requests = packing.story_items(table(spark, folder, "instruct_records")), packing.request_items(table(spark, folder, "bench_runs"))
    return _packing_check(stories, packing.packed_items(stories, 2048), 2048, "stories").unionByName(_packing_check(requests, packing.packed_items(requests, 512), 512, "requests"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p7_marginals(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[2]


def p7_share_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per source that has documents: its share of the whole, whether it was met to within twice its largest document,
    and whether no document was repeated more often than allowed."""
    chosen, shares, _ = mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    largest = chosen.groupBy("source").agg(F.max("tokens").alias("largest"))
    total = shares.agg(F.sum("taken_tokens").alias("total")).first().total or 0
    rows = shares.where("reachable_share > 0").join(largest, "source")
    met = F.abs(F.col("taken_tokens") - F.col("reachable_share") * total) <= 2 * F.col("largest")
    return rows.select("source", F.round("reachable_share", 6).alias("share"), met.alias("met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    scored = abuse.scored_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.where("passages > 0").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scored_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def p8_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates_per_source(p8_scores(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(sql, name) for name in queries() if hasattr(sql, name)}
