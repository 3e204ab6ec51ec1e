"""Queries of sampling and decoding rules over score rows; embeddings stand in for logits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.plans.registry import Registry
from fabula.tables import table

registry = Registry()
query = registry.add

_LOGITS = "(SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS token, CAST(unnest(embedding) AS DOUBLE) * 10 AS logit FROM embeddings)"


def logits(spark, d):
    """row_id, token, logit in long form."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token", "x")).select("row_id", "token", (F.col("x").cast("double") * 10).alias("logit"))


def softmax(rows, temperature):
    """rows with p: the softmax of logit / temperature within a row_id."""
    w = Window.partitionBy("row_id")
    scaled = rows.withColumn("s", F.col("logit") / temperature)
    raised = scaled.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return raised.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("s", "e")


def softmax_sql(t: float) -> str:
    return f"(SELECT row_id, token, logit, e / sum(e) OVER (PARTITION BY row_id) AS p FROM (SELECT *, exp(logit / {t} - max(logit / {t}) OVER (PARTITION BY row_id)) AS e FROM {_LOGITS}))"


@query(f"SELECT row_id, token, round(p, 9) AS p FROM {softmax_sql(0.8)}")
def softmax_temperature(spark, d):
    return softmax(logits(spark, d), 0.8).select("row_id", "token", F.round("p", 9).alias("p"))


@query(f"SELECT row_id, token FROM (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS k FROM {_LOGITS}) WHERE k <= 8")
def topk_with_ties(spark, d):
    """Top 8 by threshold: all that tie with the eighth stay."""
    w = Window.partitionBy("row_id").orderBy(F.desc("logit"))
    return logits(spark, d).withColumn("k", F.rank().over(w)).where("k <= 8").select("row_id", "token")


@query(f"""WITH c AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS before FROM {softmax_sql(1.0)}), k AS (SELECT * FROM c WHERE before < 0.9)
    SELECT row_id, token, round(p / sum(p) OVER (PARTITION BY row_id), 9) AS p FROM k""")
def nucleus_filter(spark, d):
    """The most probable tokens up to 0.9, with the one that crosses it, renormalized."""
    own = Window.partitionBy("row_id")
    run = own.orderBy(F.desc("p"), "token").rowsBetween(Window.unboundedPreceding, 0)
    kept = softmax(logits(spark, d), 1.0).withColumn("before", F.sum("p").over(run) - F.col("p")).where("before < 0.9")
    return kept.select("row_id", "token", F.round(F.col("p") / F.sum("p").over(own), 9).alias("p"))


@query(f"SELECT row_id, arg_max(token, struct_pack(a := logit, b := -token)) AS token FROM {_LOGITS} GROUP BY row_id")
def greedy_argmax(spark, d):
    """The token with the greatest logit, the first of ties."""
    return logits(spark, d).groupBy("row_id").agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("token"))


@query(f"""WITH c AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, ((row_id * 7919 + 17) % 10007 + 0.5) / 10007.0 AS u FROM {softmax_sql(1.0)})
    SELECT row_id, CAST(coalesce(min(token) FILTER (upto >= u), max(token)) AS INTEGER) AS token FROM c GROUP BY row_id""")
def categorical_draw(spark, d):
    """A draw from each distribution by the inverse of its running sum, at a uniform from a congruence."""
    run = Window.partitionBy("row_id").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    u = (F.pmod(F.col("row_id") * 7919 + 17, F.lit(10007)) + 0.5) / 10007.0
    rows = softmax(logits(spark, d), 1.0).withColumn("upto", F.sum("p").over(run)).withColumn("u", u)
    return rows.groupBy("row_id").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("u"), F.col("token"))), F.max("token")).alias("token"))


@query(f"""WITH a AS {softmax_sql(1.0)}, b AS {softmax_sql(0.8)}
    SELECT a.row_id, round(sum(a.p * (ln(a.p) - ln(b.p))), 8) AS kl, round(-sum(a.p * ln(a.p)), 8) AS entropy FROM a JOIN b USING (row_id, token) GROUP BY a.row_id""")
def kl_entropy(spark, d):
    """Exact divergence of each row's distribution from the one at temperature 0.8, and its entropy; one shuffle for both."""
    w = Window.partitionBy("row_id")
    rows = softmax(logits(spark, d), 1.0)
    sharp = rows.withColumn("e", F.exp(F.col("logit") / 0.8 - F.max(F.col("logit") / 0.8).over(w))).withColumn("q", F.col("e") / F.sum("e").over(w))
    p, q = F.col("p"), F.col("q")
    return sharp.groupBy("row_id").agg(F.round(F.sum(p * (F.ln(p) - F.ln(q))), 8).alias("kl"), F.round(-F.sum(p * F.ln(p)), 8).alias("entropy"))


@query("SELECT label, arg_max(vec_id, struct_pack(a := round(list_sum(embedding), 4), b := -vec_id)) AS vec_id FROM embeddings GROUP BY label")
def argmax_tiebreak(spark, d):
    """The row with the greatest rounded sum in each group, the lowest id of ties."""
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4)
    return table(spark, d, "embeddings").select("label", "vec_id", total.alias("s")).groupBy("label").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("vec_id"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * m) / greatest(sum(m), 1), 4) AS masked_mean FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS m FROM lineitem) GROUP BY ALL""")
def masked_mean(spark, d):
    """sum(x m) / max(sum(m), 1) by group."""
    m = F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * m) / F.greatest(F.sum(m), F.lit(1)), 4).alias("masked_mean"))


@query("SELECT vec_id FROM embeddings ORDER BY (vec_id * 7919 + 17) % 1000003, vec_id LIMIT 50")
def seeded_sample(spark, d):
    """A sampling operator: 50 rows in the order of a fixed congruence."""
    return table(spark, d, "embeddings").select("vec_id").orderBy(F.pmod(F.col("vec_id") * 7919 + 17, F.lit(1000003)), "vec_id").limit(50)
