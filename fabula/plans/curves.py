"""Queries over training logs: replayed rows, curves, schedules, fits, interpolation, hysteresis."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fabula.operators.order import keyed_scan
from fabula.plans.registry import Registry
from fabula.tables import table

registry = Registry()
query = registry.add

_LAST = "(SELECT run_id, step, line, loss, lr, tokens_per_second, val_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY line DESC, loaded_at DESC) AS k FROM train_log WHERE step IS NOT NULL) WHERE k = 1)"


def last_rows(df):
    """The last row of each step of a run: a resumed run logs steps again, and the later line wins.

    An aggregate with a map-side part instead of a window, so a run with a third of all rows is no single task.
    """
    rest = ["loss", "lr", "tokens_per_second", "val_loss"]
    kept = df.where("step is not null").groupBy("run_id", "step").agg(F.max_by(F.struct("line", *rest), F.struct("line", "loaded_at")).alias("r"))
    return kept.select("run_id", "step", "r.line", *(f"r.{c}" for c in rest))


@query(f"SELECT run_id, step, line, loss, val_loss FROM {_LAST}")
def last_writer_wins(spark, d):
    return last_rows(table(spark, d, "train_log")).select("run_id", "step", "line", "loss", "val_loss")


@query(f"""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY step) - 1) // 100 AS bucket FROM {_LAST})
    SELECT run_id, CAST(bucket AS BIGINT) AS bucket, max(step) AS step, CAST(max(step) * 65536 AS BIGINT) AS tokens, round(avg(loss), 9) AS train_loss, any_value(lr) FILTER (step = m) AS lr, any_value(val_loss) FILTER (step = m) AS monitor_val_loss
    FROM (SELECT *, max(step) OVER (PARTITION BY run_id, bucket) AS m FROM n) GROUP BY run_id, bucket""")
def curve_buckets(spark, d):
    """Mean loss of every 100 logged steps of a run by position, with the last step's other columns."""
    rows = last_rows(table(spark, d, "train_log")).withColumn("one", F.lit(1).cast("long"))
    rows = keyed_scan(rows, ["run_id"], ["step"], "one", "i", exclusive=True).withColumn("bucket", F.floor(F.col("i") / 100))
    last = F.max(F.struct("step", "lr", "val_loss"))
    points = rows.groupBy("run_id", "bucket").agg(last.alias("r"), F.round(F.avg("loss"), 9).alias("train_loss"))
    return points.select("run_id", "bucket", "r.step", (F.col("r.step") * 65536).alias("tokens"), "train_loss", "r.lr", F.col("r.val_loss").alias("monitor_val_loss"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS i, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS j FROM {_LAST})
    SELECT run_id, round(avg(loss) FILTER (i <= 25), 9) AS first_mean, round(avg(loss) FILTER (j <= 25), 9) AS last_mean FROM n GROUP BY run_id""")
def first_last_means(spark, d):
    rows = last_rows(table(spark, d, "train_log")).withColumn("one", F.lit(1).cast("long"))
    numbered = keyed_scan(rows, ["run_id"], ["step"], "one", "i")
    counts = numbered.groupBy("run_id").agg(F.count("*").alias("n"))  # one row for each run
    rows = numbered.join(counts, "run_id").withColumn("j", F.col("n") - F.col("i") + 1)
    mean = lambda c: F.round(F.avg(F.when(F.col(c) <= 25, F.col("loss"))), 9)
    return rows.groupBy("run_id").agg(mean("i").alias("first_mean"), mean("j").alias("last_mean"))


@query(f"""SELECT run_id, step, round(sum(65536) OVER w / sum(65536 / tokens_per_second) OVER w, 4) AS tokens_per_second FROM {_LAST} WHERE tokens_per_second > 0 WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_throughput(spark, d):
    """Tokens so far by seconds so far, with 65,536 tokens a step."""
    rows = last_rows(table(spark, d, "train_log")).where("tokens_per_second > 0").withColumn("one", F.lit(1).cast("long")).withColumn("seconds", 65536 / F.col("tokens_per_second"))
    so_far = keyed_scan(keyed_scan(rows, ["run_id"], ["step"], "seconds", "t"), ["run_id"], ["step"], "one", "n")
    return so_far.select("run_id", "step", F.round(F.col("n") * 65536.0 / F.col("t"), 4).alias("tokens_per_second"))


@query("""WITH e AS (SELECT user_id, event_id, ts, value, CASE WHEN value >= 40 THEN 1 WHEN value <= 30 THEN 0 END AS mark FROM events WHERE value IS NOT NULL)
    SELECT user_id, event_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS paused FROM e""")
def hysteresis_state(spark, d):
    """A guard that pauses at 40 and resumes at 30: between the two it keeps its state."""
    mark = F.when(F.col("value") >= 40, 1).when(F.col("value") <= 30, 0)
    rows = table(spark, d, "events").where("value is not null").select("user_id", "event_id", "ts", mark.alias("mark"))
    state = keyed_scan(rows, ["user_id"], ["ts", "event_id"], "mark", "state", how="last")
    return state.select("user_id", "event_id", (F.coalesce("state", F.lit(0)) == 1).alias("paused"))


@query("""WITH t AS (SELECT i AS step, greatest(0, i - 50) / 950.0 AS p FROM range(1, 1001) t(i))
    SELECT step, round(CASE WHEN step <= 50 THEN 0.001 * step / 50 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, p)))) END, 12) AS lr FROM t""")
def lr_schedule(spark, d):
    """Linear warm-up over 50 of 1,000 steps, then a cosine down to a tenth."""
    step = F.col("id")
    progress = F.greatest(F.lit(0), step - 50) / 950.0
    cosine = 0.001 * (0.1 + 0.9 * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), progress))))
    return spark.range(1, 1001).select(step.alias("step"), F.round(F.when(step <= 50, 0.001 * step / 50).otherwise(cosine), 12).alias("lr"))


@query("""WITH p AS (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
    SELECT round(-regr_slope(ln(total), ln(n)), 6) AS exponent, round(exp(regr_intercept(ln(total), ln(n))), 4) AS factor, CAST(count(*) AS BIGINT) AS points FROM p WHERE total > 0""")
def power_law_fit(spark, d):
    """Least squares in logarithms: customers' order totals against their numbers of orders."""
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).where("total > 0")
    x, y = F.ln("n"), F.ln("total")
    return p.agg(F.round(-F.regr_slope(y, x), 6).alias("exponent"), F.round(F.exp(F.regr_intercept(y, x)), 4).alias("factor"), F.count("*").alias("points"))


@query(f"""WITH r AS (SELECT run_id, avg(loss) AS m FROM {_LAST} WHERE step > 100 GROUP BY run_id), b AS (SELECT avg(loss) AS base FROM {_LAST} WHERE step > 100)
    SELECT run_id, round(m, 6) AS mean_loss, round(m - base, 6) AS delta, round((SELECT max(m) - min(m) FROM r), 6) AS spread FROM r, b""")
def ablation_delta(spark, d):
    """Mean loss per run after step 100, its difference from the mean of all, and the spread over runs."""
    rows = last_rows(table(spark, d, "train_log")).where("step > 100")
    runs = rows.groupBy("run_id").agg(F.avg("loss").alias("m"))
    base = F.lit(rows.agg(F.avg("loss").alias("base")).first().base).cast("double")
    spread = F.lit(runs.agg((F.max("m") - F.min("m")).alias("spread")).first().spread).cast("double")
    return runs.select("run_id", F.round("m", 6).alias("mean_loss"), F.round(F.col("m") - base, 6).alias("delta"), F.round(spread, 6).alias("spread"))


@query("""SELECT policy, round(avg(w) FILTER (seed = 17), 6) AS s17, round(avg(w) FILTER (seed = 29), 6) AS s29, round(avg(w) FILTER (seed = 43), 6) AS s43
    FROM (SELECT policy, seed, unnest(per_request).queue_wait_ms AS w FROM (SELECT DISTINCT bench_id, policy, seed, per_request FROM bench_runs)) GROUP BY policy""")
def ablation_pivot(spark, d):
    """Mean wait by policy with one column for each seed."""
    runs = table(spark, d, "bench_runs").select("bench_id", "policy", "seed", "per_request").dropDuplicates(["bench_id"])
    rows = runs.select("policy", "seed", F.explode_outer("per_request.queue_wait_ms").alias("w"))
    wide = rows.groupBy("policy").pivot("seed", [17, 29, 43]).agg(F.avg("w"))
    return wide.select("policy", *(F.round(F.col(f"`{s}`"), 6).alias(f"s{s}") for s in (17, 29, 43)))


# parameters of the model whose runs the log holds; training takes six operations a parameter and token
PARAMETERS = 5_800_000
FLOPS = 65536.0 * 6 * PARAMETERS
_VAL = f"(SELECT run_id, step * {FLOPS} AS x, val_loss AS y FROM {_LAST} WHERE val_loss IS NOT NULL)"


@query(f"""WITH v AS {_VAL}, seg AS (SELECT run_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY run_id ORDER BY x)),
    b AS (SELECT run_id, max(x) AS budget FROM v GROUP BY run_id),
    hits AS (SELECT b.run_id AS of_run, s.run_id AS on_run, CASE WHEN s.x1 IS NULL OR b.budget <= s.x0 THEN s.y0 ELSE s.y0 + (s.y1 - s.y0) * (ln(b.budget) - ln(s.x0)) / (ln(s.x1) - ln(s.x0)) END AS loss
        FROM b JOIN seg s ON b.run_id <> s.run_id AND (b.budget >= s.x0 AND (s.x1 IS NULL OR b.budget < s.x1) OR s.i = 1 AND b.budget < s.x0))
    SELECT of_run, on_run, round(loss, 6) AS loss FROM hits""")
def curve_interpolation(spark, d):
    """The loss of each other run at a run's final compute, linear in the logarithm of compute between two points."""
    v = last_rows(table(spark, d, "train_log")).where("val_loss is not null").select("run_id", (F.col("step") * FLOPS).alias("x"), F.col("val_loss").alias("y"))
    budget = v.groupBy(F.col("run_id").alias("of_run")).agg(F.max("x").alias("b"))  # one row for each run
    runs = budget.select(F.col("of_run").alias("run_id"))
    # every run's points and the other runs' budgets in one line; each budget takes the points next to it on both sides
    point = F.struct("x", "y")
    points = v.select("run_id", "x", F.lit("").alias("of_run"), point.alias("p"))
    asked = runs.join(budget, F.col("run_id") != F.col("of_run")).select("run_id", F.col("b").alias("x"), "of_run", F.lit(None).cast(points.schema["p"].dataType).alias("p"))
    line = points.unionByName(asked).withColumn("back", -F.col("x"))
    before = keyed_scan(line, ["run_id"], ["x", "of_run"], "p", "before", how="last")
    after = keyed_scan(before, ["run_id"], ["back", "of_run"], "p", "after", how="last").where("p is null")
    x, x0, y0, x1, y1 = F.col("x"), F.col("before.x"), F.col("before.y"), F.col("after.x"), F.col("after.y")
    between = y0 + (y1 - y0) * (F.ln(x) - F.ln(x0)) / (F.ln(x1) - F.ln(x0))
    loss = F.when(x0.isNull(), y1).when(x1.isNull() | (x <= x0), y0).otherwise(between)
    return after.select("of_run", F.col("run_id").alias("on_run"), F.round(loss, 6).alias("loss"))


@query(f"""WITH v AS {_VAL}, t AS (SELECT max(m) AS target FROM (SELECT run_id, min(y) AS m FROM v GROUP BY run_id))
    SELECT run_id, round(CAST(min(x) AS DOUBLE), 1) AS compute FROM v, t WHERE y <= target GROUP BY run_id""")
def first_crossing(spark, d):
    """The least compute at which each run reaches the loss that all runs reach."""
    v = last_rows(table(spark, d, "train_log")).where("val_loss is not null").select("run_id", (F.col("step") * FLOPS).alias("x"), F.col("val_loss").alias("y"))
    target = v.groupBy("run_id").agg(F.min("y").alias("m")).agg(F.max("m").alias("target")).first().target
    return v.where(F.col("y") <= F.lit(target).cast("double")).groupBy("run_id").agg(F.round(F.min("x"), 1).alias("compute"))
