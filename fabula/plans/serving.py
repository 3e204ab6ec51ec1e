"""Queries over request logs and traces: latencies, goodput, digests, schedules, simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.operators import simulate
from fabula.operators.order import keyed_scan, percentiles, row_numbers
from fabula.plans.registry import Registry
from fabula.session import materialize
from fabula.tables import table

registry = Registry()
query = registry.add

# a bench_id that occurs twice has identical content; a request that occurs twice within a run counts once
_REQUESTS = """(SELECT bench_id, any_value(policy) AS policy, any_value(workload) AS workload, any_value(arrival_rate) AS arrival_rate, any_value(seed) AS seed, r.id AS id, max(r.status) AS status, max(r.prompt_tokens) AS prompt_tokens, max(r.output_tokens) AS output_tokens,
    max(r.queue_wait_ms) AS queue_wait_ms, max(r.ttft_ms) AS ttft_ms FROM (SELECT bench_id, policy, workload, arrival_rate, seed, unnest(per_request) AS r FROM bench_runs) GROUP BY bench_id, r.id)"""


def requests(spark, d):
    """Each request of each run once."""
    runs = table(spark, d, "bench_runs").select("bench_id", "policy", "workload", "arrival_rate", "seed", F.explode("per_request").alias("r"))
    own = ["policy", "workload", "arrival_rate", "seed"]
    inner = ["status", "prompt_tokens", "output_tokens", "queue_wait_ms", "ttft_ms"]
    return runs.groupBy("bench_id", F.col("r.id").alias("id")).agg(*(F.first(c, ignorenulls=True).alias(c) for c in own), *(F.max(f"r.{c}").alias(c) for c in inner))


_Q = lambda c, q, cond="status = 'completed'": f"round(quantile_cont({c}, {q}) FILTER ({cond}), 6)"


@query(f"""SELECT policy, workload, CAST(count(*) AS BIGINT) AS submitted, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed, CAST(count(*) FILTER (status = 'rejected') AS BIGINT) AS rejected, CAST(count(*) FILTER (status = 'cancelled') AS BIGINT) AS cancelled,
    CAST(coalesce(sum(output_tokens) FILTER (status = 'completed'), 0) AS BIGINT) AS output_tokens, round(count(*) FILTER (status = 'completed' AND ttft_ms <= 200) / count(*), 9) AS slo_fraction,
    {_Q('ttft_ms', 0.5)} AS ttft_p50, {_Q('ttft_ms', 0.95)} AS ttft_p95, {_Q('ttft_ms', 0.99)} AS ttft_p99 FROM {_REQUESTS} GROUP BY policy, workload""")
def request_summary(spark, d):
    """Counts, goodput and latencies; rejected requests stay in the denominator of the goodput."""
    status = lambda s: F.count_if(F.col("status") == s)
    done = F.col("status") == "completed"
    rows = materialize(requests(spark, d).select("policy", "workload", "status", "output_tokens", "ttft_ms"), "requests")
    waits = percentiles(rows.where(done), ["policy", "workload"], "ttft_ms", {"ttft_p50": 0.5, "ttft_p95": 0.95, "ttft_p99": 0.99})
    counts = rows.groupBy("policy", "workload").agg(
        F.count("*").alias("submitted"),
        status("completed").alias("completed"),
        status("rejected").alias("rejected"),
        status("cancelled").alias("cancelled"),
        F.coalesce(F.sum(F.when(done, F.col("output_tokens"))), F.lit(0)).cast("long").alias("output_tokens"),
        F.round(F.count_if(done & (F.col("ttft_ms") <= 200)) / F.count("*"), 9).alias("slo_fraction"),
    )
    waits = waits.select(F.col("policy").alias("p"), F.col("workload").alias("w"), *(F.round(c, 6).alias(c) for c in ("ttft_p50", "ttft_p95", "ttft_p99")))
    return counts.join(waits, F.col("policy").eqNullSafe(F.col("p")) & F.col("workload").eqNullSafe(F.col("w")), "left").drop("p", "w")


@query(f"""WITH u AS (SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events GROUP BY user_id), a AS (SELECT min(first) AS began, (max(last) - min(first)) / 1e6 AS elapsed FROM u),
    r AS (SELECT *, (first - began) / 3.6e9 AS ttft, CASE WHEN n > 1 THEN (last - first) / 3.6e9 / (n - 1) ELSE 0 END AS tpot FROM u, a)
    SELECT CAST(count(*) AS BIGINT) AS requests, round(any_value(elapsed), 3) AS elapsed_s, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) / any_value(elapsed), 9) AS tokens_per_second, CAST(count(*) FILTER (ttft <= 24 AND tpot <= 48) AS BIGINT) AS slo_requests,
        round(count(*) FILTER (ttft <= 24 AND tpot <= 48) / count(*), 9) AS slo_fraction, round(count(*) FILTER (ttft <= 24 AND tpot <= 48) / any_value(elapsed), 12) AS goodput FROM r""")
def emission_slo(spark, d):
    """Users as requests and their events as emitted tokens: throughput, and the share that meets both bounds, of the
    wait for the first (24 hours after the first of all) and of the mean time between two (48 hours)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    users = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min(us).alias("first"), F.max(us).alias("last"))
    began = users.agg(F.min("first").alias("first"), ((F.max("last") - F.min("first")) / 1e6).alias("elapsed")).first()
    ttft = (F.col("first") - F.lit(began["first"])) / 3.6e9
    tpot = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / 3.6e9 / (F.col("n") - 1)).otherwise(0.0)
    good, elapsed = F.count_if((ttft <= 24) & (tpot <= 48)), F.lit(began.elapsed)
    return users.agg(F.count("*").alias("requests"), F.round(elapsed, 3).alias("elapsed_s"), F.sum("n").alias("tokens"), F.round(F.sum("n") / elapsed, 9).alias("tokens_per_second"), good.alias("slo_requests"), F.round(good / F.count("*"), 9).alias("slo_fraction"), F.round(good / elapsed, 12).alias("goodput"))


@query(f"""WITH r AS (SELECT arrival_rate, policy, bench_id, quantile_cont(ttft_ms, 0.99) FILTER (status = 'completed') AS p99 FROM {_REQUESTS} GROUP BY 1, 2, 3)
    SELECT arrival_rate, policy, CAST(count(*) AS BIGINT) AS runs, round(median(p99), 6) AS median, round(min(p99), 6) AS low, round(max(p99), 6) AS high FROM r GROUP BY 1, 2 ORDER BY 1, 2""")
def grouped_median_envelope(spark, d):
    """Median over runs with the least and greatest, by rate and policy."""
    p99 = F.percentile(F.when(F.col("status") == "completed", F.col("ttft_ms")), F.lit(0.99))
    runs = requests(spark, d).groupBy("arrival_rate", "policy", "bench_id").agg(p99.alias("p"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return runs.groupBy("arrival_rate", "policy").agg(F.count("*").alias("runs"), r(F.percentile("p", F.lit(0.5)), "median"), r(F.min("p"), "low"), r(F.max("p"), "high")).orderBy("arrival_rate", "policy")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS emissions, CASE WHEN count(*) > 1 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 / (count(*) - 1), 3) ELSE 0.0 END AS mean_interval_ms FROM events GROUP BY user_id""")
def mean_interval_per_user(spark, d):
    """(last - first) / (n - 1) of each user's events in milliseconds; 0 for a single event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    mean = F.round((F.max(us) - F.min(us)) / 1000.0 / (F.count("*") - 1), 3)
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("emissions"), F.when(F.count("*") > 1, mean).otherwise(0.0).alias("mean_interval_ms"))


@query("""WITH g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0 AS gap FROM events)
    SELECT event_type, CAST(count(gap) AS BIGINT) AS gaps, round(quantile_cont(gap, 0.99), 3) AS p99_ms FROM g GROUP BY event_type""")
def inter_event_p99(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    before = keyed_scan(events, ["user_id"], ["us", "event_id"], "us", "before", how="last", exclusive=True)
    gaps = materialize(before.select("event_type", ((F.col("us") - F.col("before")) / 1000.0).alias("gap")), "gaps")
    p99 = percentiles(gaps, ["event_type"], "gap", {"p99_ms": 0.99}).select(F.col("event_type").alias("t"), F.round("p99_ms", 3).alias("p99_ms"))
    counts = gaps.groupBy("event_type").agg(F.count("gap").alias("gaps"))
    return counts.join(p99, F.col("event_type").eqNullSafe(F.col("t")), "left").drop("t")


@query("SELECT event_type, event_id // 1000 AS block, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest FROM events GROUP BY ALL")
def ordered_digest(spark, d):
    """Digests of the event ids of each type, in ascending order, block by block of 1,000 ids, so that no group grows."""
    block = F.floor(F.col("event_id") / 1000).alias("block")
    ids = table(spark, d, "events").groupBy("event_type", block).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return ids.select("event_type", "block", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("digest"))


@query(f"""WITH r AS (SELECT bench_id, sum(prompt_tokens + output_tokens) AS live, sum(CAST(ceil((prompt_tokens + output_tokens) / 16.0) * 16 AS BIGINT)) AS reserved FROM {_REQUESTS} WHERE status = 'completed' AND prompt_tokens > 0 GROUP BY bench_id)
    SELECT CAST(count(*) AS BIGINT) AS runs, round(max(live / reserved), 9) AS peak, round(median(live / reserved), 9) AS median FROM r WHERE reserved > 0""")
def cache_utilization(spark, d):
    """Peak and median share of live tokens in blocks of 16, over runs; runs without blocks are passed over."""
    rows = requests(spark, d).where("status = 'completed' and prompt_tokens > 0").withColumn("n", F.col("prompt_tokens") + F.col("output_tokens"))
    runs = rows.groupBy("bench_id").agg(F.sum("n").alias("live"), F.sum(F.ceil(F.col("n") / 16.0) * 16).alias("reserved")).where("reserved > 0").select((F.col("live") / F.col("reserved")).alias("u"))
    return runs.agg(F.count("*").alias("runs"), F.round(F.max("u"), 9).alias("peak"), F.round(F.percentile("u", F.lit(0.5)), 9).alias("median"))


@query("""WITH t AS (SELECT i, ((i * 7919 + 104729) % 99991 + 1) / 99992.0 AS u FROM range(256) t(i)), g AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE -ln(u) / 20.0 END AS gap FROM t)
    SELECT i AS request, round(sum(gap) OVER (ORDER BY i), 9) AS arrival, round((i // 8) * 8 / 20.0, 9) AS burst_arrival FROM g""")
def burst_arrivals(spark, d):
    """Arrivals at 20 a second: running sums of exponential gaps, and bursts of eight. Uniforms come from a congruence."""
    i = F.col("id")
    gap = F.when(i == 0, 0.0).otherwise(-F.ln((F.pmod(i * 7919 + 104729, F.lit(99991)) + 1) / 99992.0) / 20.0)
    w = Window.orderBy("request").rowsBetween(Window.unboundedPreceding, 0)  # 256 rows
    rows = spark.range(256).select(i.alias("request"), gap.alias("gap"), F.round(F.floor(i / 8) * 8 / 20.0, 9).alias("burst_arrival"))
    return rows.select("request", F.round(F.sum("gap").over(w), 9).alias("arrival"), "burst_arrival")


WORKLOADS = ["mixed", "short", "prefix", "burst", "head_of_line"]
_RATES, _SEEDS, _REQUESTS_EACH = [5.0, 20.0], [17, 29, 43], 24
_DRAW = "(r * 7919 + seed * 104729 + {k} * 15485863) % 99991"


@query(f"""WITH g AS (SELECT w.workload, v.rate, s.seed, r FROM (SELECT unnest({WORKLOADS}) AS workload) w, (SELECT unnest({_RATES}) AS rate) v, (SELECT unnest({_SEEDS}) AS seed) s, range({_REQUESTS_EACH}) t(r)),
    x AS (SELECT *, CASE WHEN r = 0 THEN 0 ELSE -ln(({_DRAW.format(k=1)} + 1) / 99992.0) / rate END AS gap, [32, 64, 256][{_DRAW.format(k=2)} % 3 + 1] AS any_prompt, [8, 16, 32][{_DRAW.format(k=3)} % 3 + 1] AS output FROM g),
    y AS (SELECT *, CASE workload WHEN 'short' THEN 32 WHEN 'prefix' THEN 48 + least(any_prompt, 32) WHEN 'head_of_line' THEN CASE WHEN r % 8 = 0 THEN 384 ELSE 32 END ELSE any_prompt END AS prompt FROM x)
    SELECT workload, CAST(rate AS DOUBLE) AS rate, CAST(seed AS INTEGER) AS seed, printf('r%04d', r) AS id, round(CASE WHEN workload = 'burst' THEN (r // 8) * 8 / rate ELSE sum(gap) OVER (PARTITION BY workload, rate, seed ORDER BY r) END, 9) AS arrival,
        CAST(least(prompt, 512 - output) AS INTEGER) AS prompt_tokens, CAST(output AS INTEGER) AS output_tokens, CAST(CASE WHEN workload = 'prefix' THEN 48 ELSE 0 END AS INTEGER) AS shared_tokens FROM y""")
def synthetic_traces(spark, d):
    """Request traces of five workloads, two rates and three seeds: open-loop arrivals (running sums of exponential gaps,
    or bursts of eight), prompts by workload, a context of 512. Draws come from a congruence."""
    pick = lambda values: F.explode(F.array(*map(F.lit, values)))
    grid = spark.range(_REQUESTS_EACH).withColumnRenamed("id", "r").withColumn("workload", pick(WORKLOADS)).withColumn("rate", pick(_RATES)).withColumn("seed", pick(_SEEDS))
    draw = lambda k: (F.col("r") * 7919 + F.col("seed").cast("long") * 104729 + k * 15485863) % 99991
    one_of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (draw(k) % len(values) + 1).cast("int"))
    is_ = lambda name: F.col("workload") == name
    any_prompt = one_of([32, 64, 256], 2)
    prompt = F.when(is_("short"), 32).when(is_("prefix"), 48 + F.least(any_prompt, F.lit(32))).when(is_("head_of_line"), F.when(F.col("r") % 8 == 0, 384).otherwise(32)).otherwise(any_prompt)
    gap = F.when(F.col("r") == 0, 0.0).otherwise(-F.ln((draw(1) + 1) / 99992.0) / F.col("rate"))
    w = Window.partitionBy("workload", "rate", "seed").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)  # 24 rows
    rows = grid.select("workload", "rate", "seed", "r", gap.alias("gap"), prompt.alias("prompt"), one_of([8, 16, 32], 3).alias("output"))
    arrival = F.when(is_("burst"), F.floor(F.col("r") / 8) * 8 / F.col("rate")).otherwise(F.sum("gap").over(w))
    return rows.select("workload", "rate", "seed", F.format_string("r%04d", "r").alias("id"), F.round(arrival, 9).alias("arrival"), F.least(F.col("prompt"), 512 - F.col("output")).alias("prompt_tokens"), F.col("output").alias("output_tokens"), F.when(is_("prefix"), 48).otherwise(0).alias("shared_tokens"))


@query("""SELECT s AS step, j AS slot, p.id FROM range(50) a(s), range(8) b(j), (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM heldout_prompts)) p WHERE p.i = (s * 8 + j) % p.n""")
def cyclic_schedule(spark, d):
    """Prompts of each of 50 steps of eight slots, going round the pool."""
    pool = row_numbers(table(spark, d, "heldout_prompts").select("id").distinct(), ["id"], "i")
    n = pool.count()
    slots = spark.range(400).select(F.floor(F.col("id") / 8).alias("step"), (F.col("id") % 8).alias("slot"), (F.col("id") % max(n, 1)).alias("i"))
    return slots.join(pool, "i").select("step", "slot", "id")


@query("""WITH p AS (SELECT unnest(['static', 'continuous', 'chunked']) AS policy, unnest([0, 1, 2]) AS k), s AS (SELECT unnest([17, 29, 43]) AS seed, unnest([0, 1, 2]) AS i), r AS (SELECT DISTINCT arrival_rate FROM bench_runs WHERE arrival_rate IS NOT NULL)
    SELECT arrival_rate, seed, policy, CAST((k - i + 3) % 3 AS INTEGER) AS turn FROM r, s, p""")
def experiment_grid(spark, d):
    """Every rate with every seed and policy; the order of the policies rotates with the seed."""
    rates = table(spark, d, "bench_runs").select("arrival_rate").where("arrival_rate is not null").distinct()
    cells = F.explode(F.array(*(F.struct(F.lit(seed).alias("seed"), F.lit(policy).alias("policy"), F.lit((k - i + 3) % 3).alias("turn")) for i, seed in enumerate((17, 29, 43)) for k, policy in enumerate(("static", "continuous", "chunked")))))
    return rates.select("arrival_rate", cells.alias("c")).select("arrival_rate", "c.seed", "c.policy", "c.turn")


_TOKENS = "list_transform(range(1, least(length(text), 64) + 1), lambda i: ascii(text[i]))"


@query("""WITH p AS (SELECT item_id, text, length(text) AS n FROM benchmark WHERE text <> ''),
    b AS (SELECT item_id, text, n, unnest(range(1, (n - 1) // 16 + 1)) AS blocks FROM p),
    k AS (SELECT item_id, blocks, left(text, CAST(blocks * 16 AS BIGINT)) AS prefix FROM b),
    first AS (SELECT prefix, min(item_id) AS owner FROM (SELECT item_id, left(text, CAST(blocks * 16 AS BIGINT)) AS prefix FROM (SELECT item_id, text, unnest(range(1, n // 16 + 1)) AS blocks FROM p)) GROUP BY prefix)
    SELECT p.item_id, CAST(coalesce(max(k.blocks) FILTER (f.owner < p.item_id), 0) * 16 AS BIGINT) AS reused FROM p LEFT JOIN k USING (item_id) LEFT JOIN first f USING (prefix) GROUP BY p.item_id""")
def longest_prefix_reuse(spark, d):
    """Characters of the longest prefix of whole blocks of 16 that an earlier item has too; the last one is never reused."""
    p = table(spark, d, "benchmark").where("text <> ''").select("item_id", "text", F.length("text").alias("n"))
    blocks = lambda most: F.explode(F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))).alias("blocks")
    prefix = F.left("text", F.col("blocks") * 16).alias("prefix")
    wanted = p.select("item_id", "text", blocks(F.floor((F.col("n") - 1) / 16).cast("int"))).select("item_id", "blocks", prefix)
    owned = p.select("item_id", "text", blocks(F.floor(F.col("n") / 16).cast("int"))).select("item_id", prefix).groupBy("prefix").agg(F.min("item_id").alias("owner"))
    hits = wanted.join(owned, "prefix").where("owner < item_id").groupBy("item_id").agg(F.max("blocks").alias("b"))
    return p.select("item_id").join(hits, "item_id", "left").select("item_id", (F.coalesce("b", F.lit(0)) * 16).cast("long").alias("reused"))


@query()
def queue_simulation(spark, d):
    """Every run's requests replayed in virtual time under its policy; checked against properties in the tests."""
    return simulate.replay(requests(spark, d))


@query()
def simulated_latency(spark, d):
    """Latencies, throughput and goodput of the replay by policy: a good request has its first token within 200 ms and
    the others within 12 ms each on average; all that were submitted are in the denominator."""
    rows = materialize(simulate.replay(requests(spark, d)), "replay")
    done = F.col("status") == "completed"
    ttft = F.col("first_token") - F.col("arrival")
    tpot = F.when(F.col("output_tokens") > 1, (F.col("finished") - F.col("first_token")) / (F.col("output_tokens") - 1)).otherwise(0.0)
    good = F.count_if(done & (ttft <= 0.2) & (tpot <= 0.012))
    elapsed = rows.groupBy("policy", "bench_id").agg((F.max("finished") - F.min("arrival")).alias("e")).groupBy("policy").agg(F.sum("e").alias("elapsed"))
    counts = rows.groupBy("policy").agg(F.count("*").alias("submitted"), *(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "rejected", "cancelled")), F.coalesce(F.sum(F.when(done, F.col("output_tokens"))), F.lit(0)).alias("tokens"), good.alias("good"))
    waits = percentiles(rows.where(done).withColumn("ttft", ttft), ["policy"], "ttft", {"ttft_p50": 0.5, "ttft_p99": 0.99})
    both = counts.join(elapsed, "policy").join(waits, "policy", "left")
    return both.select("policy", "submitted", "completed", "rejected", "cancelled", F.round("elapsed", 6).alias("elapsed_s"), F.round(F.col("tokens") / F.col("elapsed"), 6).alias("tokens_per_second"), F.round(F.col("good") / F.col("submitted"), 9).alias("slo_fraction"), F.round(F.col("good") / F.col("elapsed"), 9).alias("goodput"), F.round("ttft_p50", 6).alias("ttft_p50"), F.round("ttft_p99", 6).alias("ttft_p99"))


@query(f"""SELECT bench_id, CAST(count(*) AS BIGINT) AS requests, CAST(sum(greatest(1, coalesce(output_tokens, 0))) AS BIGINT) AS asked, true AS all_ended, true AS in_order, true AS within_what_was_asked, true AS first_in_first_out
    FROM {_REQUESTS} WHERE prompt_tokens > 0 AND arrival_rate > 0 AND policy IN ('static', 'continuous', 'chunked') GROUP BY bench_id""")
def replay_check(spark, d):
    """What holds of every replay: all requests end, times are in order, no request gets more tokens than it asked for
    and each completed one gets all, and admission is in order of arrival."""
    rows = materialize(simulate.replay(requests(spark, d)), "replay")
    asked = requests(spark, d).select("bench_id", "id", F.greatest(F.lit(1), F.coalesce("output_tokens", F.lit(0))).alias("asked"))
    both = rows.join(asked, ["bench_id", "id"])
    never = lambda c: F.count_if(~F.coalesce(c, F.lit(False))) == 0
    w = Window.partitionBy("bench_id").orderBy("arrival", "id")  # a run's requests
    both = both.withColumn("latest", F.max("admitted").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    time = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) <= F.col(b))
    return both.groupBy("bench_id").agg(
        F.count("*").alias("requests"),
        F.sum("asked").alias("asked"),
        never(F.col("status").isin("completed", "rejected", "cancelled") & F.col("finished").isNotNull()).alias("all_ended"),
        never(time("arrival", "admitted") & time("admitted", "first_token") & time("first_token", "finished")).alias("in_order"),
        never((F.col("output_tokens") <= F.col("asked")) & ((F.col("status") != "completed") | (F.col("output_tokens") == F.col("asked")))).alias("within_what_was_asked"),
        never(time("latest", "admitted")).alias("first_in_first_out"),
    )
