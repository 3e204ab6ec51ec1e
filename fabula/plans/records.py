"""Queries over records and ids: form input, validation, integrity, shuffles, windows, sets, policy summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import constraints as C
from fabula.functions import inflection, text
from fabula.operators import order
from fabula.plans import sql as Q
from fabula.plans.constraints import _PAIRS, _PROMPTS, _SAMPLES, pairs, prompts, samples
from fabula.plans.registry import Registry
from fabula.tables import table

registry = Registry()
query = registry.add

# fixed values: the features in their canonical order
FEATURES = ["Dialogue", "BadEnding", "Twist", "Foreshadowing", "MoralValue", "Conflict"]
_ORDER = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"


@query(f"""SELECT id, nullif({Q.strip("coalesce(summary, '')")}, '') AS summary, array_to_string(list_filter(list_transform(string_split(form, ','), lambda x: {Q.strip('x')}), lambda x: x <> ''), '|') AS words,
    array_to_string(list_filter({_ORDER}, lambda f: coalesce(list_contains(features, f), false)), '|') AS features FROM (SELECT *, coalesce(array_to_string(words, ' , '), '') AS form FROM {_PROMPTS})""")
def build_record(spark, d):
    """Records from form fields: a comma-separated line of words, chosen features in canonical order."""
    form = F.coalesce(F.array_join("words", " , "), F.lit(""))
    words = F.filter(F.transform(F.split(form, ","), text.strip), lambda x: x != "")
    chosen = F.filter(F.array(*map(F.lit, FEATURES)), lambda f: F.coalesce(F.array_contains("features", f), F.lit(False)))
    summary = text.strip(F.coalesce("summary", F.lit("")))
    return prompts(spark, d).select("id", F.when(summary != "", summary).alias("summary"), F.array_join(words, "|").alias("words"), F.array_join(chosen, "|").alias("features"))


@query("""WITH r AS (SELECT bench_id, unnest(per_request) AS r FROM (SELECT DISTINCT bench_id, per_request FROM bench_runs WHERE per_request IS NOT NULL)), k AS (SELECT bench_id, r.id AS id, any_value(r.prompt_tokens) AS p, any_value(r.output_tokens) AS o, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT bench_id, id, CASE WHEN n > 1 THEN 'duplicate request id' WHEN p IS NULL OR p < 1 THEN 'invalid prompt or output length' WHEN p + o > 512 THEN 'prompt plus output exceeds context' END AS problem FROM k WHERE n > 1 OR p IS NULL OR p < 1 OR p + o > 512""")
def request_validation(spark, d):
    """Requests that a server with a context of 512 would refuse, with the first reason."""
    runs = table(spark, d, "bench_runs").where("per_request is not null").groupBy("bench_id").agg(F.first("per_request").alias("q"))
    each = runs.select("bench_id", F.explode("q").alias("r")).groupBy("bench_id", F.col("r.id").alias("id")).agg(F.max("r.prompt_tokens").alias("p"), F.max("r.output_tokens").alias("o"), F.count("*").alias("n"))
    problem = F.when(F.col("n") > 1, "duplicate request id").when(F.col("p").isNull() | (F.col("p") < 1), "invalid prompt or output length").when(F.col("p") + F.col("o") > 512, "prompt plus output exceeds context")
    return each.select("bench_id", "id", problem.alias("problem")).where("problem is not null")


@query("SELECT doc_id, n_chars, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL AND n_chars IS DISTINCT FROM length(text)")
def integrity_failures(spark, d):
    """Documents whose recorded length isn't that of their text."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "n_chars", F.length("text").cast("long").alias("chars"))
    return rows.where(~F.col("n_chars").eqNullSafe(F.col("chars")))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY (event_id * 7919 + 17) % 1000003, event_id) - 1 AS BIGINT) AS place FROM events")
def seeded_shuffle(spark, d):
    """A fixed pseudo-random order of all events."""
    rows = table(spark, d, "events").select("event_id", F.pmod(F.col("event_id") * 7919 + 17, F.lit(1000003)).alias("k"))
    return order.row_numbers(rows, ["k", "event_id"], "place").select("event_id", F.col("place").cast("long").alias("place"))


@query("""WITH n AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE length(text) > 64), b AS (SELECT s, (s * 7919 + 3) AS a, s * 104729 AS c FROM range(256) t(s))
    SELECT s AS sample, substr(text, CAST(c % (length(text) - 64) + 1 AS BIGINT), 64) AS input, substr(text, CAST(c % (length(text) - 64) + 2 AS BIGINT), 64) AS target FROM b JOIN n ON n.i = a % n.n""")
def window_batch(spark, d):
    """A batch of 256 windows of 64 characters and their successors, with replacement, at places of a congruence."""
    texts = table(spark, d, "documents").where(F.length("text") > 64).select("doc_id", "text")
    rows = order.row_numbers(texts.select("doc_id"), ["doc_id"], "i")  # ids only; the few texts are fetched afterwards
    n = rows.count()
    starts = spark.range(256).select(F.col("id").alias("sample"), ((F.col("id") * 7919 + 3) % max(n, 1)).alias("i"), (F.col("id") * 104729).alias("c"))
    at = (F.col("c") % (F.length("text") - 64)).cast("int")
    chosen = rows.join(F.broadcast(starts), "i")  # 256 rows
    return texts.join(F.broadcast(chosen), "doc_id").select("sample", F.substr("text", at + 1, F.lit(64)).alias("input"), F.substr("text", at + 2, F.lit(64)).alias("target"))


@query("""SELECT 'both' AS part, CAST(count(*) AS BIGINT) AS ids FROM (SELECT id FROM samples INTERSECT SELECT id FROM heldout_prompts) UNION ALL
    SELECT 'only samples', CAST(count(*) AS BIGINT) FROM (SELECT id FROM samples EXCEPT SELECT id FROM heldout_prompts) UNION ALL SELECT 'only prompts', CAST(count(*) AS BIGINT) FROM (SELECT id FROM heldout_prompts EXCEPT SELECT id FROM samples)""")
def id_sets(spark, d):
    """Intersection and differences of the ids of samples and prompts; they are equal if both differences are empty."""
    a, b = table(spark, d, "samples").select("id"), table(spark, d, "heldout_prompts").select("id")
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("ids"))
    return count("both", a.intersect(b)).unionByName(count("only samples", a.subtract(b))).unionByName(count("only prompts", b.subtract(a)))


SEED = 17


@query(f"""SELECT DISTINCT id, sha256(id) AS digest, CAST(xor(CAST(('0x' || {" || ".join(f"substr(sha256(id), {i}, 2)" for i in range(15, 0, -2))}) AS UBIGINT), CAST({SEED} AS UBIGINT)) AS VARCHAR) AS seed FROM heldout_prompts WHERE id IS NOT NULL""")
def request_seeds(spark, d):
    """A seed for each id: the first eight bytes of its SHA-256, the lowest first, xor the run's seed; an unsigned number
    in decimal digits."""
    digest = F.sha2("id", 256)
    low_first = F.concat(*(F.substr(digest, F.lit(i), F.lit(2)) for i in range(15, 0, -2)))
    seed = F.conv(low_first, 16, -10).cast("long").bitwiseXOR(F.lit(SEED).cast("long"))
    return prompts(spark, d).select("id", digest.alias("digest"), F.conv(F.hex(seed), 16, 10).alias("seed"))


@query(f"""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY CAST(right(id, 7) AS BIGINT) * 7919 % 100003, id) AS k FROM (SELECT DISTINCT id FROM instruct_records WHERE id LIKE 'train-%' AND story IS NOT NULL) r
    WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE right(s.id, 7) = right(r.id, 7))) WHERE k <= 100""")
def sample_with_exclusion(spark, d):
    """100 training ids in a fixed pseudo-random order, without those whose number a sampled prompt has: they are taken
    out before the choice, so that it is always whole."""
    ids = table(spark, d, "instruct_records").where("id like 'train-%' and story is not null").select("id").distinct()
    gone = table(spark, d, "samples").select(F.right("id", F.lit(7)).alias("number")).distinct()
    number = F.right("id", F.lit(7))
    rest = ids.withColumn("number", number).join(gone, "number", "left_anti")
    return rest.orderBy(F.col("number").cast("long") * 7919 % 100003, "id").limit(100).select("id")


@query("""SELECT bench_id, CAST(count(*) AS BIGINT) AS deliveries, CAST(count(DISTINCT (policy, workload, arrival_rate, seed, started_at)) AS BIGINT) AS configs, CAST(count(DISTINCT md5(CAST(per_request AS VARCHAR))) AS BIGINT) AS contents FROM bench_runs GROUP BY bench_id HAVING count(*) > 1""")
def repeated_runs(spark, d):
    """Runs that were delivered several times, with the number of their different configurations and contents; more than
    one of either is a failed integrity check."""
    runs = table(spark, d, "bench_runs")
    config = F.count_distinct(F.struct("policy", "workload", "arrival_rate", "seed", "started_at"))
    grouped = runs.groupBy("bench_id").agg(F.count("*").alias("deliveries"), config.alias("configs"), F.count_distinct(F.when(F.col("per_request").isNotNull(), F.sha2(F.to_json("per_request"), 256))).alias("contents"))
    return grouped.where("deliveries > 1")


_SI = "CASE WHEN n >= 1e9 THEN printf('%.1fG', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fk', n / 1e3) ELSE CAST(n AS VARCHAR) END"


@query(f"SELECT lang, {_SI} AS size, printf('%.1f%%', 100.0 * n / sum(n) OVER ()) AS share FROM (SELECT coalesce(lower(lang), '(none)') AS lang, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS n FROM documents GROUP BY 1)")
def sizes_by_language(spark, d):
    """Bytes of text by language in short form, and their shares in per cent."""
    n = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    rows = table(spark, d, "documents").groupBy(F.coalesce(F.lower("lang"), F.lit("(none)")).alias("lang")).agg(n.alias("n"))
    total = rows.agg(F.sum("n").alias("total")).first().total
    return rows.select("lang", text.short_size("n").alias("size"), F.format_string("%.1f%%", 100.0 * F.col("n") / F.lit(total)).alias("share"))


_W = Q.words("story")
_STARTS = f"CASE WHEN sentence <> '' AND len({Q.words('sentence')}[1:4]) = 4 THEN len(list_filter({Q.grams('w', 4)}, lambda g: g = {Q.words('sentence')}[1:4])) END"


@query(f"""WITH p AS (SELECT *, {_W} AS w FROM {_PAIRS} WHERE story IS NOT NULL), s AS (SELECT *, {Q.grams('w', 4)} AS g, {_STARTS} AS starts FROM p),
    m AS (SELECT run_id, avg(x) AS mentions FROM (SELECT run_id, id, sample, avg(len(list_filter(w, lambda t: list_contains({inflection.forms_sql('lower(q)')}, t)))) AS x FROM (SELECT run_id, id, sample, w, unnest({Q.filled('words')}) AS q FROM p) WHERE regexp_matches(lower(q), '^[a-z]+$') GROUP BY run_id, id, sample) GROUP BY run_id)
    SELECT run_id, round(avg(len(w)), 6) AS length, round(avg(CASE WHEN len(g) = 0 THEN 0 ELSE 1 - len(list_distinct(g)) / len(g) END), 9) AS repetition,
    round(avg(CASE WHEN len(g) > 0 AND 1 - len(list_distinct(g)) / len(g) >= 0.1 THEN 1.0 ELSE 0.0 END), 9) AS loops, round(avg(starts), 9) AS sentence_starts, round(avg(CASE WHEN starts >= 2 THEN 1.0 WHEN starts IS NOT NULL THEN 0.0 END), 9) AS restarts, round(any_value(mentions), 9) AS word_mentions
    FROM s JOIN m USING (run_id) GROUP BY run_id""")
def policy_summary(spark, d):
    """Length, repetition, loops, sentence starts and restarts, and word mentions of each run's stories."""
    rows = pairs(spark, d).where("story is not null").select(
        "run_id",
        F.size(text.words("story")).alias("n"),
        text.repetition("story").alias("r"),
        F.when(F.col("sentence") != "", text.sentence_starts("sentence", "story")).alias("s"),
        C.word_mentions("words", "story", "forms").alias("m"),
    )
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return rows.groupBy("run_id").agg(
        F.round(F.avg("n"), 6).alias("length"),
        F.round(F.avg("r"), 9).alias("repetition"),
        share(F.col("r") >= 0.1).alias("loops"),
        F.round(F.avg("s"), 9).alias("sentence_starts"),
        F.round(F.avg(F.when(F.col("s").isNotNull(), F.when(F.col("s") >= 2, 1.0).otherwise(0.0))), 9).alias("restarts"),
        F.round(F.avg("m"), 9).alias("word_mentions"),
    )


@query(f"SELECT run_id, sample, round(avg(reward), 9) AS reward, round(avg(CAST(coalesce(finished, true) AS DOUBLE)), 9) AS finished, CAST(count(*) AS BIGINT) AS rows FROM {_SAMPLES} GROUP BY run_id, sample")
def step_metrics(spark, d):
    """Mean reward and finished share of each sampling step of a run."""
    return samples(spark, d).groupBy("run_id", "sample").agg(F.round(F.avg("reward"), 9).alias("reward"), F.round(F.avg(F.coalesce("finished", F.lit(True)).cast("double")), 9).alias("finished"), F.count("*").alias("rows"))
