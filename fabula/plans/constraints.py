"""Queries of the constraint engine: prompts, samples, checks, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fabula.functions import constraints as C
from fabula.functions import inflection, text
from fabula.operators import order
from fabula.plans import sql as Q
from fabula.plans.corpus import _ONCE, records
from fabula.plans.registry import Registry
from fabula.tables import table

registry = Registry()
query = registry.add

_FIELDS = ["summary", "words", "features", "sentence"]
_PROMPTS = "(SELECT id, max(summary) AS summary, max(words) AS words, max(features) AS features, max(sentence) AS sentence FROM heldout_prompts WHERE id IS NOT NULL GROUP BY id)"
_SAMPLES = "(SELECT run_id, id, sample, max(story) AS story, bool_or(finished) AS finished, max(reward) AS reward FROM samples GROUP BY run_id, id, sample)"


def prompts(spark, d):
    """Each prompt id once; repeated rows have the same content."""
    return table(spark, d, "heldout_prompts").where("id is not null").groupBy("id").agg(*(F.max(f).alias(f) for f in _FIELDS))


def known(prompts_, rows, unknown: str = "drop"):
    """Rows with their prompts. unknown: what happens to rows whose id has no prompt: they are dropped, or `raise` ends
    the query at the first."""
    if unknown == "raise":
        both = rows.join(prompts_.withColumn("there", F.lit(True)), "id", "left")
        return both.withColumn("id", F.when(F.col("there"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no prompt has the id "), F.coalesce("id", F.lit("null")))))).drop("there")
    return rows.join(prompts_, "id")


def samples(spark, d):
    """Each key of samples once; rows that were logged twice have the same story."""
    return table(spark, d, "samples").groupBy("run_id", "id", "sample").agg(F.max("story").alias("story"), F.bool_or("finished").alias("finished"), F.max("reward").alias("reward"))


def pairs(spark, d):
    """Samples with their prompts; the prompts are few and fixed, and broadcast as long as they are."""
    p = C.with_forms(prompts(spark, d))
    p = F.broadcast(p) if p.count() <= 50_000 else p
    return known(p, samples(spark, d))


_PAIRS = f"(SELECT s.*, p.summary, p.words, p.features, p.sentence FROM {_SAMPLES} s JOIN {_PROMPTS} p USING (id))"


def checked(df):
    """Prompts bring the forms of their words along; records are checked once each, so theirs are made on the way."""
    df = df if "forms" in df.columns else df.withColumn("forms", F.transform(text.filled("words"), inflection.forms))
    return df.withColumn("c", C.check("words", "features", "sentence", "story", "forms"))


def checked_sql(source: str, keys: str) -> str:
    """Rows of keys, words, hits, fraction, sentence_ok, dialogue_ok, reward, satisfied."""
    hit = Q.has_word("lower(w)", "n", "t", inflection.forms_sql("lower(w)"))
    return f"""(WITH r AS (SELECT {keys}, {Q.filled('words')} AS required, {Q.normalize("coalesce(story, '')")} AS n, list_distinct({Q.words("coalesce(story, '')")}) AS t,
            CASE WHEN sentence <> '' THEN {Q.sentence_in("coalesce(story, '')", 'sentence')} END AS said,
            CASE WHEN list_contains(features, 'Dialogue') THEN regexp_matches({Q.normalize("coalesce(story, '')")}, '{Q.QUOTED}') END AS spoken FROM {source}),
        u AS (SELECT {keys}, i, w, n, t FROM (SELECT {keys}, n, t, unnest(required) AS w, generate_subscripts(required, 1) AS i FROM r)),
        v AS (SELECT {keys}, list({hit} ORDER BY i) AS hits FROM u GROUP BY {keys}),
        f AS (SELECT r.*, v.hits, len(list_filter(v.hits, lambda h: h)) / len(v.hits) AS fraction FROM r LEFT JOIN v USING ({keys})),
        g AS (SELECT *, list_filter([fraction, CAST(said AS DOUBLE), CAST(spoken AS DOUBLE)], lambda x: x IS NOT NULL) AS scores FROM f)
        SELECT {keys}, required, hits, fraction, said, spoken, CASE WHEN len(scores) > 0 THEN list_sum(scores) / len(scores) END AS reward, len(scores) > 0 AND list_min(scores) = 1 AS satisfied FROM g)"""


@query(f"SELECT DISTINCT w AS word, array_to_string(list_sort({inflection.forms_sql('lower(w)')}), ' ') AS forms FROM (SELECT unnest(words) AS w FROM heldout_prompts) WHERE regexp_matches(lower(w), '^[a-z]+$')")
def inflection_forms(spark, d):
    words = table(spark, d, "heldout_prompts").select(F.explode("words").alias("word")).where(F.lower("word").rlike(r"^[a-z]+\z")).distinct()
    return words.select("word", F.array_join(F.array_sort(inflection.forms("word")), " ").alias("forms"))


@query(f"""SELECT run_id, id, sample, i AS position, w AS word, {Q.has_word('lower(w)', 'n', 't', inflection.forms_sql('lower(w)'))} AS hit FROM
    (SELECT run_id, id, sample, unnest(required) AS w, CAST(generate_subscripts(required, 1) AS INTEGER) AS i, n, t FROM (SELECT run_id, id, sample, {Q.filled('words')} AS required, {Q.normalize("coalesce(story, '')")} AS n, list_distinct({Q.words("coalesce(story, '')")}) AS t FROM {_PAIRS}))""")
def word_constraint_hits(spark, d):
    c = checked(pairs(spark, d)).select("run_id", "id", "sample", F.posexplode(F.arrays_zip(text.filled("words").alias("word"), F.col("c.words_hits").alias("hit"))).alias("i", "x"))
    return c.select("run_id", "id", "sample", (F.col("i") + 1).alias("position"), F.col("x.word").alias("word"), F.col("x.hit").alias("hit"))


@query(f"""WITH u AS (SELECT run_id, id, sample, unnest({Q.filled('words')}) AS w, {Q.words('story')} AS t FROM {_PAIRS} WHERE story IS NOT NULL)
    SELECT run_id, id, sample, round(avg(len(list_filter(t, lambda x: list_contains({inflection.forms_sql('lower(w)')}, x)))), 9) AS mentions FROM u WHERE regexp_matches(lower(w), '^[a-z]+$') GROUP BY run_id, id, sample""")
def word_mentions(spark, d):
    rows = pairs(spark, d).where("story is not null").where(F.exists(text.filled("words"), lambda w: F.lower(w).rlike(r"^[a-z]+\z")))
    return rows.select("run_id", "id", "sample", F.round(C.word_mentions("words", "story", "forms"), 9).alias("mentions"))


@query(f"SELECT run_id, id, sample, {Q.sentence_in('story', 'sentence')} AS included FROM {_PAIRS} WHERE sentence <> '' AND story IS NOT NULL")
def sentence_constraint(spark, d):
    return pairs(spark, d).where("sentence <> '' and story is not null").select("run_id", "id", "sample", text.contains_sentence("story", "sentence").alias("included"))


@query(f"SELECT doc_id, regexp_matches({Q.normalize('text')}, '{Q.QUOTED}') AS dialogue FROM documents WHERE text IS NOT NULL")
def dialogue_constraint(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.has_quoted_speech("text").alias("dialogue"))


@query(f"""WITH w AS (SELECT run_id, id, sample, {Q.words('sentence')}[1:4] AS head, {Q.words('story')} AS t FROM {_PAIRS} WHERE sentence <> '' AND story IS NOT NULL)
    SELECT run_id, id, sample, CAST(len(list_filter({Q.grams('t', 4)}, lambda g: g = head)) AS INTEGER) AS starts FROM w WHERE len(head) = 4""")
def sentence_starts(spark, d):
    rows = pairs(spark, d).where("sentence <> '' and story is not null")
    return rows.where(F.size(text.words("sentence")) >= 4).select("run_id", "id", "sample", text.sentence_starts("sentence", "story").alias("starts"))


@query(f"SELECT run_id, id, sample, array_to_string(list_transform(hits, lambda h: CASE WHEN h THEN '1' ELSE '0' END), '') AS hits, round(fraction, 9) AS fraction, said AS sentence, spoken AS dialogue, round(reward, 9) AS reward, satisfied FROM {checked_sql(_PAIRS, 'run_id, id, sample')}")
def constraint_check(spark, d):
    bits = F.array_join(F.transform("c.words_hits", lambda h: F.when(h, "1").otherwise("0")), "")
    return checked(pairs(spark, d)).select("run_id", "id", "sample", bits.alias("hits"), F.round("c.words_fraction", 9).alias("fraction"), F.col("c.sentence").alias("sentence"), F.col("c.dialogue").alias("dialogue"), F.round("c.reward", 9).alias("reward"), F.col("c.satisfied").alias("satisfied"))


def report(rows, *keys):
    """Rates and counts of the constraints of checked rows; a constraint that doesn't apply leaves its denominator."""
    c = F.col("c")
    scored = c["reward"].isNotNull()
    hits = F.size(F.filter(c["words_hits"], lambda h: h))
    n = F.when(c["words_hits"].isNotNull(), F.size(c["words_hits"]))
    rate = lambda x: F.avg(x.cast("double"))
    return rows.groupBy(*keys).agg(
        F.count_if(scored).alias("scored"),
        F.round(rate(F.when(scored, c["satisfied"])), 9).alias("satisfied"),
        F.round(F.avg(c["reward"]), 9).alias("mean_reward"),
        F.round(F.sum(F.when(c["words_hits"].isNotNull(), hits)) / F.sum(n), 9).alias("word_recall"),
        F.coalesce(F.sum(n), F.lit(0)).alias("words"),
        F.round(rate(c["words_fraction"] == 1.0), 9).alias("all_words"),
        F.round(rate(c["sentence"]), 9).alias("sentence"),
        F.count(c["sentence"]).alias("sentences"),
        F.round(rate(c["dialogue"]), 9).alias("dialogue"),
        F.count(c["dialogue"]).alias("dialogues"),
    )


_REPORT = """CAST(count(reward) AS BIGINT) AS scored, round(avg(CASE WHEN reward IS NOT NULL THEN CAST(satisfied AS DOUBLE) END), 9) AS satisfied, round(avg(reward), 9) AS mean_reward,
    round(sum(len(list_filter(hits, lambda h: h))) / sum(len(hits)), 9) AS word_recall, CAST(coalesce(sum(len(hits)), 0) AS BIGINT) AS words, round(avg(CAST(fraction = 1 AS DOUBLE)), 9) AS all_words,
    round(avg(CAST(said AS DOUBLE)), 9) AS sentence, CAST(count(said) AS BIGINT) AS sentences, round(avg(CAST(spoken AS DOUBLE)), 9) AS dialogue, CAST(count(spoken) AS BIGINT) AS dialogues"""


_MISSED = f"(SELECT r.run_id, p.id FROM (SELECT DISTINCT run_id FROM {_PAIRS}) r CROSS JOIN {_PROMPTS} p ANTI JOIN (SELECT * FROM {_SAMPLES} WHERE story IS NOT NULL) s ON s.run_id IS NOT DISTINCT FROM r.run_id AND s.id = p.id)"


def missed(rows, wanted):
    """run_id, id: the prompts of which a run has no story. What each run should have is its own list of ids, taken from
    `wanted`; only (run, id) pairs are compared, no stories."""
    runs = rows.select("run_id").distinct().agg(F.collect_set(F.struct("run_id")).alias("runs"))  # one row of few runs
    every = wanted.select("id").join(F.broadcast(runs)).select("id", F.explode("runs").alias("r")).select("id", "r.run_id")
    have = rows.where("story is not null").select(F.col("run_id").alias("r"), F.col("id").alias("i")).distinct()
    return every.join(have, F.col("id").eqNullSafe(F.col("i")) & F.col("run_id").eqNullSafe(F.col("r")), "left_anti").select("run_id", "id")


@query(f"SELECT run_id, id FROM {_MISSED}")
def missing_stories(spark, d):
    """Prompts joined to each run's stories from the left: those without one are listed, not scored."""
    return missed(pairs(spark, d), prompts(spark, d))


@query(f"""SELECT a.*, coalesce(m.missing, 0) AS missing FROM (SELECT run_id, {_REPORT} FROM {checked_sql(_PAIRS, 'run_id, id, sample')} GROUP BY run_id) a
    LEFT JOIN (SELECT run_id, CAST(count(*) AS BIGINT) AS missing FROM {_MISSED} GROUP BY run_id) m USING (run_id)""")
def constraint_report(spark, d):
    rows = pairs(spark, d)
    lacks = missed(rows, prompts(spark, d)).groupBy("run_id").agg(F.count("*").alias("missing"))  # one row for each run
    return report(checked(rows), "run_id").join(lacks, "run_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


@query(f"SELECT run_id, CAST(count(DISTINCT id) AS BIGINT) AS prompts, round(count(*) / count(DISTINCT id), 9) AS samples_per_prompt, round(avg(CAST(coalesce(finished, true) AS DOUBLE)), 9) AS finished FROM {_PAIRS} GROUP BY run_id")
def sampling_summary(spark, d):
    n = F.count_distinct("id")
    return pairs(spark, d).groupBy("run_id").agg(n.alias("prompts"), F.round(F.count("*") / n, 9).alias("samples_per_prompt"), F.round(F.avg(F.coalesce("finished", F.lit(True)).cast("double")), 9).alias("finished"))


@query(f"SELECT id, round(reward, 9) AS reward FROM {checked_sql(_ONCE, 'id')} WHERE reward IS NOT NULL AND NOT satisfied ORDER BY id LIMIT 200")
def gold_failures(spark, d):
    """The first 200 records whose own story misses a constraint: a report with a fixed length."""
    rows = checked(records(spark, d).where(text.verifiable())).where("not c.satisfied")
    return rows.select("id", F.round("c.reward", 9).alias("reward")).orderBy("id").limit(200)


_MARK = "CASE WHEN {} THEN '✓{}' ELSE '✗{}' END"


@query(f"""WITH c AS (SELECT * FROM {checked_sql(_PAIRS, 'run_id, id, sample')} JOIN (SELECT run_id, id, sample, finished FROM {_SAMPLES}) USING (run_id, id, sample)),
    p AS (SELECT *, concat_ws(' · ', CASE WHEN hits IS NOT NULL THEN '**Words:** ' || array_to_string(list_transform(range(1, len(hits) + 1), lambda i: CASE WHEN hits[i] THEN '✓ ' ELSE '✗ ' END || required[i]), ', ') END,
        CASE WHEN said IS NOT NULL THEN '**Sentence:** ' || CASE WHEN said THEN '✓ included' ELSE '✗ missing' END END, CASE WHEN spoken IS NOT NULL THEN '**Dialogue:** ' || CASE WHEN spoken THEN '✓ present' ELSE '✗ missing' END END) AS parts FROM c)
    SELECT run_id, id, sample, CASE WHEN parts = '' THEN 'No checkable instruction: add required words, a sentence, or Dialogue.' ELSE parts || ' · **Reward:** ' || printf('%.2f', reward) || CASE WHEN coalesce(finished, true) THEN '' ELSE ' (the story did not finish)' END END AS verdict FROM p""")
def verdict_line(spark, d):
    c = checked(pairs(spark, d))
    return c.select("run_id", "id", "sample", C.verdict(F.col("words"), F.col("c"), F.col("finished")).alias("verdict"))


@query(f"""SELECT run_id, id, sample, round(CASE WHEN NOT coalesce(finished, true) THEN 0.0 ELSE reward END, 9) AS score FROM {checked_sql(_PAIRS, 'run_id, id, sample')} JOIN (SELECT run_id, id, sample, finished FROM {_SAMPLES}) USING (run_id, id, sample)""")
def unfinished_zero_reward(spark, d):
    return checked(pairs(spark, d)).select("run_id", "id", "sample", F.round(C.score(F.col("c"), F.col("finished")), 9).alias("score"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {_ONCE} WHERE story IS NOT NULL),
    s AS (SELECT a.id, a.words, a.features, a.sentence, b.story FROM r a JOIN r b ON b.i = (a.i * 7919 + 13) % a.n)
    SELECT {_REPORT} FROM {checked_sql('s', 'id')}""")
def shuffled_base_rate(spark, d):
    """The constraints of each record checked on another record's story: place i takes the story at (7919 i + 13) mod n."""
    rows = order.row_numbers(records(spark, d).where("story is not null"), ["id"], "i")
    n = rows.count()
    other = rows.select(F.col("i").alias("j"), "story")
    paired = rows.drop("story").withColumn("j", F.pmod(F.col("i") * 7919 + 13, F.lit(max(n, 1)))).join(other, "j")
    return report(checked(paired))


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {_ONCE} WHERE story IS NOT NULL),
    s AS (SELECT a.id, a.words, a.features, a.sentence, b.story FROM r a JOIN r b ON b.i = (a.i * 7919 + 13) % a.n)
    SELECT 'gold' AS stories, {_REPORT} FROM {checked_sql(f"(SELECT * FROM {_ONCE} WHERE story IS NOT NULL)", 'id')} UNION ALL SELECT 'shuffled', {_REPORT} FROM {checked_sql('s', 'id')}""")
def gold_and_base_rate(spark, d):
    """The constraints checked on the records' own stories, beside the base rate of shuffled ones."""
    gold = report(checked(records(spark, d).where("story is not null")))
    kind = lambda df, name: df.select(F.lit(name).alias("stories"), "*")
    return kind(gold, "gold").unionByName(kind(shuffled_base_rate(spark, d), "shuffled"))


@query(f"SELECT id, CAST(count(*) AS BIGINT) AS rows FROM {_SAMPLES} s WHERE NOT EXISTS (SELECT 1 FROM {_PROMPTS} p WHERE p.id = s.id) GROUP BY id")
def unknown_sample_ids(spark, d):
    """Ids of samples that no prompt has: a strict join (known with unknown="raise") ends at the first of them."""
    return samples(spark, d).join(prompts(spark, d).select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("rows"))


@query(f"SELECT run_id, id, sample, sentence IS NOT NULL AS has_sentence, CAST(length(story) AS INTEGER) AS chars FROM {_PAIRS}")
def join_samples_prompts(spark, d):
    return pairs(spark, d).select("run_id", "id", "sample", F.col("sentence").isNotNull().alias("has_sentence"), F.length("story").alias("chars"))


@query(f"SELECT DISTINCT p.id FROM {_PROMPTS} p ANTI JOIN samples s ON s.id = p.id ORDER BY 1")
def anti_missing_ids(spark, d):
    """Prompts that have no sample."""
    got = table(spark, d, "samples").select("id")
    return prompts(spark, d).select("id").join(got, "id", "left_anti").orderBy("id")


@query(f"SELECT id FROM {_ONCE} r WHERE id LIKE 'train-%' AND NOT EXISTS (SELECT 1 FROM heldout_prompts p WHERE p.sentence = r.sentence)")
def anti_heldout_exclusion(spark, d):
    """Training ids whose required sentence isn't one of a held-out prompt."""
    held = table(spark, d, "heldout_prompts").where("sentence is not null").select("sentence")
    return records(spark, d).where(F.col("id").startswith("train-")).join(held, "sentence", "left_anti").select("id")


@query(f"SELECT id, sample, run_id FROM {_SAMPLES} s WHERE EXISTS (SELECT 1 FROM {_PROMPTS} p WHERE p.id = s.id AND CAST(right(p.id, 7) AS INTEGER) * 31 % 97 < 20)")
def semi_sampled_rows(spark, d):
    """Samples of a fixed pseudo-random choice of the prompts."""
    chosen = prompts(spark, d).where(F.right("id", F.lit(7)).cast("int") * 31 % 97 < 20).select("id")
    return samples(spark, d).join(chosen, "id", "left_semi").select("id", "sample", "run_id")


def with_groups(rows):
    """Rewarded samples with the mean and deviation of their group: two aggregates with a map-side part and a join, so
    that a prompt with a third of all rows is spread."""
    rows = rows.where("reward is not null")
    stats = rows.groupBy("run_id", "id").agg(F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("sd"))
    return rows.join(stats, ["run_id", "id"])


@query(f"""SELECT run_id, id, sample, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6), 6) AS advantage FROM {_SAMPLES} WHERE reward IS NOT NULL WINDOW w AS (PARTITION BY run_id, id)""")
def group_advantages(spark, d):
    """Rewards standardized within their group, a run's samples of one prompt."""
    return with_groups(samples(spark, d)).select("run_id", "id", "sample", F.round((F.col("reward") - F.col("mean")) / (F.col("sd") + 1e-6), 6).alias("advantage"))


@query(f"""WITH g AS (SELECT run_id, id, stddev_pop(reward) AS sd, avg(reward) AS m FROM {_SAMPLES} WHERE reward IS NOT NULL GROUP BY run_id, id),
    a AS (SELECT run_id, avg(abs(reward - m) / (sd + 1e-6)) AS mean_abs FROM {_SAMPLES} JOIN g USING (run_id, id) WHERE reward IS NOT NULL GROUP BY run_id)
    SELECT run_id, CAST(count(*) AS BIGINT) AS groups, round(avg(CASE WHEN sd > 1e-9 THEN 1.0 ELSE 0.0 END), 9) AS informative, round(max(mean_abs), 6) AS mean_abs_advantage FROM g JOIN a USING (run_id) GROUP BY run_id""")
def informative_groups(spark, d):
    """Share of groups whose rewards differ, and the mean absolute advantage, per run."""
    each = with_groups(samples(spark, d)).select("run_id", "id", "sd", (F.abs(F.col("reward") - F.col("mean")) / (F.col("sd") + 1e-6)).alias("a"))
    groups = each.groupBy("run_id", "id").agg(F.max("sd").alias("sd"), F.sum("a").alias("a"), F.count("*").alias("n"))
    return groups.groupBy("run_id").agg(F.count("*").alias("groups"), F.round(F.avg(F.when(F.col("sd") > 1e-9, 1.0).otherwise(0.0)), 9).alias("informative"), F.round(F.sum("a") / F.sum("n"), 6).alias("mean_abs_advantage"))


DRAWS, _BLOCK = 2000, 500


@query(f"""WITH c AS (SELECT run_id, id, avg(CAST(satisfied AS DOUBLE)) AS m FROM {checked_sql(_PAIRS, 'run_id, id, sample')} WHERE reward IS NOT NULL GROUP BY run_id, id),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM c),
    draws AS (SELECT o.run_id, b, (b * 1000003 + o.i * 7919 + (o.i * o.i) % 101 * 31 + b * b % 97 * o.i) % o.n AS j FROM o, range({DRAWS}) t(b)),
    means AS (SELECT d.run_id, b, avg(o.m) AS m FROM draws d JOIN o ON o.run_id = d.run_id AND o.i = d.j GROUP BY d.run_id, b)
    SELECT run_id, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means GROUP BY run_id""")
def cluster_bootstrap(spark, d):
    """95 % interval of the satisfied rate, drawing prompts with replacement: 2,000 draws by a fixed congruence.

    The means of a run's prompts are a small list (one number a prompt), of which each block of draws gets a copy.
    """
    scored = checked(pairs(spark, d).where(text.verifiable()))  # those that have a reward
    p = scored.groupBy("run_id", "id").agg(F.avg(F.col("c.satisfied").cast("double")).alias("m"))
    blocks = p.select("run_id", "id", "m", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - _BLOCK), F.lit(_BLOCK))).alias("first"))
    means = blocks.groupBy("run_id", "first").applyInPandas(_drawn, "run_id string, m double")
    return means.groupBy("run_id").agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def _drawn(pdf: pd.DataFrame) -> pd.DataFrame:
    """The means of one block of draws from a run's prompts in order of their ids."""
    m = pdf.sort_values("id")["m"].to_numpy()
    i, n = np.arange(len(m), dtype=np.int64), len(m)
    b = int(pdf["first"].iloc[0]) + np.arange(_BLOCK, dtype=np.int64)
    means = [m[(x * 1000003 + i * 7919 + i * i % 101 * 31 + x * x % 97 * i) % n].mean() for x in b]
    return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "m": means})


@query(f"""SELECT sample, round(avg(reward) FILTER (run_id LIKE 'base%'), 6) AS base, round(avg(reward) FILTER (run_id LIKE 'sft%'), 6) AS sft, round(avg(reward) FILTER (run_id LIKE 'grpo%'), 6) AS grpo FROM {_SAMPLES} GROUP BY sample""")
def policies_side_by_side(spark, d):
    """Mean reward by sample number, one column for each kind of policy."""
    rows = samples(spark, d).withColumn("kind", F.regexp_extract("run_id", "^[a-z]+", 0))
    wide = rows.groupBy("sample").pivot("kind", ["base", "sft", "grpo"]).agg(F.avg("reward"))
    return wide.select("sample", *(F.round(k, 6).alias(k) for k in ("base", "sft", "grpo")))


@query(f"""WITH r AS (SELECT regexp_extract(run_id, '^(.*)-s[0-9]+-', 1) AS policy, run_id, avg(reward) AS m FROM {_SAMPLES} GROUP BY 1, 2)
    SELECT policy, CAST(count(*) AS BIGINT) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM r GROUP BY policy""")
def seed_mean_sd(spark, d):
    """Mean and sample deviation over the runs of a policy."""
    runs = samples(spark, d).groupBy(F.regexp_extract("run_id", "^(.*)-s[0-9]+-", 1).alias("policy"), "run_id").agg(F.avg("reward").alias("m"))
    return runs.groupBy("policy").agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))
