"""Queries over raw texts: scans, stripping, record parsing, repetition, splits, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import text
from fabula.operators import order
from fabula.plans import sql as Q
from fabula.plans.registry import Registry
from fabula.tables import table

registry = Registry()
query = registry.add


@query(rf"SELECT doc_id, t AS text FROM (SELECT doc_id, {Q.strip('text')} AS t FROM documents) WHERE t <> ''")
def scan_strip_nonempty(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip("text").alias("text")).where("text <> ''")


@query("SELECT doc_id, CAST(octet_length(encode(text || chr(10))) AS BIGINT) AS n_bytes FROM documents WHERE text <> ''")
def parquet_text_projection(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").where("text <> ''")
    return rows.select("doc_id", F.octet_length(F.concat("text", F.lit("\n"))).cast("long").alias("n_bytes"))


@query("""SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
    SELECT 'documents' AS split, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) WHERE text <> '' GROUP BY split""")
def union_splits(spark, d):
    part = lambda name: table(spark, d, name).select(F.lit(name).alias("split"), "text")
    both = part("documents").unionByName(part("benchmark")).where("text <> ''")
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(rf"""SELECT id, doc_id FROM (SELECT printf('doc-%07d', row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id, text FROM documents)
    WHERE {Q.strip("coalesce(text, '')")} <> ''""")
def stable_row_ids(spark, d):
    """Numbers of all rows in order, also of those that are left out afterwards."""
    flagged = table(spark, d, "documents").select("doc_id", (text.strip(F.coalesce("text", F.lit(""))) != "").alias("kept"))
    kept = order.row_numbers(flagged, ["doc_id"], "n").where("kept")
    return kept.select(F.format_string("doc-%07d", "n").alias("id"), "doc_id")


@query("""WITH p AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents),
    t AS (SELECT floor(sum(n) * 0.9) AS cut FROM p)
    SELECT doc_id, CAST(greatest(least(start + n, cut) - start, 0) AS BIGINT) AS train_bytes, CAST(greatest(start + n - greatest(start, cut), 0) AS BIGINT) AS valid_bytes FROM p, t""")
def chronological_split(spark, d):
    """The first 90 % of the bytes train, the rest validates; a document on the border is in both."""
    sized = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    placed = order.running_total(sized, ["doc_id"], "n", "start")
    total = sized.agg(F.sum("n")).first()[0] or 0
    cut, end = F.lit(int(total * 0.9)), F.col("start") + F.col("n")
    train = F.greatest(F.least(end, cut) - F.col("start"), F.lit(0)).cast("long")
    valid = F.greatest(end - F.greatest(F.col("start"), cut), F.lit(0)).cast("long")
    return placed.select("doc_id", train.alias("train_bytes"), valid.alias("valid_bytes"))


@query("""SELECT i AS row_id, ['queued', 'active', 'completed'][i % 3 + 1] AS state, CAST((i * 7919 + 17) % 9999 + 1 AS BIGINT) AS id,
    '{"id":' || ((i * 7919 + 17) % 9999 + 1) || ',"state":"' || ['queued', 'active', 'completed'][i % 3 + 1] || '","tokens":' || (((i * 7919 + 17) % 9999 + 1) % 128) || '}' AS json
    FROM range(2000) t(i)""")
def synthetic_state_machine(spark, d):
    """The synthetic JSON grammar; values come from a fixed congruence instead of a random stream."""
    value = F.pmod(F.col("id") * 7919 + 17, F.lit(9999)) + 1
    state = F.element_at(F.array(F.lit("queued"), F.lit("active"), F.lit("completed")), (F.col("id") % 3 + 1).cast("int"))
    json = F.concat(F.lit('{"id":'), value.cast("string"), F.lit(',"state":"'), state, F.lit('","tokens":'), (value % 128).cast("string"), F.lit("}"))
    return spark.range(2000).select(F.col("id").alias("row_id"), state.alias("state"), value.alias("id"), json.alias("json"))


_LINE_BREAK = r"\r\n|[\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH lines AS (
    SELECT doc_id, unnest(string_split(regexp_replace(text, '{_LINE_BREAK}', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '{_LINE_BREAK}', chr(10), 'g'), chr(10)), 1) AS no
    FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    labelled AS (SELECT *, CASE WHEN starts_with(line, 'Summary:') THEN 'summary' WHEN starts_with(line, 'Words:') THEN 'words' WHEN starts_with(line, 'Features:') THEN 'features'
        WHEN starts_with(line, 'Random sentence:') THEN 'sentence' WHEN starts_with(line, 'Story:') THEN 'story' END AS label FROM lines),
    placed AS (SELECT *, last_value(label IGNORE NULLS) OVER w AS now, max(CASE WHEN label = 'story' THEN no END) OVER (PARTITION BY doc_id) AS first_line,
        CASE WHEN label IS NULL THEN line ELSE {Q.strip("substr(line, length(CASE label WHEN 'summary' THEN 'Summary:' WHEN 'words' THEN 'Words:' WHEN 'features' THEN 'Features:' WHEN 'sentence' THEN 'Random sentence:' ELSE 'Story:' END) + 1)")} END AS value
        FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    folded AS (SELECT doc_id, nullif(arg_max(value, no) FILTER (label = 'summary'), '') AS summary, arg_max(value, no) FILTER (label = 'words') AS words, arg_max(value, no) FILTER (label = 'features') AS features,
        nullif(arg_max(value, no) FILTER (label = 'sentence'), '') AS sentence,
        {Q.strip("string_agg(value, chr(10) ORDER BY no) FILTER (now = 'story' AND no >= first_line AND NOT (label IS NOT NULL AND value = ''))")} AS story FROM placed GROUP BY doc_id)
    SELECT doc_id, summary, array_to_string(list_filter(list_transform(string_split(coalesce(words, ''), ','), lambda x: {Q.strip('x')}), lambda x: x <> ''), '|') AS words,
        array_to_string(list_filter(list_transform(string_split(coalesce(features, ''), ','), lambda x: {Q.strip('x')}), lambda x: x <> ''), '|') AS features, sentence, story FROM folded WHERE story <> ''""")
def conversation_field_fold(spark, d):
    """Rendered records among the documents, parsed back into their fields."""
    # most texts have no label and need not be parsed, let alone twice (for the filter on r, too)
    rows = table(spark, d, "documents").where(F.col("text").contains("Story:")).select("doc_id", "text").distinct()
    parsed = rows.select("doc_id", text.parse_record("text").alias("r")).where("r is not null")
    return parsed.select("doc_id", "r.summary", F.array_join("r.words", "|").alias("words"), F.array_join("r.features", "|").alias("features"), "r.sentence", "r.story")


_RENDER = rf"""concat_ws(chr(10), CASE WHEN summary <> '' THEN 'Summary: ' || summary END, CASE WHEN len({Q.filled('words')}) > 0 THEN 'Words: ' || array_to_string({Q.filled('words')}, ', ') END,
    CASE WHEN len({Q.filled('features')}) > 0 THEN 'Features: ' || array_to_string({Q.filled('features')}, ', ') END, CASE WHEN sentence <> '' THEN 'Random sentence: ' || sentence END, 'Story:' || chr(10))"""
_VERIFIABLE = f"(len({Q.filled('words')}) > 0 OR coalesce(sentence, '') <> '' OR coalesce(list_contains(features, 'Dialogue'), false))"
_ONCE = "(SELECT id, max(summary) AS summary, max(words) AS words, max(features) AS features, max(sentence) AS sentence, max(story) AS story, max(source) AS source FROM instruct_records WHERE id IS NOT NULL GROUP BY id)"


def records(spark, d):
    """Each id of instruct_records once: deliveries of an id have the same content, so any field's maximum is it."""
    fields = ["summary", "words", "features", "sentence", "story", "source"]
    return table(spark, d, "instruct_records").where("id is not null").groupBy("id").agg(*(F.max(f).alias(f) for f in fields))


@query(f"SELECT DISTINCT id, {_RENDER} AS prompt FROM heldout_prompts")
def render_prompt(spark, d):
    return table(spark, d, "heldout_prompts").select("id", text.render_prompt().alias("prompt")).distinct()


@query(f"""SELECT split_part(id, '-', 1) AS split, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (summary <> '') AS BIGINT) AS summary, CAST(count(*) FILTER (len({Q.filled('words')}) > 0) AS BIGINT) AS words,
    CAST(count(*) FILTER (len({Q.filled('features')}) > 0) AS BIGINT) AS features, CAST(count(*) FILTER (sentence <> '') AS BIGINT) AS sentence, CAST(count(*) FILTER ({_VERIFIABLE}) AS BIGINT) AS verifiable,
    CAST(count(*) FILTER ({Q.strip("coalesce(story, '')")} = '') AS BIGINT) AS without_story FROM {_ONCE} GROUP BY 1""")
def field_presence(spark, d):
    here = {"summary": F.col("summary") != "", "words": F.size(text.filled("words")) > 0, "features": F.size(text.filled("features")) > 0, "sentence": F.col("sentence") != "", "verifiable": text.verifiable(), "without_story": text.strip(F.coalesce("story", F.lit(""))) == ""}
    return records(spark, d).groupBy(F.substring_index("id", "-", 1).alias("split")).agg(F.count("*").alias("records"), *(F.count_if(c).alias(n) for n, c in here.items()))


_REPETITION = f"CASE WHEN text IS NULL THEN NULL WHEN len(g) = 0 THEN 0.0 ELSE 1 - len(list_distinct(g)) / len(g) END"
_GRAMS = f"(SELECT *, {Q.grams('w', 4)} AS g FROM (SELECT *, {Q.words('text')} AS w FROM documents))"


@query(f"SELECT doc_id, round({_REPETITION}, 9) AS repetition FROM {_GRAMS}")
def ngram_repetition(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.repetition("text"), 9).alias("repetition"))


@query(f"""SELECT coalesce(lower(lang), '(none)') AS lang, CAST(count(*) AS BIGINT) AS documents, round(avg(r), 9) AS repetition, round(avg(CASE WHEN r >= 0.1 THEN 1.0 ELSE 0.0 END), 9) AS loop_share
    FROM (SELECT lang, {_REPETITION} AS r FROM {_GRAMS}) WHERE r IS NOT NULL GROUP BY 1""")
def loop_share(spark, d):
    """Mean repetition and share of looping texts by language: the flagship query."""
    # the filter is on the text: one on r would be pushed below and compute it twice
    rows = table(spark, d, "documents").where("text is not null").select(F.coalesce(F.lower("lang"), F.lit("(none)")).alias("lang"), text.repetition("text").alias("r"))
    looping = F.avg(F.when(F.col("r") >= 0.1, 1.0).otherwise(0.0))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.round(F.avg("r"), 9).alias("repetition"), F.round(looping, 9).alias("loop_share"))


@query(f"""SELECT split_part(id, '-', 1) AS split, CAST(count(story) AS BIGINT) AS stories, round(avg(length(story)), 6) AS chars, round(avg(len({Q.words('story')})), 6) AS words,
    round(avg(len(list_distinct({Q.words('story')}))), 6) AS distinct_words FROM {_ONCE} WHERE story IS NOT NULL GROUP BY 1""")
def story_stats(spark, d):
    rows = records(spark, d).where("story is not null").select(F.substring_index("id", "-", 1).alias("split"), F.length("story").alias("n"), text.words("story").alias("w"))
    return rows.groupBy("split").agg(F.count("*").alias("stories"), F.round(F.avg("n"), 6).alias("chars"), F.round(F.avg(F.size("w")), 6).alias("words"), F.round(F.avg(F.size(F.array_distinct("w"))), 6).alias("distinct_words"))


@query("""SELECT doc_id, CAST(n AS BIGINT) AS tokens, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, octet_length(encode(text)) + 1 AS n FROM documents WHERE text <> '')""")
def packed_offsets(spark, d):
    """Start of each text in the packed stream of byte tokens, one end token after each text."""
    sized = table(spark, d, "documents").where("text <> ''").select("doc_id", (F.octet_length("text") + 1).cast("long").alias("tokens"))
    return order.running_total(sized, ["doc_id"], "tokens", "start")


@query("""WITH p AS (SELECT doc_id, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n
    FROM (SELECT doc_id, octet_length(encode(text)) + 1 AS n FROM documents WHERE text <> ''))
    SELECT doc_id, start FROM p WHERE start < (SELECT sum(n) FROM p) - 512""")
def usable_starts(spark, d):
    """Starts that leave a whole context of 512 tokens."""
    placed = packed_offsets(spark, d)
    total = table(spark, d, "documents").where("text <> ''").agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return placed.where(F.col("start") < total - 512).select("doc_id", "start")


@query(f"SELECT id, CAST(octet_length(encode(prompt)) AS BIGINT) AS prompt_tokens FROM (SELECT id, {_RENDER} AS prompt FROM {_ONCE} WHERE {_VERIFIABLE} AND id LIKE 'train-%') WHERE octet_length(encode(prompt)) <= 200")
def prompt_pool(spark, d):
    """Training records with a constraint whose prompt has at most 200 byte tokens."""
    rows = records(spark, d).where(F.col("id").startswith("train-") & text.verifiable())
    return rows.select("id", F.octet_length(text.render_prompt()).cast("long").alias("prompt_tokens")).where("prompt_tokens <= 200")


@query(f"""SELECT split_part(id, '-', 1) AS split, CAST(count(*) AS BIGINT) AS examples, CAST(sum(p + s + 1) AS BIGINT) AS tokens, CAST(sum(s + 1) AS BIGINT) AS loss_tokens, CAST(sum(s) AS BIGINT) AS story_bytes
    FROM (SELECT id, octet_length(encode({_RENDER})) AS p, octet_length(encode(story)) AS s FROM {_ONCE} WHERE story <> '') GROUP BY 1""")
def sft_totals(spark, d):
    """Examples, tokens and loss tokens of fine-tuning examples in byte tokens; loss on story and end token only."""
    sized = records(spark, d).where("story <> ''").select(F.substring_index("id", "-", 1).alias("split"), F.octet_length(text.render_prompt()).alias("p"), F.octet_length("story").alias("s"))
    return sized.groupBy("split").agg(F.count("*").alias("examples"), F.sum(F.col("p") + F.col("s") + 1).alias("tokens"), F.sum(F.col("s") + 1).alias("loss_tokens"), F.sum("s").alias("story_bytes"))


@query("""WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text <> ''), o AS (SELECT *, row_number() OVER (ORDER BY n, doc_id) - 1 AS i FROM s)
    SELECT CAST(i // 32 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS rows, CAST(max(n) AS BIGINT) AS width, CAST(max(n) * count(*) - sum(n) AS BIGINT) AS padding FROM o GROUP BY 1""")
def length_bucketed_batches(spark, d):
    """Batches of 32 texts of similar length, with the padding each needs."""
    sized = table(spark, d, "documents").where("text <> ''").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    numbered = order.row_numbers(sized, ["n", "doc_id"], "i").withColumn("batch", F.floor(F.col("i") / 32))
    return numbered.groupBy("batch").agg(F.count("*").alias("rows"), F.max("n").alias("width"), (F.max("n") * F.count("*") - F.sum("n")).alias("padding"))


@query("""WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text <> ''), o AS (SELECT n, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS a, (row_number() OVER (ORDER BY n, doc_id) - 1) // 32 AS b FROM s)
    SELECT 'arrival' AS batching, CAST(sum(p) AS BIGINT) AS padding FROM (SELECT max(n) * count(*) - sum(n) AS p FROM o GROUP BY a) UNION ALL SELECT 'length', CAST(sum(p) AS BIGINT) FROM (SELECT max(n) * count(*) - sum(n) AS p FROM o GROUP BY b)""")
def padding_cost(spark, d):
    """Padding of batches in order of arrival and in order of length."""
    sized = table(spark, d, "documents").where("text <> ''").select("doc_id", F.octet_length("text").cast("long").alias("n"))

    def cost(name, by):
        batches = order.row_numbers(sized, by, "i").groupBy(F.floor(F.col("i") / 32)).agg((F.max("n") * F.count("*") - F.sum("n")).alias("p"))
        return batches.agg(F.lit(name).alias("batching"), F.sum("p").alias("padding"))

    return cost("arrival", ["doc_id"]).unionByName(cost("length", ["n", "doc_id"]))
