"""Queries of the tokenizer and the byte language models; documents with even ids train, those with odd ids are held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import text
from fabula.operators import bpe, ngram
from fabula.plans import sql as Q
from fabula.plans.registry import Registry
from fabula.session import materialize
from fabula.tables import table

registry = Registry()
query = registry.add
VOCABULARIES = (2048, 4096, 8192)
FIRST = 257  # 256 bytes and the end of text, which no merge may take
MERGES = VOCABULARIES[-1] - FIRST


def _part(spark, d, odd):
    return table(spark, d, "documents").where(F.col("doc_id") % 2 == odd).select("doc_id", "text")


_BYTES = "(SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM (SELECT doc_id, text FROM documents WHERE text <> '' AND doc_id % 2 = {}))))"
_PAIRS = "(SELECT a, b FROM (SELECT lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS a, b FROM " + _BYTES + ") WHERE a IS NOT NULL)"


@query("""SELECT CAST(('0x' || b) AS INTEGER) AS token, CAST(count(*) AS BIGINT) AS n FROM (SELECT substr(h, 2 * i + 1, 2) AS b FROM (SELECT h, unnest(range(length(h) // 2)) AS i FROM (SELECT hex(encode(text)) AS h FROM documents WHERE text <> ''))) GROUP BY 1""")
def byte_token_counts(spark, d):
    return ngram.unigram_counts(table(spark, d, "documents"))


@query(f"""WITH t AS (SELECT b, count(*) AS n FROM {_BYTES.format(0)} GROUP BY b), h AS (SELECT b, count(*) AS m FROM {_BYTES.format(1)} GROUP BY b)
    SELECT CAST(sum(m) AS BIGINT) AS targets, round(ln(256), 9) AS uniform, round(sum(m * -ln((coalesce(n, 0) + 1) / (SELECT sum(n) + 256.0 FROM t))) / sum(m), 9) AS unigram FROM h LEFT JOIN t USING (b)""")
def unigram_cross_entropy(spark, d):
    loss = ngram.unigram_loss(ngram.unigram_counts(_part(spark, d, 0)), ngram.unigram_counts(_part(spark, d, 1)))
    return loss.select("targets", F.round("uniform", 9).alias("uniform"), F.round("unigram", 9).alias("unigram"))


@query(f"""WITH t AS (SELECT a, b, count(*) AS n FROM {_PAIRS.format(0)} GROUP BY a, b), r AS (SELECT a, sum(n) AS total FROM t GROUP BY a), h AS (SELECT a, b, count(*) AS m FROM {_PAIRS.format(1)} GROUP BY a, b)
    SELECT CAST(sum(m) AS BIGINT) AS targets, round(sum(m * -ln((coalesce(n, 0) + 1) / (coalesce(total, 0) + 256.0))) / sum(m), 9) AS bigram FROM h LEFT JOIN t USING (a, b) LEFT JOIN r USING (a)""")
def bigram_cross_entropy(spark, d):
    loss = ngram.bigram_loss(ngram.bigram_counts(_part(spark, d, 0)), ngram.bigram_counts(_part(spark, d, 1)))
    return loss.select("targets", F.round("bigram", 9).alias("bigram"))


_STITCH = "(SELECT a, b FROM (SELECT lag(b) OVER (ORDER BY doc_id, i) AS a, b FROM " + _BYTES + ") WHERE a IS NOT NULL)"


@query(f"SELECT CAST(('0x' || a) AS INTEGER) AS previous, CAST(('0x' || b) AS INTEGER) AS token, CAST(count(*) AS BIGINT) AS n FROM {_STITCH.format(0)} GROUP BY ALL")
def stitched_bigram_counts(spark, d):
    """Counts over the stream of all training texts joined in order of their ids."""
    rows = _part(spark, d, 0)
    both = ngram.bigram_counts(rows).unionByName(ngram.boundary_counts(rows, "doc_id"))
    return both.groupBy("previous", "token").agg(F.sum("n").alias("n"))


@query(f"""WITH t AS (SELECT b, count(*) AS n FROM {_BYTES.format(0)} GROUP BY b)
    SELECT doc_id, CAST(i // 128 AS INTEGER) AS "window", CAST(count(*) AS INTEGER) AS targets, round(sum(-ln((coalesce(n, 0) + 1) / (SELECT sum(n) + 256.0 FROM t))) / count(*), 6) AS loss FROM {_BYTES.format(1)} LEFT JOIN t USING (b) GROUP BY doc_id, i // 128""")
def windowed_heldout_loss(spark, d):
    windows = ngram.windowed_loss(_part(spark, d, 1), ngram.unigram_counts(_part(spark, d, 0)), "doc_id", 128)
    return windows.select("doc_id", "window", "targets", F.round(F.col("nats") / F.col("targets"), 6).alias("loss"))


_WORDS = f"(SELECT unnest({Q.words('text')}) AS chunk FROM documents)"


@query(f"SELECT chunk, CAST(count(*) AS BIGINT) AS n FROM {_WORDS} GROUP BY chunk")
def word_chunk_counts(spark, d):
    """Distinct chunks of the simple word pattern, which SQL can express."""
    return bpe.chunk_counts(table(spark, d, "documents"), split=text.words("text"))


@query(f"""WITH c AS (SELECT chunk, count(*) AS n FROM {_WORDS} GROUP BY chunk), p AS (SELECT substr(chunk, i, 2) AS p, n FROM (SELECT chunk, n, unnest(range(1, length(chunk))) AS i FROM c))
    SELECT hex(encode(left(p, 1))) AS "left", hex(encode(right(p, 1))) AS "right", CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY p""")
def bpe_pair_counts(spark, d):
    return bpe.pair_counts(word_chunk_counts(spark, d))


@query(f"""WITH c AS (SELECT chunk, count(*) AS n FROM {_WORDS} GROUP BY chunk), p AS (SELECT substr(chunk, i, 2) AS p, n FROM (SELECT chunk, n, unnest(range(1, length(chunk))) AS i FROM c))
    SELECT hex(encode(left(p, 1))) AS "left", hex(encode(right(p, 1))) AS "right", CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY p ORDER BY 3 DESC, 1, 2 LIMIT 1""")
def bpe_first_merge(spark, d):
    """The pair that is merged first: the most frequent, of ties the smallest."""
    return bpe_pair_counts(spark, d).orderBy(F.desc("n"), "left", "right").limit(1)


@query()
def chunk_counts(spark, d):
    """Distinct chunks of the public pre-split pattern."""
    return bpe.chunk_counts(table(spark, d, "documents"))


def _counts(spark, d):
    """The corpus is read once; its distinct chunks are a small table."""
    return materialize(bpe.chunk_counts(table(spark, d, "documents")), "chunk_counts")


def _merges(spark, d):
    return bpe.learn_merges(_counts(spark, d), MERGES)


@query("SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def chunk_cover(spark, d):
    """The chunks hold every byte and character of the texts, once."""
    n = chunk_counts(spark, d)
    return n.agg(F.sum(F.octet_length("chunk") * F.col("n")).alias("bytes"), F.sum(F.length("chunk") * F.col("n")).alias("chars"))


@query()
def bpe_merges(spark, d):
    """The first merges in order."""
    rows = [(i, left, right, 256 + i) for i, (left, right) in enumerate(_merges(spark, d))]
    return spark.createDataFrame(rows, "rank int, left int, right int, id int")


@query()
def bpe_encode_counts(spark, d):
    counts = _counts(spark, d)
    return bpe.encoded_counts(counts, bpe.learn_merges(counts, MERGES))


@query("SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, true AS known, true AS shorter FROM documents")
def encode_cover(spark, d):
    """The tokens of all chunks have as many bytes as the texts, are known, and are fewer than the bytes."""
    counts = _counts(spark, d)
    merges = bpe.learn_merges(counts, MERGES)
    sizes = spark.createDataFrame([(i, len(t)) for i, t in enumerate(bpe.vocabulary(merges))], "token int, size int")
    rows = bpe.encoded_counts(counts, merges).join(F.broadcast(sizes), "token", "left")  # at most one row a token
    return rows.agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.every(F.col("size").isNotNull()).alias("known"), (F.sum("n") < F.sum(F.col("n") * F.col("size"))).alias("shorter"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS same FROM documents WHERE text IS NOT NULL")
def roundtrip_check(spark, d):
    """Every text comes back from its tokens."""
    return bpe.encoded(table(spark, d, "documents"), _merges(spark, d), "doc_id").select("doc_id", "n_bytes", "same")


@query()
def decode_roundtrip(spark, d):
    """Tokens of every text, and whether they give it back."""
    return bpe.encoded(table(spark, d, "documents"), _merges(spark, d), "doc_id").select("doc_id", F.size("tokens").alias("tokens"), "same")


@query()
def bytes_per_token(spark, d):
    """Bytes a token of growing vocabularies, all prefixes of one list of merges; held-out texts. A vocabulary is smaller than
    asked for where no pair is left to merge."""
    merges = _merges(spark, d)
    parts = []
    for size in VOCABULARIES:
        kept = merges[: size - FIRST]
        e = bpe.encoded(_part(spark, d, 1), kept, "doc_id")
        parts.append(e.agg(F.lit(FIRST + len(kept)).alias("vocabulary"), F.sum(F.size("tokens")).alias("tokens"), F.sum("n_bytes").alias("bytes"), F.round(F.sum("n_bytes") / F.sum(F.size("tokens")), 6).alias("bytes_per_token")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH t AS (SELECT b, count(*) AS n FROM {_BYTES.format(0)} GROUP BY b), s AS (SELECT doc_id, sum(-ln((coalesce(n, 0) + 1) / (SELECT sum(n) + 256.0 FROM t))) / count(*) AS loss FROM {_BYTES.format(1)} LEFT JOIN t USING (b) GROUP BY doc_id)
    SELECT doc_id, round(loss, 6) AS loss FROM documents LEFT JOIN s USING (doc_id) WHERE doc_id % 2 = 1 AND text IS NOT NULL""")
def story_loss(spark, d):
    """Mean loss of each held-out text; null for an empty one."""
    held = _part(spark, d, 1).where("text is not null")
    windows = ngram.windowed_loss(held, ngram.unigram_counts(_part(spark, d, 0)), "doc_id", 128)
    total = windows.groupBy("doc_id").agg((F.sum("nats") / F.sum("targets")).alias("loss"))
    return held.select("doc_id").join(total, "doc_id", "left").select("doc_id", F.round("loss", 6).alias("loss"))


@query(f"""WITH t AS (SELECT b, count(*) AS n FROM {_BYTES.format(0)} GROUP BY b), h AS (SELECT b, count(*) AS m FROM {_BYTES.format(1)} GROUP BY b)
    SELECT round(sum(m * -ln((coalesce(n, 0) + 1) / (SELECT sum(n) + 256.0 FROM t))) / sum(m) / ln(2), 9) AS bits_per_byte FROM h LEFT JOIN t USING (b)""")
def bits_per_byte(spark, d):
    """Loss in bits: nats a token, times tokens a byte (one), by ln 2."""
    loss = ngram.unigram_loss(ngram.unigram_counts(_part(spark, d, 0)), ngram.unigram_counts(_part(spark, d, 1)))
    return loss.select(F.round(F.col("unigram") / F.ln(F.lit(2.0)), 9).alias("bits_per_byte"))


@query("""SELECT j AS json, sha256(j) AS digest FROM (SELECT '{"bytes":' || CAST(sum(octet_length(encode(text))) AS BIGINT) || ',"documents":' || count(text) || ',"sources":' || count(DISTINCT source) || '}' AS j FROM documents)""")
def corpus_manifest(spark, d):
    """One row: counts as JSON with sorted keys, and its digest."""
    row = table(spark, d, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("documents"), F.count_distinct("source").alias("sources"))
    return row.select(F.to_json(F.struct("bytes", "documents", "sources")).alias("json")).select("json", F.sha2("json", 256).alias("digest"))
