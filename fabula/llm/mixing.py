"""Mixing sources to target weights (problem 7), by iterative proportional fitting.

1. Every document is sized by a public tokenizer and gets its cell: source, language, topic.
2. The token totals of the cells are raked to three sets of goals: the shares of sources, of languages and of topics.
   In turn, the weights of all cells of a source, a language or a topic are scaled to their goal; that no cell may
   exceed its repeats is one more step of the cycle, with a memory of what it cut off (Dykstra's correction), so that
   the weights converge to those nearest to equal repeats that meet all goals, if such exist. Sources come last and
   out exactly; which shares of languages and topics were reached is reported.
3. In a cell of weight w, a document is taken floor(w) times and once more with the calibrated probability
   w - floor(w): systematically, along a line of the source's documents by size class, cell and hash. The running
   totals are summed in two levels, so a cell that holds a third of all rows is no single task. The largest documents
   are drawn first, and the smaller ones make up for what these gave too much or too little.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.words import split_words
from fabula.llm.pairs import language
from fabula.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the pre-split pattern of this public vocabulary, a fixed value
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SIZED = "doc_id long, source string, lang string, topic string, tokens long"
_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


# fixed values: words that show what a text is about, in four languages
_TOPICS = {
    "animals": "dog cat fox bear bird owl rabbit mouse horse fish animal animals duck puppy kitten raven badger whale walrus snail squirrel hund katze fuchs bär vogel maus pferd tier igel chien chat renard ours oiseau souris cheval animal perro gato zorro oso pájaro ratón caballo animales",
    "family": "mom mum dad mother father sister brother grandma grandpa family baby parents uncle aunt mutter vater schwester bruder oma opa familie mère père soeur frère famille grand-mère madre padre hermana hermano abuela abuelo familia",
    "nature": "tree forest river garden flower sun rain snow wind sky mountain lake sea beach star moon wald fluss garten blume sonne regen berg see meer forêt rivière jardin fleur soleil pluie montagne mer bosque río jardín flor sol lluvia montaña mar",
    "food": "cake bread soup apple cookie milk cheese pie honey dinner lunch breakfast eat cook baker kuchen brot suppe apfel milch käse bäcker gâteau pain soupe pomme lait fromage boulanger pastel pan sopa manzana leche queso panadero",
    "travel": "boat train car ship road bridge journey map travel harbor pier market castle tower village town schiff zug auto straße brücke reise markt schloss turm bateau train route pont voyage marché château barco tren camino puente viaje mercado castillo",
    "play": "ball game toy play kite music song dance friend friends party drum puzzle spiel ball spielzeug lied freund freunde jeu jouet chanson ami amis fête juego juguete canción amigo amigos fiesta",
    "feelings": "happy sad angry afraid scared brave love sorry kind lonely proud jealous worried froh traurig wütend angst mutig liebe heureux triste fâché peur courageux amour feliz triste enojado miedo valiente amor",
    "learning": "school teacher book read write learn lesson story word words summary answer question schule lehrer buch lesen lernen geschichte wort école maître livre lire apprendre histoire mot escuela maestro libro leer aprender historia palabra",
}
_TOPIC_OF = {w: t for t, ws in reversed(_TOPICS.items()) for w in ws.split()}


def topic(words: list[str]) -> str:
    """The topic most of whose words a text holds, of equal ones the first; `other` if it has none."""
    hits = Counter(filter(None, map(_TOPIC_OF.get, words)))
    return max(_TOPICS, key=hits.__getitem__) if hits else "other"


def _size(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [split_words(t) for t in texts]
            n = [len(encoder.encode_ordinary(t)) for t in texts]
            langs = [language(w) or "und" for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(langs, pa.string()), pa.array([topic(w) for w in words], pa.string()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "topic", "tokens"])

    return run


def source_name(column):
    """Names that differ only in letter case or outer white space are one source."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every document whose id, source and text are not null and whose text has
    a token. Of several rows with one doc_id that with the greatest source and text counts."""
    if os.path.exists(tokenizer):
        documents.sparkSession.sparkContext.addFile(tokenizer)  # for executors that don't have it
    rows = documents.where("doc_id is not null and source is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), source_name("source").alias("source"), "text")
    sized = rows.mapInArrow(_size(tokenizer), _SIZED).where("tokens > 0")
    once = sized.groupBy("doc_id").agg(F.max(F.struct("source", "tokens", "lang", "topic")).alias("c"))
    return once.select("doc_id", "c.source", "c.lang", "c.topic", "c.tokens")


def rake(tokens: np.ndarray, labels: tuple[np.ndarray, ...], goals: tuple[np.ndarray, ...], cap: np.ndarray, turns: int = 2000) -> np.ndarray:
    """Weight (mean repeats) of each cell: iterative proportional fitting of the token totals by each of the labels to
    its goals, with no weight above its cell's cap.

    The cap is a step of the cycle, with Dykstra's correction, so the weights converge to the fit that is nearest to
    equal weights among those that meet all goals and caps. If there is none, the first labels come out exactly as
    long as their caps allow.
    """
    weight, cut = np.ones(len(tokens)), np.ones(len(tokens))
    total = [np.maximum(g, 1e-300) for g in goals]
    off = lambda w: max((float(np.max(np.abs(np.bincount(l, w * tokens, len(g)) - g) / np.max(t), initial=0)) for l, g, t in zip(labels, goals, total)), default=0)  # noqa: E731, E741
    for _ in range(turns):
        for label, goal in reversed(list(zip(labels, goals))):
            now = np.bincount(label, weight * tokens, len(goal))
            weight = weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[label]
        full = weight * cut
        weight = np.minimum(full, cap)
        cut = np.divide(full, weight, out=np.ones_like(full), where=weight > 0)
        if off(weight) < 1e-9 or cut.max(initial=0) > 1e12:
            break
    # what is missing to the first goals is given by the cells that are below their caps
    label, goal = labels[0], goals[0]
    for _ in range(100):
        now = np.bincount(label, weight * tokens, len(goal))
        if np.all(np.abs(now - goal) <= 1e-9 * np.maximum(goal, 1)):
            break
        below = weight < cap
        room = np.bincount(label[below], (weight * tokens)[below], len(goal))
        scale = np.where(now > goal, np.divide(goal, now, out=np.ones_like(goal), where=now > 0), 1 + np.divide(goal - now, room, out=np.zeros_like(goal), where=room > 0))
        weight = np.where(below | (scale < 1)[label], np.minimum(weight * scale[label], cap), weight)
    return weight


def _goals(asked: DataFrame | None, column: str, names: list[str], have: np.ndarray) -> np.ndarray:
    """Shares of the names, adding up to 1: those asked for, or those of the tokens that there are."""
    if asked is None:
        return have / max(have.sum(), 1)
    given = {r[0]: r[1] or 0.0 for r in asked.groupBy(column).agg(F.sum("target_share")).collect()}  # one row a name
    share = np.array([given.get(n, 0.0) for n in names])
    return share / share.sum() if share.sum() else share


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 11, languages: DataFrame | None = None, topics: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, shares, marginals): doc_id, source, lang, topic, tokens, repeats of the documents that are taken; per
    source target_share, reachable_share, documents, available_tokens, taken_tokens, actual_share, mean_repeats,
    most_repeats, max_repeats; and kind (source, lang, topic), name, target_share, fitted_share, actual_share.

    targets: source, target_share, max_repeats (null: 1); rows of one source are added up, a null source is left out.
    languages: lang, target_share; topics: topic, target_share; without them the shares of the whole corpus are kept,
    whatever the sources' shares would make of them. Names without documents can't have their share, names without
    target get none, and the others are scaled to 1 (reachable_share). total_tokens: size of the mixture; by default
    the largest at which no source needs more than its repeats, so that all shares are met. If it is larger, a source
    that is exhausted gives all it may, and actual_share shows what it lacks. Sources go before languages and topics.
    Empty tables give no chosen documents.
    """
    spark = documents.sparkSession
    sized = materialize(sized_documents(documents, tokenizer), "sized")
    goal = targets.where("source is not null").groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    goals = goal.orderBy("source").collect()  # one row per source of the targets
    # at most sources * languages * topics rows
    cells = sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).join(F.broadcast(goal.select("source")), "source").orderBy("source", "lang", "topic").collect()
    of = {g.source: g for g in goals}
    live = [s for s in sorted({c.source for c in cells}) if (of[s].target_share or 0) > 0 and of[s].max_repeats > 0]
    cells = [c for c in cells if c.source in live]
    share = np.array([of[s].target_share for s in live], float)
    share = share / share.sum() if len(share) else share
    tokens = np.array([c.tokens for c in cells], float)
    names = [live, sorted({c.lang for c in cells}), sorted({c.topic for c in cells})]
    labels = tuple(np.array([n.index(c[k]) for c in cells], np.int64) for k, n in zip(("source", "lang", "topic"), names))
    cap = np.array([of[s].max_repeats for s in live], float)
    have = [np.bincount(x, tokens, len(n)) if len(cells) else np.zeros(0) for x, n in zip(labels, names)]
    size = total_tokens if total_tokens is not None else float(np.min(cap * have[0] / share)) if live else 0.0
    wanted = np.minimum(share * size, cap * have[0])
    asked = [share, _goals(languages, "lang", names[1], have[1]), _goals(topics, "topic", names[2], have[2])]
    weight = rake(tokens, labels, (wanted, asked[1] * wanted.sum(), asked[2] * wanted.sum()), cap[labels[0]]) if cells else np.zeros(0)
    weights = spark.createDataFrame([(c.source, c.lang, c.topic, float(w)) for c, w in zip(cells, weight)], "source string, lang string, topic string, weight double")
    buckets = max(1, max((c.n for c in cells), default=0) // 20_000)
    chosen = _draw(sized.join(F.broadcast(weights), ["source", "lang", "topic"]), live, wanted, cap, seed, buckets)
    amount = F.sum(F.col("tokens") * F.col("repeats"))
    taken = chosen.groupBy("source").agg(F.count("*").alias("documents"), amount.alias("taken_tokens"), F.sum("repeats").alias("rows"), F.max("repeats").alias("most"))
    plan = spark.createDataFrame([(g.source, g.target_share, int(g.max_repeats), float(share[live.index(g.source)]) if g.source in live else 0.0, int(have[0][live.index(g.source)]) if g.source in live else 0) for g in goals], "source string, target_share double, max_repeats int, reachable_share double, available_tokens long")
    total = chosen.agg(amount.alias("t")).first().t or 0
    none = lambda c: F.coalesce(c, F.lit(0))
    shares = plan.join(taken, "source", "left").select("source", "target_share", "reachable_share", none("documents").alias("documents"), "available_tokens", none("taken_tokens").alias("taken_tokens"), (none("taken_tokens") / F.lit(max(total, 1))).alias("actual_share"), (none("taken_tokens") / F.greatest("available_tokens", F.lit(1))).alias("mean_repeats"), none("most").alias("most_repeats"), "max_repeats")
    kinds = list(zip(("source", "lang", "topic"), names, labels, asked))
    fitted = [(k, n, float(g), float(f)) for k, ns, x, gs in kinds for n, g, f in zip(ns, gs, np.bincount(x, weight * tokens, len(ns)) / max(wanted.sum(), 1e-300))]
    by_cell = chosen.groupBy("source", "lang", "topic").agg(amount.alias("t"))
    each = by_cell.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name"), "t") for k, *_ in kinds))).alias("k"))
    got = each.groupBy("k.kind", "k.name").agg(F.sum("k.t").alias("t"))
    marginals = spark.createDataFrame(fitted, "kind string, name string, target_share double, fitted_share double").join(got, ["kind", "name"], "left").withColumn("actual_share", none("t") / F.lit(max(total, 1))).drop("t")
    return chosen, shares, marginals


# shares of a source's tokens from which a document belongs to the first, second, ... draw
_DRAWS = (0.02, 0.002, 0.0002)


def _draw(rows: DataFrame, names: list[str], wanted: np.ndarray, cap: np.ndarray, seed: int, buckets: int) -> DataFrame:
    """The chosen documents, drawn from the largest to the smallest; after each draw the weights of a source's
    remaining documents are scaled to what it still lacks."""
    spark = rows.sparkSession
    draws = len(_DRAWS) + 1

    def plan(values: np.ndarray, name: str) -> DataFrame:
        return spark.createDataFrame([(s, float(w), float(c), float(v)) for s, w, c, v in zip(names, wanted, cap, values)], f"source string, wanted double, cap double, {name} double")

    share = F.col("tokens") / F.col("wanted")
    number = sum(((share < x).cast("int") for x in _DRAWS), F.lit(0))
    ranked = rows.join(F.broadcast(plan(np.ones(len(names)), "one")), "source").withColumn("draw", number)
    due = np.zeros((len(names), draws))
    for r in ranked.groupBy("source", "draw").agg(F.sum(F.col("weight") * F.col("tokens")).alias("t")).collect():
        due[names.index(r.source), r.draw] = r.t
    scale, taken, parts = np.ones(len(names)), np.zeros(len(names)), []
    columns = [*rows.columns, "draw"]
    for i in range(draws):
        if due[:, i].any():
            here = ranked.select(*columns).where(F.col("draw") == i).join(F.broadcast(plan(scale, "scale")), "source")
            part = materialize(_systematic(here.withColumn("weight", F.least(F.col("weight") * F.col("scale"), F.col("cap"))).select(*rows.columns), seed, buckets), "chosen")
            for r in part.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect():
                taken[names.index(r.source)] += r.t
            parts.append(part)
        rest = due[:, i + 1 :].sum(1)
        scale = np.maximum(np.divide(wanted - taken, rest, out=np.ones(len(names)), where=rest > 0), 0)
    chosen = parts[0] if parts else _systematic(rows, seed, buckets)
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    return chosen


def _systematic(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """rows with repeats: the weight's floor, and one more wherever the running total of the weights' fractions passes
    a whole number; zero repeats are left out.

    A source's documents stand in line by size class, cell and hash, so that the chosen ones have all sizes in
    proportion. Fractions are whole millionths, so sums don't depend on their order.
    """
    unit = 1_000_000
    mass = F.round(F.col("weight") * unit).cast("long")
    rows = rows.withColumn("whole", F.floor(mass / unit).cast("long")).withColumn("rest", mass % unit)
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("grade", F.floor(F.log2("tokens") * 4).cast("int")).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    # the number of stretches is bounded by cells * size classes * buckets, whatever the number of documents
    line = ["grade", "lang", "topic", "bucket"]
    sums = rows.groupBy("source", *line).agg(F.sum("rest").alias("sum"))
    before = Window.partitionBy("source").orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", *line, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", *line).orderBy("tokens", "order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(unit))
    run = F.col("base") + start + F.sum("rest").over(within)
    joined = rows.join(offsets, ["source", *line])
    repeats = F.col("whole") + F.floor(run / unit) - F.floor((run - F.col("rest")) / unit)
    return joined.withColumn("repeats", repeats.cast("int")).where("repeats > 0").select("doc_id", "source", "lang", "topic", "tokens", "repeats")
