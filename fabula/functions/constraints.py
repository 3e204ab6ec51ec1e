"""Checks of a story against the constraints of its prompt, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import text
from fabula.functions.inflection import forms

_PLAIN = r"^[a-z]+\z"


def with_forms(df: DataFrame, words: str = "words", into: str = "forms") -> DataFrame:
    """df with the forms of its required words (an array for each word): made once for each distinct list of words."""
    lists = df.select(words).distinct().select(F.col(words).alias("__words"), F.transform(text.filled(words), forms).alias(into))
    return df.join(lists, F.col(words).eqNullSafe(F.col("__words"))).drop("__words")


def has_word(word: Column, normal: Column, tokens: Column, spellings: Column | None = None) -> Column:
    """The word or an inflection of it stands as a whole word. A word with other characters than letters is looked
    for in the normalized text itself, with an optional regular ending. spellings: the word's forms, if they are there."""
    spellings = forms(word) if spellings is None else spellings
    quoted = F.concat(F.lit(r"(?<![a-z])\Q"), F.replace(F.lower(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?:s|es|ed|d|ing)?(?![a-z])"))
    return F.when(F.lower(word).rlike(_PLAIN), F.arrays_overlap(spellings, tokens)).otherwise(F.regexp_like(normal, quoted))


def word_mentions(words: Column | str, story: Column | str, spellings: Column | str | None = None) -> Column:
    """Mean number of mentions, in any form, of the required words that are plain words; null if there are none."""
    spellings = F.transform(text.filled(words), forms) if spellings is None else F.col(spellings) if isinstance(spellings, str) else spellings
    plain = F.filter(F.arrays_zip(text.filled(words).alias("w"), spellings.alias("f")), lambda x: F.lower(x["w"]).rlike(_PLAIN))
    each = lambda tokens: F.transform(plain, lambda x: F.size(F.filter(tokens, lambda t: F.array_contains(x["f"], t))))
    total = lambda counts: F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0), lambda a, x: a + x) / F.size(counts))
    return text.let(text.let(text.words(story), each), total)


def check(words: Column | str, features: Column | str, sentence: Column | str, story: Column | str, spellings: Column | str | None = None) -> Column:
    """A struct of the constraints' results; those that don't apply are null.

    words_hits, words_fraction, sentence, dialogue, reward (mean of the parts that apply), satisfied (there is a part,
    and all are 1). A null story counts as an empty one. spellings: as with_forms gives them.
    """
    spellings = F.col(spellings) if isinstance(spellings, str) else spellings
    story = F.coalesce(F.col(story) if isinstance(story, str) else story, F.lit(""))
    sentence = F.col(sentence) if isinstance(sentence, str) else sentence
    required = text.filled(words)
    wanted = F.regexp_replace(text.normalize(sentence), r"[.!?]+\z", "")
    spoken = F.array_contains(F.col(features) if isinstance(features, str) else features, "Dialogue")

    def results(n: Column) -> Column:
        one = lambda w, t, f=None: F.coalesce(has_word(w, n, t, f), F.lit(False))
        marks = lambda t: F.transform(required, lambda w: one(w, t)) if spellings is None else F.zip_with(required, spellings, lambda w, f: one(w, t, f))
        hits = F.when(F.size(required) > 0, text.let(F.array_distinct(F.regexp_extract_all(n, F.lit("([a-z]+)"), 1)), marks))
        return text.let(hits, lambda h: check_struct(required, h, F.when(sentence != "", n.contains(wanted)), F.when(spoken, n.rlike(text.QUOTED))))

    return text.let(text.normalize(story), results)


def check_struct(required: Column, hits: Column, sentence: Column, dialogue: Column) -> Column:
    fraction = F.when(F.size(required) > 0, F.size(F.filter(hits, lambda h: h)) / F.size(hits))
    scores = F.filter(F.array(fraction, sentence.cast("double"), dialogue.cast("double")), lambda x: x.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        hits.alias("words_hits"),
        fraction.alias("words_fraction"),
        sentence.alias("sentence"),
        dialogue.alias("dialogue"),
        F.when(F.size(scores) > 0, total / F.size(scores)).alias("reward"),
        ((F.size(scores) > 0) & F.forall(scores, lambda x: x == 1.0)).alias("satisfied"),
    )


def score(result: Column, finished: Column) -> Column:
    """The reward of a rollout: that of its check, 0 if it never ended (a null flag counts as ended)."""
    return F.when(~F.coalesce(finished, F.lit(True)), F.lit(0.0)).otherwise(result["reward"])


def verdict(words: Column, result: Column, finished: Column) -> Column:
    """One line of Markdown with every constraint's mark and the reward."""
    # fixed values: the wording of the line
    mark = lambda hit, yes, no: F.when(hit, yes).otherwise(no)
    listed = F.array_join(F.zip_with(result["words_hits"], text.filled(words), lambda h, w: F.concat(mark(h, "✓", "✗"), F.lit(" "), w)), ", ")
    parts = F.concat_ws(
        " · ",
        F.when(result["words_hits"].isNotNull(), F.concat(F.lit("**Words:** "), listed)),
        F.when(result["sentence"].isNotNull(), F.concat(F.lit("**Sentence:** "), mark(result["sentence"], "✓ included", "✗ missing"))),
        F.when(result["dialogue"].isNotNull(), F.concat(F.lit("**Dialogue:** "), mark(result["dialogue"], "✓ present", "✗ missing"))),
    )
    ending = F.when(F.coalesce(finished, F.lit(True)), "").otherwise(" (the story did not finish)")
    full = F.concat(parts, F.lit(" · **Reward:** "), F.format_string("%.2f", result["reward"]), ending)
    return F.when(parts == "", "No checkable instruction: add required words, a sentence, or Dialogue.").otherwise(full)
