"""Text functions as Column expressions; all stay in the JVM.

A null text gives null unless a function says otherwise; an empty text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.split and str.strip know it; Java's \s and Spark's trim know less.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# fixed value: double-quoted text, or single-quoted speech between a word start and a punctuation mark
QUOTED = r"""\x22[^\x22]*[a-z][^\x22]*\x22|(?:^|[""" + SPACE + r"""])'[a-z][^'\n]{2,}[,.!?]'(?:[""" + SPACE + r"""]|$)"""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with the value computed once, however often (or inside whichever lambda) it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(text), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize(text: Column | str) -> Column:
    """Lower case, straight quotes, white space collapsed to single spaces and removed at the ends."""
    plain = F.translate(F.lower(_col(text)), "“”‘’", "\"\"''")
    return F.trim(F.regexp_replace(plain, rf"[{SPACE}]+", " "))


def words(text: Column | str) -> Column:
    """The runs of ASCII letters of the normalized text."""
    return F.regexp_extract_all(normalize(text), F.lit("([a-z]+)"), 1)


def grams(tokens: Column | str, n: int, joined: bool = False) -> Column:
    """All runs of n successive entries of an array, as arrays or joined by spaces; none if there are fewer."""

    def of(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " ") if joined else F.slice(t, i, n))

    return let(_col(tokens), of)


def gram_hashes(tokens: Column | str, n: int) -> Column:
    """64-bit hashes of all runs of n successive entries of an array; none if there are fewer."""

    def of(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(n))))

    return let(_col(tokens), of)


def repetition(text: Column | str, n: int = 4) -> Column:
    """Share of the text's word n-grams that repeat an earlier one; 0 if it has fewer than n words, null for null."""
    share = lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g))
    return F.when(_col(text).isNotNull(), let(gram_hashes(words(text), n), share))


def has_quoted_speech(text: Column | str) -> Column:
    return normalize(text).rlike(QUOTED)


def contains_sentence(text: Column | str, sentence: Column | str) -> Column:
    """The normalized sentence, without its final stops, stands in the normalized text."""
    return normalize(text).contains(F.regexp_replace(normalize(sentence), r"[.!?]+\z", ""))


def sentence_starts(sentence: Column | str, text: Column | str, n: int = 4) -> Column:
    """How often the text begins the sentence: places of its first n words; null if it has fewer."""
    head = F.slice(words(sentence), 1, n)
    hashed = F.when(F.size(head) == n, F.xxhash64(*(F.get(head, F.lit(k)) for k in range(n))))
    return let(hashed, lambda h: F.when(h.isNotNull(), F.size(F.filter(gram_hashes(words(text), n), lambda g: g == h))))


def filled(items: Column | str) -> Column:
    """An array without null and empty entries; an empty array for null."""
    return F.coalesce(F.filter(_col(items), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def render_prompt(summary="summary", word_list="words", features="features", sentence="sentence") -> Column:
    """The labelled fields in fixed order, empty ones left out, ending where the story begins."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(label + " "), value))
    listed = lambda c: F.array_join(filled(c), ", ")
    return F.concat_ws(
        "\n",
        line("Summary:", _col(summary)),
        line("Words:", listed(word_list)),
        line("Features:", listed(features)),
        line("Random sentence:", _col(sentence)),
        F.lit("Story:\n"),
    )


def verifiable(word_list="words", features="features", sentence="sentence") -> Column:
    """The record has a constraint that can be checked: words, a sentence or dialogue."""
    return (F.size(filled(word_list)) > 0) | (F.coalesce(_col(sentence), F.lit("")) != "") | F.coalesce(F.array_contains(_col(features), "Dialogue"), F.lit(False))


def parse_record(text: Column | str) -> Column:
    """A struct of summary, words, features, sentence, story from labelled lines in any order.

    A repeated label overwrites its field, a repeated story label starts the story again, lines without a label
    belong to the story while it is the current field and are ignored otherwise. Null without a story.
    """
    lines = F.split(F.regexp_replace(_col(text), r"\r\n|[\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", "\n"), "\n")
    labels = {"Summary:": "summary", "Words:": "words", "Features:": "features", "Random sentence:": "sentence", "Story:": "story"}
    empty = F.struct(
        F.lit("").alias("now"),
        *(F.lit(None).cast("string").alias(f) for f in ("summary", "words", "features", "sentence")),
        F.array().cast("array<string>").alias("story"),
    )

    def step(state: Column, line: Column) -> Column:
        label = F.lit(None).cast("string")
        value = line
        for key, name in labels.items():
            hit = line.startswith(key)
            label = F.when(hit, name).otherwise(label)
            value = F.when(hit, strip(F.substr(line, F.lit(len(key) + 1)))).otherwise(value)
        now = F.coalesce(label, state["now"])
        keep = lambda f: F.when(label == f, value).otherwise(state[f]).alias(f)
        story = F.when(label == "story", F.when(value != "", F.array(value)).otherwise(F.array().cast("array<string>"))).when(label.isNull() & (now == "story"), F.concat(state["story"], F.array(line))).otherwise(state["story"])
        return F.struct(now.alias("now"), keep("summary"), keep("words"), keep("features"), keep("sentence"), story.alias("story"))

    def finish(state: Column) -> Column:
        listed = lambda v: F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), ","), strip), lambda x: x != "")
        story = strip(F.array_join(state["story"], "\n"))
        blank = lambda v: F.when(v != "", v)
        record = F.struct(blank(state["summary"]).alias("summary"), listed(state["words"]).alias("words"), listed(state["features"]).alias("features"), blank(state["sentence"]).alias("sentence"), story.alias("story"))
        return F.when(story != "", record)

    return F.aggregate(lines, empty, step, finish)


def short_size(n: Column | str) -> Column:
    """A count with an SI prefix and one decimal: 950, 1.5k, 2.0M, 3.1G."""
    n = _col(n)
    short = lambda unit, sign: F.format_string(f"%.1f{sign}", n / unit)
    return F.when(n >= 1e9, short(1e9, "G")).when(n >= 1e6, short(1e6, "M")).when(n >= 1e3, short(1e3, "k")).otherwise(n.cast("string"))
