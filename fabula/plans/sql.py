"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations

SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
QUOTED = r"""\x22[^\x22]*[a-z][^\x22]*\x22|(?:^|[""" + SPACE + r"""])''[a-z][^''\n]{2,}[,.!?]''(?:[""" + SPACE + r"""]|$)"""


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def normalize(t: str) -> str:
    return rf"""trim(regexp_replace(translate(lower({t}), '“”‘’', '""'''''), '[{SPACE}]+', ' ', 'g'), ' ')"""


def words(t: str) -> str:
    return f"regexp_extract_all({normalize(t)}, '[a-z]+')"


def grams(w: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: {w}[i:i + {n - 1}])"


def filled(items: str) -> str:
    return f"coalesce(list_filter({items}, lambda x: x IS NOT NULL AND x <> ''), [])"


def sentence_in(t: str, s: str) -> str:
    return rf"contains({normalize(t)}, regexp_replace({normalize(s)}, '[.!?]+$', ''))"


def has_word(w: str, normal: str, tokens: str, forms: str) -> str:
    """w: the lower-cased word, forms: SQL of its forms. RE2 knows no look-around, so the neighbours are matched."""
    special = rf"regexp_replace({w}, '([!-/:-@\[-`{{-~])', '\\\1', 'g')"
    return rf"CASE WHEN regexp_matches({w}, '^[a-z]+$') THEN len(list_intersect({forms}, {tokens})) > 0 ELSE regexp_matches({normal}, '(^|[^a-z])' || {special} || '(s|es|ed|d|ing)?($|[^a-z])') END"
