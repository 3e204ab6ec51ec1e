"""Words of a text and their hashes, for Arrow-batched Python stages.

The words of a text: NFKC form, format characters (Cf) removed, lower-cased, then the maximal runs of letters
and digits. A null or empty text has no words.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import xxhash

_ASCII = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))
_FORMAT = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")
_RUN = re.compile(r"[^\W_]+")  # \w without the underscore: letters and numbers
_U = np.uint64


def fold(text: str) -> str:
    """NFKC, without format characters, in lower case."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if not _FORMAT.isdisjoint(text):
        text = "".join(c for c in text if c not in _FORMAT)
    return text.lower()


def split_words(text: str | None) -> list[str]:
    """The words of a text."""
    if not text:
        return []
    if text.isascii():
        return text.translate(_ASCII).split()
    return _RUN.findall(fold(text))


class _Hashes(dict):
    """64-bit hashes of words, kept for reuse up to a bounded number."""

    LIMIT = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def hash_words(words: list[str]) -> np.ndarray:
    """uint64 hashes of words."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting (np.unique hashes, which is slower here)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` successive word hashes; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, size):
        total = total * _U(0x9E3779B97F4A7C15) + hashes[i : n + i]
    return mix(total)


def flat_shingles(texts: list[str | None], size: int, bits: int = 48, counted: bool = False) -> tuple[np.ndarray, ...]:
    """(document number, shingle hash of `bits` bits) of every distinct shingle, sorted by both; counted: and how often
    it stands in the document.

    At most 2**(64 - bits) texts at a time.
    """
    parts, lengths = [], []
    for text in texts:
        words = split_words(text)
        parts.extend(words)
        lengths.append(len(words))
    hashes = shingle_hashes(hash_words(parts), size)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(hashes)]
    docs = np.repeat(np.arange(len(lengths)), lengths)[: len(hashes)]
    inside = np.arange(len(hashes)) + size <= ends
    packed = np.sort((docs[inside].astype(np.uint64) << _U(bits)) | (hashes[inside] >> _U(64 - bits)))
    first = np.nonzero(np.append(True, packed[1:] != packed[:-1])[: len(packed)])[0]
    one = packed[first]
    found = (one >> _U(bits)).astype(np.int64), one & _U((1 << bits) - 1)
    return (*found, np.diff(np.append(first, len(packed)))) if counted else found


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two arrays of distinct hashes; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
