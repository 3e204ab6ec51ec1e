"""A compressed full-text index of word sequences: Burrows-Wheeler transform, backward search, document array.

Rows are the suffixes of all documents in order; each document is followed by an end, the smallest symbol. What is
stored is the transform alone (the symbol before each row), as compressed bytes with the vocabulary and the lengths of
the documents: a byte or two a word. Loaded, the index holds for each symbol the rows that it precedes, one ascending
list of 32-bit numbers, of which every 16th entry is a sample that a search begins at. A step of backward search from a
range of rows to the range of those with one more word in front is a rank in that list; it is made for a whole batch of
patterns at once. The documents of the rows and the text are won back by walking all documents from their ends.
"""

from __future__ import annotations

import numpy as np
import zstandard

_EVERY = 16


class FMIndex:
    """Index of documents given as arrays of word hashes. No match crosses a document's end."""

    def __init__(self, documents: list[np.ndarray]):
        lengths = np.array([len(d) for d in documents], np.int64)
        words = np.concatenate(documents) if len(documents) else np.empty(0, np.uint64)
        vocabulary, ids = np.unique(words, return_inverse=True)
        n = len(words) + len(documents)
        start = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[start + lengths] = False
        text[inside] = ids + 1
        self._open(vocabulary, lengths, text[suffix_order(text) - 1].astype(np.int32))  # the text is a ring

    def _open(self, vocabulary: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> None:
        self.vocabulary, self.length, self.before, self.n = vocabulary, lengths, before, len(before)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        # `first[s]`: the first row that begins with symbol s, which is also where the list of its rows begins
        self.first = np.zeros(len(vocabulary) + 2, np.int64)
        np.cumsum(np.bincount(before, minlength=len(vocabulary) + 1), out=self.first[1:])
        self.rows = np.argsort(before, kind="stable").astype(np.int32)
        sampled = self.rows[::_EVERY]
        self.samples = before[sampled].astype(np.int64) * self.n + sampled
        # the rows that begin with each pair of words, by which the first step of a search is looked up: in the order of
        # `rows`, which is that of the rows one word further to the left, they lie together
        starts = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        pair = before[self.rows].astype(np.int64) * len(self.first) + starts[self.rows]
        new = np.nonzero(np.append(True, pair[1:] != pair[:-1])[: self.n])[0]
        self.pairs, self.pair_rows = pair[new], np.append(new, self.n)
        self._unroll()

    def _unroll(self) -> None:
        """The text, and the document of each row, by walking all documents back from their ends at once."""
        back = np.empty(self.n, np.int32)
        back[self.rows] = np.arange(self.n, dtype=np.int32)
        self.text, self.owner = np.zeros(self.n, np.int32), np.empty(self.n, np.int32)
        doc = np.argsort(-self.length, kind="stable")
        row = doc.copy()  # the ends are ordered by their places
        left = self.length[doc]
        self.owner[row] = doc
        while len(doc := doc[: (n := np.searchsorted(-left, 0))]):  # documents with words left come first
            row, left = row[:n], left[:n] - 1
            self.text[self.start[doc] + left] = self.before[row]
            row = back[row]
            self.owner[row] = doc

    def dump(self) -> bytes:
        """The stored form."""
        head = np.array([len(self.vocabulary), len(self.length), self.n], np.int64).tobytes()
        planes = np.ascontiguousarray(self.before.view(np.uint8).reshape(-1, 4).T).tobytes()  # small bytes beside small bytes
        body = self.vocabulary.tobytes() + self.length.astype(np.int64).tobytes() + planes
        return head + zstandard.ZstdCompressor(level=3).compress(body)

    @classmethod
    def load(cls, raw: bytes) -> FMIndex:
        words, documents, n = np.frombuffer(raw[:24], np.int64).tolist()
        body = zstandard.ZstdDecompressor().decompress(raw[24:], max_output_size=max(1, 8 * words + 8 * documents + 4 * n))
        index = cls.__new__(cls)
        planes = np.frombuffer(body, np.uint8, offset=8 * (words + documents)).reshape(4, n)
        before = np.ascontiguousarray(planes.T).view(np.int32).ravel()
        index._open(np.frombuffer(body, np.uint64, words), np.frombuffer(body, np.int64, documents, 8 * words), before)
        return index

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; -1 for words that no document has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def _rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row of the first suffix that is `symbol` before a suffix from `row` on."""
        block = np.searchsorted(self.samples, symbol * self.n + row)
        low = np.maximum(np.maximum(block - 1, 0) * _EVERY, self.first[symbol])
        high = np.minimum(block * _EVERY, self.first[symbol + 1])
        while len(wide := np.nonzero(low < high)[0]):
            middle = (low[wide] + high[wide]) >> 1
            less = self.rows[middle] < row[wide]
            low[wide] = np.where(less, middle + 1, low[wide])
            high[wide] = np.where(less, high[wide], middle)
        return low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, past the last) row of the suffixes that begin with each pattern; patterns: symbols (m, k)."""
        m, k = patterns.shape
        low, high = np.zeros(m, np.int64), np.zeros(m, np.int64)
        live = np.nonzero((patterns > 0).all(1))[0]
        last = patterns[live, k - 1]
        if k == 1:
            a, b = self.first[last], self.first[last + 1]
        else:
            key = patterns[live, k - 2] * len(self.first) + last
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            some = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
            live, at = live[some], at[some]
            a, b = self.pair_rows[at], self.pair_rows[at + 1]
        for i in range(k - 3, -1, -1):
            symbol = patterns[live, i]
            a, b = self._rank(symbol, a), self._rank(symbol, b)
            some = b > a
            live, a, b = live[some], a[some], b[some]
        low[live], high[live] = a, b
        return low, high

    def document(self, i: int) -> np.ndarray:
        """The word hashes of a document."""
        return self.vocabulary[self.text[self.start[i] : self.start[i] + self.length[i]] - 1]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; ends (0) are ordered by their places, so every suffix is unique.

    The first order is that of as many symbols as fit into 62 bits; where an end is among these, place decides.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    bits = max(1, int(text.max()).bit_length())
    step = 62 // bits
    head, open_end = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(step):
        symbol = np.where(open_end, np.roll(text, -i), 0)
        head = head << bits | symbol
        open_end &= symbol > 0
    tie = np.where(open_end, 0, np.arange(1, n + 1))
    order = np.lexsort((tie, head))
    ordered, tie = head[order], tie[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]) | (tie[1:] != tie[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.nonzero(new)[0][np.cumsum(new) - 1]
    rows = np.nonzero(~(new & np.append(new[1:], True)))[0]  # rows that share their rank with others
    while len(rows):
        suffix = order[rows]
        head, tail = rank[suffix], rank[(suffix + step) % n]
        by = np.lexsort((tail, head))
        suffix, head, tail = suffix[by], head[by], tail[by]
        order[rows] = suffix
        new = np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))
        rank[suffix] = rows[np.nonzero(new)[0]][np.cumsum(new) - 1]
        rows = rows[~(new & np.append(new[1:], True))]
        step *= 2
    return order
