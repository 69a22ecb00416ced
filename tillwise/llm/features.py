"""Per-text counts behind the quality operators, computed on whole slices."""

from __future__ import annotations

import numpy as np

from tillwise.llm import text as tx

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
END_MARK = np.zeros(256, bool)
END_MARK[[ord(c) for c in ".?!"]] = True
#: Leading bytes of UTF-8 characters: each counts one code point.
LEAD = np.ones(256, bool)
LEAD[128:192] = False


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def span_counts(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = _sums(mask)
    return sums[end] - sums[start]


def repeated_words(words: tx.Words, width: int = 3) -> np.ndarray:
    """Per text: words inside windows of ``width`` words that the text holds
    twice or more, the first occurrence included."""
    n = len(words.hash)
    number = np.maximum(words.counts - width + 1, 0)
    at = tx.ragged(np.arange(n + 1), words.first[:-1], number)
    if not len(at):
        return np.zeros(len(words.counts), np.int64)
    window = words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        window += words.hash[at + k] * (tx.mix(np.full(1, k + 1, np.uint64)) | np.uint64(1))
    _, inverse, count = np.unique(tx.mix(window), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    marked = np.zeros(n, bool)
    for k in range(width):
        marked[twice + k] = True
    return tx.per_doc(marked, words.first)


class Lines:
    """Lines of the texts of a slice, split at LF (k line feeds: k + 1 lines)."""

    def __init__(self, words: tx.Words):
        data, offsets = words.data, words.offsets
        feeds = np.flatnonzero(data == 10)
        texts = len(offsets) - 1
        per_text = np.diff(np.searchsorted(feeds, offsets))
        self.first = np.concatenate([[0], np.cumsum(per_text + 1)])
        total = int(self.first[-1])
        self.doc = np.repeat(np.arange(texts), per_text + 1)
        is_first = np.zeros(total, bool)
        is_first[self.first[:-1]] = True
        is_last = np.zeros(total, bool)
        is_last[self.first[1:] - 1] = True
        self.start = np.empty(total, np.int64)
        self.start[is_first] = offsets[:-1]
        self.start[~is_first] = feeds + 1
        self.end = np.empty(total, np.int64)
        self.end[is_last] = offsets[1:]
        self.end[~is_last] = feeds
        self.word = np.searchsorted(words.start, self.start)  # first word at or after the line's start
        self.word_end = np.searchsorted(words.start, self.end)
        self.n_words = self.word_end - self.word
        self.hash = np.zeros(total, np.uint64)
        at = 0
        while at < total:
            stop = max(at + 1, int(np.searchsorted(self.start, self.start[at] + tx.PIECE_BYTES)))
            low, high = self.start[at], self.end[stop - 1]
            self.hash[at:stop] = tx.span_hashes(tx._BYTE_CODE[data[low:high]], self.start[at:stop] - low, self.end[at:stop] - low)
            at = stop

    def repeats(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        key = tx.mix(self.hash + self.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        same[order[1:]] = key[order[1:]] == key[order[:-1]]
        return same & (self.n_words > 0)


FEATURES = (
    "log_words",
    "word_length",
    "symbol_words",
    "symbol_share",
    "upper_share",
    "digit_share",
    "distinct_share",
    "repeat_share",
    "line_repeat_share",
    "words_per_line",
    "marks_per_word",
    "bang_share",
    "short_word_share",
    "top_word_share",
)


def document_features(words: tx.Words) -> np.ndarray:
    """(texts, features). A text without words has zeros."""
    data, first = words.data, words.first
    texts = len(first) - 1
    n = words.counts
    safe = np.maximum(n, 1)
    chars = span_counts(LEAD[data], words.start, words.end)
    word_chars = np.maximum(tx.per_doc(chars, first), 1)
    in_doc = lambda mask: np.diff(_sums(mask)[words.offsets])
    symbols = span_counts(SYMBOL[data], words.start, words.end)
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    keyed = tx.mix(words.hash + words.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at, count = np.unique(keyed, return_index=True, return_counts=True)
    owner = words.doc[at]
    distinct = np.bincount(owner, minlength=texts)
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, owner, count)
    lines = Lines(words)
    line_count = np.maximum(tx.per_doc(lines.n_words > 0, lines.first), 1)
    columns = [
        np.log1p(n),
        word_chars / safe,
        tx.per_doc(symbols > 0, first) / safe,
        tx.per_doc(symbols, first) / word_chars,
        in_doc(UPPER[data]) / word_chars,
        in_doc(DIGIT[data]) / word_chars,
        distinct / safe,
        repeated_words(words) / safe,
        tx.per_doc(lines.repeats(), lines.first) / line_count,
        np.log1p(n / line_count),
        tx.per_doc(END_MARK[last], first) / safe,
        in_doc(data == 33) / safe,
        tx.per_doc(chars <= 2, first) / safe,
        top / safe,
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[n == 0] = 0
    return out
