"""Per-document features of a slice of texts, computed on the joined buffer without a loop over words."""

from __future__ import annotations

import numpy as np

from . import kernels as K

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Slice:
    """Texts of one Arrow slice with their words."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf, self.begins = K.join(texts)
        self.starts, self.ends = K.spans(self.buf)
        self.doc = K.doc_of(self.starts, self.begins)
        self.words = np.bincount(self.doc, minlength=self.n)[: self.n]
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each text."""
        return np.add.reduceat(flags, self.begins[:-1], dtype=np.int64)

    def per_words(self, values: np.ndarray, dtype=np.float64) -> np.ndarray:
        """Sum of a value per word, for each text."""
        return np.bincount(self.doc, weights=values, minlength=self.n)[: self.n].astype(dtype)

    def code_points(self) -> np.ndarray:
        return self.per_doc((self.buf & 0xC0) != 0x80) - 1

    def word_code_points(self) -> np.ndarray:
        return self.per_doc(((self.buf & 0xC0) != 0x80) & ~K._SPACE[self.buf])

    def symbols(self) -> np.ndarray:
        return self.per_doc(_SYMBOL[self.buf])

    def hashes(self, lower: bool = False) -> np.ndarray:
        return K.word_hashes(self.buf, self.starts, self.ends, lower)

    def repeated_words(self, hashes: np.ndarray, n: int = 3) -> np.ndarray:
        """Words of each text that stand in an n-word window which the text holds twice or more."""
        grams = K.ngrams(hashes, n)
        where = np.flatnonzero(self.doc[: len(grams)] == self.doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        keys = K.mix(grams[where] + self.doc[where].astype(K.U) * K.U(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        twin = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        covered = np.zeros(len(hashes) + n, bool)
        at = where[order[twin]]
        for k in range(n):
            covered[at + k] = True
        return self.per_words(covered[: len(hashes)], np.int64)


NAMES = (
    "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "bang_share", "short_words",
    "distinct_words", "repeated_words", "words_per_line", "symbol_words", "bare_punct_words", "long_words", "non_ascii_share", "stop_rate",
)


def matrix(texts: list[bytes]) -> np.ndarray:
    """One row of :data:`NAMES` for each text; a text without words has zeros."""
    s = Slice(texts)
    h = s.hashes(lower=True)
    words = np.maximum(s.words, 1)
    chars = np.maximum(s.word_code_points(), 1)
    length = s.ends - s.starts
    last = s.buf[s.ends - 1] if len(h) else np.zeros(0, np.uint8)
    has_symbol = np.add.reduceat(_SYMBOL[s.buf], s.starts, dtype=np.int64) > 0 if len(h) else np.zeros(0, bool)
    has_letter = np.add.reduceat(_LETTER[s.buf] | _DIGIT[s.buf], s.starts, dtype=np.int64) > 0 if len(h) else np.zeros(0, bool)
    # distinct (text, word) pairs: count them per text through the sorted word keys
    pair = np.lexsort((h, s.doc))
    new = np.ones(len(h), bool)
    if len(h) > 1:
        a, b = pair[1:], pair[:-1]
        new[1:] = (h[a] != h[b]) | (s.doc[a] != s.doc[b])
    distinct = np.bincount(s.doc[pair], weights=new, minlength=s.n)[: s.n] if len(h) else np.zeros(s.n)
    return np.column_stack([
        np.log1p(s.words),
        chars / words * (s.words > 0),
        s.symbols() / chars,
        s.per_doc(_UPPER[s.buf]) / np.maximum(s.per_doc(_LETTER[s.buf]), 1),
        s.per_doc(_DIGIT[s.buf]) / chars,
        s.per_doc(_PUNCT[s.buf]) / chars,
        s.per_doc(s.buf == 33) / words,
        s.per_words(length <= 3) / words,
        distinct / words,
        s.repeated_words(h) / words,
        words / np.maximum(s.per_doc(s.buf == 10), 1),
        s.per_words(has_symbol) / words,
        s.per_words(~has_letter) / words,
        s.per_words(length >= 16) / words,
        s.per_doc(s.buf >= 128) / chars,
        s.per_words((last == 46) | (last == 63) | (last == 33)) / words,
    ])
