"""Words of a text as the overlap operators compare them, and 64-bit hashes of word runs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import xxhash

from docloom.llm.transducer import one_form

_WORD = re.compile(r"\w+")
_WORD_OR_MARK = re.compile(r"[\w\u0300-\u036f]+")
_STROKE = str.maketrans("đĐ", "dD")
_MEMO_SIZE = 200_000

class _Memo(dict):
    """What a function gave for short words; bounded, and looked up without a call where it is known."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, word: str):
        known = self.function(word)
        if len(word) < 40:
            if len(self) >= _MEMO_SIZE:
                self.clear()
            self[word] = known
        return known


def _bare(word: str) -> str:
    parts = unicodedata.normalize("NFD", word.translate(_STROKE))
    return "".join(c for c in parts if not unicodedata.combining(c))


_folded = _Memo(_bare)
_hashes = _Memo(xxhash.xxh3_64_intdigest)


def fold(word: str) -> str:
    """A lower-case word without accents (đ as d)."""
    return _folded[word]


def folded_words(text: str) -> list[str]:
    """The words of a text in one form: lower case, accents removed, runs of letters, numbers and underscores."""
    lowered = one_form(text).lower()
    if lowered.isascii():
        return _WORD.findall(lowered)
    return list(filter(None, map(_folded.__getitem__, _WORD_OR_MARK.findall(lowered))))


def accented_terms(text: str) -> list[str]:
    """The same runs with their accents."""
    return _WORD.findall(one_form(text).lower())


def word_hash(word: str) -> int:
    """64 bits of a word."""
    return _hashes[word]


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes of a list of words, as uint64."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of uint64 values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of ``k`` consecutive values: a polynomial in a fixed base, as a rolling hash has it."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mixed(out)
