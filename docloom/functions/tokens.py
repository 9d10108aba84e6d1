"""Tokenizers as column expressions: a configuration compiles to one expression that stays in generated code."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import EDGE_PUNCTUATION, WORD, fold_tones, nfc, words

BUILT_IN = ("regex", "whitespace", "syllable_bigram")
SEGMENTERS = ("pyvi", "underthesea")


def available() -> dict[str, bool]:
    """Which tokenizers can be used here; segmenters need their library on every executor."""
    return {n: True for n in BUILT_IN} | {n: importlib.util.find_spec(n) is not None for n in SEGMENTERS}


@dataclass(frozen=True)
class Tokenizer:
    """``regex``: runs of letters, digits and underscores. ``whitespace``: words without punctuation at their ends.
    ``syllable_bigram``: by segments free of punctuation, their syllables and pairs of neighbours."""

    name: str = "regex"
    lowercase: bool = True
    fold_tone: bool = True
    min_len: int = 1
    keep_syllables: bool = True

    def __post_init__(self):
        if self.name not in BUILT_IN + SEGMENTERS:
            raise ValueError(f"unknown tokenizer {self.name!r}")
        if self.min_len < 1:
            raise ValueError("min_len is at least 1")

    @property
    def key(self) -> str:
        parts = [self.name, "" if self.lowercase else "nolower", "" if self.fold_tone else "notonefold"]
        parts += [f"minlen{self.min_len}" if self.min_len > 1 else "", "bigramonly" if self.name == "syllable_bigram" and not self.keep_syllables else ""]
        return "-".join(p for p in parts if p)

    def with_options(self, **options) -> Tokenizer:
        return replace(self, **options)

    def __call__(self, text: Column) -> Column:
        """The tokens of ``text`` in order; an empty array for null and empty text."""
        text = nfc(F.coalesce(text, F.lit("")))
        if self.name in SEGMENTERS:
            text = _segmented(self.name)(text)
        text = F.lower(text) if self.lowercase else text
        text = fold_tones(text) if self.fold_tone else text
        tokens = self._split(text)
        return F.filter(tokens, lambda t: F.length(t) >= self.min_len) if self.min_len > 1 else tokens

    def _split(self, text: Column) -> Column:
        if self.name == "whitespace":
            return F.filter(F.transform(words(text), lambda w: F.trim(w, F.lit(EDGE_PUNCTUATION))), lambda w: w != "")
        if self.name == "syllable_bigram":
            return F.flatten(F.transform(F.split(text, r"[^\p{L}\p{N}_\s]+"), self._segment))
        return F.regexp_extract_all(text, F.lit(f"({WORD}+)"), 1)

    def _segment(self, segment: Column) -> Column:
        syllables = F.regexp_extract_all(segment, F.lit(f"({WORD}+)"), 1)
        count = F.greatest(F.size(syllables) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(syllables, F.lit(1), count), F.slice(syllables, F.lit(2), count), lambda a, b: F.concat(a, F.lit("_"), b))
        return F.concat(syllables, pairs) if self.keep_syllables else pairs


def _segmented(name: str):
    """An Arrow function around an installed segmenter."""
    import pyarrow as pa
    from pyspark.sql.types import StringType

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        if name == "pyvi":
            from pyvi import ViTokenizer

            return pa.array([ViTokenizer.tokenize(t) for t in texts.to_pylist()], pa.string())
        from underthesea import word_tokenize

        return pa.array([word_tokenize(t, format="text") for t in texts.to_pylist()], pa.string())

    return run
