"""Visually identical text in one form: a compiled longest-match transducer over grapheme clusters.

The mapping is built from rules, checked for conflicts, and compiled once per Python process into a table from
clusters to clusters. A text is rewritten in one left-to-right pass; a text without any character that could need
rewriting is returned after a single scan.

One form means: composed letters, ordinary spaces, characters of ordinary width, no invisible characters, and Latin
letters instead of the Greek, Cyrillic or mathematical ones that only look like them. A look-alike is rewritten only
inside a word that also holds a Latin letter, so foreign words and symbols standing alone stay as they are.
Superscripts, fractions, dashes, line breaks, tabs and doubled spaces are left alone, and so are joiners between letters
of scripts that they shape (Persian, Hindi and others).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Characters without a visible shape, spaces of another kind, and look-alikes with what is expected.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧιανουρκχ", "ABEZHIKMNOPTYXiavoupkx"))
CYRILLIC = dict(zip("АВЕЗКМНОРСТУХЅІЈԚԜаеорсухѕіјһԁԛԝ", "ABE3KMHOPCTYXSIJQWaeopcyxsijhdqw"))
OTHER_SCRIPTS = {"ɑ": "a", "ɡ": "g", "ı": "i", "օ": "o", "ս": "u", "ո": "n", "Ꭺ": "A", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H"}
#: Latin letters that stand for the Vietnamese D with stroke wherever they occur.
STROKED = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ"}

ZWNJ, ZWJ = JOINERS = "\u200c\u200d"
VOWELS = "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY"
TONES = ["", "\u0300", "\u0301", "\u0303", "\u0309", "\u0323"]


class ConflictError(ValueError):
    """Two rules rewrite the same cluster differently, or a target would be rewritten again."""


def _width_rules() -> dict[str, str]:
    """Full- and half-width forms and their ordinary characters."""
    rules = {}
    for code in range(0xFF01, 0xFFEF):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if plain != char and unicodedata.name(char, "").startswith(("FULLWIDTH", "HALFWIDTH")):
            rules[char] = plain
    return rules


def _lookalike_rules() -> dict[str, str]:
    """Letters of another script (or of the mathematical alphabets) with the Latin letter they look like."""
    rules = {k: v for k, v in (GREEK | CYRILLIC).items() if v.isalpha()} | OTHER_SCRIPTS
    for code in range(0x1D400, 0x1D6A4):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            rules[chr(code)] = plain
    return rules


def _composition_rules(bases: dict[str, str]) -> dict[str, str]:
    """Every order of writing a Vietnamese vowel with its marks; ``bases`` maps other shapes of the plain letters."""
    shapes: dict[str, list[str]] = {}
    for shape, letter in bases.items():
        shapes.setdefault(letter, []).append(shape)
    rules = {}
    for vowel in VOWELS:
        letter, *quality = unicodedata.normalize("NFD", vowel)
        for tone in TONES:
            target = unicodedata.normalize("NFC", vowel + tone)
            marks = [*quality, tone] if tone else [*quality]
            orders = {"".join(marks), "".join(reversed(marks))}
            spellings = {x + o for x in (letter, *shapes.get(letter, ())) for o in orders} | {vowel + tone}
            if tone:
                spellings |= {unicodedata.normalize("NFC", letter + tone) + "".join(quality)}
            rules |= {s: target for s in spellings if s != target}
    return rules


class Transducer:
    """A conflict-checked table from clusters to clusters, applied by longest match.

    ``always`` holds rules for any place, ``in_latin`` those for words that hold a Latin letter."""

    def __init__(self, always: dict[str, str], in_latin: dict[str, str]):
        for cluster in always.keys() & in_latin.keys():
            if always[cluster] != in_latin[cluster]:
                raise ConflictError(f"{cluster!r}: {always[cluster]!r} or {in_latin[cluster]!r}")
        both = in_latin | always
        for cluster, target in both.items():
            if target in both and both[target] != target:
                raise ConflictError(f"{cluster!r} becomes {target!r}, which becomes {both[target]!r}")
        self.always, self.in_latin = always, both

    def cluster(self, text: str, latin: bool) -> str:
        """One grapheme cluster rewritten: the whole of it if the table has it, else the longest parts it has."""
        table = self.in_latin if latin else self.always
        if text in table:
            return table[text]
        out, i = [], 0
        while i < len(text):
            for j in range(len(text), i, -1):
                if text[i:j] in table:
                    out.append(table[text[i:j]])
                    break
            else:
                j = i + 1
                out.append(text[i])
            i = j
        return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=1)
def compiled() -> tuple[Transducer, re.Pattern, re.Pattern]:
    """The transducer, what finds a text that may need it, and what finds the runs to rewrite."""
    width, alike = _width_rules(), _lookalike_rules()
    always = {c: "" for c in INVISIBLE} | {c: " " for c in SPACES} | STROKED | width
    for char in map(chr, range(0x80, 0x30000)):  # characters that are never in composed form themselves
        target = unicodedata.normalize("NFC", char)
        if target != char and char not in always and target not in alike:
            always[char] = always.get(target, target)
    always |= _composition_rules({s: t for s, t in width.items() if t.isascii()})
    transducer = Transducer(always, alike | _composition_rules({s: t for s, t in alike.items()}))
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
    single = "".join(c for c in transducer.in_latin if len(c) == 1 and c <= "\uffff")
    beyond = "\U00010000-\U0002ffff"  # as one range: a set with single characters from there is slow to scan
    suspect = re.compile(f"[{re.escape(marks + single)}{beyond}]")
    others = "".join(c for c in single if not (c.isalnum() or c in INVISIBLE))
    run = re.compile(rf"[\w{re.escape(marks + INVISIBLE)}]+|[{re.escape(others)}{beyond}]")
    return transducer, suspect, run


_CLUSTERS = regex.compile(r"\X")
_JOINED = regex.compile(r"[\p{So}\p{Sk}\ufe0f]")
_LATIN = regex.compile(r"\p{Latin}")
#: Joiners that shape the letters of scripts which are written joined; they stay.
_SHAPED = "[" + "".join(rf"\p{{{s}}}" for s in "Arabic Syriac Mongolian Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Khmer Myanmar Tibetan".split()) + "]"
_JOINERS = regex.compile(rf"(?<={_SHAPED}\p{{M}}*)[\u200c\u200d]+(?={_SHAPED})")


def _rewrite(run: str, whole: str, at: int) -> str:
    """One run of letters, marks and invisible characters (or one other character) in one form."""
    _, suspect, _ = compiled()
    if not suspect.search(run):
        return run
    if run == ZWJ and at and _JOINED.match(whole, at - 1):
        return run  # holds the parts of one symbol together
    if kept := [m.span() for m in _JOINERS.finditer(whole, at, at + len(run))]:
        out, last = [], at
        for lo, hi in kept:
            out += [_bare(whole[last:lo]), whole[lo:hi]]
            last = hi
        return "".join([*out, _bare(whole[last : at + len(run)])])
    return _bare(run)


def _bare(run: str) -> str:
    """A run without invisible characters, its clusters rewritten."""
    transducer, _, _ = compiled()
    bare = run.translate(_NO_INVISIBLE)
    latin = bool(_LATIN.search(bare))
    return "".join(transducer.cluster(c, latin) for c in _CLUSTERS.findall(bare))


_NO_INVISIBLE = {ord(c): None for c in INVISIBLE}
_words: dict[str, str] = {}


def one_form(text: str) -> str:
    """``text`` in one form; the same object if nothing had to change."""
    _, suspect, run = compiled()
    if text.isascii() or not suspect.search(text):
        return text

    def fix(match: re.Match) -> str:
        word = match.group()
        if word.isascii():
            return word
        known = _words.get(word)
        if known is None:
            known = _rewrite(word, match.string, match.start())
            if len(word) < 40 and word[0] not in JOINERS:  # those depend on what stands before
                if len(_words) >= 200_000:  # bounded: a memo of this process, not a result
                    _words.clear()
                _words[word] = known
        return known

    return run.sub(fix, text)


@F.arrow_udf(StringType())
def one_form_column(texts: pa.Array) -> pa.Array:
    """Column expression: the text in one form; null stays null."""
    return pa.array([None if t is None else one_form(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(BooleanType())
def not_one_form(texts: pa.Array) -> pa.Array:
    """Column expression: whether the text isn't in one form. False for null texts and texts without a visible sign."""
    out = []
    for text in texts.to_pylist():
        form = text if text is None else one_form(text)
        out.append(text is not None and form != text and not form.isspace() and form != "")
    return pa.array(out, pa.bool_())


def normalize_texts(df: DataFrame, text: str, into: str = "one_form") -> DataFrame:
    """Add the column ``into`` with ``text`` in one form. One narrow pass, no shuffle.

    Null texts give null, empty texts stay empty; other columns, repeated rows and row order are untouched. If ``into``
    exists it is replaced."""
    return df.withColumn(into, one_form_column(F.col(text)))


def changed_records(df: DataFrame, key: str, text: str, table: str) -> DataFrame:
    """Rows ``tbl, rec_key`` of the records whose ``text`` isn't in one form, each once.

    Null, empty and blank texts don't count; a null key is kept as null. Only the found keys are shuffled."""
    found = df.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text")).where("text is not null")
    return found.where(not_one_form("text")).select(F.lit(table).alias("tbl"), "rec_key").distinct()

