"""What of a document bears on a question: paragraphs, their scores, and the best of them in order."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docloom.functions.text import question_key

# Sizes in characters of a paragraph, of what is joined to the next, and of the head; what starts a section;
# words that say nothing about a question.
LARGEST, SMALLEST, HEAD = 2000, 200, 600
_CAPITAL = r"[^\W\da-z_]"
SECTION = re.compile(rf"(?=\s(?:Điều\s+\d+\s*[\.:]|Chương\s+[IVXLC]+\b|[IVX]{{1,5}}\.\s+{_CAPITAL}{{2,}}|\d{{1,2}}\.\s+{_CAPITAL}{{2,}}))")
STOP = (
    "là", "gì", "nào", "được", "của", "và", "có", "cho", "trong", "khi", "thì",
    "các", "những", "về", "với", "theo", "như", "thế", "ai", "bao", "lâu",
    "nhiêu", "phải", "không", "này", "đó", "một", "người", "ra", "sao", "hay",
    "bị", "đến", "từ", "sẽ", "mà", "nếu", "hoặc", "cũng", "còn", "đã", "tại",
)
_BLANK = re.compile(r"\n\s*\n")
_PUNCTUATION = re.compile(r"[^\w\sÀ-ỹ]")


def _windows(text: str) -> list[str]:
    return [text[i : i + LARGEST] for i in range(0, len(text), LARGEST)]


def split_paragraphs(text: str) -> list[str]:
    """Paragraphs by blank lines, else by the starts of sections, else windows; what is larger than a paragraph is cut
    into windows, and what is smaller than ``SMALLEST`` is joined to what follows."""
    text = text.replace("\r", "")
    parts: list[str] = []
    for pattern in (_BLANK, SECTION):
        parts = [p for p in map(str.strip, pattern.split(text)) if p]
        if len(parts) > 1:
            break
    else:
        parts = _windows(text)
    out: list[str] = []
    held = ""
    for part in parts:
        large = len(part) > LARGEST
        if not large:
            held = f"{held} {part}".strip() if held else part
        if held and (large or len(held) >= SMALLEST):
            out.append(held)
            held = ""
        if large:
            out += _windows(part)
    return [*out, held] if held else out or [text]


def plain(text: str) -> str:
    """Composed, lower case, without punctuation, with single spaces."""
    return " ".join(_PUNCTUATION.sub(" ", unicodedata.normalize("NFC", text).lower()).split())


def keywords(question: Column, stop: tuple[str, ...] = STOP) -> Column:
    """The different content words of a question, longest first."""
    kept = F.filter(F.array_distinct(F.split(question_key(question), " ")), lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1)
    return F.transform(F.array_sort(F.transform(kept, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])


def pick(text: str, words: list[str], top: int = 4) -> tuple[str, list[tuple[int, str]]]:
    """The head of a text and up to ``top`` of its paragraphs, in their order: those of highest keyword density above 0.

    A keyword's occurrences count by its length and a weight that falls with the share of paragraphs that have it; the
    density divides by one more than the root of the paragraph's length."""
    paragraphs = split_paragraphs(text)
    forms = [plain(p) for p in paragraphs]
    share = {w: sum(w in f for f in forms) / len(forms) for w in words}

    def density(form: str) -> float:
        return sum(form.count(w) * len(w) / (1 + 10 * share[w]) for w in words) / (len(form) ** 0.5 + 1)

    scores = [density(f) for f in forms]
    best = sorted(range(len(forms)), key=lambda i: -scores[i])[:top]
    return paragraphs[0][:HEAD], [(i, paragraphs[i]) for i in sorted(best) if scores[i] > 0]


_PICKED = StructType([StructField("head", StringType()), StructField("parts", ArrayType(StructType([StructField("place", IntegerType()), StructField("excerpt", StringType())])))])
_ARROW_PICKED = pa.struct([("head", pa.string()), ("parts", pa.list_(pa.struct([("place", pa.int32()), ("excerpt", pa.string())])))])


def _picker(top: int):
    @F.arrow_udf(_PICKED)
    def run(texts: pa.Array, words: pa.Array) -> pa.Array:
        found = (pick(t or "", w or [], top) for t, w in zip(texts.to_pylist(), words.to_pylist()))
        return pa.array([{"head": head, "parts": [{"place": i, "excerpt": p} for i, p in parts]} for head, parts in found], _ARROW_PICKED)

    return run


def excerpts(questions: DataFrame, gold: DataFrame, corpus: DataFrame, top: int = 4) -> DataFrame:
    """Rows ``qid, doc_id, place, excerpt``: of each gold document the head (place -1) and the paragraphs of highest
    density, in the order of the document. ``gold`` has ``qid, doc_id``."""
    texts = corpus.select("doc_id", "text").join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = gold.join(questions.select("qid", keywords(F.col("question")).alias("k")), "qid").join(texts, "doc_id")
    picked = rows.select("qid", "doc_id", _picker(top)("text", "k").alias("p"))
    head = F.array(F.struct(F.lit(-1).alias("place"), F.col("p.head").alias("excerpt")))
    return picked.select("qid", "doc_id", F.explode(F.concat(head, F.col("p.parts"))).alias("b")).select("qid", "doc_id", "b.*")


def highlight(text: str, words: list[str]) -> str:
    """HTML of a text with the words marked."""
    escaped = html.escape(text)
    pattern = "|".join(re.escape(html.escape(w)) for w in sorted(words, key=len, reverse=True))
    return re.sub(f"({pattern})", r"<mark>\1</mark>", escaped, flags=re.I) if pattern else escaped
