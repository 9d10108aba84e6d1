"""Text expressions: built-in where Spark has them, Arrow functions where it doesn't (Unicode forms, erfc)."""

from __future__ import annotations

import math
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# What a pattern means by white space, word characters and crawler leftovers.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
CRAWLER_LEFTOVERS = ("quý khách vui lòng đăng nhập", "đăng nhập để xem", "rò rỉ mật khẩu", "vui lòng đăng nhập để", "đăng nhập để tiếp tục")
LINK_FOLDERS = r"^[a-z]+://[^/]+/([a-z\-]+)/([a-z\-]+)/"
EDGE_PUNCTUATION = ".,;:()[]{}\"'“”‘’…-–—/\\!?*"


def _arrow(function, kind, arrow):
    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], arrow)

    return apply


def _bare(text: str) -> str:
    parts = unicodedata.normalize("NFD", text)
    return "".join(c for c in parts if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


#: The text in Unicode form NFC; the pass is skipped inside for ASCII.
nfc = _arrow(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), StringType(), pa.string())
#: The text without accents, đ as d.
strip_diacritics = _arrow(_bare, StringType(), pa.string())


@F.arrow_udf(DoubleType())
def erfc(values: pa.Array) -> pa.Array:
    """Complementary error function."""
    return pa.array([None if v is None else math.erfc(v) for v in values.to_pylist()], pa.float64())


def chi_square_p(statistic: Column) -> Column:
    """The p-value of a chi-square statistic of one degree of freedom."""
    return erfc(F.sqrt(statistic / 2))


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean(text: Column) -> Column:
    """NFC, collapsed white space, and nothing from the first crawler leftover on. Null counts as empty."""
    flat = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), SPACE + "+", " ")
    return F.trim(F.regexp_replace(flat, f"(?iu)({'|'.join(CRAWLER_LEFTOVERS)}).*$", ""))


def duplicate_key(text: Column) -> Column:
    """What exact duplicates share: collapsed, lower case, as MD5."""
    return F.md5(F.lower(collapse(text)))


def question_key(text: Column) -> Column:
    """Lower-case words of a question without punctuation, in NFC."""
    return collapse(F.regexp_replace(F.lower(nfc(text)), rf"[^\p{{L}}\p{{N}}_\s\x{{c0}}-\x{{1ef9}}]", " "))


def words(text: Column) -> Column:
    """White-space separated words; none for empty or blank text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def plain_words(text: Column, least: int = 3) -> Column:
    """The different words without accents, in lower case, of at least so many characters; a slug's hyphens part words."""
    bare = strip_diacritics(F.lower(F.coalesce(text, F.lit(""))))
    return F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit(f"({WORD}+)"), 1), lambda w: F.length(w) >= least))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def chunk_key(doc_id: Column, position: Column) -> Column:
    return F.format_string("%s::%04d", doc_id, position)


def chunk_position(chunk_id: Column) -> Column:
    """The position a chunk id ends with; null if it has none."""
    return F.element_at(F.split(chunk_id, "::"), -1).try_cast("int")


def is_blank(text: Column) -> Column:
    """Whether a text is null or has no visible character."""
    return ~F.coalesce(text.rlike(rf"[^\s\x{{a0}}\x{{3000}}]"), F.lit(False))


def link_domain(link: Column) -> Column:
    """The first two folders of a link, of small letters and hyphens, as a field of law; ? where it hasn't two."""
    link = F.coalesce(link, F.lit(""))
    first, second = (F.regexp_extract(link, LINK_FOLDERS, i) for i in (1, 2))
    return F.when(first == "", F.lit("?")).otherwise(F.concat_ws("/", first, second))


def tone_pairs() -> list[tuple[str, str]]:
    """The spellings of oa, oe and uy with the tone on the second vowel, and with it on the first."""
    out = []
    for first, second in ("oa", "oe", "uy"):
        for mark in "\u0300\u0301\u0303\u0309\u0323":
            out.append((unicodedata.normalize("NFC", first + second + mark), unicodedata.normalize("NFC", first + mark + second)))
    return out


def fold_tones(text: Column) -> Column:
    """One place for the tone of oa, oe and uy (the first vowel); qu stays, as its u isn't a vowel."""
    for late, early in tone_pairs():
        text = F.regexp_replace(text, f"(?<!q){late}", early) if late[0] == "u" else F.replace(text, F.lit(late), F.lit(early))
    return text


# Document codes as the head of a text states them, as texts cite them, and as slugs spell them.
CODE = r"[0-9]{1,5}[A-ZĐ]*\s*/\s*(?:[0-9]{4}\s*/\s*)?[A-ZĐ]{2,}[a-z]*(?:\s*-\s*[A-ZĐ]+[a-z]*)*"
CITED = r"[0-9]{1,5}[A-ZĐ]*/[0-9]{4}/[A-ZĐ]{2,}[a-z]*(?:-[A-ZĐ]+[a-z]*)*"
CITED_CODE = rf"(?<![\p{{L}}\p{{N}}_])({CITED})(?![\p{{L}}\p{{N}}_])"
SLUG_CODE = r"(?:^|-)(\d{1,5})-(\d{4})-([A-Za-zĐđ]{2,}(?:-[A-Za-zĐđ]+)*?)(?=-[a-zđ]{2,}-|$)"


def code_key(code: Column) -> Column:
    """A document code without spaces, in capitals."""
    return F.upper(F.regexp_replace(code, r"\s+", ""))


def own_code(name: Column, text: Column) -> Column:
    """A document's own code: from the head of its text, else from the slug in its name; null if it has none."""
    stated = F.regexp_extract(F.substring(text, 1, 1500), rf"Số:\s*({CODE})", 1)
    slug = F.array(*(F.regexp_extract(F.coalesce(name, F.lit("")), SLUG_CODE, i) for i in (1, 2, 3)))
    return F.nullif(code_key(F.when(stated != "", stated).when(slug[0] != "", F.array_join(slug, "/")).otherwise(F.lit(""))), F.lit(""))


# Kinds of documents (longer names first) and where a title stops.
DOCUMENT_KINDS = ("THÔNG TƯ LIÊN TỊCH", "THÔNG TƯ", "NGHỊ ĐỊNH", "NGHỊ QUYẾT", "QUYẾT ĐỊNH", "CHỈ THỊ", "PHÁP LỆNH", "LUẬT", "BỘ LUẬT", "HIẾN PHÁP", "QUY CHUẨN KỸ THUẬT QUỐC GIA", "TIÊU CHUẨN QUỐC GIA", "CÔNG VĂN", "KẾ HOẠCH")
TITLE_STOP = r"(?<![\p{L}\p{N}_])(?:Căn cứ|CĂN CỨ|Điều\s+1(?![\p{L}\p{N}_])|ĐIỀU\s+1(?![\p{L}\p{N}_])|Chương\s+I(?![\p{L}\p{N}_])|CHƯƠNG\s+I(?![\p{L}\p{N}_])|Xét đề nghị)"
BOILERPLATE = r"CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM|Độc lập\s*-\s*Tự do\s*-\s*Hạnh phúc|-{3,}|_{3,}"


def title(text: Column, max_words: int = 30) -> Column:
    """Code, kind and name of a document from its head; null where it names no kind."""
    head = F.substring(text, 1, 1500)
    code = F.regexp_extract(head, rf"Số:\s*({CODE})", 1)
    after = F.when(code != "", F.regexp_replace(head, rf"(?s)^.*?Số:\s*{CODE}", "")).otherwise(head)
    tail = F.regexp_extract(after, rf"(?s)(?:{'|'.join(DOCUMENT_KINDS)}).*$", 0)
    tail = F.regexp_replace(F.regexp_replace(tail, rf"(?s){TITLE_STOP}.*$", ""), BOILERPLATE, " ")
    name = F.trim(F.array_join(F.slice(words(tail), 1, max_words), " "), F.lit(" .,;:-"))
    return F.when(name != "", F.trim(F.concat_ws(" ", F.regexp_replace(code, r"\s+", ""), name)))
