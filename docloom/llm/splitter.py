"""Splitting oversized texts at natural boundaries by recursive bisection.

Sizes are counted in words (runs of characters without white space; no-break and full-width spaces are white space,
zero-width characters are not). A text within the limit stays one piece. A larger one is cut at the strongest boundary
near its middle, and so are the halves, until every part fits into the limit minus the overlap; then every part but the
first gets the words before it as overlap. Pieces are slices of the text, so joining them without their overlaps gives
all its words back in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: A table of configurations larger than this isn't one; it is refused rather than cut.
MAX_CONFIGS = 1000

_TOKEN = re.compile(r"\S+")
_HEADINGS = {"loose": re.compile(r"điều\s+\d+\b", re.I), "strict": re.compile(r"điều\s+\d+\.\s", re.I)}
_ITEM = re.compile(r"(?:\d{1,3}|[a-zđ])[.)]$|[-+•]$", re.I)

# Strength of the boundary before a word.
HEADING, PARAGRAPH, LINE, SENTENCE, ITEM, CLAUSE, COMMA, SPACE = 7, 6, 5, 4, 3, 2, 1, 0


@dataclass(frozen=True)
class SplitConfig:
    """One row of the configuration; an overlap that isn't smaller than the size counts as none."""

    cfg_id: int
    size: int
    overlap: int
    strategy: str = "loose"

    def __post_init__(self):
        if self.size < 1:
            raise ValueError(f"configuration {self.cfg_id}: a size of {self.size} words")
        if self.strategy not in _HEADINGS:
            raise ValueError(f"configuration {self.cfg_id}: unknown strategy {self.strategy!r}")
        if not 0 <= self.overlap < self.size:
            object.__setattr__(self, "overlap", 0)


def _strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For every word the strength of the boundary before it, but for headings."""
    out = [SPACE] * len(spans)
    for i in range(1, len(spans)):
        before, start = spans[i - 1][1], spans[i][0]
        last = text[before - 1]
        if start - before > 1 or text[before] in "\n\r\u2028":
            gap = text[before:start]
            breaks = gap.count("\n") or gap.count("\r") + gap.count("\u2028")
            if breaks:
                out[i] = PARAGRAPH if breaks > 1 else LINE
                continue
        if last in ".!?…" and not _ITEM.match(text[spans[i - 1][0] : before]):
            out[i] = SENTENCE
        elif spans[i][1] - start <= 4 and _ITEM.match(text[start : spans[i][1]]):
            out[i] = ITEM
        elif last in ";:":
            out[i] = CLAUSE
        elif last == ",":
            out[i] = COMMA
    return out


def _with_headings(base: list[int], text: str, spans: list[tuple[int, int]], headings: re.Pattern) -> list[int]:
    """The strengths with the words raised that begin a heading, which follows a line's or a sentence's end."""
    out, starts = list(base), [start for start, _ in spans]
    for match in headings.finditer(text):
        i = bisect_left(starts, match.start())
        if 0 < i < len(starts) and starts[i] == match.start() and (base[i] in (LINE, PARAGRAPH) or text[spans[i - 1][1] - 1] in ".;:!?"):
            out[i] = HEADING
    return out


def _nearest_strongest(strengths: list[int], first: int, last: int, middle: float) -> int:
    """Of the strongest boundaries in ``first..last`` the one nearest to the middle, the earlier of two."""
    window = strengths[first : last + 1]
    strongest, at = max(window), min(max(int(middle) - first + 1, 0), len(window))
    before, after = window[:at][::-1], window[at:]
    left = first + at - 1 - before.index(strongest) if strongest in before else None
    right = first + at + after.index(strongest) if strongest in after else None
    if left is None or right is None:
        return right if left is None else left
    return left if middle - left <= right - middle else right


def bisect_spans(strengths: list[int], size: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(first word with overlap, first own word, end)`` of every piece of a text with these boundaries."""
    n = len(strengths)
    if n <= size:
        return [(0, 0, n)] if n else []
    limit, parts, stack = size - overlap, [], [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= limit:
            parts.append((lo, hi))
            continue
        middle, reach = (lo + hi) / 2, max(1, (hi - lo) // 4)
        first, last = max(lo + 1, int(middle) - reach), min(hi - 1, int(middle) + reach)
        if not lo and overlap < last:
            first = max(first, min(overlap, limit))  # else the first piece couldn't give the whole overlap
        cut = _nearest_strongest(strengths, first, last, middle)
        stack += [(cut, hi), (lo, cut)]
    return [(max(0, lo - overlap) if lo else 0, lo, hi) for lo, hi in parts]


def split_text(text: str, config: SplitConfig) -> list[dict]:
    """The pieces of one text under one configuration, in order."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return _pieces(text, spans, config, {}, True)


def _pieces(text: str, spans: list, config: SplitConfig, strengths: dict, with_text: bool) -> list[dict]:
    if len(spans) > config.size and config.strategy not in strengths:
        if "" not in strengths:
            strengths[""] = _strengths(text, spans)
        base = strengths[""]
        strengths[config.strategy] = _with_headings(base, text, spans, _HEADINGS[config.strategy])
    cuts = bisect_spans(strengths.get(config.strategy) if len(spans) > config.size else [SPACE] * len(spans), config.size, config.overlap)
    return [
        {
            "cfg_id": config.cfg_id,
            "piece": i,
            "n_pieces": len(cuts),
            "start_word": start,
            "own_word": own,
            "end_word": end,
            "text": text[spans[start][0] : spans[end - 1][1]] if with_text else None,
        }
        for i, (start, own, end) in enumerate(cuts)
    ]


_PIECE = StructType(
    [
        *(StructField(c, IntegerType()) for c in ("cfg_id", "piece", "n_pieces", "start_word", "own_word", "end_word")),
        StructField("text", StringType()),
    ]
)
_ARROW_PIECE = pa.list_(
    pa.struct([*((c, pa.int32()) for c in ("cfg_id", "piece", "n_pieces", "start_word", "own_word", "end_word")), ("text", pa.string())])
)


def _pieces_column(configs: list[SplitConfig], with_text: bool):
    @F.arrow_udf(ArrayType(_PIECE))
    def split(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            spans = [m.span() for m in _TOKEN.finditer(text or "")]
            strengths: dict = {}
            out.append([p for c in configs for p in _pieces(text, spans, c, strengths, with_text)])
        return pa.array(out, _ARROW_PIECE)

    return split


def read_configs(table: DataFrame) -> list[SplitConfig]:
    """The rows of a configuration table ``cfg_id, chunk_size, overlap, strategy``; at most ``MAX_CONFIGS``, else an
    error. Rows without id or size are skipped, a null overlap is none, a null strategy is loose."""
    rows = table.select("cfg_id", "chunk_size", "overlap", "strategy").distinct().limit(MAX_CONFIGS + 1).collect()
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configurations")
    known = (r for r in rows if r.cfg_id is not None and r.chunk_size is not None)
    return sorted((SplitConfig(r.cfg_id, r.chunk_size, r.overlap or 0, r.strategy or "loose") for r in known), key=lambda c: c.cfg_id)


def split_records(df: DataFrame, key: str, text: str, configs: list[SplitConfig], with_text: bool = True, only: Column | None = None) -> DataFrame:
    """Rows ``cfg_id, key, piece, n_pieces, start_word, own_word, end_word, text``: every text cut under every
    configuration.

    One narrow pass: a text crosses to Python once for all configurations, and nothing is shuffled. Null, empty and
    blank texts have no pieces; repeated rows are cut each for itself (deduplicate what you read, or what you get).
    ``only`` filters the pieces by their columns before they are spread into rows; without ``with_text`` the column
    ``text`` is null and the texts aren't copied back."""
    pieces = _pieces_column(configs, with_text)(F.col(text))
    if only is not None:
        pieces = F.filter(pieces, lambda p: only(p))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.explode(pieces).alias("__p"))
    fields = [F.col(f"__p.{f.name}").alias(f.name) for f in _PIECE.fields]
    return rows.select(fields[0], F.col("__key").alias(key), *fields[1:])
