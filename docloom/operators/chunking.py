"""Cutting documents into chunks: word windows, structural markers, and both combined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import chunk_key, is_blank, words

# What starts an article, and whether the continuation tag is taken from the window's size.
MARKERS = {"loose": (r"(?<![\p{L}\p{N}_])Điều\s+\d+(?![\p{L}\p{N}_])", False), "strict": (r"(?<![\p{L}\p{N}_])Điều\s+\d+\.\s", True)}


@dataclass(frozen=True)
class Chunking:
    size: int = 256
    overlap: int = 64
    strategy: str = "loose"

    def __post_init__(self):
        if self.strategy not in MARKERS:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.size < 1:
            raise ValueError("size is at least 1")


def windows(text: Column, size: Column | int, overlap: int) -> Column:
    """Windows of ``size`` words, each beginning ``overlap`` words before the last one's end; a text within the size
    stays as it is, an empty one has none. An overlap that isn't smaller than the size counts as none."""
    size = F.lit(size) if isinstance(size, int) else size
    step = F.when(size - overlap > 0, size - overlap).otherwise(size)
    tokens = words(text)
    last = F.ceil((F.size(tokens) - size) / step).cast("int")
    starts = F.sequence(F.lit(0), last)
    cut = F.transform(starts, lambda k: F.array_join(F.slice(tokens, k * step + 1, size), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).when(F.size(tokens) <= size, F.array(text)).otherwise(cut)


def sections(text: Column, strategy: str) -> Column:
    """The text before the first marker, if any, and a part from each marker on."""
    parts = F.split(text, f"(?iu)(?={MARKERS[strategy][0]})")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def chunk_texts(text: Column, config: Chunking) -> Column:
    """The chunks of a cleaned text: sections within the size whole, larger ones in windows whose continuations are
    tagged with their article; a text without markers in windows."""
    marker, reserve = MARKERS[config.strategy]

    def section(part: Column) -> Column:
        label = F.trim(F.regexp_extract(part, f"(?iu)({marker})", 1))
        tag = F.concat(F.lit("["), label, F.lit(" - tiếp theo] "))
        budget = F.greatest(config.size - F.size(words(tag)), F.lit(1)) if reserve else F.lit(config.size)
        size = F.when(label != "", budget).otherwise(config.size)
        plain = windows(part, size, config.overlap)
        tagged = F.transform(plain, lambda w, i: F.when((i == 0) | (label == "") | F.startswith(F.trim(w), label), w).otherwise(F.concat(tag, w)))
        return F.when(F.size(words(part)) <= config.size, F.array(part)).otherwise(tagged)

    cut = F.flatten(F.transform(sections(text, config.strategy), section))
    return F.when(text.rlike(f"(?iu){marker}"), cut).otherwise(windows(text, config.size, config.overlap))


def chunk_documents(corpus: DataFrame, config: Chunking | None = None) -> DataFrame:
    """Rows ``chunk_id, doc_id, position, text``; blank documents have none."""
    cut = corpus.where(~is_blank(F.col("text"))).select("doc_id", F.posexplode(chunk_texts(F.col("text"), config or Chunking())).alias("position", "text"))
    return cut.select(chunk_key(F.col("doc_id"), F.col("position")).alias("chunk_id"), "doc_id", "position", "text")


def chunking_summary(corpus: DataFrame, config: Chunking | None = None) -> DataFrame:
    """One row: documents that aren't blank, their chunks, and the documents without a marker, which fall back to windows."""
    config = config or Chunking()
    rows = corpus.where(~is_blank(F.col("text"))).select(F.size(chunk_texts(F.col("text"), config)).alias("n"), F.col("text").rlike(f"(?iu){MARKERS[config.strategy][0]}").alias("marked"))
    return rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count_if(~F.col("marked")).alias("fallback"))


def chunk_contract(chunks: DataFrame) -> DataFrame:
    """One row of counts: chunks, ids of another form, repeated ids, empty texts, and chunks a document."""
    repeated = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.count_if(is_blank(F.col("text"))).alias("blank"))
    per_doc = repeated.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("blank").alias("blank"), F.count_if(~F.col("chunk_id").rlike(r"^.+::[0-9]{4,}$")).alias("malformed"))
    return per_doc.agg(
        F.sum("n").alias("chunks"),
        F.count("*").alias("documents"),
        F.sum("repeated").alias("repeated_ids"),
        F.sum("blank").alias("empty_texts"),
        F.sum("malformed").alias("malformed_ids"),
        F.round(F.avg("n"), 6).alias("mean_chunks"),
        F.max("n").alias("most_chunks"),
        F.min("n").alias("least_chunks"),
    )
