"""The corpus: cleaning, exact and near duplicates, profiles and contracts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.bm25 import rank_within
from docloom.session import materialize

#: Sets in a block of the exact comparison, words compared at once, and parts each side of the blocks is dealt to.
SET_BLOCK, SET_WORDS, SET_PARTS = 2_000, 1_024, 16


def first_delivery(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key in ``order``, nulls first; of rows equal in that any one.

    The smallest is kept while rows are combined, before and after their shuffle; nothing is sorted by key and no group is
    gathered."""
    others = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__first"))
    return first.select(key, "__first.*").select(*rows.columns)


def clean_records(raw: DataFrame) -> DataFrame:
    """Rows ``doc_id, name, link, text`` of raw documents ``id, name, link, passage``.

    Of rows delivered again the first by load time, then file, counts. Ids become text; a missing name or link is empty,
    links are lower case; a null passage is empty text."""
    first = first_delivery(raw, "id", ["loaded_at", "source_file"]) if "loaded_at" in raw.columns else raw
    return first.select(
        F.col("id").cast("string").alias("doc_id"),
        F.trim(F.coalesce("name", F.lit(""))).alias("name"),
        F.lower(F.trim(F.coalesce("link", F.lit("")))).alias("link"),
        tx.clean(F.col("passage")).alias("text"),
    )


def exclude(rows: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Rows whose key isn't among the excluded ones."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def corpus_contract(corpus: DataFrame) -> DataFrame:
    """One row of counts that a clean corpus has at 0 (but for the first)."""
    junk = f"(?iu)({'|'.join(tx.CRAWLER_LEFTOVERS)})"
    per_id = corpus.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("text") == "").alias("empty"),
        F.count_if(F.col("text").rlike(r"[\r\n\t]|  ")).alias("spacing"),
        F.count_if(F.col("link").rlike(r"\p{Lu}")).alias("links"),
        F.count_if(F.col("text").rlike(junk)).alias("leftovers"),
        F.count_if((F.length("text") < 200) & F.lower("text").contains("đăng nhập")).alias("logins"),
    )
    return per_id.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("empty", "empty_texts"), ("spacing", "unflattened"), ("links", "capital_links"), ("leftovers", "leftovers"), ("logins", "short_logins"))),
    )


def duplicate_groups(corpus: DataFrame) -> DataFrame:
    """Rows ``doc_id, group_key, group_size`` of documents that share their normalized text with others; empty texts
    aren't duplicates. Only hashes are shuffled; sizes are combined first, so a text copied everywhere is no hot task."""
    keyed = corpus.where(~tx.is_blank(F.col("text"))).select("doc_id", tx.duplicate_key(F.col("text")).alias("group_key"))
    keyed = materialize(keyed, "keys")  # both sides of the join read it, and cleaning the texts twice costs more
    sizes = keyed.groupBy("group_key").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return keyed.join(sizes, "group_key").select("doc_id", "group_key", "group_size")


def duplicate_links(corpus: DataFrame) -> DataFrame:
    """Rows ``link, documents`` of links that several documents have."""
    return corpus.where("link <> ''").groupBy("link").agg(F.count("*").alias("documents")).where("documents > 1")


def length_profile(corpus: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), limits: tuple[int, ...] = (256, 512)) -> DataFrame:
    """One row: texts, mean, median, percentiles and maximum of their lengths in words, and shares above limits.

    A percentile is the value at ``floor(n * share)`` counted from 0. Lengths are counted by value and summed up in
    order, so no list of all lengths is made."""
    counts = corpus.groupBy(tx.word_count(F.col("text")).alias("w")).agg(F.count("*").alias("n"))
    order = Window.orderBy("w")
    running = counts.select("w", "n", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))

    def at(share: float) -> Column:
        index = F.least(F.col("all") - 1, F.floor(F.col("all") * F.lit(share)))
        return F.min(F.when(F.col("upto") > index, F.col("w")))

    return running.agg(
        F.sum("n").alias("texts"),
        F.round(F.sum(F.col("w") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        *(at(s).alias(f"p{round(s * 100)}") for s in shares),
        F.max("w").alias("longest"),
        *(F.round(F.sum(F.when(F.col("w") > x, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias(f"above_{x}") for x in limits),
    )


def structure_profile(corpus: DataFrame, marker: str = r"(?<![\p{L}\p{N}_])Điều\s+\d+") -> DataFrame:
    """One row: texts, those with a marker, their share, and the mean number of markers where there are any."""
    rows = corpus.select(F.regexp_count("text", F.lit(f"(?iu){marker}")).alias("m"))
    return rows.agg(F.count("*").alias("texts"), F.count_if(F.col("m") > 0).alias("marked"), F.round(F.count_if(F.col("m") > 0) / F.count("*"), 6).alias("share"), F.round(F.avg(F.when(F.col("m") > 0, F.col("m"))), 6).alias("mean_markers"))


def missing_fields(raw: DataFrame, fields: tuple[str, ...] = ("name", "link", "passage")) -> DataFrame:
    """Rows ``field, missing, empty``: how often a field is null, and how often it is blank."""
    counts = raw.agg(*(F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNull()).alias("missing"), F.count_if(F.col(f).isNotNull() & tx.is_blank(F.col(f))).alias("empty")).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*fields)).alias("f")).select("f.*")


def longest_texts(corpus: DataFrame, most: int = 10) -> DataFrame:
    """The texts with the most words; of equal ones that of the smaller id."""
    return corpus.select("doc_id", tx.word_count(F.col("text")).alias("words")).orderBy(F.col("words").desc(), "doc_id").limit(most)


# Words wider than the crawler leftovers, to find unknown kinds of them, and how much is shown around one.
BROAD_KEYWORDS = ("đăng nhập", "mật khẩu", "quý khách", "rời quầy", "tài khoản của bạn")
BEFORE, AFTER = 60, 150


def pollution(corpus: DataFrame) -> DataFrame:
    """Rows ``doc_id, keyword, known_pattern, context`` of cleaned texts: the first broad keyword, in their order, that a
    text holds, whether it also holds a known leftover, and what surrounds the keyword."""
    low = F.lower("text")
    found = F.coalesce(*(F.when(low.contains(k), F.lit(k)) for k in BROAD_KEYWORDS))
    known = F.lit(False)
    for leftover in tx.CRAWLER_LEFTOVERS:
        known = known | low.contains(leftover)
    rows = corpus.select("doc_id", found.alias("keyword"), known.alias("known_pattern"), "text", low.alias("low")).where("keyword is not null")
    at = F.instr(F.col("low"), F.col("keyword"))
    start = F.greatest(at - BEFORE, F.lit(1))
    return rows.select("doc_id", "keyword", "known_pattern", F.substring("text", start, at + AFTER - start).alias("context"))


def _titled(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    rows = chunks.join(titles, "doc_id", "left")
    there = F.instr(F.substring("text", 1, 300), F.substring("title", 1, 40)) > 0
    return rows.withColumn("state", F.when(F.col("title").isNull(), "none").when(there, "there").otherwise("added"))


def with_titles(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Chunks with their document's title in front, unless it stands in the first 300 characters already."""
    added = F.concat(F.col("title"), F.lit(". "), F.col("text"))
    return _titled(chunks, titles).withColumn("text", F.when(F.col("state") == "added", added).otherwise(F.col("text"))).drop("title", "state")


def title_statistics(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """One row: chunks, those that get a title, have it already or have none, the share that gets one, and titles."""
    counts = _titled(chunks, titles).agg(F.count("*").alias("chunks"), *(F.count_if(F.col("state") == s).alias(a) for s, a in (("added", "prepended"), ("there", "already_had"), ("none", "no_title"))))
    share = F.round(F.coalesce(F.try_divide("prepended", "chunks"), F.lit(0.0)), 4)
    return counts.withColumn("share_prepended", share).join(F.broadcast(titles.agg(F.count("*").alias("documents_with_title"))))


def _question_words(questions: DataFrame) -> DataFrame:
    return questions.select("qid", "answer", F.array_distinct(F.filter(F.split(tx.question_key(F.col("question")), " "), lambda w: F.length(w) > 1)).alias("words"))


def _gold_status(ga: str, gb: str) -> Column:
    same = F.array_sort(F.array_distinct(ga)) == F.array_sort(F.array_distinct(gb))
    return F.when(same, "AGREE").when(F.size(F.array_intersect(ga, gb)) > 0, "NESTED").otherwise("DISJOINT")


# Words that say nothing about a question.
QUESTION_STOP = (
    "là", "gì", "nào", "được", "của", "và", "có", "cho", "trong", "khi", "thì",
    "các", "những", "về", "với", "theo", "quy", "định", "như", "thế", "ai",
    "bao", "lâu", "nhiêu", "phải", "không", "này", "đó", "một", "người",
)


def question_pairs(questions: DataFrame, threshold: float, frequent: float = 0.02, stop: tuple[str, ...] = QUESTION_STOP, block: int = 200) -> DataFrame:
    """Rows ``qid_a, qid_b, similarity, status`` of questions whose sets of words (longer than one character) share at
    least ``threshold`` of their union, found through rare words.

    A replica of the reference's lossy rule; ``all_question_pairs`` finds every pair. The rules of the blocks define the
    result: a word in more than ``frequent`` of the questions, a stop word, or a block of more than ``block`` questions
    finds no pair. Status compares the gold documents: AGREE, NESTED, DISJOINT."""
    rows = _question_words(questions)
    words = rows.select("qid", F.explode("words").alias("word"))
    total = rows.count()
    sizes = words.groupBy("word").agg(F.count("*").alias("df")).where((F.col("df") <= total * frequent) & F.col("df").between(2, block))
    if stop:
        sizes = sizes.where(~F.col("word").isin(*stop))
    blocked = words.join(sizes.select("word"), "word")
    pairs = blocked.alias("a").join(blocked.alias("b"), "word").where("a.qid < b.qid").select(F.col("a.qid").alias("qid_a"), F.col("b.qid").alias("qid_b")).distinct()
    both = pairs.join(rows.select(F.col("qid").alias("qid_a"), F.col("words").alias("wa"), F.col("answer").alias("ga")), "qid_a")
    both = both.join(rows.select(F.col("qid").alias("qid_b"), F.col("words").alias("wb"), F.col("answer").alias("gb")), "qid_b")
    similarity = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return both.where(similarity >= threshold).select("qid_a", "qid_b", F.round(similarity, 3).alias("similarity"), _gold_status("ga", "gb").alias("status"))


def _shared_counts(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Common words of every set of one block (words ``a``, sizes ``n``) with every set of another (``b``, ``m``)."""
    counts = np.zeros((len(n), len(m)), np.float32)
    both = np.intersect1d(a, b)
    for lo in range(0, len(both), SET_WORDS):
        some = both[lo : lo + SET_WORDS]
        marks = []
        for words, sizes in ((a, n), (b, m)):
            at = np.minimum(np.searchsorted(some, words), len(some) - 1)
            held = some[at] == words
            mark = np.zeros((len(sizes), len(some)), np.float32)
            mark[np.repeat(np.arange(len(sizes)), sizes)[held], at[held]] = 1
            marks.append(mark)
        counts += marks[0] @ marks[1].T
    return counts


def _similar_sets(threshold: float):
    """Function over pairs of blocks: rows ``x, y, similarity`` of their sets at ``threshold`` or above."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k, l, ids, n, a, others, m, b = (c[row].as_py() if i < 2 else c[row].values.to_numpy() for i, c in enumerate(batch.columns))
                shared = _shared_counts(a, b, n, m).astype(np.float64)
                similarity = shared / (n[:, None] + m[None, :] - shared)
                found = similarity >= threshold
                x, y = np.nonzero(np.triu(found, 1) if k == l else found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(others[y]), pa.array(similarity[x, y])], ["x", "y", "similarity"])

    return compare


def all_question_pairs(questions: DataFrame, threshold: float) -> DataFrame:
    """Rows ``qid_a, qid_b, similarity, status`` of all questions whose sets of words (longer than one character) share
    at least ``threshold`` of their union, whatever the words; ``threshold`` is above 0.

    Where nearly all words are frequent no filter on words leaves anything out, so all different sets are compared:
    dealt into blocks of about ``SET_BLOCK``, every pair of blocks by products of their incidence matrices. The time is
    quadratic in the number of different sets, as the result is; what is moved and held is a block. Equal sets are one
    set. Questions without such a word are in no pair."""
    rows = materialize(_question_words(questions).withColumn("set", F.md5(F.array_join(F.array_sort("words"), " "))), "questions").where("size(words) > 0")
    sets = materialize(rows.groupBy("set").agg(F.any_value("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "sets")
    words = sets.select("id", F.explode("words").alias("word"))
    numbers = materialize(words.select("word").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    numbered = words.join(numbers, "word").groupBy("id").agg(F.collect_list("number").alias("words"))
    blocks = max(1, -(-sets.count() // SET_BLOCK))
    held = numbered.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "words")).alias("sets"))
    held = held.select("block", "sets.id", F.transform("sets", lambda s: F.size(s["words"]).cast("long")).alias("sizes"), F.flatten("sets.words").alias("words"))
    held = materialize(held, "blocks").repartition(min(blocks, SET_PARTS), "block")
    tiles = held.alias("a").hint("shuffle_replicate_nl").join(held.alias("b"), F.col("a.block") <= F.col("b.block"))
    tiles = tiles.select("a.block", F.col("b.block").alias("other"), *(f"{s}.{c}" for s in "ab" for c in ("id", "sizes", "words"))).toDF("k", "l", "ids", "n", "a", "others", "m", "b")
    found = materialize(tiles.mapInArrow(_similar_sets(threshold), "x long, y long, similarity double"), "similar")

    members = materialize(rows.join(sets.select("set", "id"), "set").select("id", "qid", "answer"), "members")
    a, b = (members.select(F.col("id").alias(x), F.col("qid").alias(f"q{x}"), F.col("answer").alias(f"g{x}")) for x in "xy")
    equal = a.join(b, F.col("x") == F.col("y")).where("qx < qy").withColumn("similarity", F.lit(1.0))
    both = found.join(a, "x").join(b, "y").unionByName(equal)
    return both.select(F.least("qx", "qy").alias("qid_a"), F.greatest("qx", "qy").alias("qid_b"), F.round("similarity", 3).alias("similarity"), _gold_status("gx", "gy").alias("status"))


def name_passage_overlap(raw: DataFrame) -> DataFrame:
    """One row: files whose document has no name, those with a blank passage, those with both, and their percentage of
    the blank ones."""
    files = raw.where("source_file is not null").groupBy("source_file")
    rows = files.agg(F.bool_or(F.col("name").isNull()).alias("n"), F.bool_or(F.col("passage").isNotNull() & tx.is_blank(F.col("passage"))).alias("p"))
    counts = rows.agg(F.count_if("n").alias("missing_names"), F.count_if("p").alias("empty_passages"), F.count_if(F.col("n") & F.col("p")).alias("both"))
    return counts.withColumn("share_of_empty", F.round(100 * F.col("both") / F.greatest("empty_passages", F.lit(1)), 1))
