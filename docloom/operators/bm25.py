"""BM25: an index of blocks of chunks, which every task of a search reads once for the questions it holds.

Joining postings to the terms of many questions makes a row for every posting and question, and dealing blocks of
questions and of chunks to tasks moves each chunk as often as there are blocks of questions. Here a row of the index is a
block of chunks as a small inverted file, written once to the shared folder. A task holds some thousands of questions,
reads the blocks one after another, and keeps only the best chunks so far. What is shuffled are the chunks once and the
questions once, whatever their numbers; what a task holds is its questions, their best chunks and one block, and no
question reaches the driver. Equal texts are one class, of chunks as of questions, and are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.tokens import Tokenizer
from docloom.session import materialize, stored

#: Questions that a task holds, different texts in a block of chunks, questions scored at once, and the share of a block's
#: texts that makes a term dense.
QUESTION_BLOCK, CHUNK_BLOCK, AT_ONCE, DENSE = 8192, 2048, 128, 0.05
#: Best chunks of a question that a task keeps; longer lists leave it block by block and are ranked by a shuffle.
HELD = 2000
#: Rows in a batch that leaves a task.
BATCH = 1 << 16

_COPIES = pa.list_(pa.struct([("chunk_id", pa.string()), ("doc_id", pa.string())]))
_BLOCK = pa.schema([("copies", pa.list_(_COPIES)), ("times", pa.list_(pa.int32())), ("length", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("row", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
_BLOCK_TYPE = "copies array<array<struct<chunk_id string, doc_id string>>>, times array<int>, length array<int>, terms array<string>, df array<bigint>, ends array<int>, row array<int>, tf array<int>"
_FOUND = pa.schema([("qid", pa.string()), ("chunk_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class Index:
    """The tables of an index, and the numbers its weights need."""

    blocks: DataFrame  # inverted files of texts: copies, times, length of each text; terms, df, ends, row, tf of postings by term
    terms: DataFrame  # term, df, idf
    chunks: int
    documents: int
    average_length: float
    k1: float
    b: float


def tokens_of(rows: DataFrame, keys: list[str], text: str, tokenizer: Tokenizer) -> DataFrame:
    return rows.select(*keys, tokenizer(F.col(text)).alias("tokens"))


def classes(rows: DataFrame, text: str, members: Column, into: str) -> DataFrame:
    """Rows ``into, text``: the members of each different text, null members too; a null text is an empty one."""
    keyed = rows.select(members.alias(into), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return keyed.groupBy(F.unhex(F.md5("text")).alias("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct(into))), lambda x: x[into]).alias(into), F.any_value("text").alias("text"))


def inverse_frequency(df: Column, total: int) -> Column:
    return F.log(1 + (F.lit(float(total)) - df + 0.5) / (df + 0.5))


def counted(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of some lists, and their postings by term, then row: number of the term, row and count."""
    names = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cells, tf = np.unique(names.indices.to_numpy().astype(np.int64) * max(1, len(tokens)) + row, return_counts=True)
    return names.dictionary, *np.divmod(cells, max(1, len(tokens))), tf


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts of a task, in the order they come in."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == size:
                yield _block(pa.Table.from_batches(held))
                held, count = [], 0
    if count:
        yield _block(pa.Table.from_batches(held))


def _block(rows: pa.Table) -> pa.RecordBatch:
    copies, tokens = (pa.concat_arrays(rows[c].chunks) for c in ("copies", "tokens"))
    times, length = (x.value_lengths().to_numpy() for x in (copies, tokens))
    terms, term, row, tf = counted(tokens)
    ends = np.searchsorted(term, np.arange(len(terms)), "right")
    df = np.add.reduceat(times[row].astype(np.int64), np.append(0, ends[:-1])) if len(terms) else np.empty(0, np.int64)
    columns = [copies.cast(_COPIES), times, length, terms, df, ends, row, tf]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) if isinstance(x, list) else pa.ListArray.from_arrays([0, len(x)], pa.array(x, f.type.value_type)) for x, f in zip(columns, _BLOCK)], schema=_BLOCK)


def build_index(chunks: DataFrame, tokenizer: Tokenizer | None = None, k1: float = 1.5, b: float = 0.75, min_df: int = 1) -> Index:
    """Index a table ``chunk_id, doc_id, text``. Lengths count all tokens, those of dropped terms too; the mean length
    counts empty chunks. Texts are shuffled once, to meet their copies, and document frequencies combined before."""
    texts = classes(chunks, "text", F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id")), "copies")
    packed = tokens_of(texts, ["copies"], "text", tokenizer or Tokenizer()).mapInArrow(partial(_pack, size=CHUNK_BLOCK), _BLOCK_TYPE)
    blocks = materialize(packed, "index")
    length = F.aggregate(F.zip_with("times", "length", lambda n, x: n.cast("long") * x), F.lit(0).cast("long"), lambda x, y: x + y)
    total = blocks.agg(F.coalesce(F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)), F.sum(length)).first()
    documents = blocks.select(F.explode(F.array_distinct(F.flatten("copies")["doc_id"]))).agg(F.count_distinct("col")).first()[0]
    frequency = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df")).where(F.col("df") >= min_df)
    terms = materialize(frequency.select("term", "df", inverse_frequency(F.col("df"), total[0]).alias("idf")), "terms")
    return Index(blocks, terms, total[0], documents, total[1] / total[0] if total[1] else 1.0, k1, b)


def score_chunks(questions: DataFrame, index: Index, tokenizer: Tokenizer | None = None, top: int = 50, binary: bool = False, decimals: int = 6) -> DataFrame:
    """Rows ``qid, chunk_id, doc_id, score, rank``: the ``top`` chunks of every question with a score above 0; ties by
    chunk id. Scores are rounded before they are ranked, so the order doesn't depend on the order of summation.

    A question has one row. Every question meets every block of chunks, as it may match any chunk; the rows of a question
    leave one task."""
    texts = classes(questions.select(F.col("qid").cast("string").alias("qid"), "question"), "question", F.col("qid"), "qids")
    asked = materialize(tokens_of(texts, ["qids"], "text", tokenizer or Tokenizer()), "questions")
    number = asked.count()
    cores = questions.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-number // QUESTION_BLOCK), min(cores, -(-number // AT_ONCE)))
    options = dict(blocks=index.blocks.materialized_at, vocabulary=index.terms.materialized_at, block=QUESTION_BLOCK, at_once=AT_ONCE, dense=DENSE, top=top, binary=binary, decimals=decimals, k1=index.k1, b=index.b, average=index.average_length)
    dealt = asked.repartition(tasks, F.col("qids")[0])
    if top > HELD:
        found = dealt.mapInArrow(partial(_search, ranked=False, **options), "qid string, chunk_id string, doc_id string, score double")
        return rank_within(found, ["qid"], [F.col("score").desc(), F.col("chunk_id")], top)
    return dealt.mapInArrow(partial(_search, ranked=True, **options), "qid string, chunk_id string, doc_id string, score double, rank int")


def _search(batches: Iterator[pa.RecordBatch], block: int, **options) -> Iterator[pa.RecordBatch]:
    """The best chunks of all questions of a task, ``block`` of them at a time."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, block - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == block:
                yield from _search_block(pa.Table.from_batches(held), **options)
                held, count = [], 0
    if count:
        yield from _search_block(pa.Table.from_batches(held), **options)


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name)[0].values.to_numpy(zero_copy_only=False)


def _search_block(rows: pa.Table, blocks: str, vocabulary: str, at_once: int, dense: float, top: int, binary: bool, decimals: int, k1: float, b: float, average: float, ranked: bool) -> Iterator[pa.RecordBatch]:
    qids, tokens = (pa.concat_arrays(rows[c].chunks) for c in ("qids", "tokens"))
    names, term, asker, times = counted(tokens)
    idf = np.zeros(len(names))
    for batch in stored(vocabulary, ["term", "idf"], 1 << 16):
        mine = pc.index_in(batch.column("term"), value_set=names)
        known = mine.is_valid()
        idf[mine.filter(known).to_numpy()] = batch.column("idf").filter(known).to_numpy()
    factor = idf[term] if binary else times * idf[term]
    by = np.lexsort((term, asker))
    by = by[idf[term[by]] > 0]
    asker, term, factor = asker[by], term[by], factor[by]
    parts = [_Asked(lo, min(at_once, len(qids) - lo), asker, term, factor, top) for lo in range(0, len(qids), at_once)]
    columns = ["times", "length", "terms", "ends", "row", "tf"] + ([] if ranked else ["copies"])
    for at, batch in enumerate(stored(blocks, columns, 1)):
        times, length, ends, row, tf = (_values(batch, c) for c in ("times", "length", "ends", "row", "tf"))
        n = len(times)
        wanted = pc.fill_null(pc.index_in(batch.column("terms")[0].values, value_set=names), -1).to_numpy(zero_copy_only=False)
        of = np.repeat(wanted, np.diff(ends, prepend=0))
        tf, row, of = tf[of >= 0], row[of >= 0], of[of >= 0]
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
        postings = _Postings(n, len(names), of, row, weight, dense)
        for part in parts:
            q, c, score = part.best(postings, times, decimals)
            if not len(q):
                continue
            if ranked:
                part.add(q, np.full(len(q), at), c, score, times[c])
            else:
                yield from _rows(qids, q + part.lo, batch.column("copies")[0].values.take(pa.array(c)), score, None)
    if not ranked:
        return
    for part in parts:
        part.settle()
    kept = [np.concatenate(x) for x in zip(*((part.q + part.lo, part.at, part.c, part.score) for part in parts))]
    places, place = np.unique(np.stack(kept[1:3]), axis=1, return_inverse=True)
    copies = []
    if len(kept[0]):
        edges = np.flatnonzero(np.diff(places[0], prepend=-1, append=-1))
        wanted = {int(places[0][lo]): places[1][lo:hi] for lo, hi in zip(edges[:-1], edges[1:])}
        copies = [batch.column("copies")[0].values.take(pa.array(wanted[at])) for at, batch in enumerate(stored(blocks, ["copies"], 1)) if at in wanted]
    if copies:
        yield from _rows(qids, kept[0], pa.concat_arrays(copies).take(pa.array(place.ravel())), kept[3], top)


def _rows(qids: pa.ListArray, q: np.ndarray, copies: pa.ListArray, score: np.ndarray, top: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of every question of each class for every copy of its chunks; with ``top`` that many, and ranked."""
    if top is not None:
        copies = _first(copies, top)
    sizes = copies.value_lengths().to_numpy()
    chunks = copies.flatten()
    q, score = np.repeat(q, sizes), np.repeat(score, sizes)
    if top is not None:
        ids, docs = chunks.field("chunk_id"), chunks.field("doc_id")
        order = pc.sort_indices(pa.table({"q": q, "s": -score, "c": ids, "d": docs}), [(k, "ascending") for k in "qscd"]).to_numpy()
        q, score, chunks = q[order], score[order], chunks.take(pa.array(order))
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) + 1
        keep = rank <= top
        q, score, rank, chunks = q[keep], score[keep], rank[keep], chunks.filter(pa.array(keep))
    ids, docs = chunks.field("chunk_id"), chunks.field("doc_id")
    # the rows of each class, then for each of its questions all of them
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    sizes = np.diff(np.append(starts, len(q)))
    asked = qids.take(pa.array(q[starts]))
    start, size = np.repeat(starts, asked.value_lengths().to_numpy()), np.repeat(sizes, asked.value_lengths().to_numpy())
    names = asked.flatten()
    upto = np.cumsum(size)
    lo = 0
    while lo < len(names):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BATCH, "right")))
        own = np.repeat(np.arange(lo, hi), size[lo:hi])
        at = np.repeat(start[lo:hi] - np.cumsum(size[lo:hi]) + size[lo:hi], size[lo:hi]) + np.arange(len(own))
        columns = [names.take(pa.array(own)), ids.take(pa.array(at)), docs.take(pa.array(at)), pa.array(score[at])]
        if top is None:
            yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)
        else:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rank[at].astype(np.int32))], ["qid", "chunk_id", "doc_id", "score", "rank"])
        lo = hi


def _first(lists: pa.ListArray, most: int) -> pa.ListArray:
    """The first elements of each list, up to ``most``."""
    sizes = lists.value_lengths().to_numpy()
    if not len(sizes) or sizes.max() <= most:
        return lists
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = lists.flatten().filter(pa.array(place < most))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(sizes, most))).astype(np.int32)), kept)


class _Postings:
    """A block's postings of the terms that the questions of a task have. Those that many of the texts have are rows of a
    matrix, the others lists."""

    def __init__(self, n: int, vocabulary: int, term: np.ndarray, row: np.ndarray, weight: np.ndarray, dense: float):
        self.n = n
        self.often = np.bincount(term, minlength=vocabulary) >= max(1, dense * n)
        self.place = np.cumsum(self.often) - 1
        heavy = self.often[term]
        self.dense = np.zeros((int(self.often.sum()), n))
        self.dense[self.place[term[heavy]], row[heavy]] = weight[heavy]
        # sums of terms above 0 have a bounded relative error in single precision, others don't
        self.single = not len(weight) or weight.min() > 0
        self.rough = self.dense.astype(np.float32) if self.single else self.dense
        term, self.row, self.weight = term[~heavy], row[~heavy], weight[~heavy]
        order = np.argsort(term, kind="stable")
        term, self.row, self.weight = term[order], self.row[order], self.weight[order]
        self.bounds = np.searchsorted(term, np.arange(vocabulary + 1))


class _Asked:
    """Some questions, and their best chunks so far: question, block, row, score and how many copies there are."""

    def __init__(self, lo: int, size: int, asker: np.ndarray, term: np.ndarray, factor: np.ndarray, top: int):
        mine = slice(*np.searchsorted(asker, [lo, lo + size]))
        self.lo, self.size, self.top = lo, size, top
        self.who, self.what, self.much = asker[mine] - lo, term[mine], factor[mine]
        self.most = int(np.bincount(self.who, minlength=1).max())
        self.q, self.at, self.c, self.times = (np.empty(0, np.int64) for _ in range(4))
        self.score, self.floor = np.empty(0), np.zeros(size)
        self.new: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def best(self, block: _Postings, times: np.ndarray, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, rows and scores of a block that may be among the best: all from the floor on, ties included. They
        are told by sums in single precision, less the most that these can be off, and then summed exactly."""
        thick = block.often[self.what]
        who, what, much = self.who[thick], self.what[thick], self.much[thick]
        used, column = np.unique(block.place[what], return_inverse=True)
        factors = np.zeros((self.size, len(used)))
        factors[who, column] = much
        rough = factors.astype(block.rough.dtype) @ block.rough[used]
        who, what, much = self.who[~thick], self.what[~thick], self.much[~thick]
        sizes = block.bounds[what + 1] - block.bounds[what]
        picked = np.repeat(block.bounds[what] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cells = np.repeat(who * block.n, sizes) + block.row[picked]
        thin = np.bincount(cells, block.weight[picked] * np.repeat(much, sizes), self.size * block.n).reshape(self.size, block.n)
        rough = rough + thin
        off = 1 - (self.most + 16) * 2.0**-22
        floor = self.floor - 0.6 * 10.0**-decimals
        if block.n > self.top and not len(self.q):
            floor = np.maximum(floor, np.partition(rough, -self.top, axis=1)[:, -self.top] * off - 10.0**-decimals)
        q, c = np.nonzero((rough >= np.where(floor > 0, floor * off, floor)[:, None]) & (rough > 0))
        score = thin[q, c].astype(np.float64)
        columns = np.ascontiguousarray(block.dense[used].T)
        for lo in range(0, len(q), 4096):
            x = slice(lo, lo + 4096)
            score[x] += np.einsum("ij,ij->i", factors[q[x]], columns[c[x]])
        score = np.round(score, decimals)
        keep = (score >= self.floor[q]) & (score > 0)
        return q[keep], c[keep], score[keep]

    def add(self, q: np.ndarray, at: np.ndarray, c: np.ndarray, score: np.ndarray, times: np.ndarray) -> None:
        self.new.append((q, at, c, score, times))
        self.count += len(q)
        if not len(self.q) or 2 * self.count > len(self.q):
            self.settle()

    def settle(self) -> None:
        """Drop what can't be among the best: where as many chunks have higher scores. The floor is the last place's."""
        q, at, c, score, times = (np.concatenate(x) for x in zip((self.q, self.at, self.c, self.score, self.times), *self.new))
        self.new, self.count = [], 0
        order = np.lexsort((-score, q))
        q, at, c, score, times = (x[order] for x in (q, at, c, score, times))
        before = np.cumsum(np.minimum(times, self.top)) - np.minimum(times, self.top)
        own = np.concatenate([[True], q[1:] != q[:-1]])[: len(q)]
        tied = np.flatnonzero(own | np.concatenate([[True], score[1:] != score[:-1]])[: len(q)])
        above = np.repeat(before[tied], np.diff(np.append(tied, len(q)))) - np.repeat(before[own], np.diff(np.append(np.flatnonzero(own), len(q))))
        keep = above < self.top
        self.q, self.at, self.c, self.score, self.times = (x[keep] for x in (q, at, c, score, times))
        full = np.bincount(self.q, np.minimum(self.times, self.top), self.size) >= self.top
        least = np.full(self.size, np.inf)
        np.minimum.at(least, self.q, self.score)
        self.floor = np.where(full, least, 0.0)


def rank_within(rows: DataFrame, keys: list[str], order: list[Column], top: int | None = None, into: str = "rank") -> DataFrame:
    """Number the rows of every group in order, and keep the first ``top``."""
    ranked = rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if top is None else ranked.where(F.col(into) <= top)


def explain_questions(questions: DataFrame, index: Index, tokenizer: Tokenizer | None = None, top: int = 5) -> DataFrame:
    """Rows ``qid, known, unknown``: the terms of highest idf, and those the index doesn't have, in order."""
    found = tokens_of(questions, ["qid"], "question", tokenizer or Tokenizer()).select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    terms = found.join(index.terms, "term", "left")
    known = F.array_sort(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct((-F.round("idf", 6)).alias("s"), "term"))))
    unknown = F.array_sort(F.collect_list(F.when(F.col("idf").isNull(), F.col("term"))))
    rows = terms.groupBy("qid").agg(F.slice(known, 1, top).alias("k"), unknown.alias("u"))
    return rows.select("qid", F.array_join(F.transform("k", lambda x: x["term"]), " ").alias("known"), F.array_join("u", " ").alias("unknown"))


def index_summary(index: Index) -> DataFrame:
    """One row: chunks, documents, vocabulary, postings, mean length."""
    counts = index.terms.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return counts.select(F.lit(index.chunks).cast("long").alias("chunks"), F.lit(index.documents).cast("long").alias("documents"), "vocabulary", "postings", F.round(F.lit(index.average_length), 6).alias("mean_length"))
