"""Combining rankings: weighted reciprocal ranks, label propagation, rescoring and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.bm25 import rank_within


def normalized(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to one; negative ones and a sum of zero are errors."""
    total = sum(weights.values())
    if min(weights.values(), default=0) < 0 or total <= 0:
        raise ValueError("weights are 0 or more, and not all 0")
    return {k: w / total for k, w in weights.items()}


def sweep(names: list[str], base: dict[str, float], first: float) -> dict[str, float]:
    """The weight ``first`` for the first source; the others share the rest as in ``base``, or equally."""
    rest = names[1:]
    total = sum(base[n] for n in rest)
    return {names[0]: first} | {n: (1 - first) * (base[n] / total if total else 1 / len(rest)) for n in rest}


def fuse(rankings: dict[str, DataFrame], weights: dict[str, float], k: int = 60, absent_rank: int | None = None, item: str = "doc_id", tie: str | None = None, top: int | None = None, decimals: int = 9, rescale: bool = True, carry: str | None = None) -> DataFrame:
    """Rows ``qid, item, score, rank``, and ``carry`` if named: the sum of ``weight / (k + rank)`` over the sources that have the item.

    A source of weight 0 contributes nothing, not even items. With ``absent_rank`` an item also gets every source's
    share at that rank where the source lacks it: one constant less what the present sources would have given there, so
    one aggregation over the union does. Equal scores go by the rank in source ``tie``, then by item. The column ``carry``
    is that of the source, even of weight 0, which ranks the item highest. The rows are shuffled once, by question."""
    weights = {n: w for n, w in (normalized(weights) if rescale else weights).items() if w > 0 or carry}
    carried = F.col(carry) if carry else F.lit(None).cast("string")
    parts = [rankings[n].select("qid", F.col(item).alias("item"), F.lit(n).alias("source"), "rank", F.lit(float(w)).alias("w"), carried.alias("carry")) for n, w in weights.items()]
    rows = reduce(DataFrame.unionByName, parts).repartition("qid")
    share = F.col("w") / (k + F.col("rank"))
    score = F.sum(share)
    if absent_rank is not None:
        everywhere = sum(weights.values()) / (k + absent_rank)
        score = F.sum(share - F.col("w") / (k + absent_rank)) + F.lit(everywhere)
    first = F.min(F.when(F.col("source") == tie, F.col("rank"))) if tie else F.lit(None).cast("int")
    highest = F.min(F.struct("rank", "carry"))["carry"]
    fused = rows.groupBy("qid", "item").agg(F.round(score, decimals).alias("score"), first.alias("__tie"), highest.alias("__carry"), F.max("w").alias("__w"))
    ranked = rank_within(fused.where("__w > 0"), ["qid"], [F.col("score").desc(), F.col("__tie").asc_nulls_last(), F.col("item")], top)
    return ranked.select("qid", F.col("item").alias(item), "score", "rank", *([F.col("__carry").alias(carry)] if carry else []))


def neighbour_documents(similar: DataFrame, neighbours: int = 50, top: int | None = None, decimals: int = 6) -> DataFrame:
    """Rows ``qid, doc_id, score, rank``: documents by the labels of the most similar questions.

    ``similar`` has ``qid, item_id, answer, score, rank`` with one more neighbour than wanted, the question itself perhaps
    among them; ``answer`` is the neighbour's documents as JSON, which spares a join of all neighbours to their labels. A
    neighbour gives its documents its score as a share of the best one's. The rows are shuffled once, by question."""
    others = similar.where("qid <> item_id").repartition("qid")
    kept = rank_within(others, ["qid"], [F.col("rank")], neighbours, "place")
    share = kept.withColumn("share", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
    documents = share.select("qid", "share", F.explode(F.from_json("answer", "array<string>")).alias("doc_id"))
    scored = documents.groupBy("qid", "doc_id").agg(F.round(F.sum("share"), decimals).alias("score"))
    return rank_within(scored, ["qid"], [F.col("score").desc(), F.col("doc_id")], top)


def rescore_by_overlap(ranking: DataFrame, question_words: DataFrame, name_words: DataFrame, factor: float, decimals: int = 6) -> DataFrame:
    """Scores times ``1 + factor * share of the name's words in the question``; equal scores keep their old order."""
    rows = ranking.join(question_words, "qid", "left").join(name_words, "doc_id", "left")
    size = F.coalesce(F.size("name_words"), F.lit(0))
    shared = F.coalesce(F.size(F.array_intersect("question_words", "name_words")), F.lit(0))
    bonus = F.when(size > 0, shared / size).otherwise(0.0)
    rows = rows.select("qid", "doc_id", F.round(F.col("score") * (1 + factor * bonus), decimals).alias("score"), F.col("rank").alias("old_rank"))
    return rank_within(rows, ["qid"], [F.col("score").desc(), F.col("old_rank")])


def vote_domain(ranking: DataFrame, domains: DataFrame, depth: int = 10, decimals: int = 6) -> DataFrame:
    """Rows ``qid, domain``: the domain with the largest sum of scores in the first ``depth`` ranks; of equal ones that
    seen first."""
    votes = ranking.where(F.col("rank") <= depth).join(domains, "doc_id", "left").groupBy("qid", F.coalesce("domain", F.lit("?")).alias("domain"))
    votes = votes.agg(F.round(F.sum("score"), decimals).alias("votes"), F.min("rank").alias("seen"))
    return rank_within(votes, ["qid"], [F.col("votes").desc(), F.col("seen")], 1, "place").select("qid", "domain")


def apply_domain(ranking: DataFrame, domains: DataFrame, chosen: DataFrame, boost: float | None = None, decimals: int = 6) -> DataFrame:
    """Only documents of the chosen domain, or with ``boost`` all, theirs at ``1 + boost`` times the score. A document
    that has no row in ``domains`` votes for ?, but is of no domain itself."""
    rows = ranking.join(domains, "doc_id", "left").join(chosen.withColumnRenamed("domain", "chosen"), "qid")
    fits = F.coalesce(F.col("domain") == F.col("chosen"), F.lit(False))
    if boost is None:
        rows = rows.where(fits)
        return rank_within(rows.select("qid", "doc_id", "score", F.col("rank").alias("old_rank")), ["qid"], [F.col("old_rank")])
    score = F.round(F.when(fits, F.col("score") * (1 + boost)).otherwise(F.col("score")), decimals)
    return rank_within(rows.select("qid", "doc_id", score.alias("score"), F.col("rank").alias("old_rank")), ["qid"], [F.col("score").desc(), F.col("old_rank")])


def rerank(ranking: DataFrame, scores: DataFrame, depth: int, mode: str = "replace", k: int = 60, weight: float = 0.5, decimals: int = 9) -> DataFrame:
    """Rows ``qid, doc_id, score, rank``: the first ``depth`` in the order of ``scores`` (qid, doc_id, rerank_score; the
    best of several), or of both orders' reciprocal ranks (``rrf``); the tail unchanged, scores as retrieved."""
    if mode not in ("replace", "rrf"):
        raise ValueError(f"unknown mode {mode!r}")
    best = scores.groupBy("qid", "doc_id").agg(F.max("rerank_score").alias("rerank_score"))
    head = ranking.where(F.col("rank") <= depth).join(best, ["qid", "doc_id"], "left")
    by_score = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rank")))
    head = head.withColumn("second", by_score)
    key: Column = F.col("second").cast("double")
    if mode == "rrf":
        key = -F.round((1 - weight) / (k + F.col("rank")) + weight / (k + F.col("second")), decimals)
    head = head.select("qid", "doc_id", "score", F.lit(0).alias("part"), key.alias("key"), F.col("rank").alias("old"))
    tail = ranking.where(F.col("rank") > depth).select("qid", "doc_id", "score", F.lit(1).alias("part"), F.col("rank").cast("double").alias("key"), F.col("rank").alias("old"))
    return rank_within(head.unionByName(tail), ["qid"], [F.col("part"), F.col("key"), F.col("old")]).select("qid", "doc_id", "score", "rank")


def overlap_scores(pairs: DataFrame, question: str, text: str) -> DataFrame:
    """A deterministic scorer in place of a model: the share of the question's words that the text has."""
    share = F.size(F.array_intersect(question, text)) / F.greatest(F.size(F.array_distinct(F.col(question))), F.lit(1))
    return pairs.withColumn("rerank_score", F.round(share, 6))


def interleave(a: Column, b: Column) -> Column:
    """Two lists taken in turn, as far as the shorter goes, each item once."""
    size = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size), lambda x, y: F.array(x, y))
    return F.array_distinct(F.flatten(pairs))
