"""Search over parameters: what is computed once, what is spread over the cells, and how good a choice really is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.bm25 import rank_within
from docloom.operators.statistics import stable_order


def fusion_recalls(a: DataFrame, b: DataFrame, gold: DataFrame, cells: list[tuple[float, int]], top: int, decimals: int = 9) -> DataFrame:
    """Rows ``w, k, qid, recall`` of fusing two rankings with weights ``w, 1 - w`` and constant ``k``. The rankings are
    read once and spread over the cells, a stated list."""
    cell = F.explode(F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(k).alias("k")) for w, k in cells)))
    rows = a.select("qid", "doc_id", "rank", F.lit(0).alias("s")).unionByName(b.select("qid", "doc_id", "rank", F.lit(1).alias("s")))
    spread = rows.select("*", cell.alias("c")).select("qid", "doc_id", "rank", "s", "c.*")
    share = F.when(F.col("s") == 0, F.col("w")).otherwise(1 - F.col("w")) / (F.col("k") + F.col("rank"))
    fused = spread.groupBy("w", "k", "qid", "doc_id").agg(F.round(F.sum(share), decimals).alias("score"))
    best = rank_within(fused, ["w", "k", "qid"], [F.col("score").desc(), F.col("doc_id")], top)
    lists = best.groupBy("w", "k", "qid").agg(F.collect_list("doc_id").alias("l"))
    wanted = gold.select("qid", "answer", cell.alias("c")).select("qid", "answer", "c.*")
    hit = F.size(F.array_intersect("answer", F.coalesce("l", F.array().cast("array<string>"))))
    return wanted.join(lists, ["w", "k", "qid"], "left").select("w", "k", "qid", (hit / F.size("answer")).alias("recall"))


def half(key: str, seed: int = 42) -> Column:
    """0 or 1 for a key, the same whenever it is asked."""
    return F.conv(F.substring(stable_order(key, seed), 1, 1), 16, 10).cast("int") % 2


def choose(recalls: DataFrame, decimals: int = 6) -> DataFrame:
    """One row ``w, k, fit, report, optimism``: the cell that is best on one half of the questions (of equal ones the
    larger w, then the smaller k), its recall on the other half, and how much more the best cell there would have had."""
    fold = recalls.withColumn("half", half("qid"))
    means = fold.groupBy("w", "k").agg(F.round(F.avg(F.when(F.col("half") == 0, F.col("recall"))), decimals).alias("fit"), F.round(F.avg(F.when(F.col("half") == 1, F.col("recall"))), decimals).alias("report"))
    best = means.agg(F.max_by(F.struct("w", "k", "fit", "report"), F.struct("fit", "w", -F.col("k"))).alias("c"), F.max("report").alias("most"))
    return best.select("c.*", F.round(F.col("most") - F.col("c.report"), decimals).alias("optimism"))


def cross_validate(recalls: DataFrame, parameter: str, decimals: int = 6) -> DataFrame:
    """Rows ``fold, parameter, recall``: for each half of the questions the parameter that is best on the other half (of
    equal ones the smallest) and its recall here. ``recalls`` has ``parameter, qid, recall``."""
    means = recalls.withColumn("half", half("qid")).groupBy(parameter, "half").agg(F.round(F.avg("recall"), decimals).alias("r"))
    chosen = means.groupBy((1 - F.col("half")).alias("fold")).agg(F.max_by(parameter, F.struct("r", -F.col(parameter))).alias(parameter))
    return chosen.join(means.withColumnRenamed("half", "fold"), ["fold", parameter]).select("fold", parameter, F.col("r").alias("recall"))


def bonus_recalls(ranking: DataFrame, question_words: DataFrame, name_words: DataFrame, gold: DataFrame, factors: list[float], top: int, decimals: int = 6) -> DataFrame:
    """Rows ``factor, qid, recall`` of rescoring by the overlap with names, for every factor."""
    rows = ranking.join(gold.select("qid"), "qid", "left_semi").join(question_words, "qid", "left").join(name_words, "doc_id", "left")
    size = F.coalesce(F.size("name_words"), F.lit(0))
    share = F.when(size > 0, F.coalesce(F.size(F.array_intersect("question_words", "name_words")), F.lit(0)) / size).otherwise(0.0)
    spread = rows.select("qid", "doc_id", "score", "rank", share.alias("share"), F.explode(F.array(*(F.lit(float(f)) for f in factors))).alias("factor"))
    spread = spread.withColumn("s", F.round(F.col("score") * (1 + F.col("factor") * F.col("share")), decimals))
    best = spread.withColumn("place", F.row_number().over(Window.partitionBy("factor", "qid").orderBy(F.col("s").desc(), "rank"))).where(F.col("place") <= top)
    lists = best.groupBy("factor", "qid").agg(F.collect_list("doc_id").alias("l"))
    wanted = gold.select("qid", "answer", F.explode(F.array(*(F.lit(float(f)) for f in factors))).alias("factor"))
    hit = F.size(F.array_intersect("answer", F.coalesce("l", F.array().cast("array<string>"))))
    return wanted.join(lists, ["factor", "qid"], "left").select("factor", "qid", (hit / F.size("answer")).alias("recall"))


def probe_scores(pairs: DataFrame, decimals: int = 6) -> DataFrame:
    """One row about a reranker's scores ``qid, doc_id, is_gold, rerank_score``: how many aren't numbers, their mean and
    deviation, and how often a question's best gold score beats its best other one."""
    bad = F.isnan("rerank_score") | (F.abs("rerank_score") == float("inf"))
    fine = F.when(~bad, F.col("rerank_score"))
    per = pairs.groupBy("qid").agg(F.max(F.when(F.col("is_gold"), fine)).alias("g"), F.max(F.when(~F.col("is_gold"), fine)).alias("o")).where("g is not null and o is not null")
    wins = per.agg(F.count("*").alias("compared"), F.round(F.avg((F.col("g") > F.col("o")).cast("double")), decimals).alias("win_rate"))
    whole = pairs.agg(F.count("*").alias("scores"), F.count_if(bad).alias("not_numbers"), F.round(F.avg(fine), decimals).alias("mean"), F.round(F.stddev_pop(fine), decimals).alias("deviation"))
    return whole.join(F.broadcast(wins))


def guard_holdout(split: str, allowed: bool = False) -> str:
    """The split's name, with an error for the part that is kept for the end unless it is asked for."""
    if split == "holdout" and not allowed:
        raise PermissionError("the holdout part is measured once, on purpose")
    return split


def weight_sweep(a: DataFrame, b: DataFrame, gold: DataFrame, weights: list[float], top: int, k: int = 60, decimals: int = 9) -> DataFrame:
    """Rows ``w, recall, chosen``: recall at ``top`` of fusing two rankings with every weight ``w`` of the second; of equal
    scores the better rank in ``a`` goes first, of the best weights the smallest is chosen."""
    rows = a.select("qid", "doc_id", F.col("rank").alias("ra"), F.lit(None).cast("int").alias("rb")).unionByName(b.select("qid", "doc_id", F.lit(None).cast("int").alias("ra"), F.col("rank").alias("rb")))
    both = rows.groupBy("qid", "doc_id").agg(F.min("ra").alias("ra"), F.min("rb").alias("rb"))
    grid = F.explode(F.array(*(F.lit(float(w)) for w in weights)))
    spread = both.select("*", grid.alias("w"))
    part = lambda weight, rank: F.coalesce(weight / (k + F.col(rank)), F.lit(0.0))
    scored = spread.withColumn("s", F.round(part(1 - F.col("w"), "ra") + part(F.col("w"), "rb"), decimals))
    best = rank_within(scored, ["w", "qid"], [F.col("s").desc(), F.col("ra").asc_nulls_last(), F.col("doc_id")], top)
    lists = best.groupBy("w", "qid").agg(F.collect_list("doc_id").alias("l"))
    wanted = gold.select("qid", "answer", grid.alias("w"))
    hit = F.size(F.array_intersect("answer", F.coalesce("l", F.array().cast("array<string>"))))
    recalls = wanted.join(lists, ["w", "qid"], "left").groupBy("w").agg(F.round(F.avg(hit / F.size("answer")), 6).alias("recall"))
    chosen = recalls.agg(F.max_by("w", F.struct("recall", -F.col("w"))).alias("best"))
    return recalls.join(F.broadcast(chosen)).select("w", "recall", (F.col("w") == F.col("best")).alias("chosen"))
