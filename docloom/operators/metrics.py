"""Evaluation of rankings and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ANSWERS = 5
# Tiers by how often a document is gold.
TIERS = ((0, 0, "0"), (1, 2, "1-2"), (3, 10, "3-10"), (11, None, "11+"))


def top_lists(ranking: DataFrame, depth: int) -> DataFrame:
    """Rows ``qid, answer``: the first documents of each question in order."""
    rows = ranking.where(F.col("rank") <= depth).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("a"))
    return rows.select("qid", F.transform("a", lambda x: x["doc_id"]).alias("answer"))


def hits(predicted: Column, gold: Column) -> Column:
    """How many different documents both lists have. The element types must agree: comparing numbers with text is an
    error, not a silent zero."""
    return F.size(F.array_intersect(predicted, gold))


def official_score(predicted: DataFrame, gold: DataFrame, decimals: int = 6) -> DataFrame:
    """One row ``questions, recall, precision``: means over the questions of ``gold``.

    A question with no answer or more than five counts 0 on both; precision divides by the answers as given, repeated
    ones included. The two tables must have the same questions."""
    missing = gold.join(predicted, "qid", "left_anti").count(), predicted.join(gold, "qid", "left_anti").count()
    if any(missing):
        raise ValueError(f"{missing[0]} questions without prediction, {missing[1]} predictions without question")
    return score_rows(predicted, gold).agg(F.count("*").alias("questions"), F.round(F.avg("recall"), decimals).alias("recall"), F.round(F.avg("precision"), decimals).alias("precision"))


def score_rows(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows ``qid, recall, precision``."""
    rows = gold.select("qid", F.col("answer").alias("gold")).join(predicted, "qid")
    valid = F.size("answer").between(1, MAX_ANSWERS)
    shared = hits(F.col("answer"), F.col("gold"))
    recall = F.when(valid, shared / F.size(F.array_distinct("gold"))).otherwise(0.0)
    precision = F.when(valid, shared / F.size("answer")).otherwise(0.0)
    return rows.select("qid", recall.alias("recall"), precision.alias("precision"))


def recall_per_question(ranking: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Rows ``qid, k, recall`` for every question of ``gold`` and every depth; gold lists must not be empty."""
    lists = top_lists(ranking, max(ks)).withColumnRenamed("answer", "got")
    rows = gold.join(lists, "qid", "left").select("qid", "answer", F.coalesce("got", F.array().cast("array<string>")).alias("got"), F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"))
    return rows.select("qid", "k", (hits(F.slice("got", F.lit(1), F.col("k")), F.col("answer")) / F.size(F.array_distinct("answer"))).alias("recall"))


def recall_at(ranking: DataFrame, gold: DataFrame, ks: list[int], decimals: int = 6) -> DataFrame:
    return recall_per_question(ranking, gold, ks).groupBy("k").agg(F.round(F.avg("recall"), decimals).alias("recall"))


def gold_frequency(labels: DataFrame) -> DataFrame:
    """Rows ``doc_id, n``: how many questions have the document as gold."""
    return labels.select(F.explode(F.array_distinct("answer")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))


def tier(frequency: Column) -> Column:
    out = F.when(F.lit(False), "")
    for low, high, name in TIERS:
        out = out.when((frequency >= low) & (F.lit(True) if high is None else frequency <= high), name)
    return out


def question_tiers(gold: DataFrame, frequency: DataFrame) -> DataFrame:
    """Rows ``qid, tier``, by the rarest of a question's gold documents."""
    rows = gold.select("qid", F.explode("answer").alias("doc_id")).join(frequency, "doc_id", "left")
    return rows.groupBy("qid").agg(tier(F.min(F.coalesce("n", F.lit(0)))).alias("tier"))


def recall_by_tier(ranking: DataFrame, gold: DataFrame, frequency: DataFrame, ks: list[int], decimals: int = 6) -> DataFrame:
    """Rows ``k, tier, questions, recall, spread`` where spread is the best tier's recall less the worst's."""
    rows = recall_per_question(ranking, gold, ks).join(question_tiers(gold, frequency), "qid")
    means = rows.groupBy("k", "tier").agg(F.count("*").alias("questions"), F.avg("recall").alias("r"))
    at = Window.partitionBy("k")
    return means.select("k", "tier", "questions", F.round("r", decimals).alias("recall"), F.round(F.max("r").over(at) - F.min("r").over(at), decimals).alias("spread"))


def diagnose(predicted: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """One row of counts of what would fail silently, and the mean number of answers."""
    repeated = F.sum(F.size("answer") - F.size(F.array_distinct("answer")))
    unknown = predicted.select(F.explode("answer").alias("doc_id")).distinct().join(corpus_ids, "doc_id", "left_anti").agg(F.count("*").alias("unknown_ids"))
    counts = predicted.agg(
        F.count("*").alias("questions"),
        repeated.alias("repeated"),
        F.count_if(F.size("answer") > MAX_ANSWERS).alias("too_many"),
        F.count_if(F.size("answer") == 0).alias("empty"),
        F.count_if(F.exists("answer", lambda a: a.isNull() | (F.trim(a) != a) | (a == ""))).alias("odd_ids"),
        F.round(F.avg(F.size("answer")), 6).alias("mean_answers"),
    )
    return counts.join(F.broadcast(unknown))


def size_histogram(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(F.size("answer").alias("size")).agg(F.count("*").alias("questions"))


def dedupe_and_cut(answers: Column, most: int = MAX_ANSWERS) -> Column:
    """Text ids, each once in order of first appearance, and then the first ``most``."""
    return F.slice(F.array_distinct(F.transform(answers, lambda a: a.cast("string"))), 1, most)


def compare_runs(a: DataFrame, b: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Rows ``k, questions, both, only_a, only_b, neither, a_wins, b_wins, ties``: hits and recall of two rankings over
    the same questions."""
    ra = recall_per_question(a, gold, ks).withColumnRenamed("recall", "ra")
    rb = recall_per_question(b, gold, ks).withColumnRenamed("recall", "rb")
    x, y = F.col("ra") > 0, F.col("rb") > 0
    return ra.join(rb, ["qid", "k"]).groupBy("k").agg(
        F.count("*").alias("questions"),
        F.count_if(x & y).alias("both"),
        F.count_if(x & ~y).alias("only_a"),
        F.count_if(~x & y).alias("only_b"),
        F.count_if(~x & ~y).alias("neither"),
        F.count_if(F.col("ra") > F.col("rb")).alias("a_wins"),
        F.count_if(F.col("ra") < F.col("rb")).alias("b_wins"),
        F.count_if(F.col("ra") == F.col("rb")).alias("ties"),
    )


def agreement(a: DataFrame, b: DataFrame, depths: list[int]) -> DataFrame:
    """Rows ``depth, questions, same_lists, same_sets, first_divergence`` over the questions both rankings have; the last
    is the first rank at which any two lists differ."""
    la, lb = top_lists(a, max(depths)).withColumnRenamed("answer", "x"), top_lists(b, max(depths)).withColumnRenamed("answer", "y")
    rows = la.join(lb, "qid").select("x", "y", F.explode(F.array(*(F.lit(d) for d in depths))).alias("depth"))
    rows = rows.select("depth", F.slice("x", F.lit(1), F.col("depth")).alias("x"), F.slice("y", F.lit(1), F.col("depth")).alias("y"))
    return rows.groupBy("depth").agg(F.count("*").alias("questions"), F.count_if(F.col("x") == F.col("y")).alias("same_lists"), F.count_if(F.array_sort("x") == F.array_sort("y")).alias("same_sets"), F.min(_first_difference("x", "y")).alias("first_divergence"))


def _first_difference(a: str, b: str) -> Column:
    """The first place at which two arrays differ, from 1; null if they don't."""
    longest = F.greatest(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(0), longest), lambda i: (i < longest) & F.get(a, i).eqNullSafe(F.get(b, i)))
    place = F.array_position(same, F.lit(False))
    return F.when(place <= longest, place).cast("int")


def cap_equivalence(full: DataFrame, capped: DataFrame, gold: DataFrame, top: int, k: int, decimals: int = 4) -> DataFrame:
    """One row: questions, those whose list or set of the first ``top`` documents a cap changes, and the recall at ``k``
    and ``top`` of both rankings."""
    a, b = (top_lists(r, top).withColumnRenamed("answer", n) for r, n in ((full, "x"), (capped, "y")))
    both = a.join(b, "qid").agg(F.count("*").alias("questions"), F.count_if(F.col("x") != F.col("y")).alias("list_diff"), F.count_if(F.array_sort("x") != F.array_sort("y")).alias("set_diff"))
    for ranking, name in ((full, "full"), (capped, "capped")):
        recalls = recall_per_question(ranking, gold, [k, top])
        both = both.join(F.broadcast(recalls.agg(*(F.round(F.avg(F.when(F.col("k") == d, F.col("recall"))), decimals).alias(f"recall_{d}_{name}") for d in (k, top)))))
    return both


def failure_modes(ranking: DataFrame, gold: DataFrame, near: int = 5, far: int = 50) -> DataFrame:
    """Rows ``qid, mode``: OK if the near ranks have all gold documents, MISS50 if the far ranks have none, else MISS5."""
    lists = top_lists(ranking, far).withColumnRenamed("answer", "got")
    rows = gold.join(lists, "qid", "left").select("qid", "answer", F.coalesce("got", F.array().cast("array<string>")).alias("got"))
    missed = F.size(F.array_except("answer", F.slice("got", 1, near)))
    found = F.size(F.array_intersect("answer", "got"))
    return rows.select("qid", F.when(missed == 0, "OK").when(found == 0, "MISS50").otherwise("MISS5").alias("mode"))


def failure_sample(modes: DataFrame, wanted: dict[str, int], decimals: int = 6) -> DataFrame:
    """Rows ``mode, questions, taken, rescale``: how many questions of each wanted mode a sample takes, and the factor that
    brings its share in the sample back to that among all questions."""
    all_ = modes.agg(F.count("*").alias("all"))
    take = F.coalesce(*(F.when(F.col("mode") == m, F.lit(n)) for m, n in wanted.items()))
    counts = modes.groupBy("mode").agg(F.count("*").alias("questions")).where(take.isNotNull()).withColumn("taken", F.least(F.col("questions"), take))
    share = F.try_divide(F.col("questions") * sum(wanted.values()), F.col("all") * F.col("taken"))
    return counts.join(F.broadcast(all_)).select("mode", "questions", "taken", F.round(share, decimals).alias("rescale"))


def ranking_contract(ranking: DataFrame, top: int) -> DataFrame:
    """One row of violations: too long, documents repeated, scores rising, ranks with gaps."""
    by = Window.partitionBy("qid").orderBy("rank")
    rows = ranking.withColumn("rising", F.coalesce(F.col("score") > F.lag("score").over(by), F.lit(False)))
    per = rows.groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.count_if("rising").alias("r"), F.max("rank").alias("last"))
    return per.agg(F.count("*").alias("questions"), F.count_if(F.col("n") > top).alias("too_long"), F.count_if(F.col("n") > F.col("d")).alias("repeated"), F.coalesce(F.sum("r"), F.lit(0)).alias("rising"), F.count_if(F.col("n") != F.col("last")).alias("gaps"))


def list_differences(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Rows ``qid, only_a, only_b, symmetric``: how many of the first documents stand in one of two rankings alone."""
    both = top_lists(a, depth).join(top_lists(b, depth).withColumnRenamed("answer", "other"), "qid")
    rows = both.select("qid", F.size(F.array_except("answer", "other")).alias("only_a"), F.size(F.array_except("other", "answer")).alias("only_b"))
    return rows.withColumn("symmetric", F.col("only_a") + F.col("only_b"))


def submission_shape(predicted: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of violations of a submission: questions missing or unknown, empty, too many, repeated answers."""
    both = questions.select("qid", F.lit(True).alias("asked")).join(predicted, "qid", "full")
    return both.agg(
        F.count_if(F.col("answer").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("unknown"),
        F.count_if(F.size("answer") == 0).alias("empty"),
        F.count_if(F.size("answer") > MAX_ANSWERS).alias("too_many"),
        F.count_if(F.size("answer") > F.size(F.array_distinct("answer"))).alias("repeated"),
    )
