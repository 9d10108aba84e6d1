"""Audits of labelled questions against each other, the corpus and its duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.bm25 import rank_within
from docloom.operators.corpus import first_delivery


def distinct_questions(rows: DataFrame) -> DataFrame:
    """Questions without repeated deliveries: the first by time counts."""
    return first_delivery(rows, "qid", ["asked_at"])


def labelled(rows: DataFrame) -> DataFrame:
    """Rows ``qid, question, answer`` with a gold document, each document once."""
    known = distinct_questions(rows).where(F.coalesce(F.size("answer"), F.lit(0)) > 0)
    return known.select("qid", "question", F.array_distinct("answer").alias("answer"))


def answer_counts(questions: DataFrame) -> DataFrame:
    """Rows ``answers, questions, ceiling`` where ceiling is the precision of five documents at best."""
    sizes = questions.groupBy(F.coalesce(F.size("answer"), F.lit(0)).alias("answers")).agg(F.count("*").alias("questions"))
    return sizes.select("answers", "questions", (F.least("answers", F.lit(5)) / 5).alias("ceiling"))


def label_conflicts(questions: DataFrame) -> DataFrame:
    """Rows ``question_key, questions, gold_sets, disjoint`` of questions asked several times with different gold sets;
    disjoint if no document is in all of them."""
    rows = questions.where(~tx.is_blank(F.col("question"))).select("qid", tx.question_key(F.col("question")).alias("question_key"), F.array_join(F.array_sort("answer"), "|").alias("gold"), "answer")
    groups = rows.groupBy("question_key").agg(F.count("*").alias("questions"), F.count_distinct("gold").alias("gold_sets")).where("gold_sets > 1")
    shared = rows.select("question_key", F.explode("answer").alias("d")).groupBy("question_key", "d").agg(F.count("*").alias("n")).groupBy("question_key").agg(F.max("n").alias("most"))
    return groups.join(shared, "question_key").select("question_key", "questions", "gold_sets", (F.col("most") < F.col("questions")).alias("disjoint"))


def consistent_surplus(questions: DataFrame) -> DataFrame:
    """One row: groups of equal questions with equal gold sets, and how many questions they are too many."""
    rows = questions.where(~tx.is_blank(F.col("question"))).groupBy(tx.question_key(F.col("question")).alias("k")).agg(F.count("*").alias("n"), F.count_distinct(F.array_join(F.array_sort("answer"), "|")).alias("g"))
    return rows.where("n > 1 and g = 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def id_coverage(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: gold documents, those not in the corpus, and corpus documents that are never gold."""
    gold = questions.select(F.explode("answer").alias("doc_id")).distinct()
    both = gold.withColumn("g", F.lit(1)).join(corpus.select("doc_id", F.lit(1).alias("c")), "doc_id", "full")
    return both.agg(F.count("g").alias("gold"), F.count_if(F.col("c").isNull()).alias("orphans"), F.count_if(F.col("g").isNull()).alias("unused"))


def broken_gold(questions: DataFrame, corpus: DataFrame, short: int = 200) -> DataFrame:
    """Rows ``qid, doc_id, problem``: gold documents that are missing or shorter than ``short`` characters."""
    gold = questions.select("qid", F.explode("answer").alias("doc_id"))
    rows = gold.join(corpus.select("doc_id", F.length("text").alias("size")), "doc_id", "left")
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("size") < short, "short")
    return rows.select("qid", "doc_id", problem.alias("problem")).where("problem is not null")


# What announces that the content is in an attached file.
ATTACH_MARKERS = ("FILE ĐƯỢC ĐÍNH KÈM", "FILE ĐÍNH KÈM")


def suspicious_gold(questions: DataFrame, corpus: DataFrame, short: int = 2500) -> DataFrame:
    """Rows ``qid, doc_id, chars, flags``: gold documents of a question that may be cut, being shorter than ``short``
    characters (SHORT) or naming an attached file (ATTACH), or both (SHORT+ATTACH). The documents are flagged before the
    join, so no text is moved."""
    capitals = F.upper("text")
    attached = F.lit(False)
    for marker in ATTACH_MARKERS:
        attached = attached | capitals.contains(marker)
    flags = F.concat_ws("+", F.when(F.length("text") < short, "SHORT"), F.when(attached, "ATTACH"))
    flagged = corpus.select("doc_id", F.length("text").alias("chars"), flags.alias("flags")).where("flags <> ''")
    return questions.select("qid", F.explode("answer").alias("doc_id")).join(flagged, "doc_id").select("qid", "doc_id", "chars", "flags")


def overloaded(frequency: DataFrame, least: int = 10, most: int = 20) -> DataFrame:
    """The ``most`` most frequent gold documents that are gold for at least ``least`` questions (cut before filtered)."""
    return frequency.orderBy(F.col("n").desc(), "doc_id").limit(most).where(F.col("n") >= least)


def gold_in_duplicates(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows ``qid, group_key, gold_members, group_size, kind``: a question's smallest group of duplicates with gold
    documents. BOTH if it has several as gold, PARTIAL if copies of its gold aren't gold."""
    gold = questions.select("qid", F.explode("answer").alias("doc_id"))
    met = gold.join(groups, "doc_id").groupBy("qid", "group_key").agg(F.count("*").alias("gold_members"), F.max("group_size").alias("group_size"))
    first = rank_within(met, ["qid"], [F.col("group_key")], 1, "__n").drop("__n")
    return first.withColumn("kind", F.when(F.col("gold_members") > 1, "BOTH").otherwise("PARTIAL"))


def keep_of_duplicates(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows ``group_key, gold_members, keep``: without gold the shortest id, then the smallest; with one gold member
    that; with more none, as someone must look."""
    gold = questions.select(F.explode("answer").alias("doc_id")).distinct().withColumn("g", F.lit(1))
    rows = groups.join(gold, "doc_id", "left")
    smallest = F.min(F.struct(F.length("doc_id").alias("l"), F.col("doc_id").alias("d")))["d"]
    kept = F.when(F.count("g") == 0, smallest).when(F.count("g") == 1, F.min(F.when(F.col("g") == 1, F.col("doc_id"))))
    return rows.groupBy("group_key").agg(F.count("g").alias("gold_members"), kept.alias("keep"))


def question_lengths(questions: DataFrame) -> DataFrame:
    """One row: mean, smallest and largest number of words of questions that have any, and how many have two or fewer."""
    words = questions.select(tx.word_count(F.coalesce("question", F.lit(""))).alias("w"))
    some = F.when(F.col("w") > 0, F.col("w"))
    return words.agg(F.round(F.avg(some), 1).alias("mean"), F.min(some).alias("least"), F.max("w").alias("most"), F.count_if(F.col("w") <= 2).alias("short"))


def duplicate_statistics(questions: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """One row: groups of equal passages and of equal links with their documents, questions with several gold documents,
    those with several in one group, and those whose gold has a copy that isn't gold, also in percent."""
    gold = questions.select("qid", F.explode("answer").alias("doc_id"))
    met = gold.join(groups, "doc_id").groupBy("qid", "group_key").agg(F.count("*").alias("inside"), F.max("group_size").alias("size"))
    per = met.groupBy("qid").agg(F.max("inside").alias("most"), F.bool_or(F.col("inside") < F.col("size")).alias("risk"))
    passages = groups.agg(F.count_distinct("group_key").alias("passage_groups"), F.count("*").alias("passage_documents"))
    linked = links.agg(F.count("*").alias("link_groups"), F.coalesce(F.sum("documents"), F.lit(0)).alias("link_documents"))
    asked = questions.agg(F.count("*").alias("all"), F.count_if(F.size("answer") > 1).alias("multi_answer_questions"))
    found = per.agg(F.count_if(F.col("most") > 1).alias("several_gold_in_a_group"), F.count_if("risk").alias("questions_at_risk"))
    row = passages.join(F.broadcast(linked)).join(F.broadcast(asked)).join(F.broadcast(found))
    return row.withColumn("percent_at_risk", F.round(100 * F.col("questions_at_risk") / F.col("all"), 2)).drop("all")
