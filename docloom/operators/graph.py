"""The citation graph, its neighbourhoods, and groups that must not be split."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.components import connected_components

# What tells an amendment from a citation, and how far before it.
AMENDMENTS = ("sửa đổi", "bổ sung", "thay thế", "bãi bỏ", "hết hiệu lực", "hợp nhất")
AMEND_WINDOW = 120
_CITED = re.compile(rf"\b({tx.CITED})\b")
_AMENDS = re.compile("|".join(AMENDMENTS), re.I)


def document_codes(corpus: DataFrame) -> DataFrame:
    """Rows ``code, doc_id``: whose own code it is; where several claim it, the first in the order of the corpus, which is
    that of its files' names and so of the ids as text."""
    rows = corpus.select("doc_id", tx.own_code(F.col("name"), F.col("text")).alias("code")).where("code is not null")
    return rows.groupBy("code").agg(F.min("doc_id").alias("doc_id"))


def _citations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, code, kind = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for match in _CITED.finditer(text):
                before = text[max(0, match.start() - AMEND_WINDOW) : match.start()]
                src.append(doc)
                code.append(match.group(1).upper())
                kind.append("amend" if _AMENDS.search(before) else "cite")
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(code, pa.string()), pa.array(kind, pa.string())], ["src", "code", "kind"])


def citations(corpus: DataFrame) -> DataFrame:
    """Rows ``src, code, kind`` of all codes cited in the texts. What stands before a match decides its kind, and
    built-in expressions give no offsets, so the texts pass through Arrow."""
    return corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_citations, "src string, code string, kind string")


def citation_edges(corpus: DataFrame) -> DataFrame:
    """Rows ``src, dst, kind``: a document cites another of the corpus by its code; amendments win over citations.

    A code is combined with its source before the join, so a code that everyone cites has one row a document."""
    own = corpus.select(F.col("doc_id").alias("src"), tx.own_code(F.col("name"), F.col("text")).alias("own"))
    cited = citations(corpus).groupBy("src", "code").agg(F.min("kind").alias("kind"))  # amend < cite
    codes = document_codes(corpus).withColumnRenamed("doc_id", "dst")
    rows = cited.join(codes, "code").where("src <> dst").join(own, "src").where("own is null or own <> code")
    return rows.groupBy("src", "dst").agg(F.min("kind").alias("kind"))


def graph_summary(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: documents, edges, amendments, mean and largest number of outgoing edges, documents without any."""
    degrees = edges.groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("out"), F.count_if(F.col("kind") == "amend").alias("amend"))
    touched = edges.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct().withColumn("t", F.lit(1))
    rows = corpus.select("doc_id").join(degrees, "doc_id", "left").join(touched, "doc_id", "left")
    return rows.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("edges"),
        F.coalesce(F.sum("amend"), F.lit(0)).alias("amendments"),
        F.round(F.coalesce(F.sum("out"), F.lit(0)) / F.count("*"), 2).alias("mean_out"),
        F.coalesce(F.max("out"), F.lit(0)).alias("largest_out"),
        F.count_if(F.col("t").isNull()).alias("isolated"),
    )


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1, kinds: tuple[str, ...] = ("cite", "amend")) -> DataFrame:
    """Rows ``seed, doc_id, hop``: documents within ``hops`` edges of a seed in either direction, at their least
    distance; the seed itself isn't one. Every hop is a join of the frontier, of which known rows are dropped."""
    used = edges.where(F.col("kind").isin(*kinds))
    both = used.select(F.col("src").alias("at"), F.col("dst").alias("to")).union(used.select(F.col("dst").alias("at"), F.col("src").alias("to"))).distinct()
    frontier = seeds.select(F.col("doc_id").alias("seed"), F.col("doc_id").alias("at")).distinct()
    seen = frontier.select("seed", F.col("at").alias("doc_id"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        reached = frontier.join(both, "at").select("seed", F.col("to").alias("doc_id")).distinct()
        reached = reached.join(seen, ["seed", "doc_id"], "left_anti")
        seen = seen.unionByName(reached.withColumn("hop", F.lit(hop)))
        frontier = reached.select("seed", F.col("doc_id").alias("at"))
    return seen.where("hop > 0")


def leak_groups(questions: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows ``qid, group_id``: questions whose gold documents touch the same group of duplicates, directly or through
    questions that touch several, belong together; every other question is its own group."""
    gold = questions.select("qid", F.explode("answer").alias("doc_id"))
    touched = gold.join(duplicates.select("doc_id", "group_key"), "doc_id").select("qid", F.concat(F.lit("group:"), "group_key").alias("cluster")).distinct()
    edges = touched.select(F.concat(F.lit("question:"), "qid").alias("q"), "cluster")
    parts = connected_components(edges, "q", "cluster").where("node like 'question:%'").select(F.substring("node", F.lit(len("question:") + 1), F.length("node")).alias("qid"), "component")
    smallest = parts.groupBy("component").agg(F.min("qid").alias("g"))
    grouped = parts.join(smallest, "component").select("qid", F.concat(F.lit("group_"), "g").alias("group_id"))
    return questions.select("qid").join(grouped, "qid", "left").select("qid", F.coalesce("group_id", "qid").alias("group_id"))


def reachable_gold(missed: DataFrame, ranking: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """Rows ``qid, reachable``: whether a missed question's gold documents are neighbours of its first documents."""
    seeds = ranking.where(F.col("rank") <= depth).join(missed.select("qid"), "qid")
    near = neighbours(edges, seeds.select("doc_id")).select(F.col("seed").alias("doc_id"), F.col("doc_id").alias("near"))
    found = seeds.join(near, "doc_id").select("qid", F.col("near").alias("doc_id")).distinct()
    hit = found.join(missed.select("qid", F.explode("answer").alias("doc_id")), ["qid", "doc_id"]).select("qid").distinct().withColumn("r", F.lit(True))
    return missed.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("r", F.lit(False)).alias("reachable"))


def cited_by_question(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows ``qid, doc_id``: documents whose code a question names."""
    named = questions.select(F.col("qid"), F.explode(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(tx.CITED_CODE), 1)).alias("code"))
    return named.select("qid", F.upper("code").alias("code")).distinct().join(document_codes(corpus), "code").select("qid", "doc_id").distinct()


def title_table(corpus: DataFrame) -> DataFrame:
    """Rows ``doc_id, title`` of documents whose head names their kind."""
    return corpus.select("doc_id", tx.title(F.col("text")).alias("title")).where("title is not null")


def reach_probe(ranking: DataFrame, gold: DataFrame, edges: DataFrame, depth: int = 5, hops: int = 1) -> DataFrame:
    """One row ``questions, hit, reach_any, reach_top1, median_added``: ranked questions, those with a gold document in the
    first ``depth``, the missed ones with a gold document near those or near the first, and the upper median of how many
    documents the neighbourhoods add."""
    none = F.array().cast("array<string>")
    head = ranking.where(F.col("rank") <= depth).join(gold.select("qid"), "qid", "left_semi")
    lists = head.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("d")).select("qid", F.transform("d", lambda x: x["doc_id"]).alias("d"))
    asked = gold.join(lists, "qid").withColumn("missed", F.size(F.array_intersect("answer", "d")) == 0)
    seeds = head.join(asked.where("missed").select("qid"), "qid", "left_semi").select("qid", "rank", "doc_id")
    near = neighbours(edges, seeds.select("doc_id"), hops).select(F.col("seed").alias("doc_id"), F.col("doc_id").alias("near"))
    reached = seeds.join(near, "doc_id").groupBy("qid").agg(F.collect_set("near").alias("near"), F.collect_set(F.when(F.col("rank") == 1, F.col("near"))).alias("near1"))
    rows = asked.join(reached, "qid", "left").select("answer", "d", "missed", *(F.coalesce(c, none).alias(c) for c in ("near", "near1")))
    added = F.when(F.col("missed"), F.size(F.array_except("near", "d")))
    hit = lambda c: F.coalesce(F.col("missed") & (F.size(F.array_intersect("answer", c)) > 0), F.lit(False))
    counts = rows.agg(F.count("*").alias("questions"), F.count_if(~F.col("missed")).alias("hit"), F.count_if(hit("near")).alias("reach_any"), F.count_if(hit("near1")).alias("reach_top1"))
    sizes = rows.where("missed").groupBy(added.alias("n")).agg(F.count("*").alias("k"))
    order = sizes.select("n", F.sum("k").over(Window.orderBy("n")).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("all"))
    middle = order.agg(F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))), F.lit(0)).alias("median_added"))
    return counts.join(F.broadcast(middle))
