"""The queries of the operators in this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import distinctive, encode, mixing, neardup, overlap, permindex, splitter, topn, transducer, truncation
from docloom.operators.bm25 import rank_within


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- problem 1 ---------------------------------------------------------------------------------------------------


def _question_overlaps(spark: SparkSession, d: str) -> DataFrame:
    train = _table(spark, d, "train").select("qid", "question", "answer", "source")
    evals = _table(spark, d, "eval_questions").select("qid", "question", "answer", "source", "split")
    pairs = overlap.overlapping_records(evals, train, "qid", "qid", "question")
    a = evals.select(F.col("qid").alias("left_key"), F.col("answer").alias("left_answer"), "split", "source").distinct()
    b = train.select(F.col("qid").alias("right_key"), F.col("answer").alias("right_answer")).distinct()
    found = pairs.join(a, "left_key").join(b, "right_key").where(overlap.matching_answers("left_answer", "right_answer"))
    return found.drop("left_answer", "right_answer")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _question_overlaps(spark, d).select(F.col("left_key").alias("eval_qid"), F.col("right_key").alias("train_qid")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source: questions, those that stand in train, pairs, pairs that the chained seeds prove, and the mean
    coverage of the best pair."""
    found = _question_overlaps(spark, d)
    best = found.groupBy("left_key").agg(F.count("*").alias("pairs"), F.count_if("chained").alias("chained"), F.max("left_cover").alias("cover"))
    evals = _table(spark, d, "eval_questions").groupBy("qid", "split", "source").count().drop("count")
    rows = evals.join(best.withColumnRenamed("left_key", "qid"), "qid", "left").groupBy("split", "source")
    return rows.agg(
        F.count("*").alias("questions"),
        F.count("pairs").alias("overlapping"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("chained"), F.lit(0)).alias("chained"),
        F.round(F.avg("cover"), 4).alias("mean_cover"),
    )


# --- problem 2 ---------------------------------------------------------------------------------------------------


def _record_groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, d, "raw_contexts").select("id", "name", "passage").where(F.col("passage").rlike(distinctive.VISIBLE))
    return neardup.near_duplicate_groups(rows.select("id", F.concat_ws(" ", F.coalesce("name", F.lit("")), "passage").alias("text")), "id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(_record_groups(spark, d)[0])


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a record: its group, the group's size, and of the record's links their number, how many the alignment
    proves, and the least edit similarity."""
    groups, links = _record_groups(spark, d)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("group_size"), F.min("key").alias("group_key"))
    ends = links.select(F.explode(F.array("x", "y")).alias("class_id"), "aligned", "edit_similarity").groupBy("class_id")
    ends = ends.agg(F.count("*").alias("links"), F.count_if("aligned").alias("aligned_links"), F.round(F.min("edit_similarity"), 6).alias("least_edit_similarity"))
    rows = groups.join(sizes, "group_id").join(ends, "class_id", "left").fillna(0, ["links", "aligned_links"])
    return rows.select(F.col("key").alias("id"), "group_key", "group_size", "links", "aligned_links", "least_edit_similarity")


# --- problem 3 ---------------------------------------------------------------------------------------------------


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = _table(spark, d, "chunk_vectors").select("chunk_id", "embedding")
    return permindex.most_similar(vectors, "chunk_id", "embedding").select("chunk_id", "neighbor_id")


# --- problem 4 ---------------------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "ranking_rows").select("doc_id", "score", "chunk_id", "qid")
    return topn.top_n_per_group(rows, "doc_id", "score", ["chunk_id", "qid"], 3).select("doc_id", "qid", "chunk_id")


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "ranking_rows").select("doc_id", "score", "chunk_id", "qid")
    return topn.top_n_per_group(rows, "doc_id", "score", ["chunk_id", "qid"], 10)


def _top_sql(n: int, columns: str) -> str:
    return f"""
    WITH r AS (SELECT DISTINCT doc_id, score, chunk_id, qid FROM ranking_rows
               WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
         k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id ASC NULLS LAST, qid ASC NULLS LAST) AS INT) AS rank FROM r)
    SELECT {columns} FROM k WHERE rank <= {n}"""


# --- problem 5 ---------------------------------------------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    contexts = transducer.changed_records(_table(spark, d, "raw_contexts"), "id", "passage", "raw_contexts")
    return contexts.unionByName(transducer.changed_records(_table(spark, d, "train"), "qid", "question", "train"))


def p5_one_form(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables with its text in one form."""
    a = _table(spark, d, "raw_contexts").select(F.lit("raw_contexts").alias("tbl"), F.col("id").cast("string").alias("rec_key"), F.col("passage").alias("text"))
    b = _table(spark, d, "train").select(F.lit("train").alias("tbl"), F.col("qid").alias("rec_key"), F.col("question").alias("text"))
    return transducer.normalize_texts(a.unionByName(b), "text").drop("text")


# --- problem 6 ---------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages the splitter cuts, by their first pieces."""
    configs = splitter.read_configs(_table(spark, d, "chunker_config"))
    pieces = splitter.split_records(
        _table(spark, d, "raw_contexts").select("id", "passage"), "id", "passage", configs, with_text=False, only=lambda p: (p["piece"] == 0) & (p["n_pieces"] > 1)
    )
    return pieces.select("cfg_id", "id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every passage under every configuration, repeated deliveries once."""
    return splitter.split_records(_passages(spark, d), "id", "passage", splitter.read_configs(_table(spark, d, "chunker_config")))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """Different rows ``id, passage``; the passage is compared by its hash and moved once."""
    rows = _table(spark, d, "raw_contexts").where("passage is not null").select("id", "passage", F.md5("passage").alias("h"))
    return rows.groupBy("id", "h").agg(F.any_value("passage").alias("passage")).drop("h")


def p6_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The words of every passage put together again from its pieces without their overlaps, per configuration, as a hash;
    and whether a piece exceeds the size, or one after the first hasn't the whole overlap."""
    table = _table(spark, d, "chunker_config")
    pieces = splitter.split_records(_passages(spark, d), "id", "passage", splitter.read_configs(table))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    own = F.array_join(F.slice(words, F.col("own_word") - F.col("start_word") + 1, F.col("end_word") - F.col("own_word")), " ")
    wanted = table.select("cfg_id", "chunk_size", F.when(F.coalesce("overlap", F.lit(0)) < F.col("chunk_size"), F.coalesce("overlap", F.lit(0))).otherwise(0).alias("wanted")).distinct()
    rows = pieces.withColumn("own", own).withColumn("words", F.size(words)).join(F.broadcast(wanted), "cfg_id")
    rows = rows.groupBy("cfg_id", "id").agg(
        F.array_sort(F.collect_list(F.struct("piece", "own"))).alias("parts"),
        (F.max("words") > F.max("chunk_size")).alias("too_large"),
        (F.count_if((F.col("piece") > 0) & (F.col("own_word") - F.col("start_word") != F.col("wanted"))) > 0).alias("short_overlap"),
    )
    return rows.select("cfg_id", "id", F.md5(F.array_join(F.transform("parts", lambda p: p["own"]), " ")).alias("words"), "too_large", "short_overlap")


SPACES = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

P6_REJOINED = r"""
    WITH r AS (SELECT DISTINCT id, passage FROM raw_contexts WHERE passage IS NOT NULL),
         w AS (SELECT id, list_filter(regexp_split_to_array(passage, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM r)
    SELECT c.cfg_id, w.id, md5(array_to_string(w, ' ')) AS words, false AS too_large, false AS short_overlap FROM w CROSS JOIN chunker_config c WHERE len(w) > 0"""


P6_SQL = r"""
    WITH w AS (SELECT id, len(list_filter(regexp_split_to_array(passage, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) AS n
               FROM raw_contexts WHERE passage IS NOT NULL)
    SELECT DISTINCT c.cfg_id, w.id FROM w JOIN chunker_config c ON w.n > c.chunk_size"""


# --- problem 7 ---------------------------------------------------------------------------------------------------


def _scored_terms(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.score_terms(_table(spark, d, "raw_contexts").select("id", "passage"), "id", "passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.most_distinctive(_scored_terms(spark, d), "id")


def p7_llr(spark: SparkSession, d: str) -> DataFrame:
    """The five terms of every record with the highest log-likelihood ratio."""
    scores = _scored_terms(spark, d).select("id", "term", F.round("llr", 6).alias("llr"))
    # a record has a term once, and what it has many terms of is its own text, so there is nothing to spread
    return rank_within(scores, ["id"], [F.col("llr").desc(), F.col("term")], 5)


# --- problem 8 ---------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(_table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


# --- problem 9 ---------------------------------------------------------------------------------------------------


def _mix(spark: SparkSession, d: str):
    documents = _table(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(documents, _table(spark, d, "mix_targets"), "doc_id", "text", "source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """All uses of texts in training order."""
    return _mix(spark, d)[0].orderBy("position", "source", "doc_id", "copy")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that may be used, each with the source and document it counts for."""
    sources = [s.name for s in mixing.read_targets(_table(spark, d, "mix_targets"))]
    return mixing.eligible_texts(_table(spark, d, "documents"), sources, "doc_id", "text", "source").select("source", F.col("key").alias("doc_id"))


P9_TEXTS = """SELECT source, doc_id FROM documents SEMI JOIN mix_targets USING (source) WHERE text <> ''
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id NULLS FIRST) = 1"""


def p9_contract(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mix, per target source: its texts, and whether any use names a document of another source,
    exceeds the cap, skips a copy, leaves training time or comes before an earlier copy; and whether its tokens are off
    what its share demands by more than its largest text."""
    mixed, plan = _mix(spark, d)
    owners = _table(spark, d, "documents").select("doc_id", F.col("source").alias("owner")).distinct()
    named = mixed.join(owners, "doc_id", "left").groupBy("source", "doc_id", "copy").agg(F.count_if(F.col("owner") == F.col("source")).alias("own"), F.first("position").alias("position"), F.first("n_tokens").alias("n"))
    turns = named.groupBy("source", "doc_id").agg(F.max("copy").alias("last"), F.count("*").alias("uses"), F.count_if(F.col("own") == 0).alias("foreign"), F.max_by("position", "copy").alias("latest"), F.max("position").alias("most"), F.min("position").alias("least"), F.sum("n").alias("tokens"))
    got = turns.groupBy("source").agg(
        F.sum("foreign").alias("foreign"), F.max("last").alias("last"), F.count_if(F.col("uses") != F.col("last") + 1).alias("gaps"),
        F.count_if((F.col("least") < 0) | (F.col("most") > 1)).alias("outside"), F.count_if(F.col("latest") < F.col("most")).alias("turned"), F.sum("tokens").alias("tokens"),
    )
    rows = [(s.name, s.texts, float(s.demand), s.max_repeats, s.largest) for s in plan]
    wanted = spark.createDataFrame(rows, "source string, texts long, demand double, max_repeats int, largest long")
    found = wanted.join(F.broadcast(got), "source", "left").fillna(0)
    off = F.abs(F.col("tokens") - F.col("demand")) > F.col("largest")
    return found.select(
        "source", "texts", F.col("foreign").cast("int").alias("foreign_names"), (F.col("last") >= F.greatest("max_repeats", F.lit(1))).alias("over_cap"),
        F.col("gaps").cast("int").alias("copies_missing"), F.col("outside").cast("int").alias("outside_time"), F.col("turned").cast("int").alias("out_of_turn"), off.alias("off_share"),
    )


P9_CONTRACT = f"""WITH t AS ({P9_TEXTS}) SELECT m.source, count(t.source) AS texts, 0 AS foreign_names, false AS over_cap, 0 AS copies_missing, 0 AS outside_time, 0 AS out_of_turn, false AS off_share
    FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) m LEFT JOIN t USING (source) GROUP BY m.source"""


# --- problem 10 --------------------------------------------------------------------------------------------------


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_texts(_table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("truncated").select("doc_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares_by_source(_truncated(spark, d), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p1_found p1_report p2_found p2_groups p3_found p4_found p4_ranked p5_found p5_one_form p6_found p6_pieces p6_rejoined p7_found p7_llr p8_ids p9_mix p9_shares p9_texts p9_contract p10_found p10_shares"
    return {n: globals()[n] for n in names.split() if n in globals()}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _top_sql(3, "doc_id, qid, chunk_id"),
        "p4_ranked": _top_sql(10, "doc_id, score, chunk_id, qid, rank"),
        "p6_found": P6_SQL,
        "p6_rejoined": P6_REJOINED,
        "p9_texts": P9_TEXTS,
        "p9_contract": P9_CONTRACT,
    }
