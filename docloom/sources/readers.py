"""Readers: every id becomes text, every alias its one name, and what is malformed is either an error or a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import chunk_key, chunk_position, is_blank
from docloom.operators.bm25 import rank_within
from docloom.operators.pooling import pool_documents

RAW_SCHEMA = "id string, name string, link string, passage string, text string, _corrupt string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped. A malformed line is an error, or with ``strict`` off null
    columns and its text in ``_corrupt``."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt string")
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return reader.options(**options).json(path)


def read_raw_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of a folder with a JSON file for each document: rows ``id, name, link, passage, source_file``, and rows
    ``source_file, problem`` of files that can't be read or have no id."""
    files = spark.read.schema(RAW_SCHEMA).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)
    rows = files.select("id", "name", "link", F.coalesce("passage", "text").alias("passage"), "_corrupt", F.col("_metadata.file_name").alias("source_file"))
    problem = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(F.col("id").isNull(), "no id")
    bad = rows.select("source_file", problem.alias("problem")).where("problem is not null")
    return rows.where("_corrupt is null and id is not null").drop("_corrupt"), bad


def field_presence(spark: SparkSession, path: str, fields: tuple[str, ...] = ("name", "link", "passage")) -> DataFrame:
    """Rows ``field, absent, empty, present`` over a folder of JSON files: a key that isn't there differs from an empty
    value, which a fixed schema can't tell."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    keys = [F.lit(f) for f in fields]
    rows = raw.select(F.explode(F.array(*(F.struct(k.alias("field"), F.map_contains_key("m", k).alias("there"), F.element_at("m", k).alias("v")) for k in keys))).alias("f")).select("f.*")
    return rows.groupBy("field").agg(F.count_if(~F.col("there")).alias("absent"), F.count_if(F.col("there") & is_blank(F.col("v"))).alias("empty"), F.count_if(F.col("there") & ~is_blank(F.col("v"))).alias("present"))


def _alias(df: DataFrame, *names: str) -> Column:
    there = [F.col(n) for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of the columns {names} is there")
    return F.coalesce(*there)


def normalize_chunks(rows: DataFrame, skip_empty: bool = True) -> DataFrame:
    """Rows ``chunk_id, doc_id, position, text``: ids as text, under either name; a missing position is read from the
    chunk id, a missing chunk id built from the position; empty texts are dropped if asked."""
    text, doc = _alias(rows, "text", "passage"), _alias(rows, "doc_id", "id").cast("string")
    given = F.col("chunk_id") if "chunk_id" in rows.columns else F.lit(None).cast("string")
    position = F.coalesce(F.col("position").cast("int") if "position" in rows.columns else F.lit(None).cast("int"), chunk_position(given))
    out = rows.select(F.coalesce(given, chunk_key(doc, position)).alias("chunk_id"), doc.alias("doc_id"), position.alias("position"), text.alias("text"))
    return out.where(~is_blank(F.col("text"))) if skip_empty else out


def chunks_by_id(chunks: DataFrame, needed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks whose ids are needed, and the needed ids that no chunk has."""
    ids = needed.select("chunk_id").distinct()
    return chunks.join(ids, "chunk_id", "left_semi"), ids.join(chunks, "chunk_id", "left_anti")


def first_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """The first ``most`` chunks by document and position, for a look at a store."""
    return chunks.orderBy("doc_id", "position", "chunk_id").limit(most)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id`` of a JSON object whose ``docs_exclude_from_corpus`` lists the documents to leave out; an object
    without that list is an error."""
    kinds = "docs_exclude_from_corpus array<string>, n_corpus_after_exclusion long"
    entries = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("v"))
    there = F.assert_true(F.col("v.docs_exclude_from_corpus").isNotNull(), F.lit("no docs_exclude_from_corpus"))
    return entries.where(there.isNull()).select(F.explode("v.docs_exclude_from_corpus").alias("doc_id")).distinct()


def raw_or_clean(spark: SparkSession, clean: str, raw: list[str]) -> DataFrame:
    """The cleaned corpus (JSON lines) where it is there, else the raw documents of the first folder that is; rows
    ``doc_id, name, link, text``."""
    try:
        rows = spark.read.json(first_existing(spark, [clean]))
    except FileNotFoundError:
        rows = read_raw_documents(spark, first_existing(spark, raw))[0]
    return rows.select(_alias(rows, "doc_id", "id").cast("string").alias("doc_id"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "link")), F.coalesce(_alias(rows, "text", "passage"), F.lit("")).alias("text"))


def corpus_ids(rows: DataFrame) -> DataFrame:
    return rows.select(_alias(rows, "doc_id", "id").cast("string").alias("doc_id")).distinct()


def read_question_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``qid, question, answer`` of one JSON object that maps question ids to objects, plain questions or plain
    lists of answers; an answer that isn't there is null."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("qid", "v"))
    structured = F.from_json("v", "question string, answer array<string>")
    kind = F.substring(F.trim("v"), 1, 1)
    return entries.select(
        "qid",
        F.when(kind == "{", structured["question"]).when(kind != "[", F.col("v")).alias("question"),
        F.when(kind == "{", structured["answer"]).when(kind == "[", F.from_json("v", "array<string>")).alias("answer"),
    )


def require_labels(questions: DataFrame) -> DataFrame:
    """The questions, with an error for one without gold documents."""
    fine = F.coalesce(F.size("answer"), F.lit(0)) > 0
    return questions.where(F.assert_true(fine, F.concat(F.lit("no label: "), "qid")).isNull())


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``qid, rank, doc_id, score, chunk_id`` of one JSON object of ranked lists ``[doc, score, chunk]``; a document
    that comes again is dropped, and the ranks close up."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("qid", "l"))
    rows = lists.select("qid", F.posexplode("l").alias("pos", "r")).select("qid", "pos", F.col("r")[0].alias("doc_id"), F.try_element_at("r", F.lit(2)).cast("double").alias("score"), F.try_element_at("r", F.lit(3)).alias("chunk_id"))
    first = rank_within(rows, ["qid", "doc_id"], [F.col("pos")], 1, "n").drop("n")
    return rank_within(first, ["qid"], [F.col("pos")]).select("qid", "rank", "doc_id", "score", "chunk_id")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Rows of label audits in CSV, with texts over several lines."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def log_fingerprints(spark: SparkSession, path: str, pattern: str = r"fingerprint[=: ]+([0-9a-f]{8,})") -> DataFrame:
    """Rows ``file, fingerprint`` found in logs."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_extract("value", pattern, 1).alias("fingerprint"))
    return lines.where("fingerprint <> ''").distinct()


def ranking_table(rows: DataFrame) -> DataFrame:
    """Rows ``qid, rank, doc_id, score, chunk_id`` of retrieval results: rows without document or with a score that is
    null or NaN are dropped, a document's best row stands for it, and ranks are given anew by score, then document."""
    known = rows.where(F.col("doc_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return pool_documents(known.select("qid", "doc_id", "score", "chunk_id").distinct(), "max").select("qid", "rank", "doc_id", "score", "chunk_id")


def union_by_source(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables under each other with their name as ``source``."""
    return reduce(DataFrame.unionByName, (t.withColumn("source", F.lit(n)) for n, t in tables.items()))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several paths that exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        if hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path)):
            return path
    raise FileNotFoundError(f"none of {paths}")
