"""Sinks: distributed tables, the few small files that leave the engine, and the checks on both."""

from __future__ import annotations

import hashlib
import json
import subprocess
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.operators.metrics import dedupe_and_cut, submission_shape

#: A submission is one file by definition; more questions than this aren't one.
MAX_QUESTIONS = 1_000_000


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, range-sorted over the files if an order is given; a reader in file order sees it."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def content_hash(df: DataFrame, columns: list[str] | None = None) -> str:
    """A hash of the rows that doesn't depend on files or order: the sum and the count of the rows' hashes."""
    columns = sorted(columns or df.columns)
    digest = F.conv(F.substring(F.md5(F.to_json(F.struct(*columns))), 1, 15), 16, 10).cast("decimal(38,0)")
    total, rows = df.agg(F.sum(digest), F.count("*")).first()
    return hashlib.sha256(f"{total or 0}:{rows}:{','.join(columns)}".encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``file, sha256, size`` of the files at a path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def fingerprint(ids: list[str]) -> str:
    """BLAKE2b-96 of an ordered list of ids with its size; binds vectors to the chunks they were made from."""
    body = str(len(ids)) + "".join(f"{i}\0" for i in ids)
    return hashlib.blake2b(body.encode(), digest_size=12).hexdigest()


def vectors_match(chunks: DataFrame, vectors: DataFrame) -> tuple[int, int]:
    """How many chunks have no vector, and how many vectors no chunk."""
    a, b = chunks.select("chunk_id").distinct(), vectors.select("chunk_id").distinct()
    return a.join(b, "chunk_id", "left_anti").count(), b.join(a, "chunk_id", "left_anti").count()


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` lacks, so a broken-off job goes on where it stopped."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti") if there else rows
    written = Observation()
    new.observe(written, F.count("*").alias("n")).write.mode("append").parquet(path)
    return written.get["n"]


def check_shards(shards: DataFrame) -> DataFrame:
    """Rows ``shard, problem`` of shards ``shard, first, last, rows, fingerprint, zero_tail``: gaps, wrong sizes, other
    origins, vectors that were never written."""
    from pyspark.sql import Window

    order = Window.orderBy("first")  # one row a shard
    expected = F.coalesce(F.lag("last").over(order), F.lit(0))
    origin = F.first("fingerprint").over(order)
    problem: Column = F.when(F.col("first") != expected, "gap").when(F.col("last") - F.col("first") != F.col("rows"), "size")
    problem = problem.when(F.col("fingerprint") != origin, "origin").when(F.col("zero_tail") > 0, "unwritten")
    return shards.select("shard", problem.alias("problem")).where("problem is not null")


def submission_rows(predicted: DataFrame, questions: DataFrame, fill: bool = False) -> DataFrame:
    """Rows ``qid, answer`` as submitted: text ids, each once, at most five. Questions without prediction are an error,
    or with ``fill`` have none."""
    cut = predicted.select("qid", dedupe_and_cut(F.col("answer")).alias("answer"))
    if fill:
        cut = questions.select("qid").join(cut, "qid", "left").select("qid", F.coalesce("answer", F.array().cast("array<string>")).alias("answer"))
    shape = submission_shape(cut, questions).first().asDict()
    wrong = {k: n for k, n in shape.items() if n and not (k == "empty" and fill)}
    if wrong:
        raise ValueError(f"not a submission: {wrong}")
    return cut


def write_submission(rows: DataFrame, path: str) -> str:
    """A zip file with ``submission.json``, read back before it counts; returns the hash of its content."""
    answers = {r.qid: {"answer": list(r.answer)} for r in rows.orderBy("qid").limit(MAX_QUESTIONS + 1).toLocalIterator()}
    if len(answers) > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions")
    body = json.dumps(answers, ensure_ascii=False, indent=1, sort_keys=True).encode()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        file.writestr("submission.json", body)
    with zipfile.ZipFile(path) as file:
        if file.namelist() != ["submission.json"] or file.read("submission.json") != body:
            raise OSError(f"{path} doesn't hold what was written")
    return hashlib.sha256(body).hexdigest()


def verify_files(spark: SparkSession, folder: str, expected: dict[str, str]) -> DataFrame:
    """Rows ``file, problem`` of the files of a manifest that are missing or have another hash."""
    want = spark.createDataFrame(list(expected.items()), "file string, want string")
    rows = want.join(file_hashes(spark, folder), "file", "left")
    return rows.select("file", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "changed").alias("problem")).where("problem is not null")


def write_predictions(predicted: DataFrame, path: str) -> None:
    """Rows ``qid, answer`` as JSON lines in the order of the questions; ids as text, each once, at most five."""
    write_jsonl(predicted.select("qid", dedupe_and_cut(F.col("answer")).alias("answer")), path, ["qid"])


def write_run(ranking: DataFrame, predicted: DataFrame, folder: str, settings: dict) -> dict:
    """A run as it can be repeated: the ranking, the predictions made of it, and a row of metadata with the settings, the
    commit they ran at and hashes of both tables, written last; returns the metadata."""
    spark = ranking.sparkSession
    ranking.write.mode("overwrite").parquet(f"{folder}/ranking")
    predicted.write.mode("overwrite").parquet(f"{folder}/predictions")
    again = {n: spark.read.parquet(f"{folder}/{n}") for n in ("ranking", "predictions")}
    made = {"settings": json.dumps(settings, ensure_ascii=False, sort_keys=True), "commit": commit_state(), **{f"{n}_hash": content_hash(t) for n, t in again.items()}, "questions": again["predictions"].count()}
    spark.createDataFrame([made]).coalesce(1).write.mode("overwrite").json(f"{folder}/run")
    return made


def commit_state(folder: str = ".") -> str:
    """The short hash of the checked-out commit, with + if files were changed since; empty outside a repository."""
    run = lambda *args: subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
    commit = run("rev-parse", "--short", "HEAD")
    return commit.stdout.strip() + ("+" if run("status", "--porcelain").stdout.strip() else "") if not commit.returncode else ""


def write_excluded(excluded: DataFrame, path: str, most: int = 100_000) -> int:
    """A Markdown list of the questions ``qid, question, answer`` that were set apart, and how many there are."""
    got = excluded.select("qid", "question", "answer").orderBy("qid").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} excluded questions")
    parts = [f"## {r.qid}\n\n{r.question or ''}\n\nGold: {', '.join(r.answer or ())}\n" for r in got]
    Path(path).write_text("\n".join([f"# Excluded questions: {len(got)}\n", *parts]), encoding="utf-8")
    return len(got)


EXPERIMENT = "time string, config string, split string, metric string, value double, note string, commit string"


def append_experiments(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append results ``time, config, split, metric, value, note`` to the experiment table with the state of the commit; a
    table with other columns is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = spark.createDataFrame([(*row, commit_state()) for row in rows], EXPERIMENT)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop) and spark.read.parquet(path).columns != new.columns:
        raise ValueError(f"{path} has other columns")
    new.coalesce(1).write.mode("append").parquet(path)


def plan_encoding(chunks: int, shards: int, rows_a_second: float, dim: int, bytes_a_number: int = 2) -> list[dict]:
    """The rows of each shard of an encoding job, the rest going to the first shards, with hours and GB they take."""
    if shards < 1 or chunks < 0 or rows_a_second <= 0:
        raise ValueError("shards, chunks and speed must be positive")
    size, rest = divmod(chunks, shards)
    out, first = [], 0
    for shard in range(shards):
        rows = size + (shard < rest)
        out.append({"shard": shard + 1, "first": first, "last": first + rows, "rows": rows, "hours": rows / rows_a_second / 3600, "gb": rows * dim * bytes_a_number / 1e9})
        first += rows
    return out


def write_splits(split: DataFrame, folder: str) -> None:
    """The parts of a split as one partitioned table, written beside its place, checked, and moved there."""
    spark = split.sparkSession
    staged = f"{folder}.staged"
    split.write.mode("overwrite").partitionBy("part").parquet(staged)
    again = spark.read.parquet(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, stage = (jvm.org.apache.hadoop.fs.Path(p) for p in (folder, staged))
    system = place.getFileSystem(conf)
    if content_hash(again.select(*split.columns)) != content_hash(split):
        system.delete(stage, True)
        raise OSError("the split read back isn't the split written")
    system.delete(place, True)
    system.rename(stage, place)


def local_report(path: str, heading: str, rows: DataFrame, most: int = 1000) -> None:
    """A Markdown table of a small result; one of more than ``most`` rows is refused, not cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows aren't a report")
    lines = [f"# {heading}", "", " | ".join(rows.columns), " | ".join("-" for _ in rows.columns), *(" | ".join(map(str, r)) for r in got)]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
