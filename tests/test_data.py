"""Readers, sinks, graphs, splits, components and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import corpus, dense, graph, labels, splits, statistics
from docloom.operators.components import connected_components
from docloom.session import discard, materialize, shared_dir
from docloom.sources import readers, sinks
from docloom.streaming.ingest import append_stream, clean_stream


def test_question_maps(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"1": {"question": "a", "answer": ["x"]}, "2": {"question": "b", "answer": None}, "3": "c", "4": ["y", "z"]}))
    got = {r.qid: (r.question, r.answer) for r in readers.read_question_map(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"1": ("a", ["x"]), "2": ("b", None), "3": ("c", None), "4": (None, ["y", "z"])}
    with pytest.raises(Exception, match="no label"):
        readers.require_labels(readers.read_question_map(spark, str(tmp_path / "q.json"))).collect()


def test_raw_documents(spark, tmp_path):
    for name, body in {"context_1": '{"id": 1, "passage": null, "text": "t"}', "context_2": '{"id": 2, "name": "n", "passage": ""}', "context_3": "{broken", "context_4": '{"name": "x"}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    good, bad = readers.read_raw_documents(spark, str(tmp_path))
    assert {(r.id, r.passage) for r in good.collect()} == {("1", "t"), ("2", "")}
    assert {(r.source_file, r.problem) for r in bad.collect()} == {("context_3.json", "unreadable"), ("context_4.json", "no id")}


def test_field_presence(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "name": ""}')
    (tmp_path / "b.json").write_text('{"id": 2, "name": "n", "link": "l"}')
    got = {r.field: (r.absent, r.empty, r.present) for r in readers.field_presence(spark, str(tmp_path)).collect()}
    assert got == {"name": (0, 1, 1), "link": (1, 0, 1), "passage": (2, 0, 0)}


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\nnonsense\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string").collect()
    loose = readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string", strict=False).collect()
    assert [(r.id, r._corrupt) for r in loose] == [("1", None), (None, "nonsense")]


def test_chunks(spark):
    rows = spark.createDataFrame([(7, "7::0002", "a"), (8, "8::0000", " "), (9, "x", "b")], "id int, chunk_id string, passage string")
    assert {(r.chunk_id, r.doc_id, r.position) for r in readers.normalize_chunks(rows).collect()} == {("7::0002", "7", 2), ("x", "9", None)}
    named = spark.createDataFrame([("5", 3, "t")], "doc_id string, position int, text string")
    assert readers.normalize_chunks(named).first().chunk_id == "5::0003"
    found, missing = readers.chunks_by_id(readers.normalize_chunks(named), spark.createDataFrame([("5::0003",), ("no",)], "chunk_id string"))
    assert found.count() == 1 and [r.chunk_id for r in missing.collect()] == ["no"]
    with pytest.raises(ValueError):
        readers.normalize_chunks(spark.createDataFrame([(1,)], "id int"))


def test_ranking_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"q": [["a", 3.0, "a::0"], ["a", 2.0, "a::1"], ["b", 1.0]]}))
    got = [tuple(r) for r in readers.read_ranking(spark, str(tmp_path / "r.json")).orderBy("rank").collect()]
    assert got == [("q", 1, "a", 3.0, "a::0"), ("q", 2, "b", 1.0, None)]


def test_submission(spark, tmp_path):
    asked = spark.createDataFrame([("1",), ("2",)], "qid string")
    given = spark.createDataFrame([("1", [1, 2, 2, 3, 4, 5, 6])], "qid string, answer array<int>")
    with pytest.raises(ValueError):
        sinks.submission_rows(given, asked)
    rows = sinks.submission_rows(given, asked, fill=True)
    assert {r.qid: r.answer for r in rows.collect()} == {"1": ["1", "2", "3", "4", "5"], "2": []}
    assert len(sinks.write_submission(rows, str(tmp_path / "s.zip"))) == 64


def test_hashes_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sinks.content_hash(rows) == sinks.content_hash(rows.orderBy(F.desc("k")).repartition(3)) != sinks.content_hash(rows.limit(1))
    path = str(tmp_path / "t")
    assert sinks.append_missing(rows.limit(1), path, "k") == 1 and sinks.append_missing(rows, path, "k") == 1 and sinks.append_missing(rows, path, "k") == 0
    (tmp_path / "f.bin").write_bytes(b"x")
    assert [tuple(r) for r in sinks.verify_files(spark, str(tmp_path / "f.bin"), {"f.bin": "0", "g.bin": "1"}).orderBy("file").collect()] == [("f.bin", "changed"), ("g.bin", "missing")]
    assert sinks.fingerprint(["a", "b"]) != sinks.fingerprint(["ab"]) and len(sinks.fingerprint([])) == 24
    shards = spark.createDataFrame([(1, 0, 5, 5, "f", 0), (2, 6, 9, 3, "f", 0), (3, 9, 12, 3, "g", 0)], "shard int, first int, last int, rows int, fingerprint string, zero_tail int")
    assert {(r.shard, r.problem) for r in sinks.check_shards(shards).collect()} == {(2, "gap"), (3, "origin")}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a int, b int"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_components_of_random_graphs(spark, coalesce):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000, i) for i in range(1001, 1200)] + [(None, 1), (5, None), (6, 6)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        named = [(None if a is None else f"n{a:05d}", None if b is None else f"n{b:05d}") for a, b in edges]
        got = connected_components(spark.createDataFrame(named, "a string, b string"), "a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.component for r in got} == {f"n{x:05d}": f"n{find(x):05d}" for x in parent} and len(got) == len(parent)


def test_intermediate_tables(spark, monkeypatch):
    table = materialize(spark.range(3))
    assert table.count() == 3
    discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.materialized_at).count()
    with pytest.raises(ValueError, match="share"):
        shared_dir(_Cluster)


class _Cluster:
    """A session on a cluster whose settings name no shared folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: _Cluster.conf)

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    return self

                def isEmpty(self):
                    return True


def test_citations(spark):
    rows = [("1", "", "Số: 1/2020/TT-A nội dung"), ("2", "", "Số: 2/2020/TT-A. Căn cứ 1/2020/TT-A. Bãi bỏ 1/2020/TT-A và 9/2020/TT-A, 2/2020/TT-A"), ("3", "", "theo 2/2020/TT-A"), ("4", "", None)]
    edges = graph.citation_edges(spark.createDataFrame(rows, "doc_id string, name string, text string"))
    assert {tuple(r) for r in edges.collect()} == {("2", "1", "amend"), ("3", "2", "cite")}
    seeds = spark.createDataFrame([("1",)], "doc_id string")
    assert {(r.doc_id, r.hop) for r in graph.neighbours(edges, seeds, 2).collect()} == {("2", 1), ("3", 2)}
    assert graph.neighbours(edges, seeds, 2, ("cite",)).count() == 0


def test_named_codes_and_reach(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "", "Số: 1/2020/TT-A THÔNG TƯ về thuế"), ("2", "", "theo 1/2020/TT-A"), ("3", "", "khác")], "doc_id string, name string, text string")
    asked = spark.createDataFrame([("q", "Theo 1/2020/TT-A thì sao?"), ("r", None)], "qid string, question string")
    assert [tuple(r) for r in graph.cited_by_question(asked, corpus).collect()] == [("q", "1")]
    assert [tuple(r) for r in graph.title_table(corpus).collect()] == [("1", "1/2020/TT-A THÔNG TƯ về thuế")]
    missed = spark.createDataFrame([("q", ["1"]), ("r", ["3"])], "qid string, answer array<string>")
    ranking = spark.createDataFrame([("q", 1, "2"), ("r", 1, "2")], "qid string, rank int, doc_id string")
    got = graph.reachable_gold(missed, ranking, graph.citation_edges(corpus)).collect()
    assert {(r.qid, r.reachable) for r in got} == {("q", True), ("r", False)}
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)


def test_split(spark):
    sizes = {f"g{i}": 1 + i % 4 for i in range(60)}
    parts = splits.fill(sizes, splits.SplitPlan(20, 5, 20))
    filled = {p: sum(sizes[g] for g, at in parts.items() if at == p) for p in splits.NAMES}
    assert filled["holdout"] <= 20 and filled["error_pool"] <= 5 and filled["dev"] <= 20 and sum(filled.values()) == sum(sizes.values())
    sets = splits.nested(sizes, [100, 50, 10])
    assert set(sets[10]) < set(sets[50]) < set(sets[100]) and all(sum(sizes[g] for g in s) == n for n, s in sets.items())
    with pytest.raises(ValueError):
        splits.carve({"a": 2}, 1, ["a"])


def test_leak_groups_bridge_clusters(spark):
    q = spark.createDataFrame([("1", ["a"]), ("2", ["b", "c"]), ("3", ["d"]), ("4", ["z"])], "qid string, answer array<string>")
    dup = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g2")], "doc_id string, group_key string")
    got = {r.qid: r.group_id for r in graph.leak_groups(q, dup).collect()}
    assert got["1"] == got["2"] == got["3"] != got["4"] == "4"


def test_label_audits(spark):
    q = spark.createDataFrame([("1", "Hỏi A?", ["x"]), ("2", "hỏi a", ["y"]), ("3", "B", ["x"]), ("4", "b!", ["x"]), ("5", None, ["x"])], "qid string, question string, answer array<string>")
    conflict = labels.label_conflicts(q).first()
    assert (conflict.question_key, conflict.questions, conflict.disjoint) == ("hỏi a", 2, True)
    assert tuple(labels.consistent_surplus(q).first()) == (1, 1)


def test_shards_and_samples(spark):
    rows = spark.createDataFrame([(f"{i:03d}", "ab"[i % 5 == 0]) for i in range(8)], "k string, s string")
    assert [r.n for r in statistics.shard_bounds(rows, "k", 3).orderBy("shard").collect()] == [3, 3, 2]
    assert statistics.stratified_sample(rows, "k", "s", 4).count() == 4
    assert statistics.random_sample(rows, "k", 5, [rows.where("s = 'b'").select("k")]).where("s = 'b'").count() == 0


def test_dense_usable_and_empty(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, float("nan")]), ("e", [1.0]), ("f", [2.0, 0.1])], "id string, embedding array<float>")
    fine = rows.where(dense.usable(F.col("embedding"), 2))
    assert {r.id for r in fine.collect()} == {"a", "f"}
    assert [(r.qid, r.item_id) for r in dense.search(fine, fine, 5).orderBy("qid").collect()] == [("a", "f"), ("f", "a")]
    assert dense.search(fine.where("false"), fine).count() == 0 == dense.search(fine, fine.where("false")).count()
    assert fine.select(dense.norm(dense.normalize(F.col("embedding"))).alias("n")).first().n == pytest.approx(1)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"id": "1", "passage": "A  b", "fetched_at": "2024-01-01T00:00:00Z"}\n{"id": "1", "passage": "A  b", "fetched_at": "2024-01-01T00:00:00Z"}\n')
    append_stream(clean_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1", "A b")]


def test_pairs_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SET_BLOCK", 40)  # several blocks
    monkeypatch.setattr(corpus, "SET_WORDS", 7)
    rng = random.Random(5)
    texts = [" ".join(rng.sample([f"từ{k}" for k in range(30)], rng.randrange(1, 12))) for _ in range(220)] + ["hai câu giống hệt"] * 3 + ["a b c", "?", ""]
    rows = [(f"q{i:03d}", t, [str(rng.randrange(3)), str(rng.randrange(3))]) for i, t in enumerate(texts)]
    sets = {q: {w for w in t.split() if len(w) > 1} for q, t, _ in rows}
    expected = {(x, y) for x in sets for y in sets if x < y and sets[x] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.3}
    df = spark.createDataFrame(rows, "qid string, question string, answer array<string>")
    got = corpus.all_question_pairs(df, 0.3).collect()
    assert sorted((r.qid_a, r.qid_b) for r in got) == sorted(expected)
    assert {r.similarity for r in got if r.qid_a > "q219"} == {1.0}
    assert len({(r.qid_a, r.qid_b) for r in corpus.question_pairs(df, 0.3).collect()}) < len(expected)  # the lossy rule
    assert corpus.all_question_pairs(df.where("false"), 0.3).count() == 0


def test_runs_and_logs(spark, tmp_path):
    ranking = spark.createDataFrame([("q", 1, "a", 2.0)], "qid string, rank int, doc_id string, score double")
    predicted = spark.createDataFrame([("q", ["a", "a", "b"]), ("p", [])], "qid string, answer array<string>")
    made = sinks.write_run(ranking, predicted, str(tmp_path / "run"), {"k": 60})
    again = sinks.write_run(ranking.repartition(3), predicted, str(tmp_path / "run2"), {"k": 60})
    assert made["questions"] == 2 and {k: made[k] for k in ("settings", "ranking_hash", "predictions_hash")} == {k: again[k] for k in ("settings", "ranking_hash", "predictions_hash")}
    assert spark.read.json(str(tmp_path / "run/run")).first().settings == '{"k": 60}'
    sinks.write_predictions(predicted, str(tmp_path / "p"))
    assert [(r.qid, r.answer) for r in spark.read.json(str(tmp_path / "p")).collect()] == [("p", []), ("q", ["a", "b"])]
    assert sinks.write_excluded(predicted.withColumn("question", F.lit("?")), str(tmp_path / "x.md")) == 2 and "## q" in (tmp_path / "x.md").read_text()
    row = ("t", "c", "dev", "recall", 0.5, "")
    for _ in range(2):
        sinks.append_experiments(spark, str(tmp_path / "e"), [row])
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    ranking.write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="columns"):
        sinks.append_experiments(spark, str(tmp_path / "other"), [row])
    sinks.local_report(str(tmp_path / "r.md"), "Heading", ranking)
    assert "q | 1 | a | 2.0" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError, match="more than"):
        sinks.local_report(str(tmp_path / "r.md"), "Heading", spark.range(5), most=4)
    plan = sinks.plan_encoding(10, 3, 1.0, 1000)
    assert [(p["first"], p["last"]) for p in plan] == [(0, 4), (4, 7), (7, 10)] and plan[0]["gb"] == pytest.approx(8e-6)


def test_further_readers(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"docs_exclude_from_corpus": ["1", "2", "1"], "n_corpus_after_exclusion": 9}))
    assert {r.doc_id for r in readers.read_exclusions(spark, str(tmp_path / "d.json")).collect()} == {"1", "2"}
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(Exception, match="no docs_exclude"):
        readers.read_exclusions(spark, str(tmp_path / "n.json")).collect()
    chunks = spark.createDataFrame([("b::0000", "b", 0, "x"), ("a::0001", "a", 1, "y"), ("a::0000", "a", 0, "z")], "chunk_id string, doc_id string, position int, text string")
    assert [r.chunk_id for r in readers.first_chunks(chunks, 2).collect()] == ["a::0000", "a::0001"]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "context_7.json").write_text('{"id": 7, "name": null, "link": "l", "passage": "p"}')
    found = readers.raw_or_clean(spark, str(tmp_path / "clean.jsonl"), [str(tmp_path / "none"), str(raw)])
    assert [tuple(r) for r in found.collect()] == [("7", "", "l", "p")]
    (tmp_path / "clean.jsonl").write_text('{"doc_id": "8", "name": "n", "link": "", "text": "t"}\n')
    assert [tuple(r) for r in readers.raw_or_clean(spark, str(tmp_path / "clean.jsonl"), [str(raw)]).collect()] == [("8", "n", "", "t")]
    (tmp_path / "a.csv").write_text('qid,note\n1,"two\nlines"\n')
    assert [(r.qid, r.note) for r in readers.read_audit(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines")]
    (tmp_path / "l.log").write_text("start\nfingerprint: 0123abcd99\n")
    assert [(r.file, r.fingerprint) for r in readers.log_fingerprints(spark, str(tmp_path / "l.log")).collect()] == [("l.log", "0123abcd99")]
    one = spark.createDataFrame([("a",)], "chunk_id string")
    assert {r.source for r in readers.union_by_source({"x": one, "y": one}).collect()} == {"x", "y"}
    assert sinks.vectors_match(one, spark.createDataFrame([("a",), ("b",)], "chunk_id string")) == (0, 1)
    assert {r.doc_id for r in readers.corpus_ids(chunks).collect()} == {"a", "b"}
    qids = spark.createDataFrame([("1",), ("2",)], "qid string")
    assert [r.qid for r in splits.not_nested(qids, qids.where("qid = '1'")).collect()] == ["2"]


def test_vectors_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"v{i:03d}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    whole = sorted(dense.search(df.where("id < 'v040'"), df, 4).collect())
    assert len(whole) == 160
    for name, size in {"QUERY_BLOCK": 7, "ITEM_BLOCK": 11, "AT_ONCE": 2}.items():
        monkeypatch.setattr(dense, name, size)
    assert sorted(dense.search(df.where("id < 'v040'"), df, 4).collect()) == whole
    chunks = df.select(F.col("id").alias("chunk_id"))
    vectors = df.withColumnRenamed("id", "chunk_id")
    assert dense.require_match(chunks, vectors, 8).count() == 90
    for a, b, dim in ((chunks, vectors.limit(5), 8), (chunks.limit(5), vectors, 8), (chunks, vectors, 9)):
        with pytest.raises(ValueError):
            dense.require_match(a, b, dim)
