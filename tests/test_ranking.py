"""Pooling, fusion, cut-off and scoring against the fixture tables."""

import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25, cutoff, fusion, metrics, pooling, statistics
from docloom.plans import retrieval
from docloom.plans.config import ConfigError, load, merged
from docloom.session import materialize
from docloom.sources import demo


def ranked(spark, lists):
    rows = [(q, d, float(100 - i), f"{d}::0000", i + 1) for q, docs in lists.items() for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "qid string, doc_id string, score double, chunk_id string, rank int")


def scored(spark, scores, qid="q"):
    rows = [(qid, f"d{i:02d}", float(s), f"c{i}", i + 1) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "qid string, doc_id string, score double, chunk_id string, rank int")


def answers(spark, table):
    return spark.createDataFrame(list(table.items()), "qid string, answer array<string>")


@pytest.mark.parametrize("pool, a, b", [("max", 3, 5), ("sum", 6, 5), ("mean_top2", 2.5, 5), ("mean_top3", 2, 5)])
def test_pooling(spark, pool, a, b):
    rows = spark.createDataFrame([("q", "a::0", "a", 3.0), ("q", "a::1", "a", 1.0), ("q", "a::2", "a", 2.0), ("q", "b::0", "b", 5.0)], "qid string, chunk_id string, doc_id string, score double")
    assert {r.doc_id: r.score for r in pooling.pool_documents(rows, pool).collect()} == {"a": a, "b": b}


def test_logsumexp_and_anchor(spark):
    rows = spark.createDataFrame([("q", "a::7", "a", 3.0), ("q", "a::2", "a", 3.0), ("q", "a::1", "a", 2.0)], "qid string, chunk_id string, doc_id string, score double")
    wide = pooling.pool_documents(rows, "logsumexp").first()
    assert wide.score == pytest.approx(math.log(2 * math.exp(3) + math.exp(2)), abs=1e-6) and wide.chunk_id == "a::2"
    assert pooling.pool_documents(rows, "logsumexp", tau=0.01).first().score == pytest.approx(3 + 0.01 * math.log(2), abs=1e-6)
    for wrong in (("mean_top0", 1.0), ("other", 1.0), ("logsumexp", 0.0)):
        with pytest.raises(ValueError):
            pooling.check_pool(*wrong)


def test_cap_comes_before_pooling(spark):
    rows = spark.createDataFrame([("q", "a::0", "a", 5.0), ("q", "b::0", "b", 3.0), ("q", "b::1", "b", 2.9)], "qid string, chunk_id string, doc_id string, score double")
    assert [r.doc_id for r in pooling.pool_documents(rows, "sum").collect()] == ["b", "a"]
    assert [r.doc_id for r in pooling.pool_documents(rows, "sum", cap=2).collect()] == ["a", "b"]


def test_fusion(spark):
    a, b = ranked(spark, {"q": ["x", "y"]}), ranked(spark, {"q": ["y"]})
    got = {r.doc_id: r.score for r in fusion.fuse({"a": a, "b": b}, {"a": 0.5, "b": 0.5}).collect()}
    assert got == {"x": pytest.approx(0.5 / 61), "y": pytest.approx(0.5 / 62 + 0.5 / 61)}
    assert [r.doc_id for r in fusion.fuse({"a": a, "b": ranked(spark, {"q": ["z"]})}, {"a": 1, "b": 0}).collect()] == ["x", "y"]
    far = {r.doc_id: r.score for r in fusion.fuse({"a": a, "b": b}, {"a": 0.5, "b": 0.5}, absent_rank=10**6, decimals=12).collect()}
    assert far["x"] == pytest.approx(0.5 / 61 + 0.5 / (60 + 10**6), abs=1e-12)
    with pytest.raises(ValueError):
        fusion.normalized({"a": 0.0})
    assert fusion.sweep(["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.1}, 0.6) == pytest.approx({"a": 0.6, "b": 0.3, "c": 0.1})


SPECTRA = {"decisive": ([100, 20, 19, 18.5, 18, 17, 16, 15, 14, 13], 1), "flat": ([50 - i / 10 for i in range(10)], 5), "pair": ([80, 79, 40, 39, 38, 37, 36, 35, 34, 33], 2), "equal": ([7] * 10, 5), "short": ([5], 1)}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("scale, shift", [(1, 0), (3, 0), (1, -200)])
def test_cut_is_invariant(spark, name, scale, shift):
    scores, count = SPECTRA[name]
    assert cutoff.cut_at_first_margin(scored(spark, [s * scale + shift for s in scores]), 0.4).first()["count"] == count


def test_cut_grows_with_the_threshold(spark):
    counts = [cutoff.cut_at_first_margin(scored(spark, SPECTRA["pair"][0]), t).first()["count"] for t in (0.0, 0.02, 0.4, 0.9)]
    assert counts == sorted(counts)
    with pytest.raises(ValueError):
        cutoff.rank_margins(scored(spark, [1]), scale_rank=1)


@pytest.mark.parametrize("mode", cutoff.MODES)
def test_rules(spark, mode):
    rows = scored(spark, [10, 9, 2, 1, 0.5, 0.1])
    assert cutoff.cut_by_rule(rows, 1e9, "cascade", mode).first()["count"] == 5
    assert cutoff.cut_by_rule(rows, 1e9, "top1", mode).first()["count"] == 5
    assert cutoff.cut_by_rule(rows, -1, "top1", mode).first()["count"] == 1


@pytest.mark.parametrize(
    "gold, given, recall, precision",
    [
        (["100"], ["100"], 1, 1), (["100"], ["100", "2", "3", "4", "5"], 1, 0.2), (["100"], ["100"] * 3, 1, 0.333333), (["100", "200"], ["100", "100", "200"], 1, 0.666667),
        (["1"], ["1", "2", "3", "4", "5", "6"], 0, 0), (["1", "2", "3", "4", "5"], ["1", "2", "3", "4", "5"], 1, 1), (["1", "9"], ["1", "2", "3", "4", "5"], 0.5, 0.2), (["1"], [], 0, 0), (["1"], ["1", "8"], 1, 0.5),
    ],
)
def test_official_score(spark, gold, given, recall, precision):
    got = metrics.official_score(answers(spark, {"q": given}), answers(spark, {"q": gold})).first()
    assert (got.recall, got.precision) == (pytest.approx(recall), pytest.approx(precision))


def test_scores_are_loud(spark):
    with pytest.raises(ValueError):
        metrics.official_score(answers(spark, {"q": ["1"]}), answers(spark, {"q": ["1"], "r": ["2"]}))
    numbers = spark.createDataFrame([("q", [1])], "qid string, answer array<int>")
    with pytest.raises(Exception, match="DATATYPE_MISMATCH"):
        metrics.official_score(numbers, answers(spark, {"q": ["1"]}))


def test_dedupe_before_cut(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "b", "c", "c", "d", "e", "f"],)], "a array<string>")
    assert rows.select(metrics.dedupe_and_cut(F.col("a")).alias("a")).first().a == list("abcde")
    both = spark.createDataFrame([(["a", "b", "c"], ["b", "x"])], "a array<string>, b array<string>")
    assert both.select(fusion.interleave(F.col("a"), F.col("b")).alias("o")).first().o == ["a", "b", "x"]


def test_mcnemar_and_bootstrap(spark):
    a = spark.createDataFrame([(f"q{i}", 1.0 if i < 40 else 0.0) for i in range(100)], "qid string, recall double")
    b = spark.createDataFrame([(f"q{i}", 1.0 if 10 <= i < 70 else 0.0) for i in range(100)], "qid string, recall double")
    test = statistics.mcnemar(a, b).first()
    assert (test.wins, test.losses, test.chi2) == (30, 10, pytest.approx(19**2 / 40)) and test.p_value == pytest.approx(math.erfc(math.sqrt(19**2 / 80)), abs=1e-6)
    part = b.withColumn("recall", F.when(F.col("qid") == "q5", 0.5).otherwise(F.col("recall")))  # half of the gold is a loss too
    assert statistics.mcnemar(a, part).first().losses == 10 and statistics.mcnemar(part, a).first().wins == 10
    same = statistics.mcnemar(a, a).first()
    assert (same.chi2, same.p_value) == (0, 1)
    interval = statistics.bootstrap_interval(statistics.paired_differences(a, b), 2000).first()
    half = 1.96 * math.sqrt((0.4 - 0.04) / 100)
    assert interval["mean"] == pytest.approx(0.2) and interval.low == pytest.approx(0.2 - half, abs=0.03) and interval.high == pytest.approx(0.2 + half, abs=0.03)
    with pytest.raises(ValueError):
        statistics.paired_differences(a, b.limit(3))


def test_whole_pipeline(spark):
    chunks, questions = demo.tiny(spark)
    inputs = retrieval.Inputs(questions.select("qid", "question"), chunks)
    spec = {"retriever": {"sources": {"words": {"type": "bm25"}, "pairs": {"type": "bm25", "tokenizer": "syllable_bigram"}}, "weights": {"words": 0.4, "pairs": 0.6}, "rrf_k": 20}, "calibrate": {"threshold": 0.5}}
    ranking, predicted = retrieval.run(spec, inputs, 3)
    assert metrics.recall_at(ranking, questions.select("qid", "answer"), [1]).first().recall == 1
    assert predicted.count() == 3
    nothing = spark.createDataFrame([("z", "zzzz qqqq")], "qid string, question string")
    assert retrieval.build({"type": "bm25"}).search(retrieval.Inputs(nothing, chunks)).count() == 0
    for wrong in ({"type": "other"}, {"type": "bm25", "x": 1}, {"sources": {"a": {}}}, {"sources": {"a": {}, "b": {}}, "pool": "sum"}):
        with pytest.raises(ConfigError):
            retrieval.build(wrong)


def test_hybrid_of_one_weight_is_that_source(spark):
    chunks, questions = demo.synthetic(spark, 12)
    inputs = retrieval.Inputs(questions.select("qid", "question"), chunks)
    alone = retrieval.build({"type": "bm25"}).search(inputs, 5)
    for level in ("doc", "chunk"):
        spec = {"sources": {"a": {"type": "bm25"}, "b": {"type": "bm25", "tokenizer": "whitespace"}}, "weights": {"a": 1, "b": 0}, "fuse_level": level}
        both = retrieval.build(spec).search(inputs, 5)
        assert {(r.qid, r.doc_id, r["rank"]) for r in both.collect()} == {(r.qid, r.doc_id, r["rank"]) for r in alone.collect()}


def test_scores_equal_a_scalar_twin(spark):
    chunks, questions = demo.synthetic(spark, 30)
    index = bm25.build_index(chunks)
    got = {(r.qid, r.chunk_id): r.score for r in bm25.score_chunks(questions, index, top=1000).collect()}
    texts = {r.chunk_id: _tokens(r.text) for r in chunks.collect()}
    mean = sum(map(len, texts.values())) / len(texts)
    df = {}
    for tokens in texts.values():
        for t in set(tokens):
            df[t] = df.get(t, 0) + 1
    for q in questions.collect():
        for cid, tokens in texts.items():
            score = sum(math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * tokens.count(t) * 2.5 / (tokens.count(t) + 1.5 * (0.25 + 0.75 * len(tokens) / mean)) for t in _tokens(q.question) if t in df)
            assert got.get((q.qid, cid), 0.0) == pytest.approx(score, abs=2e-6)


def _tokens(text):
    import re

    from docloom.functions.text import tone_pairs

    text = text.lower()
    for late, early in tone_pairs():
        text = re.sub(f"(?<!q){late}" if late[0] == "u" else late, early, text)
    return re.findall(r"\w+", text)


def test_questions_in_several_blocks(spark, monkeypatch):
    chunks, questions = demo.synthetic(spark, 12)
    whole = bm25.score_chunks(questions, bm25.build_index(chunks)).collect()
    for name, size in {"QUESTION_BLOCK": 2, "CHUNK_BLOCK": 5, "AT_ONCE": 1, "DENSE": 0.5}.items():
        monkeypatch.setattr(bm25, name, size)
    assert sorted(bm25.score_chunks(questions, bm25.build_index(chunks)).collect()) == sorted(whole)


def test_a_search_moves_no_chunk_for_a_block_of_questions(spark, monkeypatch):
    """However many blocks there are, the plan repeats neither questions nor chunks, and ranks without a shuffle."""
    chunks, questions = demo.synthetic(spark, 12)
    for name, size in {"QUESTION_BLOCK": 2, "CHUNK_BLOCK": 5}.items():
        monkeypatch.setattr(bm25, name, size)
    found = bm25.score_chunks(questions, bm25.build_index(chunks), top=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Window" not in plan


def test_rows_of_questions_are_shuffled_once(spark):
    """Fusion and labels of neighbours move the found rows by question, and no more."""
    a = ranked(spark, {"q": ["x", "y"], "p": ["y"]})
    shuffles = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("Exchange")
    fused = fusion.fuse({"a": a, "b": ranked(spark, {"q": ["y", "z"]})}, {"a": 1, "b": 0}, carry="chunk_id")
    assert shuffles(fused) == 1 and [(r.doc_id, r.chunk_id) for r in fused.where("qid = 'q'").orderBy("rank").collect()] == [("x", "x::0000"), ("y", "y::0000")]
    similar = spark.createDataFrame([("q", "q", '["s"]', 9.0, 1), ("q", "m", '["d", "e,f"]', 4.0, 2), ("q", "n", '["d"]', 2.0, 3), ("q", "o", '["d"]', 1.0, 4)], "qid string, item_id string, answer string, score double, rank int")
    near = fusion.neighbour_documents(similar, 2)
    assert shuffles(near) == 1 and [(r.doc_id, r.score) for r in near.orderBy("rank").collect()] == [("d", 1.5), ("e,f", 1.0)]


def test_copies_of_chunks_and_questions(spark, monkeypatch):
    """Equal texts are scored once, but all copies are ranked, and the last place's ties go by chunk id."""
    texts = ["an ninh mạng", "an toàn mạng", "thuế đất", "an ninh", "", None]
    rows = [(f"c{i:02d}", f"d{i % 7}", texts[i * i % 6]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")
    asked = [("q1", "an ninh mạng"), ("q2", "an ninh mạng"), ("q3", "đất an"), ("q4", "zz"), ("q5", None)]
    questions = spark.createDataFrame(asked, "qid string, question string")
    index = bm25.build_index(chunks)
    assert index.chunks == 30 and index.documents == 7
    nameless = spark.createDataFrame([(None, "mạng")], "qid string, question string")
    assert [r.qid for r in bm25.score_chunks(nameless, index, top=3).collect()] == [None] * 3
    whole = bm25.score_chunks(questions, index, top=3000).collect()
    assert len(whole) == sum(sum(1 for _, _, t in rows if set((q or "").split()) & set((t or "").split())) for _, q in asked)
    for sizes in ({}, {"CHUNK_BLOCK": 1, "QUESTION_BLOCK": 1, "AT_ONCE": 1}):
        for name, size in sizes.items():
            monkeypatch.setattr(bm25, name, size)
        index = bm25.build_index(chunks)
        for top in (1, 3, 7, 12):
            got = bm25.score_chunks(questions, index, top=top).collect()
            want = [r for q in ("q1", "q2", "q3") for r in sorted((r for r in whole if r.qid == q), key=lambda r: (-r.score, r.chunk_id))[:top]]
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_shuffles_of_a_materialized_table_are_freed(spark):
    shuffles = lambda: str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()).count("shuffle_")
    before = shuffles()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "freed")
    assert shuffles() <= before and table.count() == 10


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: null}\nb: [1]\n")
    (tmp_path / "top.yaml").write_text("extends: base.yaml\na: {x: 2}\nc: {extends: 'base.yaml#a', z: 3}\n")
    assert load(tmp_path / "top.yaml") == {"a": {"x": 2, "y": None}, "b": [1], "c": {"x": 1, "y": None, "z": 3}}
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    for name in ("loop.yaml", "none.yaml"):
        with pytest.raises(ConfigError):
            load(tmp_path / name)
    assert merged({"a": [1]}, {"a": [2]}) == {"a": [2]}


def test_failure_modes(spark):
    gold = spark.createDataFrame([("all", ["a", "b"]), ("some", ["a", "x"]), ("far", ["z"]), ("none", ["y"])], "qid string, answer array<string>")
    rows = [(q, r + 1, d) for q in ("all", "some", "far", "none") for r, d in enumerate(["a", "b", "c", "d", "e", "z"])]
    modes = metrics.failure_modes(spark.createDataFrame(rows, "qid string, rank int, doc_id string"), gold)
    assert {r.qid: r["mode"] for r in modes.collect()} == {"all": "OK", "some": "MISS5", "far": "MISS5", "none": "MISS50"}
    sample = {r["mode"]: (r.questions, r.taken, r.rescale) for r in metrics.failure_sample(modes, {"MISS5": 1, "MISS50": 3}).collect()}
    assert sample == {"MISS5": (2, 1, 2.0), "MISS50": (1, 1, 1.0)}


def test_domains(spark):
    """A chosen field keeps its documents; those outside the corpus vote for ? but are of no field."""
    rows = spark.createDataFrame([("q", "a", 5.0, 1), ("q", "b", 4.0, 2), ("q", "c", 3.0, 3), ("p", "x", 9.0, 1), ("p", "a", 1.0, 2)], "qid string, doc_id string, score double, rank int")
    domains = spark.createDataFrame([("a", "thue"), ("b", "dat"), ("c", "dat")], "doc_id string, domain string")
    chosen = fusion.vote_domain(rows, domains)
    assert {r.qid: r.domain for r in chosen.collect()} == {"q": "dat", "p": "?"}
    assert [(r.doc_id, r["rank"]) for r in fusion.apply_domain(rows, domains, chosen).orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    assert [r.doc_id for r in fusion.apply_domain(rows, domains, chosen, 0.5).where("qid = 'q'").orderBy("rank").collect()] == ["b", "a", "c"]
