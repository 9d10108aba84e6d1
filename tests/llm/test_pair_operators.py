"""Overlaps, near duplicates, the permutation index, top-N and mixing against brute force, and the cases all meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing, neardup, overlap, permindex, queries, topn
from docloom.llm.words import folded_words


def sets(rows):
    return {k: set(folded_words(t)) for k, t in rows if t and folded_words(t)}


def sentences(seed, n, length=30, vocabulary=400):
    rng = random.Random(seed)
    return [[f"từ{rng.randrange(vocabulary)}" for _ in range(length)] for _ in range(n)]


# --- overlaps across splits ---


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    train = [(f"t{i}", " ".join(s)) for i, s in enumerate(sentences(1, 200))]
    evals = []
    for i, s in enumerate(sentences(1, 200)[:80]):
        at = rng.randrange(20)
        s = s[:at] + [f"mới{rng.randrange(99)}" for _ in range(rng.randrange(6))] + s[at + rng.randrange(4) :]
        evals.append((f"e{i}", " ".join(s if i % 2 else s[15:] + s[:15]).upper()))
    short = [("a b", "b a"), ("a b c", "c a"), ("x", "x"), ("x", "y"), ("a b c d e f", "f e d c b"), ("k l m n", "n m l z")]
    train += [(f"st{i}", t) for i, (t, _) in enumerate(short)]
    evals += [(f"se{i}", e) for i, (_, e) in enumerate(short)]
    schema = "qid string, question string"
    got = overlap.overlapping_records(spark.createDataFrame(evals, schema), spark.createDataFrame(train, schema), "qid", "qid", "question")
    a, b = sets(evals), sets(train)
    expected = {(x, y) for x, s in a.items() for y, t in b.items() if 3 * len(s & t) >= 2 * len(s | t)}
    rows = got.collect()
    assert {(r.left_key, r.right_key) for r in rows} == expected and len(rows) == len(expected)
    assert all(0 <= r.left_cover <= 1 and r.shared <= r.union for r in rows)


def test_overlap_cases(spark):
    schema = "qid string, question string, words string, cls string"
    left = [("1", "một hai ba bốn", "", ""), ("1", "một hai ba bốn", "", ""), ("2", None, "", ""), ("3", " ", "", ""), (None, "một hai ba bốn", "", ""), ("4", "...", "", ""), ("5", "dài " * 50_000, "", "")]
    right = [("9", "Một hai ba bốn!", "", ""), ("8", "dài", "", "")]
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    assert {(x.left_key, x.right_key) for x in overlap.overlapping_records(l, r, "qid", "qid", "question").collect()} == {("1", "9"), ("5", "8")}
    for a, b in ((l.where("false"), r), (l, r.where("false"))):
        assert overlap.overlapping_records(a, b, "qid", "qid", "question").count() == 0
    lists = spark.createDataFrame([(["a"], ["a"]), (["a"], ["b"]), (None, ["b"]), (["a"], []), (["a", None], ["b"])], "x array<string>, y array<string>")
    assert [r.m for r in lists.select(overlap.matching_answers("x", "y").alias("m")).collect()] == [True, False, True, True, False]


def winnowed(runs, keys=None):
    return overlap.winnow(runs if keys is None else keys, np.array([0, len(runs)]), np.array([len(runs)]))


def test_winnowing_keeps_shared_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        run = rng.integers(0, 2**63, overlap.WINDOW, dtype=np.uint64)
        a = np.concatenate([rng.integers(0, 2**63, 9, dtype=np.uint64), run])
        b = np.concatenate([run, rng.integers(0, 2**63, 9, dtype=np.uint64)])
        picked = [set(x[winnowed(x)].tolist()) for x in (a, b)]
        assert picked[0] & picked[1]


def test_winnowing_a_batch_is_winnowing_its_texts():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 4, 5, 40, 1, 7]
    runs = rng.integers(0, 6, sum(sizes), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    expected = []
    for lo, n in zip(offsets, sizes):
        part = runs[lo : lo + n].tolist()
        w = min(n, overlap.WINDOW)
        expected += sorted({lo + max(range(i, i + w), key=lambda j: (-part[j], j)) for i in range(n - w + 1)})
    assert overlap.winnow(runs, offsets, np.array(sizes)).tolist() == expected


def test_chain_and_extension():
    a = [f"w{i}" for i in range(30)]
    b = a[:12] + ["x"] + a[13:]
    n, in_a, in_b = overlap.chain_and_extend(a, b, [(2, 2), (15, 15), (20, 20), (24, 3)])
    assert n == 3 and in_a.sum() == in_b.sum() == 29 and not in_a[12]
    got = overlap.verify_pair(a, b, [(2, 2), (15, 15)], 2, 3)
    assert got["found"] and got["chained"] and (got["shared"], got["union"]) == (29, 31)
    alone = overlap.verify_pair(a, b, [(2, 2)], 2, 3)  # what one seed covers proves nothing, so the sets decide
    assert alone["found"] and not alone["chained"] and alone["left_words"] == 12
    assert not overlap.verify_pair(a, a[:10] + [f"z{i}" for i in range(20)], [(0, 0)], 2, 3)["found"]


def test_hot_fingerprints_are_dealt(spark, monkeypatch):
    """Many texts with a common run on both sides, in tiles of three, and all words shuffled in some."""
    monkeypatch.setattr(overlap, "TILE", 3)
    rng = random.Random(4)
    head = [f"h{i}" for i in range(12)]
    base = [[*head, *s] for s in sentences(6, 40, 28, 900)]
    train = [(f"t{i}", " ".join(s)) for i, s in enumerate(base)]
    evals = [(f"e{i}", " ".join(rng.sample(s, len(s)) if i % 3 == 0 else s[: 40 - i % 9])) for i, s in enumerate(base)]
    schema = "qid string, question string"
    got = overlap.overlapping_records(spark.createDataFrame(evals, schema), spark.createDataFrame(train, schema), "qid", "qid", "question").collect()
    a, b = sets(evals), sets(train)
    expected = {(x, y) for x, s in a.items() for y, t in b.items() if 3 * len(s & t) >= 2 * len(s | t)}
    assert {(r.left_key, r.right_key) for r in got} == expected and len(got) == len(expected) >= 40
    assert {r.left_key for r in got if not r.chained} >= {f"e{i}" for i in range(0, 40, 3)}
    assert all(r.chained and r.seeds and r.left_cover == 1 for r in got if int(r.left_key[1:]) % 3)


def test_questions_equal_brute_force(spark, folder, duck):
    t = duck.sql("SELECT DISTINCT qid, question, answer FROM train WHERE question IS NOT NULL").fetchall()
    e = duck.sql("SELECT DISTINCT qid, question, answer FROM eval_questions WHERE question IS NOT NULL").fetchall()
    a, b = sets((k, q) for k, q, _ in e), sets((k, q) for k, q, _ in t)
    ga, gb = {k: g for k, _, g in e}, {k: g for k, _, g in t}
    expected = {(x, y) for x, s in a.items() for y, u in b.items() if 3 * len(s & u) >= 2 * len(s | u) and (not ga[x] or not gb[y] or set(ga[x]) & set(gb[y]))}
    assert {tuple(r) for r in queries.p1_found(spark, folder).collect()} == expected
    assert queries.p1_report(spark, folder).agg(F.sum("questions")).first()[0] == duck.sql("SELECT count(*) FROM (SELECT DISTINCT qid, split, source FROM eval_questions)").fetchall()[0][0]


# --- near duplicates ---


def grams(text):
    w = folded_words(text)
    return set(zip(w, w[1:], w[2:]))


def brute_groups(rows, threshold=0.5):
    sets_ = {k: g for k, t in rows if t and (g := grams(t))}
    parent = {k: k for k in sets_}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets_)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            if len(sets_[x] & sets_[y]) >= threshold * len(sets_[x] | sets_[y]):
                parent[find(x)] = find(y)
    return {(y, x) for i, x in enumerate(keys) for y in keys[:i] if find(x) == find(y)}


@pytest.mark.parametrize(("tile", "divided"), [(4096, 1 << 16), (3, 1 << 16), (3, 6)])
def test_groups_equal_brute_force(spark, monkeypatch, tile, divided):
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "DIVIDED", divided)
    rng = random.Random(3)
    rows = []
    head = sentences(9, 1, 40)[0]  # what many records share without being linked
    for i, s in enumerate(sentences(2, 40, 120)):
        s = [*head, *s] if i % 2 else s
        rows.append((i * 10, " ".join(s)))
        for j in range(1, rng.randrange(5)):
            s = list(s)
            for _ in range(rng.randrange(12)):
                s[rng.randrange(len(s))] = f"sửa{rng.randrange(50)}"
            if rng.random() < 0.3:
                s = s[60:] + s[:60]
            rows.append((i * 10 + j, " ".join(s)))
    groups, links = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {tuple(r) for r in neardup.group_pairs(groups).collect()} == brute_groups(rows)
    assert links.where("edit_similarity > 1 or order_share > 1").count() == 0


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_reordered_records_are_found(spark):
    """Sentences in reverse, and shuffled blocks, at similarities from 0.5 to 0.75: no link may be lost."""
    rng = random.Random(11)
    rows, pairs = [], {}
    for i in range(240):
        parts = [[f"t{rng.randrange(3000)}" for _ in range(8 if i % 2 else 12)] for _ in range(30 if i % 2 else 18)]
        other = [list(p) for p in parts]
        for _ in range(rng.randrange(0, 20)):
            p = rng.choice(other)
            p[rng.randrange(len(p))] = f"s{rng.randrange(3000)}"
        other = other[::-1] if i % 3 else rng.sample(other, len(other))
        a, b = (" ".join(w for p in x for w in p) for x in (parts, other))
        rows += [(2 * i, a), (2 * i + 1, b)]
        pairs[(2 * i, 2 * i + 1)] = jaccard(a, b)
    wanted = {p for p, j in pairs.items() if 0.5 <= j <= 0.75}
    assert len(wanted) > 100
    groups, links = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    found = {tuple(r) for r in neardup.group_pairs(groups).collect()}
    assert len(wanted & found) >= 0.99 * len(wanted) and found == brute_groups(rows)
    assert links.where("not aligned").count() > 0.5 * links.count()  # sets decide these
    assert links.agg(F.avg("order_share")).first()[0] < 0.5


def unmet_pair(rng, shared=72):
    """Two texts at a similarity of one half or just above that agree on no sketch: their own k-mers are those that the
    hash functions prefer."""
    words = [f"g{rng.randrange(10**6)}" for _ in range(shared + 2)]
    seen = set()

    def own(size):
        text = list(words)
        with np.errstate(over="ignore"):
            for _ in range(size):
                tries = [f"r{rng.randrange(10**9)}" for _ in range(300)]
                kmers = neardup.rolling_hashes(neardup.word_hashes([x for w in tries for x in (*text[-2:], w)]), 3)[::3]
                so_far = neardup.rolling_hashes(neardup.word_hashes(text), 3)
                ranks = lambda k: k.astype(np.uint32)[None, :] * neardup._FACTORS[: neardup.SKETCHES, None] + neardup._TERMS.astype(np.uint32)[: neardup.SKETCHES, None]
                best = (ranks(kmers) < ranks(so_far).min(1)[:, None]) & np.array([i not in seen for i in range(neardup.SKETCHES)])[:, None]
                pick = int(best.sum(0).argmax())
                seen.update(np.flatnonzero(best[:, pick]).tolist())
                text.append(tries[pick])
        return " ".join(text)

    return own(shared // 2), own(shared // 2)


def test_links_that_no_sketch_finds(spark):
    rng = random.Random(17)
    rows = []
    for i in range(3):
        a, b = unmet_pair(rng)
        x, y = (neardup.order_min_hash(np.array(list(dict.fromkeys(neardup.rolling_hashes(neardup.word_hashes(t.split()), 3).tolist())), np.uint64))[0] for t in (a, b))
        assert not set((x >> np.uint64(1)).tolist()) & set((y >> np.uint64(1)).tolist()) and jaccard(a, b) == 0.5
        rows += [(2 * i, a), (2 * i + 1, b)]
    groups, links = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {tuple(r) for r in neardup.group_pairs(groups).collect()} == brute_groups(rows) == {(0, 1), (2, 3), (4, 5)}
    assert links.where("aligned and order_share is null").count() == 3


def test_sketches_meet_whatever_the_order():
    """The chance that two records at a similarity of about one half agree on no sketch, by simulation."""
    rng = np.random.default_rng(5)
    agreed = []
    for _ in range(400):
        shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (200, 100, 100))
        x, _ = neardup.order_min_hash(np.concatenate([shared, a]))
        y, _ = neardup.order_min_hash(np.concatenate([b, rng.permutation(shared)]))
        agreed.append(int(((x ^ y) <= 1).sum()))
    assert min(agreed) > 1 and np.mean(agreed) == pytest.approx(neardup.SKETCHES / 4, rel=0.1)


def test_few_kmers_meet(spark):
    rows = [(1, "a b c"), (2, "a b c d"), (3, "x y z w"), (4, "y z w v"), (5, "p q r s t"), (6, "q r s t u")]
    groups, _ = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {tuple(r) for r in neardup.group_pairs(groups).collect()} == brute_groups(rows) == {(1, 2), (5, 6)}


def test_near_duplicate_cases(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (3, "a b"), (4, "a b"), (5, None), (6, ""), (None, "a b c d"), (7, "x y z " * 30_000), (8, "y z x " * 30_000)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("cls", F.lit(1)).withColumn("key", F.lit(1))
    groups, _ = neardup.near_duplicate_groups(df, "id", "text")
    assert {tuple(r) for r in neardup.group_pairs(groups).collect()} == {(1, 2), (7, 8)}
    assert {r.key for r in groups.collect()} == {1, 2, 7, 8}
    empty, links = neardup.near_duplicate_groups(df.where("false"), "id", "text")
    assert empty.count() == links.count() == 0


def test_pairs_are_told_apart_without_a_shuffle(spark):
    """Only pairs of keys that both have several groups can repeat, so only they are made distinct."""
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (1, 11), (2, 11), (2, 11), (4, 11)], "key long, group_id long")
    pairs = neardup.group_pairs(groups)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_many_copies(spark):
    rows = [(i, "một văn bản được giao lại rất nhiều lần") for i in range(300)] + [(1000 + i, f"khác hẳn số {i} với từ{i} chữ{i} câu{i}") for i in range(50)]
    groups, links = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert groups.groupBy("group_id").count().agg(F.max("count")).first()[0] == 300 and links.count() == 0
    assert groups.where("key < 1000").select("class_id").distinct().count() == 1


def test_banded_alignment_is_exact():
    """The longest common subsequence of labelled k-mers, against the plain recurrence."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, last = [0], row
            for j, y in enumerate(b):
                row.append(max(row[-1], last[j + 1], last[j] + (x == y)))
        return row[-1]

    rng = random.Random(1)
    for n in (5, 60, 300):
        for _ in range(12):
            a = [rng.choice("abcd") for _ in range(n)]
            b = [rng.choice("abcd") if rng.random() < 0.1 else x for x in a]
            b = b[n // 3 :] + b[: n // 3] if rng.random() < 0.4 else b[: rng.randrange(3, n + 1)]
            x, y = (neardup.labelled(neardup.rolling_hashes(neardup.word_hashes(w), 3))[0] for w in (a, b))
            chain = neardup.banded_alignment(x, y)
            assert len(chain) == common(x.tolist(), y.tolist()) and all(x[i] == y[j] for i, j in chain)
            assert all(p < q and r < t for (p, r), (q, t) in zip(chain, chain[1:]))


def test_verification():
    a = [f"w{i}" for i in range(100)]
    edited = a[:50] + ["mới"] + a[51:]
    assert neardup.verify_pair(a, edited, 0.5)[:2] == (True, True)
    assert neardup.verify_pair(a, a[50:] + a[:50], 0.5, ordered=False)[:2] == (True, False)
    assert neardup.verify_pair(a, a[:40] + [f"z{i}" for i in range(60)], 0.5)[0] is False
    repeated = "x y z ".split() * 40
    assert neardup.verify_pair(repeated, "x y z q r s t".split(), 0.5)[0] is False


def test_records_equal_brute_force(spark, folder, duck):
    rows = duck.sql("SELECT DISTINCT id, coalesce(name, '') || ' ' || passage FROM raw_contexts WHERE trim(passage) <> ''").fetchall()
    assert {tuple(r) for r in queries.p2_found(spark, folder).collect()} == brute_groups(rows)


# --- similar vectors ---


def brute_neighbours(rows, k=5, least=0.85, dim=64):
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None for x in v)}
    fine = {i: v / np.linalg.norm(v) for i, v in sorted(fine.items()) if not np.isnan(v).any() and v.any()}
    ids, m = list(fine), np.array(list(fine.values()))
    sims = np.round(m @ m.T, 6)
    return {(ids[a], ids[b]) for a in range(len(ids)) for b in sorted((j for j in range(len(ids)) if j != a and sims[a, j] >= least), key=lambda j: (-sims[a, j], ids[j]))[:k]}


def vectors(seed, n, dim=64, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    return [(f"v{i:05d}", (centres[i % len(centres)] + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("tile", [8, 4096])
def test_recall(spark, monkeypatch, tile):
    monkeypatch.setattr(permindex, "TILE", tile)  # files of more are compared in blocks
    rows = vectors(1, 700)
    got = {(r.id, r.neighbor_id) for r in permindex.most_similar(spark.createDataFrame(rows, "id string, embedding array<float>"), "id", "embedding").collect()}
    expected = brute_neighbours(rows)
    assert len(got & expected) >= 0.9 * len(expected) and len(got - expected) <= 0.1 * len(expected)


def test_recall_on_the_tables(spark, folder, duck):
    rows = duck.sql("SELECT chunk_id, any_value(embedding) FROM chunk_vectors GROUP BY 1").fetchall()
    got, expected = {tuple(r) for r in queries.p3_found(spark, folder).collect()}, brute_neighbours(rows)
    assert len(got & expected) >= 0.9 * len(expected)


def test_vector_cases(spark):
    base = vectors(2, 40)
    copies = [(f"c{i:03d}", base[0][1]) for i in range(60)] + [("scaled", [2 * x for x in base[0][1]])]
    bad = [("n1", None), ("n2", []), ("n3", [1.0]), ("n4", [0.0] * 64), ("n5", [float("nan")] * 64), ("n6", [None] * 64), (None, base[1][1]), base[3]]
    rows = base + copies + bad
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("key", F.lit(1)).withColumn("neighbor_id", F.lit(1))
    got = {(r.id, r.neighbor_id) for r in permindex.most_similar(df, "id", "embedding").collect()}
    expected = brute_neighbours(dict(rows).items())
    assert {x for x in got if x[0].startswith(("c", "scaled"))} == {x for x in expected if x[0].startswith(("c", "scaled"))}
    assert permindex.most_similar(df.where("false"), "id", "embedding").count() == 0
    few = permindex.most_similar(df.where("id in ('c000', 'c001', 'scaled')"), "id", "embedding").collect()
    assert {(r.id, r.neighbor_id) for r in few} == {(a, b) for a in ("c000", "c001", "scaled") for b in ("c000", "c001", "scaled") if a != b}
    assert permindex.most_similar(df.where("id = 'c000'"), "id", "embedding").count() == 0


def test_footrule():
    orders = np.array([[1, 2, 3], [2, 1, 3], [7, 8, 9], [1, 2, 3]], np.int16)
    weights = permindex._weights(orders, 10)
    assert permindex.footrule(orders, weights, np.array([0, 0, 0]), np.array([3, 1, 2])).tolist() == [0, 2, 12]
    plain = [[sum(abs((x.index(p) if p in x else 3) - (y.index(p) if p in y else 3)) for p in range(10)) for y in orders.tolist()] for x in orders.tolist()]
    assert permindex.footrule(orders, weights, np.arange(4)[:, None], np.arange(4)[None, :]).tolist() == plain


def test_footrule_decides(spark, monkeypatch):
    """A smaller distance loses neighbours: what isn't near by footrule is never reranked."""
    df = spark.createDataFrame(vectors(3, 300), "id string, embedding array<float>")
    near = permindex.most_similar(df, "id", "embedding", least=0.5).count()
    monkeypatch.setattr(permindex, "near_distance", lambda *_: 30)
    assert 0 < permindex.most_similar(df, "id", "embedding", least=0.5).count() < 0.7 * near


# --- top N ---


def test_top_n(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}", float(rng.randrange(20)), f"c{rng.randrange(500)}", f"q{i % 7}") for i in range(5000)]
    extra = [(None, 1.0, "c", "q"), ("g1", None, "c", "q"), ("g1", float("nan"), "c", "q"), ("g1", float("inf"), None, None), ("g2", -1.0, "c", None)]
    df = spark.createDataFrame(rows + rows[:500] + extra, "g string, s double, c string, q string").withColumn("rank", F.lit("clash")).withColumn("salt", F.lit(1))
    got = {}
    for r in topn.top_n_per_group(df, "g", "s", ["c", "q"], 3, salts=5).orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append((r.s, r.c, r.q))
    expected = {}
    for g, s, c, q in sorted({*rows, *extra[3:]}, key=lambda r: (-r[1], r[2] is None, r[2] or "", r[3] is None, r[3] or "")):
        expected.setdefault(g, []).append((s, c, q))
    assert got == {g: v[:3] for g, v in expected.items()}
    assert topn.top_n_per_group(df.where("false"), "g", "s", ["c"], 3).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_run(name, spark, folder):
    assert queries.queries()[name](spark, folder).count() > 0


# --- mixing ---


def documents(spark):
    rows = [(i, f"văn bản số {i} của nguồn lớn", "large") for i in range(400)] + [(1000 + i, f"chữ nhỏ {i}", "small") for i in range(20)]
    rows += [(2000, "văn bản số 1 của nguồn lớn", "large"), (2001, None, "large"), (2002, "", "small"), (2003, "không nguồn", None), (2004, "nguồn lạ", "other"), (None, "khoá trống", "large")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("position", F.lit(1))


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_mix(spark):
    mixed, plan = mixing.mix_sources(documents(spark), targets(spark, ("large", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)), "doc_id", "text", "source")
    rows = mixed.collect()
    got = {r.source: r for r in mixing.shares(mixed, plan).collect()}
    assert got["large"].actual_share == pytest.approx(2 / 3, abs=0.02) and got["small"].actual_share == pytest.approx(1 / 3, abs=0.02) and got["absent"].tokens == 0
    assert got["small"].most_uses == 3 and got["large"].most_uses == 1
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and not {r.doc_id for r in rows} & {2000, 2001, 2002, 2003, 2004}
    early = sum(r.source == "small" for r in rows if r.position < 0.5) / sum(r.source == "small" for r in rows)
    assert early < 0.45 and all(0 <= r.position <= 1 for r in rows)  # repeated sources come later
    assert sorted(mixing.mix_sources(documents(spark).repartition(7), targets(spark, ("large", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)), "doc_id", "text", "source")[0].collect()) == sorted(rows)


def test_mix_names_documents_of_their_source(spark):
    """A text of a target and another source counts for the target; one of two targets for the smaller, by its own key."""
    rows = [(1, "văn bản chung", "aaa"), (2, "văn bản chung", "zzz"), (3, "văn bản riêng", "zzz"), (4, "hai nguồn", "zzz"), (5, "hai nguồn", "mmm"), (0, "hai nguồn", "aaa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = mixing.eligible_texts(df, ["mmm", "zzz"], "doc_id", "text", "source").collect()
    assert {(r.source, r.key) for r in texts} == {("zzz", 2), ("zzz", 3), ("mmm", 5)}
    mixed, _ = mixing.mix_sources(df, targets(spark, ("zzz", 0.5, 1), ("mmm", 0.5, 9)), "doc_id", "text", "source")
    assert {(r.source, r.doc_id) for r in mixed.collect()} == {("zzz", 2), ("zzz", 3), ("mmm", 5)}


def test_mix_cases(spark):
    wanted = targets(spark, ("large", 1.0, 1))
    assert mixing.mix_sources(documents(spark).where("false"), wanted, "doc_id", "text", "source")[0].count() == 0
    assert mixing.mix_sources(documents(spark), wanted.where("false"), "doc_id", "text", "source")[0].count() == 0
    assert mixing.mix_sources(documents(spark), targets(spark, ("large", 1.0, 0)), "doc_id", "text", "source")[0].count() == 0
    some, plan = mixing.mix_sources(documents(spark), wanted, "doc_id", "text", "source", total=100)
    assert some.agg(F.sum("n_tokens")).first()[0] == pytest.approx(100, abs=30)
    late, _ = mixing.mix_sources(documents(spark), wanted, "doc_id", "text", "source", schedules={"large": [(0.0, 0.0), (1.0, 2.0)]})
    assert late.agg(F.avg("position")).first()[0] == pytest.approx(2 / 3, abs=0.02)
    for wrong in ([("a", -1.0, 1)], [("a", 0.5, 1), ("a", 0.6, 1)]):
        with pytest.raises(ValueError):
            mixing.read_targets(targets(spark, *wrong))


def test_demand_is_inverted():
    knots = [(0.0, 0.0), (0.3, 2.0), (0.6, 2.0), (1.0, 0.5)]
    t = np.linspace(0, 1, 50)
    grid = np.linspace(0, 1, 200_001)
    area = np.concatenate([[0], np.cumsum((np.interp(grid[1:], *zip(*knots)) + np.interp(grid[:-1], *zip(*knots))) / 2)])
    assert mixing.invert_demand(knots, np.interp(t, grid, area / area[-1])) == pytest.approx(t, abs=1e-4)
    for wrong in ([(0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.0, -1.0), (1.0, 1.0)]):
        with pytest.raises(ValueError):
            mixing.invert_demand(wrong, t)
