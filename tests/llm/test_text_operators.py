"""One form, splitting, encoding, term scores and truncation: fixtures, invariants, and the cases every operator meets."""

import math
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import distinctive, encode, splitter, transducer, truncation, words
from docloom.llm.transducer import one_form

SAME = {
    "phảι": "phải", "С‌ăn": "Căn", "t​hаng": "thang", "Ｔｒữｕ ２０": "Trữu 20", "Ðiều": "Điều", "QТ1753": "QT1753", "ộ": "ộ", "ộ": "ộ",
    "а́o": "áo", "a b　c": "a b c", "ợ": "ợ", "ｏ̂́n": "ốn", "​": "", "ế": "ế", "рlaron_th\xado7": "plaron_tho7",
}
KEPT = ["می\u200cخواهم", "क्\u200dष", "ГОСТ α Ω", "m² ½ – “x”", "a\nb\t  c", "日本語。", "👨‍👩‍👧", "", "Nghị định 5/2020"]


@pytest.mark.parametrize("text", SAME)
def test_one_form(text):
    assert one_form(text) == SAME[text]


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert one_form(text) == text


@given(st.text(st.sampled_from(list("aăâeêoôơuưyđAĐ bcn1.\n") + list("̛̣̀́̂̆​ аоιＴｎ")), max_size=30))
@settings(max_examples=300, deadline=None)
def test_one_form_is_final(text):
    form = one_form(text)
    assert one_form(form) == form == unicodedata.normalize("NFC", form)


def test_joiners_elsewhere_are_invisible():
    assert one_form("t\u200cin می\u200cخواهم t\u200din \u200cمی\u200c") == "tin می\u200cخواهم tin می"


def test_conflicts_are_found():
    with pytest.raises(transducer.ConflictError):
        transducer.Transducer({"a": "b"}, {"a": "c"})
    with pytest.raises(transducer.ConflictError):
        transducer.Transducer({"a": "b", "b": "c"}, {})
    longest = transducer.Transducer({"ab": "x", "a": "y"}, {})
    assert longest.cluster("aba", False) == "xy"


def test_changed_records(spark):
    rows = [(1, "phải"), (1, "phải"), (2, "phảι"), (2, "phảι"), (3, None), (4, ""), (5, " ​"), (None, "t​hang"), (6, "x" * 200_000 + "​")]
    df = spark.createDataFrame(rows, "id long, passage string").withColumn("tbl", transducer.F.lit(0)).withColumn("rec_key", transducer.F.lit(0))
    got = sorted((r.tbl, r.rec_key or "") for r in transducer.changed_records(df, "id", "passage", "t").collect())
    assert got == [("t", ""), ("t", "2"), ("t", "6")]
    assert transducer.changed_records(df.where("false"), "id", "passage", "t").count() == 0
    assert transducer.normalize_texts(df, "passage").where("id = 2").first().one_form == "phải"
    assert transducer.normalize_texts(df, "passage", "tbl").where("id = 3").first().tbl is None


def test_words():
    assert words.folded_words("Điều 5: Cơ quan_thuế m² ĐƯỜNG") == ["dieu", "5", "co", "quan_thue", "m²", "duong"]
    assert words.accented_terms("Điều ĐIỀU x²") == ["điều", "điều", "x²"]
    assert words.folded_words("...") == []


# --- splitting ---


@given(st.lists(st.sampled_from(["a", "b.", "c,", "d;", "\n", "\n\n", "Điều 3. ", "1."]), max_size=120), st.integers(1, 12), st.integers(0, 14), st.sampled_from(["loose", "strict"]))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_text_back(parts, size, overlap, strategy):
    text = " ".join(parts)
    config = splitter.SplitConfig(1, size, overlap, strategy)
    pieces, all_words = splitter.split_text(text, config), text.split()
    assert [w for p in pieces for w in p["text"].split()[p["own_word"] - p["start_word"] :]] == all_words
    assert all(len(p["text"].split()) == p["end_word"] - p["start_word"] <= size for p in pieces)
    assert (len(pieces) > 1) == (len(all_words) > size)
    for before, after in zip(pieces, pieces[1:]):
        assert after["own_word"] == before["end_word"]
        assert after["own_word"] - after["start_word"] == min(config.overlap, after["own_word"])


def test_natural_boundaries():
    text = " ".join(["một"] * 9) + ". " + " ".join(["hai"] * 8)
    assert [p["text"].split()[-1] for p in splitter.split_text(text, splitter.SplitConfig(1, 12, 0))] == ["một.", "hai"]
    assert splitter.SplitConfig(1, 5, 5).overlap == 0
    for wrong in ((1, 0, 0), (1, 5, 0, "other")):
        with pytest.raises(ValueError):
            splitter.SplitConfig(*wrong)


def test_split_records(spark):
    long = " ".join(["w"] * 50_000)
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, " \n"), (5, long), (None, "a b c d")], "id long, passage string").withColumn("piece", splitter.F.lit(9))
    configs = [splitter.SplitConfig(1, 2, 1), splitter.SplitConfig(2, 100, 10)]
    got = splitter.split_records(df, "id", "passage", configs).collect()
    assert [(r.text, r.piece) for r in got if r.id == 1 and r.cfg_id == 1] == [("a", 0), ("a b", 1), ("b c", 2)]
    assert {r.id for r in got} == {1, 5, None} and all(len(r.text.split()) <= 100 for r in got)
    assert splitter.split_records(df.where("false"), "id", "passage", configs).count() == 0
    table = spark.createDataFrame([(1, 5, None, None), (None, 5, 1, "loose"), (2, None, 1, "loose")], "cfg_id int, chunk_size int, overlap int, strategy string")
    assert splitter.read_configs(table) == [splitter.SplitConfig(1, 5, 0, "loose")]


def test_found_equals_word_counts(spark, folder, duck):
    from docloom.llm import queries

    expected = {
        (c, i) for i, p in duck.sql("SELECT DISTINCT id, passage FROM raw_contexts WHERE passage IS NOT NULL").fetchall() for c, s in duck.sql("SELECT cfg_id, chunk_size FROM chunker_config").fetchall() if len(p.split()) > s
    }
    assert {(r.cfg_id, r.id) for r in queries.p6_found(spark, folder).collect()} == expected


# --- encoding ---


@pytest.fixture(scope="module")
def plain():
    pytest.importorskip("public_tokenizers")
    return encode.load_encoding(encode.default_path())[0]


@given(st.text(st.sampled_from(list("ab cđề日\n\t.'s1  　 \x85😀")), max_size=200))
@settings(max_examples=300, deadline=None)
def test_chunks_agree_with_whole_texts(text):
    plain = encode.load_encoding(encode.default_path())[0]
    assert encode.ChunkEncoder(encode.default_path()).encode(text) == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 70_000, "日本" * 20_000, " " * 50_000 + "b", "a.b" * 20_000, "word word " * 9_000, "<|endoftext|> x"])
def test_long_stretches(plain, text, monkeypatch):
    encoder = encode.ChunkEncoder(encode.default_path())
    assert encoder.encode(text) == plain.encode_ordinary(text)
    monkeypatch.setattr(encode, "MAX_CHUNK", 100)  # every join is repaired
    assert encode.ChunkEncoder(encode.default_path()).encode(text) == plain.encode_ordinary(text)


def test_memo_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(encode, "MEMO_BYTES", 1000)
    encoder = encode.ChunkEncoder(encode.default_path())
    text = " ".join(f"word{i}" for i in range(2000))
    assert encoder.encode(text) == plain.encode_ordinary(text) and encoder.held <= 1000


def test_encode_texts(spark, plain):
    df = spark.createDataFrame([(1, "Điều 5"), (2, None), (3, ""), (1, "Điều 5"), (None, "x")], "doc_id long, text string").withColumn("ids", encode.F.lit("clash"))
    got = sorted((r.doc_id or 0, r.ids) for r in encode.encode_texts(df, "text").collect())
    one = plain.encode_ordinary("Điều 5")
    assert got == [(0, plain.encode_ordinary("x")), (1, one), (1, one), (2, []), (3, [])]
    assert encode.encode_texts(df.where("false"), "text").count() == 0
    assert {r.n for r in df.select(encode.token_counts(encode.default_path())("text").alias("n")).collect()} == {len(one), 0, 1}


def test_ids_of_all_documents(spark, folder, duck, plain):
    from docloom.llm import queries

    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.p8_ids(spark, folder).collect():
        assert r.ids == (plain.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])


# --- term scores ---


def test_term_scores(spark):
    df = spark.createDataFrame([(1, "a a b"), (1, "a a b"), (2, "a c"), (3, " "), (4, None), (5, "..."), (None, "b")], "id long, passage string").withColumn("df", distinctive.F.lit(0))
    got = {(r.id, r.term): r for r in distinctive.score_terms(df, "id", "passage").collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "c"), (None, "b")}
    assert (got[1, "a"].tf, got[1, "a"].df) == (2, 2)
    assert got[1, "a"].idf == pytest.approx(math.log(1 + (4 - 2 + 0.5) / 2.5))  # the text of dots counts in N
    a, b, c, d = 2, 1, 1, 2
    xlx = lambda x: x * math.log(x) if x else 0
    g2 = 2 * (xlx(a) + xlx(b) + xlx(c) + xlx(d) + xlx(6) - xlx(a + b) - xlx(c + d) - xlx(a + c) - xlx(b + d))
    assert got[1, "a"].llr == pytest.approx(g2)
    assert {(r.id, r.term) for r in distinctive.most_distinctive(distinctive.score_terms(df, "id", "passage"), "id").collect()} == {(1, "a"), (2, "a"), (None, "b")}
    assert distinctive.score_terms(df.where("false"), "id", "passage").count() == 0


@pytest.mark.parametrize("heavy", [1, 20_000])
def test_top_terms_equal_brute_force(spark, folder, duck, monkeypatch, heavy):
    from docloom.llm import queries

    monkeypatch.setattr(distinctive, "HEAVY_TERMS", heavy)
    texts = dict(duck.sql("SELECT id, passage FROM raw_contexts WHERE passage IS NOT NULL").fetchall())
    counts = {i: Counter(words.accented_terms(p)) for i, p in texts.items() if p.strip()}
    df = Counter(t for c in counts.values() for t in c)
    score = lambda t, n: (-round(n * math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)), 6), t)
    expected = {(i, min(score(t, n) for t, n in c.items() if df[t] > 1)[1]) for i, c in counts.items() if any(df[t] > 1 for t in c)}
    assert {(r.id, r.term) for r in queries.p7_found(spark, folder).collect()} == expected


# --- truncation ---

COMPLETE = ["Câu một. Câu hai kết thúc.", "Nội dung đủ. v.v…", "Nội dung. “trích dẫn”", "Hết câu.\n(Đã ký)", "Xong. ./."]
CUT = ["Câu một. Câu hai chưa", "Câu một, câu hai,", "Nội dung bị [...]", "Câu bị ngắt…", "Câu bị ngắ�", "Câu bị&nbs", "Câu bị \\u01", "Xong.\nĐiều 6.", "a) xong; b)"]


@pytest.mark.parametrize("text", COMPLETE + CUT)
def test_endings(text):
    found = truncation.judge_ending(text)
    assert (found["open"] or found["broken"]) == (text in CUT)


def truncated_corpus():
    words_ = "quyết định nghiệm thu công trình phòng thử thực hiện theo văn bản".split()
    rows = [(i, " ".join(words_[(i + k) % len(words_)] for k in range(12)) + ".\nThân bài nói về việc " + words_[i % len(words_)] + f".\nTrang {i}", "a") for i in range(40)]
    rows += [(100 + i, ("Đầu bài. " + " ".join(words_[(i * 7 + k) % len(words_)] for k in range(40)))[:100], "b") for i in range(10)]
    rows += [(200, "Câu đầu. Quyết định nghiệm thu công trì", "c"), (201, "Câu đầu. Quyết định nghiệm thu công trình.", "c"), (202, "Thông báo về việc nghiệm thu", "c")]
    return rows + [(300, None, "c"), (301, "", None), (302, "  ", "c"), (200, "Câu đầu. Quyết định nghiệm thu công trì", "c"), (303, "x" * 100_000 + ".", None)]


def test_truncated(spark):
    df = spark.createDataFrame(truncated_corpus(), "doc_id long, text string, source string").withColumn("truncated", truncation.F.lit(1)).withColumn("token", truncation.F.lit(1))
    found = truncation.truncated_texts(df, "doc_id", "text", "source")
    cut = {r.doc_id for r in found.where("truncated").collect()}
    assert cut == {200, *range(100, 110)}
    assert {r.doc_id for r in found.where("within_word").collect()} >= {200}
    assert {r.source: (r.texts, r.truncated) for r in truncation.shares_by_source(found, "source").collect()} == {"a": (40, 0), "b": (10, 10), "c": (4, 2), None: (1, 0)}
    assert truncation.truncated_texts(df.where("false"), "doc_id", "text", "source").count() == 0


def found_truncated(spark, rows):
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string")
    return {r.doc_id for r in truncation.truncated_texts(df, "doc_id", "text", "source").where("truncated").collect()}


def test_copies_tell_nothing(spark):
    whole = [(i, t) for i, t, s in truncated_corpus() if s == "a"]
    cut = "Câu đầu.\nBiên soạn lại toàn bộ văn bản theo quyết định"
    other = "Câu khác.\nBiên soạn lại hồ sơ nghiệm thu theo văn bản"
    assert found_truncated(spark, [*whole, (900, cut), (901, other.replace("Biên soạn", "Kính gửi"))]) == {900, 901}
    assert found_truncated(spark, [*whole, *((900 + k, cut) for k in range(2))]) == {900, 901}
    hot = [(1000 + k, cut) for k in range(30)]  # a third of all rows
    assert found_truncated(spark, [*whole, *hot]) == {i for i, _ in hot}
    title = "Thông báo về việc nghiệm thu"
    assert found_truncated(spark, [*whole, *((900 + k, title) for k in range(4))]) == set()  # no field limit


def test_recurring_fragments_are_no_words(spark):
    line = "Câu về công trình và quy trình của phòng thử số"
    whole = [(i, f"{line} {i}. {line} {i}. Nội dung {'đăng ký quy trình' if i % 3 else 'thông báo'}.") for i in range(120)]
    cut = [(900 + i, f"Thông báo {i} về việc nghiệm thu công trì") for i in range(8)]  # titles, each another text
    kept = [(950 + i, f"Thông báo {i} về việc đăng ký quy trình") for i in range(8)]
    assert found_truncated(spark, [*whole, *cut, *kept]) == {i for i, _ in cut}


def test_the_trie_decides(spark, monkeypatch):
    """A fragment that no text uses as a word is found by the trie alone; a name that begins no word isn't a cut."""
    line = "Câu về công trình và quy trình của phòng thử số"
    whole = [(i, f"{line} {i}. {line} {i}.") for i in range(60)]
    cut = [(900 + i, f"Câu đầu số {i}{' nữa' * i}. Câu hai về việc nghiệm thu công trì") for i in range(4)]
    signed = [(950 + i, f"Câu đầu số {i}{' nữa' * i}. Câu hai đủ.\nNgười lập bảng thứ {i} là ông Xyzq{chr(97 + i)}w") for i in range(4)]
    assert found_truncated(spark, [*whole, *cut, *signed]) == {i for i, _ in cut}
    real = truncation._final_tokens
    monkeypatch.setattr(truncation, "_final_tokens", lambda *a: real(*a).withColumn("fragment", truncation.F.lit(False)))
    assert found_truncated(spark, [*whole, *cut, *signed]) == set()


def test_stamps_of_any_length(spark):
    """A stamp behind a field limit is learned whatever its length, also where it stands right behind a letter."""
    stamp = " (văn bản này còn tiếp tục ở phần sau, xem thêm toàn văn tại trang thông tin điện tử của cơ quan ban hành, mục công báo, số ra cùng ngày)."
    text = "Quyết định nghiệm thu công trình phòng thử thực hiện theo văn bản và quy trình đăng ký hằng năm của cơ quan "
    body = [(i, f"Bài {i:03d}. " + text * 3 + f"Kết thúc bài {i}.") for i in range(30)]
    cut = [(500 + i, (f"Phần {i:03d}. " + text * 4)[:200]) for i in range(8)]
    stamped = [(600 + i, (f"Mục {i:03d}. " + text * 4)[:200] + (stamp if i % 2 else stamp.strip())) for i in range(6)]
    assert found_truncated(spark, [*body, *cut, *stamped]) == {i for i, _ in [*cut, *stamped]}


def test_ratio_equals_brute_force(spark, folder, duck):
    """Every record's five terms of highest log-likelihood ratio, from entropies instead of the operator's formula."""
    from docloom.llm import queries

    rows = duck.sql("SELECT id, min(passage) FROM raw_contexts WHERE regexp_matches(passage, '[^\\s\\x{a0}\\x{ad}\\x{2000}-\\x{200d}\\x{3000}\\x{feff}]') GROUP BY id").fetchall()
    counts = {i: Counter(words.accented_terms(t)) for i, t in rows}
    whole = sum(counts.values(), Counter())
    total = whole.total()

    def entropy(*ks):
        n = sum(ks)
        return -sum(k / n * math.log(k / n) for k in ks if k)

    def ratio(k, own, all_):
        a, b, c, d = k, own - k, all_ - k, total - own - all_ + k
        g2 = 2 * total * (entropy(a + b, c + d) + entropy(a + c, b + d) - entropy(a, b, c, d))
        return math.copysign(max(g2, 0), a * d - b * c) if a * d != b * c else 0.0

    got = {}
    for r in queries.p7_llr(spark, folder).collect():
        got.setdefault(r.id, []).append((r.rank, r.term, r.llr))
    for i, terms in counts.items():
        own = terms.total()
        best = sorted((ratio(k, own, whole[t]) for t, k in terms.items()), reverse=True)[:5]
        rows_ = sorted(got.get(i, []))
        assert [x for _, _, x in rows_] == pytest.approx(best, abs=2e-4)
        assert all(x == pytest.approx(ratio(terms[t], own, whole[t]), abs=2e-4) for _, t, x in rows_)
