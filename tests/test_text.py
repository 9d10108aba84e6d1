"""Tokenizers, tone folding, cleaning and chunking against fixtures and scalar twins."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.tokens import Tokenizer
from docloom.operators import chunking


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in rows.select("i", column.alias("o")).orderBy("i").collect()]


def test_tone_folding(spark):
    pairs = {"hoà bình": "hòa bình", "khoẻ mạnh": "khỏe mạnh", "thuỷ lợi": "thủy lợi", "uỷ ban": "ủy ban", "hoá đơn": "hóa đơn", "quý khách": "quý khách", "quỷ kế": "quỷ kế", "cửa hàng": "cửa hàng", "giá": "giá"}
    assert one(spark, tx.fold_tones(F.col("t")), *pairs) == list(pairs.values())


@pytest.mark.parametrize(
    "tokenizer, text, tokens",
    [
        (Tokenizer(), "Điều 5. Cơ quan thuế", "điều,5,cơ,quan,thuế"),
        (Tokenizer("whitespace"), "(quy định),", "quy,định"),
        (Tokenizer("whitespace", lowercase=False), "số 78/2021/TT-BTC.", "số,78/2021/TT-BTC"),
        (Tokenizer("syllable_bigram"), "cơ quan thuế", "cơ,quan,thuế,cơ_quan,quan_thuế"),
        (Tokenizer("syllable_bigram", keep_syllables=False), "cơ quan thuế", "cơ_quan,quan_thuế"),
        (Tokenizer("syllable_bigram"), "quy định. Điều 5", "quy,định,quy_định,điều,5,điều_5"),
        (Tokenizer(min_len=2), "Điều 5 về cơ quan", "điều,về,cơ,quan"),
        (Tokenizer(), "", ""),
        (Tokenizer("syllable_bigram"), None, ""),
        (Tokenizer("whitespace"), " - ", ""),
    ],
)
def test_tokenizers(spark, tokenizer, text, tokens):
    assert one(spark, F.array_join(tokenizer(F.col("t")), ","), text) == [tokens]


def test_tokenizer_options():
    assert Tokenizer("syllable_bigram", False, False, 2, False).key == "syllable_bigram-nolower-notonefold-minlen2-bigramonly"
    for wrong in ({"name": "other"}, {"min_len": 0}):
        with pytest.raises(ValueError):
            Tokenizer(**wrong)


def test_cleaning(spark):
    got = one(spark, tx.clean(F.col("t")), "A \r\n\n B", "Luật ĐĂNG NHẬP ĐỂ XEM tiếp", None, "Nghi" + "ệ" + "p", " x　y ")
    assert got == ["A B", "Luật", "", "Nghiệp", "x y"]


def test_link_domain_and_titles(spark):
    links = ("https://a.vn/van-ban/thue-phi/le-phi-1.aspx", "https://a.vn/van-ban/1.aspx", "https://a.vn/Van/Ban/x", None, "x")
    assert one(spark, tx.link_domain(F.col("t")), *links) == ["van-ban/thue-phi", "?", "?", "?", "?"]
    assert one(spark, tx.plain_words(F.replace("t", F.lit("-"), F.lit(" "))), "Quyet-dinh-24-2019-QD-CKL", "Quyết định của Đà Lạt") == [["quyet", "dinh", "2019", "ckl"], ["quyet", "dinh", "cua", "lat"]]
    head = "BỘ TÀI CHÍNH Số: 78/2021/TT-BTC THÔNG TƯ hướng dẫn hoá đơn, Căn cứ Luật"
    assert one(spark, tx.title(F.col("t")), head, "không có") == ["78/2021/TT-BTC THÔNG TƯ hướng dẫn hoá đơn", None]
    assert one(spark, tx.own_code(F.lit("Thong-tu-17-2022-TT-BGTVT-sua-doi-x"), F.col("t")), "Số: 5/2020/NĐ-CP", "") == ["5/2020/NĐ-CP", "17/2022/TT-BGTVT"]


def test_erfc(spark):
    got = spark.range(1).select(tx.chi_square_p(F.lit(3.841458820694124)).alias("p")).first().p
    assert got == pytest.approx(0.05, abs=1e-6)


def scalar_windows(text, size, overlap):
    words = text.split()
    step = size - overlap if size > overlap else size
    if len(words) <= size:
        return [text] if words else []
    count = -(-(len(words) - size) // step) + 1
    return [" ".join(words[k * step : k * step + size]) for k in range(count)]


@pytest.mark.parametrize("n, size, overlap", [(10, 4, 1), (4, 4, 1), (5, 4, 4), (0, 4, 1), (9, 4, 0), (100, 7, 3)])
def test_windows(spark, n, size, overlap):
    text = " ".join(f"w{i}" for i in range(n))
    assert one(spark, chunking.windows(F.col("t"), size, overlap), text) == [scalar_windows(text, size, overlap)]


def scalar_chunks(text, config):
    """The same definition over plain strings."""
    marker = re.compile({"loose": r"\bĐiều\s+\d+\b", "strict": r"\bĐiều\s+\d+\.\s"}[config.strategy], re.I)
    starts = [m.start() for m in marker.finditer(text)]
    if not text.strip():
        return []
    if not starts:
        return scalar_windows(text, config.size, config.overlap)
    out = []
    for lo, hi in zip([0, *starts], [*starts, len(text)]):
        part = text[lo:hi].strip()
        if not part:
            continue
        if len(part.split()) <= config.size:
            out.append(part)
            continue
        found = marker.search(part)
        label = found.group().strip() if found else ""
        tag = f"[{label} - tiếp theo] "
        size = max(config.size - len(tag.split()), 1) if label and config.strategy == "strict" else config.size
        for i, piece in enumerate(scalar_windows(part, size, config.overlap)):
            out.append(piece if not i or not label or piece.strip().startswith(label) else tag + piece)
    return out


@pytest.mark.parametrize("strategy", ["loose", "strict"])
def test_chunks_equal_their_twin(spark, folder, strategy):
    from docloom.plans.catalog import clean

    config = chunking.Chunking(40, 10, strategy)
    rows = clean(spark, folder)
    got = {}
    for r in chunking.chunk_documents(rows, config).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {r.doc_id: c for r in rows.collect() if (c := scalar_chunks(unicodedata.normalize("NFC", r.text), config))}


def test_chunking_fixtures(spark):
    text = "Mở đầu Điều 1. Một theo Điều 5 của luật Điều 2. Hai"
    for strategy, n in (("loose", 4), ("strict", 3)):
        assert len(one(spark, chunking.chunk_texts(F.col("t"), chunking.Chunking(strategy=strategy)), text)[0]) == n
    long = "Điều 7. " + " ".join(f"w{i}" for i in range(28))
    pieces = one(spark, chunking.chunk_texts(F.col("t"), chunking.Chunking(10, 2, "strict")), long)[0]
    assert all(p.startswith("[Điều 7") and len(p.split()) <= 10 for p in pieces[1:])
    with pytest.raises(ValueError):
        chunking.Chunking(strategy="other")
