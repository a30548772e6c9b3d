import time
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import search
from lectern.plans import retrieval


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("梯度下降 is 好", ["梯度", "度下", "下降", "降好", "is"]), ("一 word_2 Été", ["word_2", "t"]), ("", []), (None, [])],
)
def test_tokens(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t")).alias("x")).first()["x"]
    assert got == want


def test_features_and_embedding(spark):
    docs = spark.createDataFrame([(1, "学习 Go 学习"), (2, "")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in search.hash_embedding(docs, ["id"]).collect()}
    feats = ["c:学", "c:习", "c:学", "c:习", "b:学习", "b:习学", "b:学习", "w:go"]
    want = [0.0] * 256
    for f in feats:
        want[zlib.crc32(f.encode()) % 256] += 1
    length = sum(x * x for x in want) ** 0.5
    assert got[1] == pytest.approx([x / length for x in want]) and got[2] == [0.0] * 256


def test_match_forms(spark):
    t = F.col("t")
    assert one(spark, X.match_form(t), t="Ａｂ　c-d\n（e）") == "Abcd(e)"
    assert one(spark, X.loose_match_form(t), t="Ａｂ　c-d\n（e）。") == "Abcde"
    assert one(spark, X.tidy(t), t=" 线 性  回归 is  fine ") == "线性回归 is fine"
    assert one(spark, X.without_markdown(t), t="**bold** [link](http://x) `code` [b]") == "bold link code b"


def test_cutting(spark):
    t = F.col("t")
    assert one(spark, X.clip(t, 3), t="abcd") == "abc…" and one(spark, X.clip(t, 4), t="abcd") == "abcd"
    assert one(spark, X.short(t, 4), t="ab  cdef") == "ab …"
    assert one(spark, X.slices(t, 14), t="x" * 30) == ["x" * 14, "x" * 14, "xx"] and one(spark, X.slices(t), t="") == []
    # The first kind of mark counts, not the first mark.
    assert one(spark, X.first_sentence(t), t="a; b. c。d") == "a; b. c。"
    assert one(spark, X.earliest_sentence(t), t="a; b. c。d") == "a;"
    assert one(spark, X.first_sentence(t), t="y" * 100) == "y" * 90 + "…"
    assert one(spark, X.sentence_at(t, F.lit(4)), t="甲。乙丙是指丁。戊") == "乙丙是指丁。"


def test_names_and_citations(spark):
    t = F.col("t")
    for name, want in (("《线性回归》", "线性回归"), ("首先要做", ""), ("A 为 f", ""), ("ab", ""), ("abc", "abc"), ("x" * 17, ""), (" 张量 ", "张量")):
        assert one(spark, X.clean_name(t), t=name) == want
    assert one(spark, X.cited(t, F.lit(3)), t="[2] [9] [1] [2] [0]") == [2, 1]
    assert one(spark, X.json_text(t), t='so ```json\n{"a": 1}\n``` yes') == '{"a": 1}'
    assert one(spark, X.json_text(t, "[", "]"), t="so [1, [2]] yes") == "[1, [2]]" and one(spark, X.json_text(t), t="none") is None
    assert one(spark, X.cloze(t, F.lit("b")), t="abcb") == "a____cb"
    assert one(spark, X.target_language(t), t="这是一本教材") == "en" and one(spark, X.target_language(t, "zh"), t="这是一本教材") == "zh"


def test_predicates(spark):
    t = F.col("t")
    for text, want in (("f(x) = 2x", True), ("公式 = 1", False), ("plain words", False), ("a =" + "b" * 80, False)):
        assert one(spark, X.looks_like_formula(t), t=text) == want
    for line, want in (("结束。", True), ("The end.", True), ("pi is 3.", False), ("on", False)):
        assert one(spark, X.ends_sentence(t), t=line) == want
    for line, want in (("- 12 -", True), ("Intro ..... 3", True), ("https://a.b", True), ("text 12", False)):
        assert one(spark, X.is_noise_line(t), t=line) == want
    assert one(spark, X.is_noise_title(t), t=" 目 录 ") and not one(spark, X.is_noise_title(t), t="目录学")


def test_sentence_after_a_line_break_and_in_a_long_text_without_marks(spark):
    t = F.col("t")
    assert one(spark, X.sentence_at(t, F.lit(3)), t="ab\ncd") == "cd"
    # Each character was once the start of a search to the end: minutes for such a text.
    start = time.monotonic()
    assert one(spark, X.sentence_at(t, F.lit(250_000)), t="x" * 500_000) == "x" * 160
    assert time.monotonic() - start < 20


def _cosines(spark, folder, query):
    """Vectors whose cosine with vector 0 is 0.1234564997, which no rounding to nine places may raise to 0.123457."""
    x = 0.1234564997
    rows = [(0, [1.0, 0.0], 3), (1, [x, (1 - x * x) ** 0.5], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return {r["vec_id"]: r["score"] for r in query(spark, str(folder)).collect()}


def test_cosine_topk_rounds_once(spark, tmp_path):
    assert _cosines(spark, tmp_path, retrieval.cosine_topk) == {0: 1.0, 1: 0.123456}


def test_cosine_allowed_ids_rounds_once(spark, tmp_path):
    assert _cosines(spark, tmp_path, retrieval.cosine_allowed_ids) == {0: 1.0, 1: 0.123456}
