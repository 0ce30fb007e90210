import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sorakana.functions import text as T


def each(spark, column, *inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_digits_and_kana(spark):
    assert each(spark, T.full_width_digits, "123", "a0b9", "日本語", "", None) == ["１２３", "a０b９", "日本語", "", None]
    assert each(spark, T.hiragana, "カタカナ", "コンピュータ", "ヷヸヹヺ", "ｶﾅ", "ひらカタ") == ["かたかな", "こんぴゅーた", "わゐゑを", "ｶﾅ", "ひらかた"]


def test_variants(spark):
    assert each(spark, T.long_vowels, "コーヒー", "コヒ")[0] == ["コあヒー", "コいヒー", "コうヒー", "コえヒー", "コおヒー"]
    assert each(spark, T.long_vowels, "コヒ") == [[]]
    assert each(spark, T.new_kanji, "舊體國", "舊ひらがな", "日本語", "驢驤") == ["旧体国", "旧ひらがな", "日本語", "驢驤"]
    assert each(spark, T.variants, "舊ー", "あ") == [["舊ー", "舊あ", "舊い", "舊う", "舊え", "舊お", "旧ー"], ["あ"]]


def test_yoon_and_digits(spark):
    yes = [a + b for a in T.YOON_STARTS for b in T.YOON_ENDS]
    assert all(each(spark, T.ends_in_yoon, *yes, "にゃりょ"))
    assert each(spark, T.ends_in_yoon, "", "ゃ", "き", "キャ", "あゃ", "きゃあ") == [False] * 6
    assert each(spark, T.only_digits, "12", "１２，３", "1.5。", "", "1a", "一") == [True, True, True, False, False, False]


def test_normalize():
    assert T.normalize("") == ("", [0])
    assert T.normalize("123") == ("１２３", [0, 1, 2, 3])
    assert T.normalize("がき") == ("がき", [0, 2, 3])
    assert T.normalize("あ‌い") == ("あい", [0, 2, 3])
    assert T.normalize("‌あ") == ("あ", [1, 2])
    assert T.normalize("あ😀い") == ("あ😀い", [0, 1, 2, 3])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aあかガ゚‌😀가가ẹ́क़漢1Ω"), max_size=12))
def test_normalize_keeps_places(text):
    done, starts = T.normalize(text)
    assert done == unicodedata.normalize("NFC", text.translate(str.maketrans(T.HALF_DIGITS, T.FULL_DIGITS))).replace(T.ZWNJ, "")
    assert len(starts) == len(done) + 1 and starts == sorted(starts) and starts[-1] == len(text)


def test_normalize_column(spark):
    frame = spark.createDataFrame([("が1",), ("",), (None,)], "x string")
    got = [r["n"] and (r["n"]["normalized"], r["n"]["starts"]) for r in frame.select(T.normalized(F.col("x")).alias("n")).collect()]
    assert got[:2] == [("が１", [0, 2, 3]), ("", [0])] and (got[2] is None or got[2][0] is None)


@pytest.mark.parametrize("parts", ["a, b ,c"])
def test_split_list(spark, parts):
    assert each(spark, T.split_list, parts, None) == [["a", "b", "c"], None]


def test_ends_are_ends_of_texts(spark):
    rows = spark.createDataFrame([("きゃ",), ("きゃ\n",), ("12",), ("12\n",)], "t string").select(T.ends_in_yoon(F.col("t")).alias("y"), T.only_digits(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, False), (False, True), (False, False)]


def test_texts_are_normalized_in_bounded_parts():
    """Places of a whole batch of long texts took more memory than an executor has."""
    texts = pd.Series(["a" * 6, None, "b" * 6, "", "c" * 30, "d"])
    parts = list(T.pieces(texts, 12))
    assert [list(p) for p in parts] == [["a" * 6, None, "b" * 6, ""], ["c" * 30], ["d"]]
    assert [list(p) for p in T.pieces(pd.Series([], dtype=object), 12)] == [[]]


def test_parts_of_batches_meet_their_rows(spark):
    texts = ["あ" * (T.AT_ONCE // 3 + i) + "が" * (i % 2) + "1" for i in range(8)] + [None, "", "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r["i"]: (r["n"]["normalized"], r["n"]["starts"]) if r["n"] else None for r in frame.select("i", T.normalized(F.col("text")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert (got[i][0], list(got[i][1])) == T.normalize(t) if t is not None else got[i] is None or got[i][0] is None
