"""Japanese text functions as Column expressions, and NFC as an Arrow UDF.

All but NFC stay in the JVM. Positions count code points, as Spark's and Python's do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_DIGITS, FULL_DIGITS = "0123456789", "０１２３４５６７８９"
# Katakana small a to small ke lie 0x60 above their hiragana; four voiced letters have none of their own.
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7))) + "ヷヸヹヺ"
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7)) + "わゐゑを"
VOWELS = "あいうえお"
# Old kanji and the new forms that replace them.
OLD_KANJI = "舊體國學會實寫讀賣來歸變傳轉廣應當擔戰殘歲圖團圓壓圍醫鹽處廳與餘價兒產縣顯驗險獻嚴靈齡勞營榮櫻驛"
NEW_KANJI = "旧体国学会実写読売来帰変伝転広応当担戦残歳図団円圧囲医塩処庁与余価児産県顕験険献厳霊齢労営栄桜駅"
# What a small ya, yu or yo makes one sound with.
YOON_STARTS, YOON_ENDS = "きしちにひみりぎじびぴ", "ゃゅょ"
# The end is that of the text: in Java, $ would match before a line break as well.
DIGITS_ONLY = r"^[0-9０-９,，、.．。]+\z"
ZWNJ = "‌"
LONG_VOWEL = "ー"


def full_width_digits(text: Column) -> Column:
    return F.translate(text, HALF_DIGITS, FULL_DIGITS)


def hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def new_kanji(text: Column) -> Column:
    return F.translate(text, OLD_KANJI, NEW_KANJI)


def strip_zwnj(text: Column) -> Column:
    return F.replace(text, F.lit(ZWNJ), F.lit(""))


def long_vowels(text: Column) -> Column:
    """The text with its first long-vowel mark as each vowel, or no text without the mark."""
    at = F.instr(text, LONG_VOWEL)
    each = F.array(*(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(v), F.substring(text, at + 1, F.length(text))) for v in VOWELS))
    return F.when(at > 0, each).otherwise(F.array().cast("array<string>"))


def ends_in_yoon(text: Column) -> Column:
    return text.rlike(rf"[{YOON_STARTS}][{YOON_ENDS}]\z")


def only_digits(text: Column) -> Column:
    return text.rlike(DIGITS_ONLY)


def variants(text: Column) -> Column:
    """The text, its vowel expansions, and its new kanji if they differ, in this order."""
    new = new_kanji(text)
    return F.concat(F.array(text), long_vowels(text), F.when(new != text, F.array(new)).otherwise(F.array().cast("array<string>")))


def split_list(text: Column) -> Column:
    """Parts of a comma-separated list, trimmed; null stays null."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def compose(text: str) -> tuple[str, list[int]]:
    """NFC of a text, and where in the text each code point of it starts, with the end.

    Starts never fall, so any cut of the result is a cut of the text. What composes into
    fewer code points starts where its first part does.
    """
    if unicodedata.is_normalized("NFC", text):
        return text, list(range(len(text) + 1))
    out: list[str] = []
    starts: list[int] = []
    begin = 0
    while begin < len(text):
        end = begin + 1
        while end < len(text) and (unicodedata.combining(text[end]) or unicodedata.normalize("NFC", text[begin : end + 1]) != unicodedata.normalize("NFC", text[begin:end]) + unicodedata.normalize("NFC", text[end])):
            end += 1
        done = unicodedata.normalize("NFC", text[begin:end])
        out.append(done)
        starts += [min(begin + i, end) for i in range(len(done))]
        begin = end
    return "".join(out), [*starts, len(text)]


def normalize(text: str, full_digits: bool = True, drop_zwnj: bool = True) -> tuple[str, list[int]]:
    """Full-width digits, NFC, and no zero-width non-joiners; with starts as of compose."""
    if full_digits:
        text = text.translate(str.maketrans(HALF_DIGITS, FULL_DIGITS))
    done, starts = compose(text)
    if drop_zwnj and ZWNJ in done:
        keep = [i for i, c in enumerate(done) if c != ZWNJ]
        done, starts = "".join(done[i] for i in keep), [*(starts[i] for i in keep), starts[-1]]
    return done, starts


#: Code points that are normalized at once, or one text; their places take several times the memory of the texts.
AT_ONCE = 1 << 18


def pieces(texts: pd.Series, most: int = AT_ONCE) -> Iterator[pd.Series]:
    """A batch of texts in parts of at most ``most`` code points, or one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if i > start and size + n > most:
            yield texts.iloc[start:i]
            start, size = i, 0
        size += n
    yield texts.iloc[start:]


def run_once(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A function in Python that is run once for each row. Conditions on its result, such as that of an explode that
    there be something, are put below other steps otherwise and run it for them, before equal rows are merged, and again."""
    return udf.asNondeterministic()


def normalized(text: Column, full_digits: bool = True, drop_zwnj: bool = True) -> Column:
    """struct<normalized string, starts array<int>>; null stays null. Spark has no NFC of its own.

    A batch of rows goes back in parts of bounded size, with places as arrays of 32-bit numbers.
    """
    digits = str.maketrans(HALF_DIGITS, FULL_DIGITS) if full_digits else {}

    def one(t: str) -> tuple[str, np.ndarray]:
        plain = t.translate(digits)
        if unicodedata.is_normalized("NFC", plain) and not (drop_zwnj and ZWNJ in plain):
            return plain, np.arange(len(plain) + 1, dtype=np.int32)
        done, starts = normalize(t, full_digits, drop_zwnj)
        return done, np.array(starts, dtype=np.int32)

    @F.pandas_udf("struct<normalized: string, starts: array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for part in pieces(texts):
                yield pd.DataFrame([(None, None) if t is None else one(t) for t in part], columns=["normalized", "starts"])

    return run_once(run)(text)
