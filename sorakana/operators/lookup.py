"""Lookup of words in a dictionary by equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hiragana
from ..sources.dictionary import Dictionary
from .ranking import flagged


def lookup(words: DataFrame, dictionary: Dictionary, limit: int = 20) -> DataFrame:
    """Of distinct ``words`` (word): (word, hit_ord, entry_id), at most ``limit`` each.

    A word finds the readings equal to it or to its hiragana; only if there are none, the
    kanji forms. Hits are in order of the form, then of the entry. Looking up both spellings
    as rows of their own makes it a hash join, where an OR would compare all with all.
    """
    keys = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.array("word", hiragana(F.col("word"))))).alias("form_text"))
    found = keys.join(dictionary.forms, "form_text").groupBy("word", "kind", "entry_id").agg(F.min(F.struct("form_text", "ord")).alias("at"))
    per_word = Window.partitionBy("word")  # as many rows as a word has entries
    found = found.withColumn("best", F.min("kind").over(per_word)).where("kind = best")
    order = F.row_number().over(per_word.orderBy("at.form_text", "entry_id", "at.ord"))
    return found.withColumn("hit_ord", order).where(F.col("hit_ord") <= limit).select("word", "hit_ord", "entry_id")


def get_words(words: DataFrame, dictionary: Dictionary, limit: int, matching: str = "word") -> DataFrame:
    """Whole entries of each word in order, forms flagged against the column ``matching``."""
    found = lookup(words, dictionary, limit)
    rows = words.select("word", F.col(matching).alias("matching")).distinct().join(found, "word").join(dictionary.entries, "entry_id")
    kanji, kana = flagged(F.col("kanji_readings"), F.col("kana_readings"), F.col("matching"))
    return rows.withColumns({"kanji_readings": kanji, "kana_readings": kana})
