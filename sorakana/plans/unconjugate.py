"""Dictionary forms that a conjugated word may come from, with the grammar in between.

``candidates`` is exact, with reasons in order: it is a closure in which a later step may
add a chain of reasons to an earlier candidate, so it runs word by word, over distinct
words, in Arrow batches. ``reachable`` is the closure without reasons, by levels of joins:
it has all of these candidates, and those that only repeat a reason.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HIRAGANA, KATAKANA, hiragana, run_once
from .rules import Rule, by_ending, rules_frame
from .words import ALL_WORDS, UNKNOWN, Reason, WordType

Chains = tuple[tuple[int, ...], ...]
_FOLD = str.maketrans(KATAKANA, HIRAGANA)
_STEMS = int(WordType.MASU | WordType.TA_TE | WordType.IRREALIS)
_ICHIDAN_RESULT = int(WordType.ICHIDAN | WordType.KURU)
_STEM_ONLY: Chains = ((int(Reason.MasuStem),),)
#: Ichidan verbs have longer endings for these, so their plain stem doesn't take the short ones.
_NOT_AFTER_ICHIDAN = {int(r) for r in (Reason.Passive, Reason.Causative, Reason.CausativePassive)}


class _Found:
    __slots__ = ("chains", "kind", "word")

    def __init__(self, word: str, kind: int, chains: Chains):
        self.word, self.kind, self.chains = word, kind, chains


def _extended(chains: Chains, reasons: tuple[int, ...]) -> Chains:
    """Reasons go before the first chain, which tells how the word was made from the inside out."""
    if not reasons or not chains:
        return chains or ((reasons,) if reasons else ())
    first, rest = chains[0], chains[1:]
    if reasons[0] == Reason.Causative and first[:1] == (int(Reason.PotentialOrPassive),):
        return ((int(Reason.CausativePassive), *first[1:]), *rest)
    if reasons[0] == Reason.MasuStem and first:
        return chains
    return ((*reasons, *first), *rest)


@functools.cache
def _rules() -> dict[str, list[Rule]]:
    return by_ending()


class Unconjugator:
    def __init__(self):
        self.rules = _rules()  # made once for all batches of a worker
        self.lengths = sorted({len(e) for e in self.rules}, reverse=True)

    def candidates(self, word: str) -> list[tuple[str, int, Chains]]:
        """(word, types, chains of reasons), the word itself first, in order of discovery."""
        found = [_Found(word, UNKNOWN, ())]
        latest = {word: found[0]}
        for it in found:  # grows as it is read
            if it.kind & WordType.ICHIDAN and it.chains == _STEM_ONLY:
                continue
            if it.kind & _STEMS:
                self._ichidan(it, found, latest)
            for size in self.lengths:
                if size <= len(it.word):
                    for rule in self.rules.get(it.word[-size:].translate(_FOLD), ()):
                        self._apply(rule, it, found, latest)
        return [(c.word, c.kind, c.chains) for c in found if c.kind & ALL_WORDS]

    @staticmethod
    def _ichidan(it: _Found, found: list[_Found], latest: dict[str, _Found]) -> None:
        """The stem of an ichidan verb is the verb without its last kana, whatever follows."""
        if it.kind & WordType.IRREALIS and it.chains and it.chains[0][:1] and it.chains[0][0] in _NOT_AFTER_ICHIDAN:
            return
        bare = it.kind & WordType.MASU and not it.chains
        new = _Found(it.word + "る", _ICHIDAN_RESULT, it.chains + (_STEM_ONLY if bare else ()))
        found.append(new)
        latest.setdefault(new.word, new)

    @staticmethod
    def _apply(rule, it: _Found, found: list[_Found], latest: dict[str, _Found]) -> None:
        if not it.kind & rule.left:
            return
        word = it.word[: len(it.word) - len(rule.ending)] + rule.becomes
        if not word or any(r in chain for chain in it.chains for r in rule.reasons):
            return
        known = latest.get(word)
        if known is not None and known.kind == rule.right:
            if rule.reasons:
                known.chains = (rule.reasons, *known.chains)
            return
        new = _Found(word, rule.right, _extended(it.chains, rule.reasons))
        latest[word] = new
        found.append(new)


def candidates(word: Column) -> Column:
    """array<struct<word, type, reason_chains>> of a word; null and empty words have only themselves."""

    @F.pandas_udf("array<struct<word: string, type: int, reason_chains: array<array<int>>>>")
    def run(words: pd.Series) -> pd.Series:
        undo = Unconjugator()
        return words.map(lambda w: None if w is None else [{"word": x, "type": kind, "reason_chains": [list(c) for c in chains]} for x, kind, chains in undo.candidates(w)])

    return run_once(run)(word)


def reachable(spark: SparkSession, words: DataFrame) -> DataFrame:
    """All (start, word, type) that any number of rules lead to from each word, whatever their reasons.

    By levels of equi-joins on the ending, which holds for any number of words; each new row is
    expanded once, and levels go on until one adds nothing. Levels are checkpointed in the folder
    of ``spark.checkpoint.dir``.
    """
    set_checkpoint_folder(spark)
    rules = F.broadcast(rules_frame(spark).select("ending", "becomes", "left", "right"))  # 241 rows
    longest = max(map(len, _rules()))
    now = words.select(F.col("word").alias("start"), "word", F.lit(UNKNOWN).alias("type")).distinct().checkpoint()
    done = now
    while not now.isEmpty():
        cut = now.where(F.length("word") > 0).withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word")))))
        cut = cut.withColumn("ending", hiragana(F.expr("right(word, size)")))
        by_rule = cut.join(rules, "ending").where(F.col("type").bitwiseAND(F.col("left")) != 0)
        by_rule = by_rule.select("start", F.concat(F.expr("left(word, length(word) - size)"), "becomes").alias("word"), F.col("right").alias("type")).where("word <> ''")
        stem = now.where(F.col("type").bitwiseAND(F.lit(_STEMS)) != 0).select("start", F.concat("word", F.lit("る")).alias("word"), F.lit(_ICHIDAN_RESULT).alias("type"))
        now = by_rule.unionByName(stem).distinct().join(done, ["start", "word", "type"], "left_anti").checkpoint()
        done = done.unionByName(now)
    return done.select("start", "word", F.col("type").bitwiseAND(F.lit(ALL_WORDS)).alias("type")).where("type <> 0").distinct()


def set_checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; in local mode, where it may be unset, to a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
