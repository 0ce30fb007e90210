"""Sentences into words: a walk over the best match at each position."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, run_once
from ..sources.dictionary import Dictionary
from .search import VIEW, best_match, distinct_texts, parts_of, search_distinct, text_key

_TOKENS = "array<struct<text: string, start: int, end: int, hit: int>>"
#: Results that the walk chooses from at each position.
CONSIDERED = 5


def walk(text: str, starts: list[int], best: Callable[[int], tuple[int, int, list] | None]) -> list[dict]:
    """Tokens from left to right: the best match where there is one, else one character.

    ``best`` gives, for a position in the normalized text, (match_len, entry_id, chains). Tokens
    join to the text: what normalization drops belongs to the token before it.
    """
    out, at, begin = [], 0, 0
    place = {s: i for i, s in reversed(list(enumerate(starts)))}
    last = len(starts) - 1
    while at < last:
        hit = best(at)
        after = place[starts[at] + hit[0]] if hit else at + 1
        while after < last and starts[after] <= begin:  # a part of what composed into one character
            after += 1
        end = starts[after] if after < last else len(text)
        out.append({"text": text[begin:end], "start": begin, "end": end, "entry_id": hit[1] if hit else None, "reason_chains": hit[2] if hit else None})
        at, begin = after, end
    return out


def _walk_column(text: Column, starts: Column, pos: Column, match_len: Column) -> Column:
    """Tokens by the matches at ``pos``; hit is the place of theirs among these, so that Python sees only numbers of them."""

    @F.pandas_udf(_TOKENS)
    def run(texts: pd.Series, places: pd.Series, at: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for t, s, ps, ns in zip(texts, places, at, sizes, strict=True):
            best = {} if ps is None else {p: (n, i, None) for i, (p, n) in enumerate(zip(ps.tolist(), ns.tolist(), strict=True))}
            out.append([] if t is None else [{"text": x["text"], "start": x["start"], "end": x["end"], "hit": x["entry_id"]} for x in walk(t, s.tolist(), best.get)])
        return pd.Series(out)

    return run_once(run)(text, starts, pos, match_len)


def tokenize(texts: DataFrame, dictionary: Dictionary, longest: int | None = None) -> DataFrame:
    """Tokens of texts (text_id, text): text_id, index, text, start, end, entry_id, ent_seq, reason_chains.

    Distinct texts are walked once. Tokens without an entry are single characters; empty and
    null texts have none. start and end count characters of the text.
    """

    def chosen(results: DataFrame) -> DataFrame:
        best = results.select(*VIEW, best_match(F.col("result")).alias("b")).select(*VIEW, "b.*")
        return best.join(dictionary.entries.select("entry_id", "ent_seq"), "entry_id")

    distinct = distinct_texts(texts)
    found = search_distinct(distinct, dictionary, CONSIDERED, every_position=True, longest=longest, of=chosen)
    # A walk takes long for its size, by which a shuffle of the join's own would be merged into few tasks.
    best = found.repartition(parts_of(texts), "text_id").groupBy("text_id").agg(F.collect_list(F.struct("pos", "match_len", "entry_id", "ent_seq", "reason_chains")).alias("best"))
    rows = distinct.join(best, "text_id", "left").withColumn("n", normalized(F.col("text")))
    rows = rows.withColumn("tokens", _walk_column(F.col("text"), F.col("n.starts"), F.col("best.pos"), F.col("best.match_len")))
    rows = rows.select(F.col("text_id").alias("key"), "best", F.posexplode("tokens").alias("index", "t")).withColumn("b", F.get("best", F.col("t.hit")))
    rows = rows.select("key", "index", "t.text", "t.start", "t.end", "b.entry_id", "b.ent_seq", "b.reason_chains")
    return texts.where(F.col("text").isNotNull()).select("text_id", text_key(F.col("text")).alias("key")).join(rows, "key").select("text_id", "index", "text", "start", "end", "entry_id", "ent_seq", "reason_chains")


def windows(texts: DataFrame, width: int = 10) -> DataFrame:
    """All overlapping windows of texts as texts of their own: text_id, window, text."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - width + 1))).alias("window")
    return texts.select("text_id", "text", at).select("text_id", "window", F.substring("text", F.col("window"), F.lit(width)).alias("text"))


def with_glosses(tokens: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Tokens with the first gloss of the first sense; only entries that were chosen are joined."""
    gloss = F.get(F.get("senses", F.lit(0))["glosses"], F.lit(0))["text"]
    return tokens.join(dictionary.entries.select("entry_id", gloss.alias("gloss")), "entry_id", "left")
