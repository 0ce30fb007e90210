"""Word search at every position of texts.

What a search at a position may look at is a short piece of text, its view. Distinct views of
the whole batch are searched once: every prefix, in every spelling, is a row. Distinct spellings
are unconjugated once and joined to the dictionary once; what remains for each view are its few
hits, which a fold goes through from the longest down. Positions then meet the result of their view.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import YOON_ENDS, YOON_STARTS, hiragana, new_kanji, normalized, only_digits, run_once, variants
from ..plans.rules import by_ending, ending_characters, most_added
from ..plans.unconjugate import candidates, set_checkpoint_folder
from ..sources.dictionary import Dictionary
from .lookup import lookup
from .ranking import entry_priority, flagged, headword_type, mostly_kana, steps

#: What conjugation adds to a form at most, and the only characters that it adds.
ADDED, ADDED_CHARACTERS = most_added(), ending_characters()
_ENDINGS = frozenset(ADDED_CHARACTERS)
#: A search stops after so many times the wanted results.
PLENTY = 10
#: What a search at a position depends on, see ``views``.
VIEW = ("view", "most", "places")
_RESULT = "struct<data: array<struct<entry_id: bigint, match_len: int, reason_chains: array<array<int>>>>, match_len: int, more: boolean>"


def ending_runs(text: str) -> list[int]:
    """For each character, how many from it on are characters of endings; no more than ADDED count."""
    out, run = [], 0
    for c in reversed(text):
        run = min(run + 1, ADDED) if c in _ENDINGS else 0
        out.append(run)
    return out[::-1]


def _runs_column(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else ending_runs(t))

    return run_once(run)(text)


def positions(texts: DataFrame) -> DataFrame:
    """(text_id, text) with normalized, starts, runs of endings, and a row for each position: pos from 0."""
    rows = texts.withColumn("n", normalized(F.col("text"))).select("text_id", "n.normalized", "n.starts")
    rows = rows.where(F.length("normalized") > 0).withColumn("runs", _runs_column(F.col("normalized")))
    return rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("normalized") - 1)))


def reach(longest: Column) -> Column:
    """How long a prefix at (normalized, runs, pos) may be that comes from a form of ``longest`` characters.

    What a rule leaves of a text is the start of a form, and all that rules take away are
    characters of endings: a prefix goes on after ``longest`` characters only through those.
    """
    left = F.length("normalized") - F.col("pos")
    return F.least(left, longest + F.coalesce(F.get("runs", F.col("pos") + longest), F.lit(0)))


def prefixes(at: DataFrame, longest: Column) -> DataFrame:
    """Prefixes (text_id, pos, len, prefix, match_len) of positions, up to ``longest`` characters.

    Prefixes of digits alone are left out, and those that would cut a contracted sound.
    """
    left = F.length("normalized") - F.col("pos")
    rows = at.withColumn("most", F.least(left, longest)).where("most > 0").withColumn("len", F.explode(F.sequence(F.lit(1), F.col("most"))))
    rows = rows.withColumns({"prefix": F.substring("normalized", F.col("pos") + 1, F.col("len")), "ahead": F.substring("normalized", F.col("pos") + F.col("len"), F.lit(2))})
    cut = F.col("ahead").rlike(f"^[{YOON_STARTS}][{YOON_ENDS}]")
    match_len = F.get("starts", F.col("pos") + F.col("len")) - F.get("starts", F.col("pos"))
    return rows.where(~only_digits(F.col("prefix")) & ~cut).select("text_id", "pos", "len", "prefix", match_len.alias("match_len"))


def first_characters(dictionary: Dictionary) -> DataFrame:
    """(first, longest): folded characters that a word which may be found starts with, as many rows as kanji
    at most, and the length of the longest form that starts so. A word that starts with an ending may
    have nothing of a form left; the long vowel may stand for the start of any form."""
    fold = lambda c: hiragana(new_kanji(F.substring(c, 1, 1)))
    endings = dictionary.forms.sparkSession.createDataFrame([(e, 0) for e in by_ending()], "form_text string, size int")
    forms = dictionary.forms.select("form_text", F.length("form_text").alias("size"))
    every = forms.agg(F.lit("ー").alias("first"), F.max("size").alias("longest"))
    return forms.unionByName(endings).select(fold(F.col("form_text")).alias("first"), "size").groupBy("first").agg(F.max("size").alias("longest")).where("first <> 'ー'").unionByName(every)


def _ranked(results: list[tuple]) -> list[tuple]:
    """By steps, headword type and priority; equal ones stay in order. An entry that is
    there more than once ranks everywhere as in its last place."""
    last = {r[0]: (r[3], r[4], -r[5]) for r in results}
    return sorted(results, key=lambda r: last[r[0]])


def fold(found: Iterable[tuple[int, str, str, int, list]], max_results: int) -> tuple[list[tuple], int]:
    """Results (entry_id, match_len, chains, ...) and longest match of one position.

    ``found``: (len, prefix, variant, match_len, hits) in descending length, variants in
    order; a hit has entry_id, chains, steps, and type and priority against the prefix, and
    against the variant. The first variant that finds something is kept for all that is
    shorter. What one length yields is ranked and cut before it counts as seen.
    """
    seen: set[int] = set()
    results: list[tuple] = []
    chosen: str | None = None
    longest = done = 0
    for size, _, variant, match_len, hits in found:
        if done == size or (chosen is not None and chosen[:size] != variant):
            continue
        k = 3 if chosen is None else 5
        new = [(h[0], match_len, h[1], h[2], h[k], h[k + 1]) for h in hits if h[0] not in seen]
        if not new:
            continue
        new = _ranked(new)[:max_results]
        seen.update(r[0] for r in new)
        results += new
        longest, done = max(longest, match_len), size
        chosen = variant if chosen is None else chosen
        if len(results) >= PLENTY * max_results:
            break
    return _ranked(results)[:max_results], longest


def _fold_column(found: Column, max_results: int) -> Column:
    @F.pandas_udf(_RESULT)
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for items in rows:
            ordered = sorted(items, key=lambda r: (-r["len"], r["ord"]))
            hits = lambda r: [(h["entry_id"], [list(c) for c in h["chains"]], h["steps"], h["type"], h["priority"], h["own_type"], h["own_priority"]) for h in sorted(r["hits"], key=lambda h: (h["cand"], h["hit"]))]
            data, longest = fold(((r["len"], r["prefix"], r["variant"], r["match_len"], hits(r)) for r in ordered), max_results)
            out.append(([{"entry_id": r[0], "match_len": r[1], "reason_chains": r[2] or None} for r in data], longest, len(data) >= max_results))
        return pd.DataFrame(out, columns=["data", "match_len", "more"])

    return run(found)


def parts_of(frame: DataFrame) -> int:
    """As many partitions as a shuffle has, for rows that are small but take long, which would be merged into few by their
    size. Rows are dealt by a hash then, since a shuffle by columns by which they just met is left out of the plan."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def views(at: DataFrame, dictionary: Dictionary, longest: int | None = None) -> DataFrame:
    """Of positions that may find something: (text_id, pos) and VIEW, all that a search there depends on.

    ``view`` is the longest prefix, of ``most`` characters, and the character after it, by which a
    contracted sound is known. ``places`` are those of its characters in the text as it was given;
    empty if normalization left them alone.
    """
    first = hiragana(new_kanji(F.expr("substring(normalized, pos + 1, 1)")))
    at = at.join(F.broadcast(first_characters(dictionary)), first == F.col("first"))
    left = F.length("normalized") - F.col("pos")
    at = at.withColumn("most", F.least(left, reach(F.coalesce("longest", F.lit(0))) if longest is None else F.lit(longest))).where("most > 0")
    here, begin = F.slice("starts", F.col("pos") + 1, F.col("most") + 1), F.get("starts", F.col("pos"))
    places = F.when(here == F.sequence(begin, begin + F.col("most")), F.array().cast("array<int>")).otherwise(F.transform(here, lambda s: s - begin))
    return at.select("text_id", "pos", F.substring("normalized", F.col("pos") + 1, F.col("most") + 1).alias("view"), "most", places.alias("places"))


def view_hits(seen: DataFrame, dictionary: Dictionary, max_results: int) -> DataFrame:
    """Of distinct views, all hits: VIEW and found array<...>, for ``fold``."""
    starts = F.when(F.size("places") == 0, F.sequence(F.lit(0), F.col("most"))).otherwise(F.col("places"))
    at = seen.select(F.struct(*VIEW).alias("text_id"), F.lit(0).alias("pos"), F.col("view").alias("normalized"), starts.alias("starts"), F.col("most").alias("longest"))
    # Parts of the plan below share them, and each would make them anew.
    set_checkpoint_folder(seen.sparkSession)
    rows = prefixes(at, F.col("longest")).select("*", F.posexplode(variants(F.col("prefix"))).alias("ord", "variant")).checkpoint()
    # Once for each distinct spelling of the whole batch.
    words = rows.select("variant").distinct().repartition(parts_of(seen), F.xxhash64("variant")).withColumn("c", candidates(F.col("variant")))
    words = words.select("variant", F.posexplode("c").alias("cand", "c")).select("variant", "cand", "c.*").checkpoint()
    found = lookup(words.select("word"), dictionary, max(3 * max_results, 20))
    slim = dictionary.entries.select("entry_id", "type_mask", "kanji_readings", "kana_readings", mostly_kana(F.col("senses")).alias("usual"))
    hits = words.join(found, "word").join(slim.select("entry_id", "type_mask"), "entry_id")
    # Only the word as it stands may be of any type.
    hits = hits.where((F.col("cand") == 0) & (F.col("word") == F.col("variant")) & (F.size("reason_chains") == 0) | (F.col("type").bitwiseAND(F.col("type_mask")) != 0))
    hits = hits.groupBy("variant").agg(F.collect_list(F.struct("cand", F.col("hit_ord").alias("hit"), "entry_id", F.col("reason_chains").alias("chains"))).alias("hits"))
    pairs = rows.select("prefix", "variant").distinct().join(hits, "variant")
    ranked = pairs.select("prefix", "variant", F.explode("hits").alias("h")).select("prefix", "variant", "h.*").join(slim.drop("type_mask"), "entry_id")
    for name, against in (("", "prefix"), ("own_", "variant")):
        kanji, kana = flagged(F.col("kanji_readings"), F.col("kana_readings"), F.col(against))
        ranked = ranked.withColumns({"k": kanji, "r": kana}).withColumns({f"{name}type": headword_type(F.col("k"), F.col("r"), F.col("usual")), f"{name}priority": entry_priority(F.col("k"), F.col("r"))})
    ranked = ranked.withColumn("steps", steps(F.col("chains")))
    ranked = ranked.groupBy("prefix", "variant").agg(F.collect_list(F.struct("cand", "hit", "entry_id", "chains", "steps", "type", "priority", "own_type", "own_priority")).alias("hits"))
    rows = rows.join(ranked, ["prefix", "variant"])
    return rows.groupBy("text_id").agg(F.collect_list(F.struct("len", "ord", "prefix", "variant", "match_len", "hits")).alias("found")).select("text_id.*", "found")


def text_key(text: Column) -> Column:
    """128 bits of hashes, by which equal texts meet, so that no shuffle but the first has the texts."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(text_id, text) of distinct texts, with their keys as ids; dealt to all partitions, since their positions are many."""
    once = texts.where(F.col("text").isNotNull()).select("text").distinct().repartition(parts_of(texts), F.xxhash64("text"))
    return once.select(text_key(F.col("text")).alias("text_id"), "text")


def search_distinct(texts: DataFrame, dictionary: Dictionary, max_results: int, every_position: bool, longest: int | None = None, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As word_search, for texts that are distinct. ``of`` may change the columns of results of views, VIEW and result."""
    at = positions(texts)
    if not every_position:
        at = at.where("pos = 0")
    at = views(at, dictionary, longest)
    # They are used four times below, and each use would make them anew.
    set_checkpoint_folder(texts.sparkSession)
    seen = at.select(*VIEW).distinct().repartition(parts_of(texts), F.xxhash64(*VIEW)).checkpoint()
    results = view_hits(seen, dictionary, max_results).select(*VIEW, _fold_column(F.col("found"), max_results).alias("result"))
    # They are few. Without their plan in it, the one below is small each time that it is planned again, which spares the driver.
    results = (results if of is None else of(results)).checkpoint()
    return at.join(results, list(VIEW)).drop(*VIEW)


def word_search(texts: DataFrame, dictionary: Dictionary, max_results: int = 7, every_position: bool = False, longest: int | None = None) -> DataFrame:
    """The best entries at the start of texts (text_id, text), or at every position.

    Returns text_id, pos, result (data, match_len, more). Positions that find nothing, null
    and empty texts have no row. match_len counts characters of the text as it was given.
    Equal texts are searched once.
    """
    found = search_distinct(distinct_texts(texts), dictionary, max_results, every_position, longest).withColumnRenamed("text_id", "key")
    return texts.where(F.col("text").isNotNull()).select("text_id", text_key(F.col("text")).alias("key")).join(found, "key").select("text_id", "pos", "result")


def best_match(result: Column) -> Column:
    """Of a result, the first that is as long as the longest match, else the first of all."""
    same = F.filter(result["data"], lambda r: r["match_len"] == result["match_len"])
    return F.coalesce(F.get(same, F.lit(0)), F.get(result["data"], F.lit(0)))
