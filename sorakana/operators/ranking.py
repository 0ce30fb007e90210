"""Ranking of dictionary entries that match a text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import hiragana, split_list

# Scores of priority marks, and marks that mean the same.
SCORES = {"i1": 50, "i2": 20, "n1": 40, "n2": 20, "s1": 32, "s2": 20, "g1": 30, "g2": 15}
LONG_NAMES = {"ichi": "i", "news": "n", "spec": "s", "gai": "g"}
# Info that makes a reading, or a written form, obscure.
OBSCURE_KANA, OBSCURE_KANJI = ("ok", "rk", "sk", "ik"), ("rK", "sK", "iK")


def priority_name(mark: Column) -> Column:
    """Marks in their short form: ichi1 is i1, and so on; others stay."""
    out = mark
    for long, short in LONG_NAMES.items():
        out = F.when(mark.isin(f"{long}1", f"{long}2"), F.concat(F.lit(short), F.substring(mark, -1, 1))).otherwise(out)
    return out


def _points() -> dict[str, int]:
    """Points of all marks that have any: the scores above, and bands nf01 to nf47 of frequency."""
    out = dict(SCORES)
    out |= {long + k[1]: out[short + k[1]] for long, short in LONG_NAMES.items() for k in SCORES if k[0] == short}
    for band in range(1, 48):
        out[f"nf{band:02}"] = out[f"nf{band}"] = int(48 - band / 2)
    return out


def priority_score(mark: Column) -> Column:
    """Points of one mark; unknown marks 0."""
    table = F.create_map(*(F.lit(x) for kv in _points().items() for x in kv))
    return F.coalesce(F.try_element_at(table, mark), F.lit(0))


def priority_sum(marks: Column) -> Column:
    """The highest score, a tenth of the next, a hundredth of the one after, and so on."""
    scores = F.sort_array(F.transform(marks, priority_score), asc=False)
    parts = F.transform(scores, lambda s, i: s.cast("double") / F.pow(F.lit(10.0), i))
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def flagged(kanji: Column, kana: Column, searched: Column) -> tuple[Column, Column]:
    """Both arrays of forms with matched (equal to the text but for kana) and match.

    ``match`` is what a reader would highlight: the equal forms of a side that has any,
    else all. Readings are compared only if no kanji form is equal.
    """
    same = lambda f: hiragana(f["text"]) == hiragana(searched)
    by_kanji = F.coalesce(F.exists(kanji, same), F.lit(False))
    by_kana = ~by_kanji & F.coalesce(F.exists(kana, same), F.lit(False))

    def side(forms: Column, found: Column) -> Column:
        hit = lambda f: F.coalesce(found & same(f), F.lit(False))
        return F.transform(forms, lambda f: f.withField("matched", hit(f)).withField("match", ~found | hit(f)).withField("match_range", F.when(hit(f), F.struct(F.lit(0).alias("start"), F.length(f["text"]).alias("end")))))

    return side(kanji, by_kanji), side(kana, by_kana)


def entry_priority(kanji: Column, kana: Column) -> Column:
    """The best sum of marks among matched forms, or 0."""
    score = lambda forms: F.transform(F.filter(forms, lambda f: f["matched"] & f["priority"].isNotNull()), lambda f: priority_sum(split_list(f["priority"])))
    return F.array_max(F.concat(F.array(F.lit(0.0)), score(kanji), score(kana)))


def mostly_kana(senses: Column, exact: bool = True) -> Column:
    """Whether at least half of the English senses are usually written in kana.

    That is told by the code uk; with ``exact`` false, by these letters anywhere in a usage, as
    older dictionaries of phrases are read.
    """
    english = F.filter(senses, lambda s: (F.size(s["glosses"]) == 0) | F.exists(s["glosses"], lambda g: g["lang"].isNull() | g["lang"].isin("eng", "en")))
    usual = F.filter(english, lambda s: F.coalesce(F.exists(s["misc"], lambda m: m == "uk" if exact else m.contains("uk")), F.lit(False)))
    return (F.size(english) > 0) & (F.size(usual) * 2 >= F.size(english))


def headword_type(kanji: Column, kana: Column, usually_kana: Column) -> Column:
    """1 for a match on a headword, 2 on a mere reading of one."""
    first = F.get(F.filter(kana, lambda f: f["matched"]), F.lit(0))
    has = lambda info, codes: F.coalesce(F.exists(split_list(info), lambda x: x.isin(*codes)), F.lit(False))
    hidden = F.forall(kanji, lambda f: has(f["info"], OBSCURE_KANJI))  # true without kanji
    return F.when(first.isNull(), 1).when(has(first["info"], OBSCURE_KANA), 2).when(hidden | usually_kana | first["no_kanji"], 1).otherwise(2)


def steps(chains: Column) -> Column:
    """Grammatical steps of the longest chain of reasons."""
    return F.coalesce(F.array_max(F.transform(chains, F.size)), F.lit(0))
