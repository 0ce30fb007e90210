"""Tokens of a stream of texts, row by row, with the dictionary held in memory.

Streams can't go through the windows and aggregations of the batch plan, so each worker
has the slim dictionary. Its size is checked first; a larger one is for the batch plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HIRAGANA, KATAKANA, LONG_VOWEL, NEW_KANJI, OLD_KANJI, VOWELS, YOON_ENDS, YOON_STARTS, normalize
from ..operators.ranking import LONG_NAMES, OBSCURE_KANA, OBSCURE_KANJI, SCORES, mostly_kana
from ..operators.search import ADDED, ADDED_CHARACTERS, fold
from ..operators.tokenize import CONSIDERED, walk
from ..plans.unconjugate import Unconjugator
from ..sources.dictionary import Dictionary

#: Forms that a worker may hold.
MOST_FORMS = 2_000_000
#: Texts whose tokens a task remembers.
REMEMBERED = 4096
_HIRA, _NEW = str.maketrans(KATAKANA, HIRAGANA), str.maketrans(OLD_KANJI, NEW_KANJI)
_ENDINGS = set(ADDED_CHARACTERS)
_DIGITS = set("0123456789０１２３４５６７８９,，、.．。")


def _points(mark: str) -> int:
    for long, short in LONG_NAMES.items():
        if mark in (f"{long}1", f"{long}2"):
            mark = short + mark[-1]
    if mark.startswith("nf") and mark[2:].isdigit() and 0 < int(mark[2:]) < 48:
        return int(48 - int(mark[2:]) / 2)
    return SCORES.get(mark, 0)


class MemoryDictionary:
    """Lookup, search and tokens in plain Python; what the batch plan is checked against."""

    def __init__(self, forms: list[tuple], entries: dict[int, tuple]):
        self.forms: dict[str, list[tuple]] = {}
        for text, kind, ord_, entry in forms:
            self.forms.setdefault(text, []).append((kind, text, entry, ord_))
        self.entries = entries
        self.longest = max(map(len, self.forms), default=0)
        self.undo = Unconjugator()

    @classmethod
    def collect(cls, dictionary: Dictionary, most: int = MOST_FORMS) -> MemoryDictionary:
        n = dictionary.forms.count()
        if n > most:
            raise ValueError(f"{n} forms; no more than {most} fit in a worker")
        rows = dictionary.entries.select("entry_id", "ent_seq", "type_mask", "kanji_readings", "kana_readings", mostly_kana(F.col("senses")).alias("usual")).collect()
        side = lambda fs: [(f["text"], f["priority"], f["info"], "no_kanji" in f.__fields__ and f["no_kanji"]) for f in fs]
        return cls([tuple(r) for r in dictionary.forms.select("form_text", "kind", "ord", "entry_id").collect()], {r["entry_id"]: (r["ent_seq"], r["type_mask"], side(r["kanji_readings"]), side(r["kana_readings"]), r["usual"]) for r in rows})

    def lookup(self, word: str, limit: int) -> list[int]:
        hits = [h for form in dict.fromkeys((word, word.translate(_HIRA))) for h in self.forms.get(form, ())]
        kind = min((h[0] for h in hits), default=0)
        return list(dict.fromkeys(h[2] for h in sorted(h for h in hits if h[0] == kind)))[:limit]

    def _rank(self, entry: int, searched: str) -> tuple[int, float]:
        _, _, kanji, kana, usual = self.entries[entry]
        same = searched.translate(_HIRA)
        written = [f for f in kanji if f[0].translate(_HIRA) == same]
        read = [] if written else [f for f in kana if f[0].translate(_HIRA) == same]
        scores = [sum(s / 10**i for i, s in enumerate(sorted((_points(p.strip()) for p in f[1].split(",")), reverse=True))) for f in written + read if f[1]]
        infos = lambda f: {x.strip() for x in (f[2] or "").split(",")}
        kind = 1
        if read and infos(read[0]) & set(OBSCURE_KANA):
            kind = 2
        elif read and not (all(infos(f) & set(OBSCURE_KANJI) for f in kanji) or usual or read[0][3]):
            kind = 2
        return kind, max(scores, default=0.0)

    def _hits(self, variant: str, prefix: str, limit: int) -> list[tuple]:
        out = []
        for i, (word, kind, chains) in enumerate(self.undo.candidates(variant)):
            for entry in self.lookup(word, limit):
                if i == 0 or kind & self.entries[entry][1]:
                    out.append((entry, [list(c) for c in chains], max(map(len, chains), default=0), *self._rank(entry, prefix), *self._rank(entry, variant)))
        return out

    def search(self, text: str, starts: list[int], pos: int, max_results: int) -> tuple[list[tuple], int]:
        def found():
            most = min(len(text), pos + self.longest)
            end = min(len(text), most + ADDED)
            while most < end and text[most] in _ENDINGS:
                most += 1
            for size in range(most - pos, 0, -1):
                prefix = text[pos : pos + size]
                if set(prefix) <= _DIGITS:
                    return
                if prefix[-1] in YOON_STARTS and text[pos + size : pos + size + 1] in tuple(YOON_ENDS):
                    continue
                spellings = [prefix]
                if LONG_VOWEL in prefix:
                    spellings += [prefix.replace(LONG_VOWEL, v, 1) for v in VOWELS]
                if (new := prefix.translate(_NEW)) != prefix:
                    spellings.append(new)
                for variant in spellings:
                    if hits := self._hits(variant, prefix, max(3 * max_results, 20)):
                        yield size, prefix, variant, starts[pos + size] - starts[pos], hits

        return fold(found(), max_results)

    def tokens(self, text: str) -> list[dict]:
        done, starts = normalize(text)

        def best(pos: int) -> tuple[int, int, list] | None:
            data, longest = self.search(done, starts, pos, CONSIDERED)
            if not data:
                return None
            hit = next((r for r in data if r[1] == longest), data[0])
            return hit[1], hit[0], hit[2] or None

        return walk(text, starts, best)


def tokenize_stream(texts: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Tokens of a batch or stream of (text_id, text); the same rows as of the batch plan."""
    shared = texts.sparkSession.sparkContext.broadcast(MemoryDictionary.collect(dictionary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = shared.value
        tokens = lru_cache(REMEMBERED)(d.tokens)
        columns = ["text_id", "index", "text", "start", "end", "entry_id", "ent_seq", "reason_chains"]
        for rows in batches:
            out = [(i, k, t["text"], t["start"], t["end"], t["entry_id"], d.entries[t["entry_id"]][0] if t["entry_id"] is not None else None, t["reason_chains"]) for i, text in zip(rows["text_id"], rows["text"], strict=True) if text is not None for k, t in enumerate(tokens(text))]
            frame = pd.DataFrame(out, columns=columns)
            frame["entry_id"] = frame["entry_id"].astype("Int64")
            yield frame

    kind = dict(texts.dtypes)["text_id"]
    return texts.select("text_id", "text").mapInPandas(run, f"text_id {kind}, index int, text string, start int, end int, entry_id bigint, ent_seq string, reason_chains array<array<int>>")
