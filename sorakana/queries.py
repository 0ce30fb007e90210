"""Queries of the library itself, with SQL for another engine that gives the same rows.

Japanese text comes from sentences listed here: each document has four of them, by the
digits of its id to the base of their number, so that texts differ and the corpus grows with
the table. The dictionary is the sample of this repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import lookup as L
from .operators import ranking as R
from .operators import search as S
from .operators import tokenize as K
from .plans.rules import rules
from .plans.unconjugate import UNKNOWN, candidates, reachable
from .plans.words import ALL_WORDS, REASONS
from .sources import sample
from .sources.dictionary import Dictionary, sample_dictionary
from .streaming.tokenizer import tokenize_stream

SENTENCES = (
    "私は学生です", "食べました", "今日は良い天気です。", "東京タワーに行く", "毎日新しい単語を覚える", "コーヒーを食べたくなかった", "2024年も日本語を勉強する", "あ😀い𠮟る", "Hello こんにちは", "がくせい",
    "舊體を讀んだ", "もう走ッタ", "おおさかに来られる", "ハ゛ナナを買って待っていた", "頑張っていらっしゃる", "話さざるを得ない", "元気ですか？", "泳ぎに行きましょう", "一石二鳥", "きょうしゃしゅ",
)
MARKS = ("i1", "i2", "n1", "n2", "s1", "s2", "g1", "g2", "ichi1", "ichi2", "news1", "news2", "spec1", "spec2", "gai1", "gai2", "nf01", "nf03", "nf10", "nf47", "nf48", "nf00", "nfx", "unknown", "")
#: The inflected spellings in the sentences and their parts: spelling, place among its candidates, dictionary form, types, reasons.
INFLECTED = (
    ("かった", 4, "かう", 2, "Past"), ("き", 4, "くる", 8, "MasuStem"), ("きましょう", 4, "くる", 8, "PoliteVolitional"), ("く", 1, "くる", 9, "MasuStem"), ("くなかった", 8, "くる", 9, "Negative<Past"), ("こん", 3, "くる", 8, "Negative"),
    ("し", 3, "する", 16, "MasuStem"), ("した", 4, "する", 16, "Past"), ("せ", 3, "する", 32, "Irregular<Imperative"), ("コい", 2, "くる", 8, "Imperative"), ("勉強する", 2, "勉強", 64, "SuruNoun"), ("待って", 5, "待つ", 2, "Te"),
    ("待っていた", 6, "待つ", 2, "Continuous<Past"), ("来", 1, "来る", 9, "MasuStem"), ("来られる", 2, "来る", 9, "PotentialOrPassive"), ("泳ぎ", 2, "泳ぐ", 2, "MasuStem"), ("行き", 3, "行く", 2, "MasuStem"), ("行きましょう", 3, "行く", 2, "PoliteVolitional"),
    ("覚え", 1, "覚える", 9, "MasuStem"), ("話さざるを得ない", 5, "話す", 2, "ZaruWoEnai"), ("読んだ", 4, "読む", 2, "Past"), ("買って", 4, "買う", 2, "Te"), ("走ッタ", 5, "走る", 2, "Past"), ("頑張って", 6, "頑張る", 2, "Te"), ("頑張っていらっしゃる", 5, "頑張る", 2, "Respectful<Continuous"),
    ("食べ", 1, "食べる", 9, "MasuStem"), ("食べた", 2, "食べる", 9, "Past"), ("食べたく", 3, "食べる", 9, "Tai<Adv"), ("食べたくなかった", 9, "食べる", 9, "Tai<Negative<Past"), ("食べました", 2, "食べる", 9, "PolitePast"),
)
WORDS = ("食べました", "食べたくなかった", "走ります", "行った", "来られる", "勉強する", "しなかった", "見させられた", "話さざるを得ない", "頑張っていらっしゃる", "読んで", "食べ", "新しくない", "もどって", "買え", "待とう")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else _quoted(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, text): four sentences for each document, in an order of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("text_id"))
    n, listed = len(SENTENCES), F.array(*map(F.lit, SENTENCES))
    return docs.withColumn("text", F.concat_ws(STOP, *(F.element_at(listed, F.expr(f"int(pmod(text_id div {n**k}, {n})) + 1")) for k in range(4))))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, text): a sentence for each document."""
    return corpus(spark, sf_dir).withColumn("text", F.substring_index("text", STOP, 1))


STOP = "\n"
_LISTED = f"[{', '.join(map(_quoted, SENTENCES))}]"
_CORPUS = f"(SELECT doc_id AS text_id, concat_ws(chr(10), {', '.join(f'{_LISTED}[(doc_id // {len(SENTENCES) ** k} % {len(SENTENCES)})::INT + 1]' for k in range(4))}) AS text FROM documents)"
_SENTENCE = f"(SELECT doc_id AS text_id, {_LISTED}[(doc_id % {len(SENTENCES)})::INT + 1] AS text FROM documents)"
_FOLD = lambda x: f"translate({x}, '{T.KATAKANA}', '{T.HIRAGANA}')"
_NEW = lambda x: f"translate({x}, '{T.OLD_KANJI}', '{T.NEW_KANJI}')"


def norm_digits(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.full_width_digits(F.col("text")).alias("text"))


def kana_fold(spark, sf_dir):
    return corpus(spark, sf_dir).select("text_id", T.hiragana(F.col("text")).alias("folded"))


def old_new_kanji(spark, sf_dir):
    return corpus(spark, sf_dir).select("text_id", T.new_kanji(F.col("text")).alias("modern"))


def long_vowel_variants(spark, sf_dir):
    return corpus(spark, sf_dir).select("text_id", F.posexplode(T.variants(F.col("text"))).alias("ord", "variant"))


def text_tests(spark, sf_dir):
    cut = corpus(spark, sf_dir).select("text_id", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("n"), "text").withColumn("prefix", F.substring("text", F.lit(1), F.col("n")))
    return cut.select("text_id", "n", T.ends_in_yoon(F.col("prefix")).alias("ends_in_yoon"), T.only_digits(F.col("prefix")).alias("only_digits"))


def nfc_normalize(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text")
    rows = corpus(spark, sf_dir).select("text_id", F.replace("text", F.lit("ハ゛"), F.lit("ハ" + chr(0x3099) + T.ZWNJ)).alias("text")).unionByName(docs)
    return rows.withColumn("n", T.normalized(F.col("text"))).select("text_id", "n.normalized", F.size("n.starts").alias("n_starts"))


def priority_scores(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in MARKS], "mark string").select("mark", R.priority_score(F.col("mark")).alias("score"))


def priority_sums(spark, sf_dir):
    rows = sample_dictionary(spark).entries.select("ent_seq", F.explode("kana_readings").alias("f")).where("f.priority IS NOT NULL")
    return rows.select("ent_seq", F.col("f.text").alias("form"), F.round(R.priority_sum(T.split_list(F.col("f.priority"))), 6).alias("total"))


def type_masks(spark, sf_dir):
    return sample_dictionary(spark).entries.select("ent_seq", "type_mask")


def dict_stats(spark, sf_dir):
    return sample_dictionary(spark).statistics()


def dict_forms(spark, sf_dir):
    d = sample_dictionary(spark)
    return d.forms.join(d.entries.select("entry_id", "ent_seq"), "entry_id").select("ent_seq", "form_text", "kind", "ord")


def dict_glosses(spark, sf_dir):
    rows = sample_dictionary(spark).entries.select("ent_seq", F.explode("senses").alias("s"))
    return rows.select("ent_seq", F.col("s.index").alias("sense_index"), F.array_join("s.pos_tags", "|").alias("pos_tags"), F.posexplode("s.glosses").alias("ord", "g")).select("ent_seq", "sense_index", "pos_tags", "ord", "g.text", "g.lang")


def _substrings(spark, sf_dir):
    cut = corpus(spark, sf_dir).select("text").distinct().select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    return cut.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("at") + 1), lambda n: F.substring(F.col("text"), F.col("at"), n))).alias("word")).distinct()


def lookup_words(spark, sf_dir):
    d = sample_dictionary(spark)
    return L.lookup(_substrings(spark, sf_dir), d, 20).join(d.entries.select("entry_id", "ent_seq"), "entry_id").select("word", "hit_ord", "ent_seq")


def lookup_first(spark, sf_dir):
    d = sample_dictionary(spark)
    return L.lookup(_substrings(spark, sf_dir), d, 1).join(d.entries.select("entry_id", "ent_seq"), "entry_id").select("word", "ent_seq")


def match_flags(spark, sf_dir):
    d = sample_dictionary(spark)
    rows = L.get_words(d.forms.select(F.col("form_text").alias("word")).distinct(), d, 20)
    side = lambda c: rows.select("word", "ent_seq", F.explode(c).alias("f")).select("word", "ent_seq", F.col("f.text").alias("form"), "f.matched", "f.match")
    return side("kanji_readings").unionByName(side("kana_readings"))


def headword_ranks(spark, sf_dir):
    d = sample_dictionary(spark)
    rows = L.get_words(d.forms.select(F.col("form_text").alias("word")).distinct(), d, 20)
    return rows.select("word", "ent_seq", R.headword_type(F.col("kanji_readings"), F.col("kana_readings"), R.mostly_kana(F.col("senses"))).alias("headword_type"), F.round(R.entry_priority(F.col("kanji_readings"), F.col("kana_readings")), 6).alias("priority"))


def unconjugate_types(spark, sf_dir):
    return reachable(spark, spark.createDataFrame([(w,) for w in WORDS], "word string"))


def _named(chains: str) -> Column:
    """Chains of reasons as text."""
    names = F.array(*map(F.lit, REASONS))
    return F.array_join(F.transform(chains, lambda c: F.array_join(F.transform(c, lambda r: F.element_at(names, r + 1)), "<")), " or ")


def unconjugate_chains(spark, sf_dir):
    rows = corpus(spark, sf_dir).select(F.col("text").alias("word")).distinct().unionByName(spark.createDataFrame([(w,) for w in WORDS], "word string"))
    rows = rows.select("word", F.posexplode(candidates(F.col("word"))).alias("cand", "c"))
    return rows.select("word", "cand", F.col("c.word").alias("plain"), "c.type", _named("c.reason_chains").alias("reasons"))


def prefix_rows(spark, sf_dir):
    return S.prefixes(S.positions(sentences(spark, sf_dir)), F.length("normalized")).select("text_id", "pos", "len", "prefix", "match_len")


def longest_forms(spark, sf_dir):
    d = sample_dictionary(spark)
    rows = S.prefixes(S.positions(sentences(spark, sf_dir)), F.length("normalized"))
    keys = rows.select("text_id", "pos", "len", F.explode(F.array_distinct(F.array("prefix", T.hiragana(F.col("prefix"))))).alias("form_text"))
    return keys.join(d.forms.select("form_text").distinct(), "form_text", "left_semi").groupBy("text_id", "pos").agg(F.max("len").alias("longest"))


def word_search_all(spark, sf_dir):
    d = sample_dictionary(spark)
    rows = S.word_search(corpus(spark, sf_dir), d, 7, every_position=True)
    rows = rows.select("text_id", "pos", F.col("result.match_len").alias("longest"), "result.more", F.posexplode("result.data").alias("rank", "r"))
    return rows.select("text_id", "pos", "longest", "more", "rank", "r.entry_id", "r.match_len")


def _readable(tokens: DataFrame) -> DataFrame:
    return tokens.select("text_id", "index", "text", "start", "end", "entry_id", "ent_seq", _named("reason_chains").alias("reasons"))


def tokenize_corpus(spark, sf_dir):
    return _readable(K.tokenize(corpus(spark, sf_dir), sample_dictionary(spark)))


def token_counts(spark, sf_dir):
    return tokenize_corpus(spark, sf_dir).groupBy("ent_seq").agg(F.count("*").alias("tokens"), F.countDistinct("text").alias("spellings"))


def token_glosses(spark, sf_dir):
    d = sample_dictionary(spark)
    return K.with_glosses(K.tokenize(corpus(spark, sf_dir), d), d).select("text_id", "index", "text", "gloss")


def tokenize_windows(spark, sf_dir):
    rows = K.windows(corpus(spark, sf_dir)).select(F.struct("text_id", "window").alias("text_id"), "text")
    return K.tokenize(rows, sample_dictionary(spark)).select("text_id.text_id", "text_id.window", "index", "text", "ent_seq")


def tokenize_in_memory(spark, sf_dir):
    return _readable(tokenize_stream(corpus(spark, sf_dir), sample_dictionary(spark)))


def text_windows(spark, sf_dir):
    return K.windows(corpus(spark, sf_dir))


def length_statistics(spark, sf_dir):
    n = F.length("text").cast("double")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("lang", n.alias("n"))
    stats = {"mean": F.avg("n"), "median": F.percentile("n", 0.5), "deviation": F.stddev("n"), "least": F.min("n"), "most": F.max("n"), "p95": F.percentile("n", 0.95)}
    return docs.groupBy("lang").agg(*(F.round(e, 4).alias(k) for k, e in stats.items()))


def _dictionary_sql() -> str:
    entries = sample.entries()
    forms = [(e["ent_seq"], i, kind, f["text"], ",".join(f["priority"]) or None, ",".join(f["info"]) or None, f["no_kanji"]) for e in entries for kind, side in ((0, "readings"), (1, "kanji")) for i, f in enumerate(e[side])]
    senses = [(e["ent_seq"], i, j, g, "|".join(sample.ENTITIES[p] for p in s["pos"]), "uk" in s["misc"]) for e in entries for i, s in enumerate(e["senses"]) for j, g in enumerate(s["glosses"])]
    return f"forms AS (SELECT * FROM {_values(forms, 'ent_seq, ord, kind, form_text, priority, info, no_kanji')}), glosses AS (SELECT * FROM {_values(senses, 'ent_seq, sense_index, ord, text, pos_tags, uk')})"


_DICT = _dictionary_sql()
_SCORE = lambda m: f"CASE {' '.join(f'WHEN {m} IN ({_quoted(k)}{extra}) THEN {v}' for k, v in R.SCORES.items() for extra in [', ' + _quoted(next(long for long, short in R.LONG_NAMES.items() if short == k[0]) + k[1])])} WHEN regexp_matches({m}, '^nf[0-9]+$') AND substr({m}, 3)::INT BETWEEN 1 AND 47 THEN floor(48 - substr({m}, 3)::INT / 2.0)::INT ELSE 0 END"
_HITS = f"""keys AS (SELECT DISTINCT word, unnest([word, {_FOLD('word')}]) AS form_text FROM words),
met AS (SELECT word, kind, ent_seq, min((f.form_text, ord)) AS place FROM keys k JOIN forms f ON f.form_text = k.form_text GROUP BY ALL),
hits AS (SELECT word, ent_seq, row_number() OVER (PARTITION BY word ORDER BY place[1], ent_seq, place[2]) AS hit_ord FROM (SELECT *, min(kind) OVER (PARTITION BY word) AS best FROM met) WHERE kind = best)"""
_SUBSTRINGS = f"words AS (SELECT DISTINCT substr(text, a, n) AS word FROM (SELECT DISTINCT text FROM {_CORPUS}), range(1, 100) AS t(a), range(1, 100) AS u(n) WHERE a + n - 1 <= length(text))"
_NORMAL = "(SELECT text_id, translate(nfc_normalize(text), '0123456789', '０１２３４５６７８９') AS text FROM " + _SENTENCE + ")"
_PREFIXES = f"""prefixes AS (SELECT text_id, p - 1 AS pos, n AS len, substr(text, p, n) AS prefix, n AS match_len FROM {_NORMAL}, range(1, 60) AS t(p), range(1, 60) AS u(n)
  WHERE p + n - 1 <= length(text) AND NOT regexp_matches(substr(text, p, n), '{T.DIGITS_ONLY}') AND NOT regexp_matches(substr(text, p + n - 1, 2), '^[{T.YOON_STARTS}][{T.YOON_ENDS}]'))"""
# Of (word, ent_seq) in ``hits``: forms with their flags, and the rank of the entry for the word.
_MATCHED = f"""flags AS (SELECT word, f.*, {_FOLD('form_text')} = {_FOLD('word')} AS same FROM hits JOIN forms f USING (ent_seq)),
sides AS (SELECT *, bool_or(same AND kind = 1) OVER w AS by_kanji, bool_or(same AND kind = 0) OVER w AS by_kana FROM flags WINDOW w AS (PARTITION BY word, ent_seq)),
matched AS (SELECT *, same AND (kind = 1 OR NOT by_kanji) AS matched, CASE WHEN kind = 1 THEN NOT by_kanji OR same ELSE by_kanji OR NOT by_kana OR same END AS match FROM sides)"""
_RANKS = f"""kana AS (SELECT word, ent_seq, arg_min(info, ord) FILTER (WHERE matched AND kind = 0 AND info IS NOT NULL) AS info, coalesce(bool_or(matched AND kind = 0), false) AS read, arg_min(no_kanji, ord) FILTER (WHERE matched AND kind = 0) AS no_kanji,
  coalesce(bool_and(coalesce(list_has_any(string_split(info, ','), ['rK', 'sK', 'iK']), false)) FILTER (WHERE kind = 1), true) AS hidden FROM matched GROUP BY word, ent_seq),
usual AS (SELECT ent_seq, count(*) FILTER (WHERE uk) * 2 >= count(*) AS usual FROM (SELECT DISTINCT ent_seq, sense_index, uk FROM glosses) GROUP BY ent_seq),
score AS (SELECT word, ent_seq, kind, ord, sum(s / pow(10.0::DOUBLE, k)) AS total FROM (SELECT *, row_number() OVER (PARTITION BY word, ent_seq, kind, ord ORDER BY s DESC) - 1 AS k FROM (SELECT *, {_SCORE('m')} AS s FROM (SELECT word, ent_seq, kind, ord, unnest(string_split(priority, ',')) AS m FROM matched WHERE matched AND priority IS NOT NULL))) GROUP BY ALL),
best AS (SELECT word, ent_seq, max(total) AS priority FROM score GROUP BY ALL),
ranks AS (SELECT word, ent_seq, CASE WHEN NOT read THEN 1 WHEN list_has_any(string_split(coalesce(info, ''), ','), ['ok', 'rk', 'sk', 'ik']) THEN 2 WHEN hidden OR usual OR no_kanji THEN 1 ELSE 2 END AS headword_type, round(coalesce(priority, 0.0::DOUBLE), 6) AS priority
  FROM kana JOIN usual USING (ent_seq) LEFT JOIN best USING (word, ent_seq))"""
_FLAGGED = f"WITH {_DICT}, words AS (SELECT DISTINCT form_text AS word FROM forms), {_HITS}, {_MATCHED}"
_RULES = _values([(r.ending, r.becomes, r.left, r.right) for r in rules()], "ending, becomes, lt, rt")
_TESTS = {1: "tag LIKE 'v1%' OR tag LIKE '%Ichidan verb%'", 2: "tag LIKE 'v5%' OR tag LIKE 'v4%' OR tag LIKE '%Godan verb%'", 4: "tag LIKE 'adj-i%' OR lower(tag) LIKE '%adjective%'", 8: "tag = 'vk' OR lower(tag) LIKE '%kuru verb%'", 16: "tag IN ('vs-i', 'vs-s') OR lower(tag) LIKE '%suru verb%'", 32: "tag IN ('vs-s', 'vz') OR lower(tag) LIKE '%suru verb%'", 64: "tag = 'vs' OR (lower(tag) LIKE '%noun or participle%' AND lower(tag) LIKE '%suru%')"}

_TYPES = f"SELECT ent_seq, ({' + '.join(f'CASE WHEN bool_or({e}) THEN {b} ELSE 0 END' for b, e in _TESTS.items())})::INT AS type_mask FROM (SELECT DISTINCT ent_seq, unnest(string_split(pos_tags, '|')) AS tag FROM glosses) GROUP BY ent_seq"


def _search_sql(texts: str, results: int) -> str:
    """CTEs for the distinct texts (text) of a query: ``found``, the ranked results (text, pos, rank from 0, ent_seq,
    match_len, reasons, longest, more) of each position, and ``tokens`` (text, index, start, "end", ent_seq, reasons).

    What is inflected comes from the list above; all else, from prefixes and spellings to the walk, is done here.
    """
    return f"""{_DICT}, types AS ({_TYPES}), infl AS (SELECT * FROM {_values(INFLECTED, 'spelling, cand, plain, type, reasons')}),
texts AS MATERIALIZED (SELECT DISTINCT text, translate(text, '0123456789', '０１２３４５６７８９') AS norm FROM ({texts})),
prefixes AS MATERIALIZED (SELECT text, p - 1 AS pos, n AS len, substr(norm, p, n) AS prefix FROM texts, range(1, 100) AS t(p), range(1, 100) AS u(n)
  WHERE p + n - 1 <= length(norm) AND NOT regexp_matches(substr(norm, p, n), '{T.DIGITS_ONLY}') AND NOT regexp_matches(substr(norm, p + n - 1, 2), '^[{T.YOON_STARTS}][{T.YOON_ENDS}]')),
pre AS MATERIALIZED (SELECT DISTINCT prefix FROM prefixes),
vars AS MATERIALIZED (SELECT prefix, 0 AS ord, prefix AS variant FROM pre
  UNION ALL SELECT prefix, k, substr(prefix, 1, strpos(prefix, 'ー') - 1) || v || substr(prefix, strpos(prefix, 'ー') + 1) FROM pre, {_values(enumerate(T.VOWELS, 1), 'k, v')} WHERE contains(prefix, 'ー')
  UNION ALL SELECT prefix, 6, {_NEW('prefix')} FROM pre WHERE {_NEW('prefix')} <> prefix),
cands AS MATERIALIZED (SELECT DISTINCT variant, 0 AS cand, variant AS plain, 127 AS type, '' AS reasons FROM vars UNION ALL SELECT spelling, cand, plain, type, reasons FROM infl),
words AS (SELECT DISTINCT plain AS word FROM cands), {_HITS.replace('hits AS', 'looked AS')},
spelled AS MATERIALIZED (SELECT c.variant, c.cand, l.hit_ord, l.ent_seq, c.reasons, CASE WHEN c.reasons = '' THEN 0 ELSE len(string_split(c.reasons, '<')) END AS steps
  FROM cands c JOIN looked l ON l.word = c.plain JOIN types t USING (ent_seq) WHERE c.cand = 0 OR (c.type & t.type_mask) <> 0),
here AS MATERIALIZED (SELECT p.text, p.pos, p.len, p.prefix, v.variant, min(v.ord) AS ord FROM prefixes p JOIN vars v USING (prefix) WHERE v.variant IN (SELECT variant FROM spelled) GROUP BY ALL),
chosen AS (SELECT *, first_value(variant) OVER w AS first_variant, first_value(len) OVER w AS first_len FROM here WINDOW w AS (PARTITION BY text, pos ORDER BY len DESC, ord)),
kept AS MATERIALIZED (SELECT c.text, c.pos, c.len, CASE WHEN c.len = c.first_len THEN c.prefix ELSE c.variant END AS word, s.* FROM chosen c JOIN spelled s USING (variant) WHERE left(c.first_variant, c.len) = c.variant),
hits AS MATERIALIZED (SELECT DISTINCT word, ent_seq FROM kept), {_MATCHED}, {_RANKS},
seen AS (SELECT k.*, headword_type, priority FROM kept k JOIN ranks r USING (word, ent_seq) QUALIFY len = max(len) OVER (PARTITION BY text, pos, k.ent_seq)),
placed AS (SELECT *, row_number() OVER (PARTITION BY text, pos ORDER BY steps, headword_type, priority DESC, len DESC, cand, hit_ord) - 1 AS rank, max(len) OVER (PARTITION BY text, pos) AS longest, count(*) OVER (PARTITION BY text, pos) >= {results} AS more FROM seen),
found AS MATERIALIZED (SELECT text, pos, rank, ent_seq, len AS match_len, nullif(reasons, '') AS reasons, longest, more FROM placed WHERE rank < {results}),
one AS MATERIALIZED (SELECT text, pos, arg_min(ent_seq, rank + if(match_len = longest, 0, 1000)) AS ent_seq, min_by(struct_pack(n := match_len, r := reasons), rank + if(match_len = longest, 0, 1000)) AS best FROM found GROUP BY text, pos),
tokens AS (SELECT text, 0 AS index, 0 AS start, coalesce(best.n, 1) AS "end", ent_seq, best.r AS reasons FROM texts LEFT JOIN (SELECT * FROM one WHERE pos = 0) o USING (text) WHERE text <> ''
  UNION ALL SELECT t.text, t.index + 1, t."end", t."end" + coalesce(o.best.n, 1), o.ent_seq, o.best.r FROM tokens t LEFT JOIN one o ON o.text = t.text AND o.pos = t."end" WHERE t."end" < length(t.text))"""


_TOKENS = f"WITH RECURSIVE {_search_sql(f'SELECT text FROM {_CORPUS}', K.CONSIDERED)}, rows AS (SELECT c.text_id, t.index, substr(c.text, t.start + 1, t.\"end\" - t.start) AS text, t.start, t.\"end\", ent_seq::BIGINT AS entry_id, ent_seq, reasons FROM {_CORPUS} c JOIN tokens t USING (text))"
_WINDOWS = f'(SELECT text_id, w AS "window", substr(text, w, 10) AS text FROM {_CORPUS}, range(1, 100) AS t(w) WHERE w <= greatest(1, length(text) - 9))'

QUERIES = {f.__name__: f for f in (norm_digits, kana_fold, old_new_kanji, long_vowel_variants, text_tests, nfc_normalize, priority_scores, priority_sums, type_masks, dict_stats, dict_forms, dict_glosses, lookup_words, lookup_first, match_flags, headword_ranks, unconjugate_types, unconjugate_chains, prefix_rows, longest_forms, word_search_all, tokenize_corpus, token_counts, token_glosses, tokenize_windows, tokenize_in_memory, text_windows, length_statistics)}
ORACLES = {
    "norm_digits": "SELECT doc_id, translate(text, '0123456789', '０１２３４５６７８９') AS text FROM documents",
    "kana_fold": f"SELECT text_id, {_FOLD('text')} AS folded FROM {_CORPUS}",
    "old_new_kanji": f"SELECT text_id, {_NEW('text')} AS modern FROM {_CORPUS}",
    "long_vowel_variants": f"""SELECT text_id, 0 AS ord, text AS variant FROM {_CORPUS} UNION ALL
      SELECT text_id, k, substr(text, 1, strpos(text, 'ー') - 1) || v || substr(text, strpos(text, 'ー') + 1) FROM {_CORPUS}, {_values(enumerate(T.VOWELS, 1), 'k, v')} WHERE contains(text, 'ー') UNION ALL
      SELECT text_id, CASE WHEN contains(text, 'ー') THEN 6 ELSE 1 END, {_NEW('text')} FROM {_CORPUS} WHERE {_NEW('text')} <> text""",
    "text_tests": f"SELECT text_id, n, regexp_matches(substr(text, 1, n), '[{T.YOON_STARTS}][{T.YOON_ENDS}]$') AS ends_in_yoon, regexp_matches(substr(text, 1, n), '{T.DIGITS_ONLY}') AS only_digits FROM {_CORPUS}, range(1, 100) AS t(n) WHERE n <= length(text)",
    "nfc_normalize": f"""SELECT text_id, normalized, length(normalized) + 1 AS n_starts FROM (SELECT text_id, replace(nfc_normalize(translate(text, '0123456789', '０１２３４５６７８９')), chr(8204), '') AS normalized
      FROM (SELECT text_id, replace(text, 'ハ゛', 'ハ' || chr(12441) || chr(8204)) AS text FROM {_CORPUS} UNION ALL SELECT doc_id, text FROM documents))""",
    "priority_scores": f"SELECT mark, {_SCORE('mark')} AS score FROM {_values([(m,) for m in MARKS], 'mark')}",
    "priority_sums": f"""WITH {_DICT}, s AS (SELECT ent_seq, ord, form_text, {_SCORE('m')} AS score FROM (SELECT ent_seq, ord, form_text, unnest(string_split(priority, ',')) AS m FROM forms WHERE kind = 0 AND priority IS NOT NULL)),
      r AS (SELECT *, row_number() OVER (PARTITION BY ent_seq, ord ORDER BY score DESC) - 1 AS k FROM s) SELECT ent_seq, form_text AS form, round(sum(score / pow(10.0::DOUBLE, k)), 6) AS total FROM r GROUP BY ent_seq, ord, form_text""",
    "type_masks": f"WITH {_DICT} {_TYPES}",
    "dict_stats": f"WITH {_DICT} SELECT (SELECT count(DISTINCT ent_seq) FROM forms) AS entries, (SELECT count(*) FROM forms WHERE kind = 1) AS kanji_forms, (SELECT count(*) FROM forms WHERE kind = 0) AS kana_forms, (SELECT count(DISTINCT (ent_seq, sense_index)) FROM glosses) AS senses, (SELECT count(*) FROM glosses) AS glosses",
    "dict_forms": f"WITH {_DICT} SELECT ent_seq, form_text, kind, ord FROM forms",
    "dict_glosses": f"WITH {_DICT} SELECT ent_seq, sense_index, pos_tags, ord, text, 'eng' AS lang FROM glosses",
    "lookup_words": f"WITH {_DICT}, {_SUBSTRINGS}, {_HITS} SELECT word, hit_ord, ent_seq FROM hits WHERE hit_ord <= 20",
    "lookup_first": f"WITH {_DICT}, {_SUBSTRINGS}, {_HITS} SELECT word, ent_seq FROM hits WHERE hit_ord = 1",
    "match_flags": f"{_FLAGGED} SELECT word, ent_seq, form_text AS form, matched, match FROM matched",
    "headword_ranks": f"{_FLAGGED}, {_RANKS} SELECT word, ent_seq, headword_type, priority FROM ranks",
    "unconjugate_types": f"""WITH RECURSIVE u AS (SELECT * FROM {_RULES}), reached AS (SELECT word AS start, word, {UNKNOWN} AS type FROM {_values([(w,) for w in WORDS], 'word')}
      UNION SELECT * FROM (WITH r AS (SELECT * FROM reached) SELECT start, left(word, length(word) - length(ending)) || becomes AS w, rt FROM r JOIN u ON {_FOLD('right(word, length(ending))')} = ending AND (type & lt) <> 0
      UNION ALL SELECT start, word || 'る', 9 FROM r WHERE (type & 3328) <> 0) WHERE w <> '')
      SELECT DISTINCT start, word, (type & {ALL_WORDS})::INT AS type FROM reached WHERE (type & {ALL_WORDS}) <> 0""",
    "prefix_rows": f"WITH {_PREFIXES} SELECT * FROM prefixes",
    "longest_forms": f"WITH {_DICT}, {_PREFIXES} SELECT text_id, pos, max(len) AS longest FROM prefixes WHERE prefix IN (SELECT form_text FROM forms) OR {_FOLD('prefix')} IN (SELECT form_text FROM forms) GROUP BY ALL",
    "word_search_all": f"WITH RECURSIVE {_search_sql(f'SELECT text FROM {_CORPUS}', 7)} SELECT c.text_id, pos, longest, more, rank, ent_seq::BIGINT AS entry_id, match_len FROM {_CORPUS} c JOIN found USING (text)",
    "tokenize_corpus": f"{_TOKENS} SELECT * FROM rows",
    "tokenize_in_memory": f"{_TOKENS} SELECT * FROM rows",
    "token_counts": f"{_TOKENS} SELECT ent_seq, count(*) AS tokens, count(DISTINCT text) AS spellings FROM rows GROUP BY ent_seq",
    "token_glosses": f"{_TOKENS} SELECT text_id, index, r.text, g.text AS gloss FROM rows r LEFT JOIN (SELECT ent_seq, text FROM glosses WHERE sense_index = 0 AND ord = 0) g USING (ent_seq)",
    "tokenize_windows": f"WITH RECURSIVE {_search_sql(f'SELECT text FROM {_WINDOWS}', K.CONSIDERED)} SELECT w.text_id, w.\"window\", t.index, substr(w.text, t.start + 1, t.\"end\" - t.start) AS text, ent_seq FROM {_WINDOWS} w JOIN tokens t USING (text)",
    "text_windows": f'SELECT text_id, w AS "window", substr(text, w, 10) AS text FROM {_CORPUS}, range(1, 100) AS t(w) WHERE w <= greatest(1, length(text) - 9)',
    "length_statistics": "SELECT lang, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS median, round(stddev(n), 4) AS deviation, min(n) AS least, max(n) AS most, round(quantile_cont(n, 0.95), 4) AS p95 FROM (SELECT lang, length(text)::DOUBLE AS n FROM documents WHERE text IS NOT NULL) GROUP BY lang",
}
__all__ = ["ORACLES", "QUERIES", "Dictionary", "corpus"]
