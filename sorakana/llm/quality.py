"""Quality rules with thresholds learnt for each language and source (operator 3).

All of it is DataFrame expressions. A first pass counts what the rules look at. Counts
per language, source, measure and bucket are the quantile sketches: buckets have a fixed
relative width, so sketches merge by adding counts, in any order, to one result. Fences
from quantiles replace fixed cutoffs and are joined to the documents.

A measure that most documents of a group have has the fences of Tukey: so many ranges
beyond the quartiles. One that at most a quarter have is judged by the quartiles of those
that have it, so that a group's own habit tells what is much. If those that have it have
all at once a lot of it, with nothing in between, they are of another kind, and the fence
is in the gap. So that junk in a group cannot widen its own fences, they end at those of
its language, and these at those of all rows, unless the median is beyond: then the whole
group is of another kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, store

#: Interquartile ranges beyond a quartile that still pass. A range counts as half of that of all rows at least.
RANGES = 5
#: A measure is judged by the documents that have it if not more than one in so many has it.
SPARSE = 4
#: There is a gap if all but a twentieth of those that have a measure have so many cases of it.
APART = 10
#: Groups with fewer documents, or fewer that have a sparse measure, take the fences of their language, then those of all.
LEAST_DOCS, LEAST_SOME = 30, 10
#: Bits of a position among the words of a text; no text has more words.
_BITS = 30
#: Measures in thousandths (word length: hundredths), and the cases of those that can have gaps.
#: Words repeat by whole passages, so that their number shows no gap.
_MEASURES = {"word_length": "100 * word_chars div greatest(n_words, 1)", "symbols": "1000 * n_symbols div greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words div greatest(n_words, 1)", "upper": "1000 * n_upper div greatest(word_chars, 1)"}
_CASES = {"symbols": "n_symbols", "dup_lines": "n_dup_lines"}


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text (null: no words).

    A word that repeats is in a window of three words that the text has twice or more.
    Windows are sorted by hash and position; what shares a hash is compared in full.
    """
    mask = (1 << _BITS) - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.selectExpr("*", r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) AS words", r"filter(split(text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]') AS lines")
    rows = rows.selectExpr("doc_id", "lang", "source", "words", "cast(size(words) AS long) AS n_words", r"cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '')) AS long) AS word_chars",
        "cast(length(text) - length(translate(text, '#*$%&|<>', '')) AS long) AS n_symbols", "cast(size(lines) AS long) AS n_lines", "cast(size(lines) - size(array_distinct(lines)) AS long) AS n_dup_lines",
        "cast(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS long) AS n_upper",
        f"sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> (xxhash64(w, get(words, i + 1), get(words, i + 2)) & {~mask}L) | i)) AS grams")
    rows = rows.selectExpr("*", f"transform(filter(grams, (p, i) -> shiftright(p, {_BITS}) = shiftright(get(grams, i + 1), {_BITS}) OR shiftright(p, {_BITS}) = shiftright(get(grams, i - 1), {_BITS})), p -> cast(p & {mask}L AS int)) AS near").drop("grams")
    rows = rows.selectExpr("*", "sort_array(transform(near, p -> struct(get(words, p) AS a, get(words, p + 1) AS b, get(words, p + 2) AS c, p AS p))) AS same").drop("near", "words")
    alike = "(s.a = get(same, {0}).a AND s.b = get(same, {0}).b AND s.c = get(same, {0}).c)"
    rows = rows.selectExpr("*", f"sort_array(transform(filter(same, (s, i) -> {alike.format('i + 1')} OR {alike.format('i - 1')}), s -> s.p)) AS at").drop("same")
    rows = rows.selectExpr("*", "aggregate(transform(at, (p, i) -> least(3, coalesce(get(at, i + 1) - p, 3))), 0L, (s, x) -> s + x) AS n_repeat_words").drop("at")
    return rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _stats(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Of each group by ``keys`` and measure: documents, whether they are enough, median, quartiles, and the gap's fence."""
    sketch = sketch.groupBy(*keys, "measure", "case", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure", "case")  # at most a row for each bucket
    sketch = sketch.withColumns({"docs": F.sum("n").over(group), "some": F.sum(F.expr("CASE WHEN bucket > 0 THEN n ELSE 0 END")).over(group), "upto": F.sum("n").over(group.orderBy("bucket"))})
    sketch = sketch.withColumn("above", F.expr("upto - (docs - some)"))  # of those that have it, those up to here
    every = lambda k: f"min(CASE WHEN NOT case AND upto * 4 >= docs * {k} THEN bucket END)"
    having = lambda k, of, case="NOT case": f"min(CASE WHEN {case} AND bucket > 0 AND above * {of} >= some * {k} THEN bucket END)"
    rows = sketch.groupBy(*keys, "measure").agg(*(F.expr(e).alias(n) for n, e in {
        "docs": "max(CASE WHEN NOT case THEN docs END)", "some": "max(CASE WHEN NOT case THEN some END)", "q1": every(1), "mid": every(2), "q3": every(3),
        "s1": having(1, 4), "s3": having(3, 4), "least": having(1, 20), "cases": having(1, 20, "case")}.items()))
    sparse = f"some * {SPARSE} <= docs"
    return rows.selectExpr(*(f"{k} AS {prefix}{k}" for k in keys), f"measure AS {prefix}measure", f"docs >= {LEAST_DOCS} AND (NOT ({sparse}) OR some >= {LEAST_SOME}) AS {prefix}enough", f"mid AS {prefix}mid",
        f"CASE WHEN {sparse} THEN s1 ELSE q1 END AS {prefix}lower", f"CASE WHEN {sparse} THEN s3 ELSE q3 END AS {prefix}upper", f"CASE WHEN {sparse} AND cases >= {APART} THEN (least + 1) div 2 END AS {prefix}gap")


def thresholds(found: DataFrame) -> DataFrame:
    """Of each (t_lang, t_source), from documents that pass the base rules: {measure}_low and _high, null for none."""
    struct = lambda m, e, case: f"struct('{m}' AS measure, {str(case).lower()} AS case, {e} AS v)"
    values = ", ".join([*(struct(m, e, False) for m, e in _MEASURES.items()), *(struct(m, f"nullif({e}, 0)", True) for m, e in _CASES.items())])
    passed = found.where("NOT base_failed").selectExpr("lang", "source", f"explode(array({values})) AS x").select("lang", "source", "x.*").where("v IS NOT NULL")
    # 64 buckets for each power of two, exact below 128.
    bucket = F.expr("CASE WHEN v < 128 THEN v ELSE v - v % shiftleft(1L, length(bin(v)) - 7) END")
    sketch = store(passed.groupBy("lang", "source", "measure", "case", bucket.alias("bucket")).agg(F.count("*").alias("n")), "sketch")
    own, lang, every = _stats(sketch, ["lang", "source"], "o_"), _stats(sketch, ["lang"], "l_"), _stats(sketch, [], "e_")
    rows = own.join(lang, own["o_lang"].eqNullSafe(lang["l_lang"]) & (own["o_measure"] == lang["l_measure"])).join(every, F.col("o_measure") == F.col("e_measure"))
    for p in "eol":
        reach = f"{RANGES} * greatest({p}_upper - {p}_lower, (e_upper - e_lower) div 2)"
        rows = rows.withColumns({f"{p}_low": F.expr(f"{p}_lower - {reach}"), f"{p}_high": F.expr(f"coalesce({p}_gap, {p}_upper + {reach})")})
    for p, outer in (("l", "e"), ("o", "l")):
        rows = rows.withColumns({
            f"{p}_low": F.expr(f"CASE WHEN {p}_mid >= {outer}_low THEN greatest({p}_low, {outer}_low) ELSE {p}_low END"),
            f"{p}_high": F.expr(f"CASE WHEN {p}_mid <= {outer}_high THEN least({p}_high, {outer}_high) ELSE {p}_high END")})
    level = lambda c: F.expr(f"CASE WHEN o_enough THEN o_{c} WHEN l_enough THEN l_{c} ELSE e_{c} END")
    rows = rows.select(F.col("o_lang").alias("t_lang"), F.col("o_source").alias("t_source"), "o_measure", level("low").alias("low"), level("high").alias("high"))
    return store(rows.groupBy("t_lang", "t_source").agg(*(F.max(F.when(F.col("o_measure") == m, F.col(c))).alias(f"{m}_{c}") for m in _MEASURES for c in ("low", "high"))), "fences")


def filter_quality(docs: DataFrame) -> DataFrame:
    """Counts and verdicts of all rows.

    Null texts count as empty and fail the base rules, as all texts under 50 words do.
    Null languages and sources are groups of their own. Repeated rows are judged each.
    """
    found = store(counts(docs), "counts")
    limits = thresholds(found)
    rows = found.join(limits, found["lang"].eqNullSafe(limits["t_lang"]) & found["source"].eqNullSafe(limits["t_source"]), "left")
    inside = F.expr(" AND ".join([f"({m}_high IS NULL OR {e} <= {m}_high)" for m, e in _MEASURES.items()] + [f"{_MEASURES['word_length']} >= word_length_low"]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(documents(spark, sf_dir))


def _oracle() -> str:
    duck = {m: e.replace(" div ", " // ") for m, e in _MEASURES.items()}

    def level(keys: str) -> str:
        """One level's fences, from quantiles of the sketches by counting what is not above a bucket."""
        by = f"GROUP BY {keys} measure" if keys else "GROUP BY measure"
        part = f"PARTITION BY {keys} measure"
        plain = f"SELECT {keys} measure, bucket, sum(n) AS n FROM sketch WHERE NOT is_case GROUP BY ALL"
        return f"""(SELECT {keys} measure, a.docs >= {LEAST_DOCS} AND (a.some * {SPARSE} > a.docs OR a.some >= {LEAST_SOME}) AS enough, a.mid, if(a.some * {SPARSE} <= a.docs, s1, q1) AS lower, if(a.some * {SPARSE} <= a.docs, s3, q3) AS upper,
      if(a.some * {SPARSE} <= a.docs AND cases >= {APART}, (lowest + 1) // 2, NULL) AS gap
    FROM (SELECT {keys} measure, max(docs) AS docs, max(docs) - coalesce(max(n) FILTER (WHERE bucket = 0), 0) AS some, min(bucket) FILTER (WHERE upto * 4 >= docs) AS q1, min(bucket) FILTER (WHERE upto * 2 >= docs) AS mid, min(bucket) FILTER (WHERE upto * 4 >= docs * 3) AS q3
        FROM (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS docs FROM ({plain})) {by}) a
      LEFT JOIN (SELECT {keys} measure, min(bucket) FILTER (WHERE upto * 20 >= docs) AS lowest, min(bucket) FILTER (WHERE upto * 4 >= docs) AS s1, min(bucket) FILTER (WHERE upto * 4 >= docs * 3) AS s3
        FROM (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS docs FROM ({plain}) WHERE bucket > 0) {by}) h USING ({keys} measure)
      LEFT JOIN (SELECT {keys} measure, min(bucket) FILTER (WHERE upto * 20 >= docs) AS cases
        FROM (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS docs FROM (SELECT {keys} measure, bucket, sum(n) AS n FROM sketch WHERE is_case GROUP BY ALL)) {by}) c USING ({keys} measure))"""

    reach = lambda p: f"{RANGES} * greatest({p}.upper - {p}.lower, (e.upper - e.lower) // 2)"
    return f"""
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
grams AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
f AS (SELECT b.*, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_upper, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (rid)),
g AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
long AS MATERIALIZED ({' UNION ALL '.join([*(f"SELECT rid, lang, source, base_failed, '{m}' AS measure, false AS is_case, {e} AS v FROM g" for m, e in duck.items()), *(f"SELECT rid, lang, source, base_failed, '{m}', true, {e} FROM g WHERE {e} > 0" for m, e in _CASES.items())])}),
sketch AS MATERIALIZED (SELECT lang, source, measure, is_case, CASE WHEN v < 128 THEN v ELSE v - v % (1::BIGINT << (length(bin(v)) - 7)) END AS bucket, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
o AS {level('lang, source,')}, l AS {level('lang,')}, e AS {level('')},
t AS (SELECT o.lang, o.source, measure, o.enough, l.enough AS l_enough, o.mid, l.mid AS l_mid, o.lower - {reach('o')} AS low, l.lower - {reach('l')} AS l_low, e.lower - {reach('e')} AS e_low,
    coalesce(o.gap, o.upper + {reach('o')}) AS high, coalesce(l.gap, l.upper + {reach('l')}) AS l_high, coalesce(e.gap, e.upper + {reach('e')}) AS e_high FROM o JOIN l USING (lang, measure) JOIN e USING (measure)),
t1 AS (SELECT * REPLACE (if(l_mid >= e_low, greatest(l_low, e_low), l_low) AS l_low, if(l_mid <= e_high, least(l_high, e_high), l_high) AS l_high) FROM t),
t2 AS (SELECT * REPLACE (if(mid >= l_low, greatest(low, l_low), low) AS low, if(mid <= l_high, least(high, l_high), high) AS high) FROM t1),
fences AS (SELECT lang, source, measure, CASE WHEN enough THEN low WHEN l_enough THEN l_low ELSE e_low END AS low, CASE WHEN enough THEN high WHEN l_enough THEN l_high ELSE e_high END AS high FROM t2),
v AS (SELECT rid, bool_and((high IS NULL OR v <= high) AND (measure <> 'word_length' OR v >= low)) AS inside FROM long JOIN fences USING (lang, source, measure) WHERE NOT is_case GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept FROM g LEFT JOIN v USING (rid)
"""


ORACLE = _oracle()
