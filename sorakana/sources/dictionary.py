"""Dictionaries: from XML or SQLite to nested entries and a flat table of forms.

Entries hold all forms and senses of a word in one row. Forms are the lookup side: a row
for each written form or reading, to be joined by equality. Both are plain DataFrames, so
any source of that shape serves as a dictionary.
"""

from __future__ import annotations

import re
import sqlite3
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_list

# What the XML of an entry looks like to from_xml.
_XML = (
    "ent_seq string, k_ele array<struct<keb: string, ke_inf: array<string>, ke_pri: array<string>>>, r_ele array<struct<reb: string, re_nokanji: string, re_restr: array<string>, re_inf: array<string>, re_pri: array<string>>>, "
    "sense array<struct<stagk: array<string>, stagr: array<string>, pos: array<string>, field: array<string>, misc: array<string>, dial: array<string>, s_inf: array<string>, gloss: array<struct<_VALUE: string, _g_type: string, `_xml:lang`: string>>>>"
)
# Entities of any XML document, which the parser replaces by itself.
_PLAIN = {"lt", "gt", "amp", "quot", "apos"}
#: Between a code and the phrase that it stands for, while both travel through the parser.
_MARK = "␟"
ENTRY_SCHEMA = (
    "entry_id bigint, ent_seq string, kanji_readings array<struct<text: string, priority: string, info: string, ord: int>>, kana_readings array<struct<text: string, no_kanji: boolean, priority: string, info: string, restrictions: array<string>, ord: int>>, "
    "senses array<struct<index: int, pos_tags: array<string>, glosses: array<struct<text: string, lang: string, g_type: string>>, info: string, field: array<string>, misc: array<string>, dial: array<string>, stagk: array<string>, stagr: array<string>>>"
)


@dataclass
class Dictionary:
    """Entries as of ENTRY_SCHEMA with type_mask, and forms (form_text, kind, ord, entry_id); kind 0 is kana, 1 kanji."""

    entries: DataFrame
    forms: DataFrame

    @classmethod
    def of(cls, entries: DataFrame) -> Dictionary:
        if "type_mask" not in entries.columns:
            entries = entries.withColumn("type_mask", type_mask(F.flatten(F.transform("senses", lambda s: F.coalesce(s["pos_tags"], F.array().cast("array<string>"))))))
        side = lambda c, kind: entries.select("entry_id", F.explode(c).alias("f")).select(F.col("f.text").alias("form_text"), F.lit(kind).alias("kind"), F.col("f.ord").alias("ord"), "entry_id")
        return cls(entries, side("kana_readings", 0).unionByName(side("kanji_readings", 1)))

    def write(self, path: str) -> Dictionary:
        """Two Parquet tables; forms sorted by their text, so that readers skip row groups."""
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        self.forms.repartitionByRange("form_text").sortWithinPartitions("form_text").write.mode("overwrite").parquet(f"{path}/forms")
        return self.read(self.entries.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Dictionary:
        return cls(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/forms"))

    def statistics(self) -> DataFrame:
        """One row: entries, kanji forms, readings, senses, glosses."""
        n = lambda c: F.sum(F.size(c)).alias(c.replace("_readings", "_forms"))
        return self.entries.agg(F.count("*").alias("entries"), n("kanji_readings"), n("kana_readings"), n("senses"), F.sum(F.size(F.flatten(F.transform("senses", lambda s: s["glosses"])))).alias("glosses"))


def type_mask(tags: Column) -> Column:
    """The word types that part-of-speech tags allow, as bits; tags are codes or phrases."""
    low = F.lower
    tests = {
        1: lambda t: t.startswith("v1") | t.contains("Ichidan verb"),
        2: lambda t: t.startswith("v5") | t.startswith("v4") | t.contains("Godan verb"),
        4: lambda t: t.startswith("adj-i") | low(t).contains("adjective"),
        8: lambda t: (t == "vk") | low(t).contains("kuru verb"),
        16: lambda t: t.isin("vs-i", "vs-s") | low(t).contains("suru verb"),
        32: lambda t: t.isin("vs-s", "vz") | low(t).contains("suru verb"),
        64: lambda t: (t == "vs") | (low(t).contains("noun or participle") & low(t).contains("suru")),
    }
    out = F.lit(0)
    for bit, test in tests.items():
        out = out + F.when(F.exists(tags, test), bit).otherwise(0)
    return out.cast("int")


def entities(text: str) -> dict[str, str]:
    """Entities that a document type defines."""
    return {name: value for name, _, value in re.findall(r"<!ENTITY\s+(\S+)\s+([\"'])(.*?)\2\s*>", text, re.S)}


def parse_entries(xml_rows: DataFrame, codes: dict[str, str], all_priorities: bool = True, info_codes: bool = True) -> DataFrame:
    """Entries of rows (value: text of one <entry> element).

    Parts of speech become the phrases of their entities. Info, usage, field and dialect
    stay codes with ``info_codes``, which is what ranking compares; otherwise phrases. Forms
    without text, senses without gloss (the index counts them), entries without a number,
    a form or a sense are left out, as is what cannot be parsed. Of entries with one number
    the first stays: by the column ``at``, if the rows have it, else in the order of the rows.
    """
    marked = {k: f"{k}{_MARK}{v}" for k, v in codes.items() if k not in _PLAIN}
    table = F.create_map(*(F.lit(x) for kv in marked.items() for x in kv)) if marked else F.create_map().cast("map<string,string>")
    parts = F.split("value", "&([^;&\\s]+);")
    names = F.regexp_extract_all("value", F.lit("&([^;&\\s]+);"), F.lit(1))
    plain = F.array(*map(F.lit, sorted(_PLAIN)))
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    known = lambda n: F.when(F.array_contains(plain, n) | n.startswith("#"), F.concat(F.lit("&"), n, F.lit(";"))).otherwise(safe(F.coalesce(F.try_element_at(table, n), n)))
    filled = F.array_join(F.zip_with(parts, F.concat(F.transform(names, known), F.array(F.lit(""))), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    place = F.col("at") if "at" in xml_rows.columns else F.monotonically_increasing_id()
    rows = xml_rows.select(F.from_xml(filled, _XML).alias("e"), place.alias("at")).select("e.*", "at").where("ent_seq IS NOT NULL")
    half = lambda x, i: F.split(x, _MARK)[i]
    phrase = lambda x: F.coalesce(F.get(F.split(x, _MARK), F.lit(1)), x)
    code = (lambda x: half(x, 0)) if info_codes else phrase
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    joined = lambda c, by: F.when(F.size(some(c)) > 0, F.array_join(F.transform(c, code), by))
    pri = (lambda c: F.when(F.size(some(c)) > 0, F.array_join(c, ","))) if all_priorities else (lambda c: F.get(c, F.lit(0)))
    listed = lambda c, f: F.when(F.size(some(c)) > 0, F.transform(c, f))
    has = lambda f, name: f[name].isNotNull() & (f[name] != "")
    kanji = F.transform(F.filter(F.coalesce("k_ele", F.from_json(F.lit("[]"), "array<struct<keb: string, ke_inf: array<string>, ke_pri: array<string>>>")), lambda k: has(k, "keb")), lambda k, i: F.struct(k["keb"].alias("text"), pri(k["ke_pri"]).alias("priority"), joined(k["ke_inf"], ",").alias("info"), i.alias("ord")))
    written = F.transform("kanji_readings", lambda k: k["text"])
    kana = F.transform(F.filter(F.coalesce("r_ele", F.from_json(F.lit("[]"), "array<struct<reb: string, re_nokanji: string, re_restr: array<string>, re_inf: array<string>, re_pri: array<string>>>")), lambda r: has(r, "reb")),
        lambda r, i: F.struct(r["reb"].alias("text"), r["re_nokanji"].isNotNull().alias("no_kanji"), pri(r["re_pri"]).alias("priority"), joined(r["re_inf"], ",").alias("info"), F.array_intersect(some(r["re_restr"]), written).alias("restrictions"), i.alias("ord")))
    gloss = lambda s: F.transform(F.filter(s["gloss"], lambda g: has(g, "_VALUE")), lambda g: F.struct(g["_VALUE"].alias("text"), F.coalesce(F.nullif(g["_xml:lang"], F.lit("")), F.lit("eng")).alias("lang"), F.coalesce(g["_g_type"], F.lit("")).alias("g_type")))
    no_gloss = F.from_json(F.lit("[]"), "array<struct<text: string, lang: string, g_type: string>>")
    senses = F.filter(F.transform(F.coalesce("sense", F.array()), lambda s, i: F.struct(i.alias("index"), F.transform(some(s["pos"]), phrase).alias("pos_tags"), F.coalesce(gloss(s), no_gloss).alias("glosses"), joined(s["s_inf"], "; ").alias("info"), listed(s["field"], code).alias("field"), listed(s["misc"], code).alias("misc"), listed(s["dial"], code).alias("dial"), some(s["stagk"]).alias("stagk"), some(s["stagr"]).alias("stagr"))), lambda s: F.size(s["glosses"]) > 0)
    rows = rows.withColumn("kanji_readings", kanji).withColumn("kana_readings", kana).withColumn("senses", senses)
    rows = rows.where((F.size("kanji_readings") + F.size("kana_readings") > 0) & (F.size("senses") > 0))
    one = rows.groupBy("ent_seq").agg(F.min_by(F.struct("kanji_readings", "kana_readings", "senses"), "at").alias("e"))
    return one.select(F.coalesce(F.expr("try_cast(ent_seq AS BIGINT)"), F.xxhash64("ent_seq")).alias("entry_id"), "ent_seq", "e.*")


def read_xml(spark: SparkSession, path: str, **options) -> Dictionary:
    """A dictionary from an XML file, which may be gzipped; it is split at the ends of entries."""
    chunks = spark.read.option("lineSep", "</entry>").text(path)
    # The document type is before the first entry, in the first rows of the file.
    head = chunks.where(F.col("value").contains("<!ENTITY")).select(F.regexp_extract_all("value", F.lit(r"(<!ENTITY\s+\S+\s+(?:\"[^\"]*\"|'[^']*')\s*>)"), F.lit(1)).alias("x")).first()
    codes = entities("\n".join(head["x"])) if head else {}
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = chunks.where(F.col("value").contains("<entry>")).select(place.alias("at"), F.concat(F.lit("<entry>"), F.substring_index("value", "<entry>", -1), F.lit("</entry>")).alias("value"))
    return Dictionary.of(parse_entries(rows, codes, **options))


_samples: dict[str, Dictionary] = {}


def sample_dictionary(spark: SparkSession) -> Dictionary:
    """The dictionary of this repository, through the same parser; parsed once for an application.

    Its tables are kept as local rows, some 50 entries: a cache ends when anybody clears it, and
    every use would then have the parser's plan and parse again.
    """
    from . import sample

    application = spark.sparkContext.applicationId
    if application in _samples:
        return _samples[application]
    rows = [("<entry>" + x.split("<entry>")[1] + "</entry>",) for x in sample.xml().split("</entry>") if "<entry>" in x]
    parsed = Dictionary.of(parse_entries(spark.createDataFrame(rows, "value string"), sample.ENTITIES))
    kept = (spark.createDataFrame(t.toArrow(), t.schema) for t in (parsed.entries, parsed.forms))
    _samples.clear()
    _samples[application] = Dictionary(*kept)
    return _samples[application]


# Phrases of info and usage that rankings compare, and their codes.
PHRASES = {
    "rarely-used kanji form": "rK", "rarely used kanji form": "rK", "search-only kanji form": "sK", "word containing irregular kanji usage": "iK",
    "out-dated or obsolete kana usage": "ok", "rarely used kana form": "rk", "rarely-used kana form": "rk", "search-only kana form": "sk", "word containing irregular kana usage": "ik", "word usually written using kana alone": "uk",
}


def _coded(phrases: Column) -> Column:
    """Text with the phrases that rankings compare as their codes."""
    for phrase, code in PHRASES.items():
        phrases = F.replace(phrases, F.lit(phrase), F.lit(code))
    return phrases


def read_sqlite(spark: SparkSession, path: str, info_codes: bool = True) -> Dictionary:
    """A dictionary from an SQLite file with tables entries, kanji, readings, senses and their children.

    The file is read on the driver, as a local database has to be; it holds one dictionary.
    Such files hold phrases; with ``info_codes`` those that rankings compare become codes, so
    that entries rank as those of the XML do.
    """
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        frame = lambda sql, schema: spark.createDataFrame(db.execute(sql).fetchall(), schema)
        heads = frame("SELECT entry_id, ent_seq FROM entries", "entry_id bigint, ent_seq string")
        kanji = frame("SELECT entry_id, kanji_id, kanji_text, priority, info FROM kanji", "entry_id bigint, id bigint, text string, priority string, info string")
        kana = frame("SELECT entry_id, reading_id, reading_text, no_kanji, priority, info FROM readings", "entry_id bigint, id bigint, text string, no_kanji int, priority string, info string")
        limits = frame("SELECT reading_id, kanji_text FROM reading_restrictions", "id bigint, x string")
        senses = frame("SELECT entry_id, sense_id, sense_index, info FROM senses", "entry_id bigint, id bigint, `index` int, info string")
        lists = {n: frame(f"SELECT sense_id, {c} FROM sense_{n}", "id bigint, x string") for n, c in (("pos", "pos"), ("field", "field"), ("misc", "misc"), ("dial", "dial"), ("stagk", "kanji_text"), ("stagr", "reading_text"))}
        glosses = frame("SELECT sense_id, gloss_id, gloss_text, lang, g_type FROM glosses", "id bigint, gid bigint, text string, lang string, g_type string")
    finally:
        db.close()
    if info_codes:
        kanji, kana = (f.withColumn("info", _coded(F.col("info"))) for f in (kanji, kana))
        lists["misc"] = lists["misc"].withColumn("x", _coded(F.col("x")))
    return Dictionary.of(nest(heads, kanji, kana, limits, senses, lists, glosses))


def nest(heads: DataFrame, kanji: DataFrame, kana: DataFrame, limits: DataFrame, senses: DataFrame, lists: dict[str, DataFrame], glosses: DataFrame) -> DataFrame:
    """Entries from relational tables; children in ascending id."""
    none = F.array().cast("array<string>")
    ordered = lambda *cols: F.array_sort(F.collect_list(F.struct("id", *cols)))
    k = kanji.groupBy("entry_id").agg(ordered("text", "priority", "info").alias("k"))
    k = k.select("entry_id", F.transform("k", lambda x, i: F.struct(x["text"].alias("text"), x["priority"].alias("priority"), x["info"].alias("info"), i.alias("ord"))).alias("kanji_readings"))
    kana = kana.join(limits.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("restrictions")), "id", "left")
    r = kana.groupBy("entry_id").agg(ordered("text", "no_kanji", "priority", "info", "restrictions").alias("r"))
    r = r.select("entry_id", F.transform("r", lambda x, i: F.struct(x["text"].alias("text"), (x["no_kanji"] == 1).alias("no_kanji"), x["priority"].alias("priority"), x["info"].alias("info"), F.coalesce(x["restrictions"], none).alias("restrictions"), i.alias("ord"))).alias("kana_readings"))
    for name, rows in lists.items():
        senses = senses.join(rows.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias(name)), "id", "left")
    g = glosses.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("gid", "text", F.coalesce(F.nullif("lang", F.lit("")), F.lit("eng")).alias("lang"), F.coalesce("g_type", F.lit("")).alias("g_type")))).alias("g"))
    senses = senses.join(g, "id").withColumn("glosses", F.transform("g", lambda x: F.struct(x["text"].alias("text"), x["lang"].alias("lang"), x["g_type"].alias("g_type"))))
    one = F.struct("index", F.coalesce("pos", none).alias("pos_tags"), "glosses", "info", "field", "misc", "dial", F.coalesce("stagk", none).alias("stagk"), F.coalesce("stagr", none).alias("stagr"))
    s = senses.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "id", one.alias("s")))), lambda x: x["s"]).alias("senses"))
    out = heads.join(k, "entry_id", "left").join(r, "entry_id", "left").join(s, "entry_id", "left")
    empty = {c: F.from_json(F.lit("[]"), t) for c, t in (("kanji_readings", k.schema["kanji_readings"].dataType), ("kana_readings", r.schema["kana_readings"].dataType), ("senses", s.schema["senses"].dataType))}
    return out.select("entry_id", "ent_seq", *(F.coalesce(c, e).alias(c) for c, e in empty.items()))


__all__ = ["ENTRY_SCHEMA", "Dictionary", "entities", "nest", "parse_entries", "read_sqlite", "read_xml", "sample_dictionary", "split_list", "type_mask"]
