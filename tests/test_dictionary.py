import sqlite3

from pyspark.sql import functions as F

from sorakana.operators import ranking as R
from sorakana.operators.lookup import get_words, lookup
from sorakana.sources import sample
from sorakana.sources.dictionary import Dictionary, parse_entries, read_sqlite, read_xml, sample_dictionary, type_mask

XML = """<?xml version="1.0"?>
<!DOCTYPE JMdict [
<!ENTITY v1 "Ichidan verb">
<!ENTITY uk "word usually written using kana alone">
<!ENTITY rK "rarely-used, kanji form">
]>
<JMdict>
<entry><ent_seq>1</ent_seq><k_ele><keb>甲</keb><ke_inf>&rK;</ke_inf><ke_pri>ichi1</ke_pri><ke_pri>news2</ke_pri></k_ele><k_ele><ke_pri>x</ke_pri></k_ele>
<r_ele><reb>こう</reb><re_nokanji/><re_restr>甲</re_restr><re_restr>乙</re_restr></r_ele>
<sense><pos>&v1;</pos></sense><sense><pos>&v1;</pos><misc>&uk;</misc><s_inf>a</s_inf><s_inf>b</s_inf><gloss xml:lang="fre" g_type="lit">l'un &amp; l'autre</gloss></sense></entry>
<entry><ent_seq>2</ent_seq><r_ele><reb>なし</reb></r_ele><sense><pos>&v1;</pos></sense></entry>
<entry><ent_seq>3</ent_seq><sense><gloss>no form</gloss></sense></entry>
<entry><r_ele><reb>ばん</reb></r_ele><sense><gloss>no number</gloss></sense></entry>
<entry><ent_seq>1</ent_seq><r_ele><reb>ん</reb></r_ele><sense><gloss>again</gloss></sense></entry>
<entry><ent_seq>4</ent_seq><r_ele><reb>かな</reb></r_ele><sense><gloss>kana &unknown; &lt;b&gt;</gloss></sense></entry>
</JMdict>
"""


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML, encoding="utf-8")
    rows = {r["ent_seq"]: r for r in read_xml(spark, str(tmp_path / "d.xml")).entries.collect()}
    assert set(rows) == {"1", "4"}
    one = rows["1"]  # of two entries with one number, the first stays
    assert [tuple(k) for k in one["kanji_readings"]] == [("甲", "ichi1,news2", "rK", 0)]
    assert [(k["text"], k["no_kanji"], k["restrictions"]) for k in one["kana_readings"]] == [("こう", True, ["甲"])]
    (s,) = one["senses"]
    assert (s["index"], s["pos_tags"], s["info"], s["misc"], tuple(s["glosses"][0])) == (1, ["Ichidan verb"], "a; b", ["uk"], ("l'un & l'autre", "fre", "lit"))
    assert rows["4"]["senses"][0]["glosses"][0]["text"] == "kana unknown <b>"


def test_compatible_switches(spark):
    rows = spark.createDataFrame([("<entry>" + XML.split("<entry>")[1].split("</entry>")[0] + "</entry>",)], "value string")
    codes = {"v1": "Ichidan verb", "uk": "word usually written using kana alone", "rK": "rarely-used, kanji form"}
    (one,) = parse_entries(rows, codes, all_priorities=False, info_codes=False).collect()
    assert tuple(one["kanji_readings"][0]) == ("甲", "ichi1", "rarely-used, kanji form", 0)
    assert one["senses"][0]["misc"] == ["word usually written using kana alone"]


def test_the_first_of_a_number_stays(spark, tmp_path):
    """In a file of many splits, and among rows with their places."""
    entry = lambda n, x: f"<entry><ent_seq>{n}</ent_seq><r_ele><reb>{x}</reb></r_ele><sense><gloss>{x}</gloss></sense></entry>"
    body = "\n".join(entry(i, f"z{i}") for i in range(300)) + "\n" + "\n".join(entry(i, f"a{i}") for i in range(300))
    (tmp_path / "d.xml").write_text(f"<JMdict>\n{body}\n</JMdict>\n", encoding="utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["ent_seq"]: r["kana_readings"][0]["text"] for r in read_xml(spark, str(tmp_path / "d.xml")).entries.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {str(i): f"z{i}" for i in range(300)}
    rows = spark.createDataFrame([(2, entry(1, "b")), (1, entry(1, "c")), (3, entry(1, "a"))], "at int, value string")
    assert parse_entries(rows, {}).first()["kana_readings"][0]["text"] == "c"


def test_letters_of_a_usage(spark):
    rows = spark.createDataFrame([([(["uk"], [("x", "eng")])],), ([(["likely uk or so"], [("x", "eng")])],), ([(["arch"], [("x", "eng")])],)], "senses array<struct<misc: array<string>, glosses: array<struct<text: string, lang: string>>>>")
    got = rows.select(R.mostly_kana(F.col("senses")).alias("a"), R.mostly_kana(F.col("senses"), exact=False).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False)]


def test_sample_and_round_trip(spark, tmp_path):
    d = sample_dictionary(spark)
    (tmp_path / "s.xml").write_text(sample.xml(), encoding="utf-8")
    x = read_xml(spark, str(tmp_path / "s.xml"))
    assert x.entries.count() == len(sample.entries()) and not x.entries.exceptAll(d.entries).count()
    again = d.write(str(tmp_path / "out"))
    assert not again.entries.exceptAll(d.entries).count() and not again.forms.exceptAll(d.forms).count()


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "d.db")
    db.executescript("""CREATE TABLE entries(entry_id, ent_seq); CREATE TABLE kanji(kanji_id, entry_id, kanji_text, priority, info); CREATE TABLE readings(reading_id, entry_id, reading_text, no_kanji, priority, info);
    CREATE TABLE reading_restrictions(reading_id, kanji_text); CREATE TABLE senses(sense_id, entry_id, sense_index, info); CREATE TABLE sense_pos(sense_id, pos); CREATE TABLE sense_field(sense_id, field); CREATE TABLE sense_misc(sense_id, misc);
    CREATE TABLE sense_dial(sense_id, dial); CREATE TABLE sense_stagk(sense_id, kanji_text); CREATE TABLE sense_stagr(sense_id, reading_text); CREATE TABLE glosses(gloss_id, sense_id, gloss_text, lang, g_type);
    INSERT INTO entries VALUES (1, '10'); INSERT INTO kanji VALUES (1, 1, '見る', 'ichi1', 'rarely used kanji form,word containing irregular kanji usage'); INSERT INTO sense_misc VALUES (1, 'word usually written using kana alone'), (1, 'archaic'); INSERT INTO readings VALUES (1, 1, 'みる', 0, 'ichi1', NULL); INSERT INTO senses VALUES (1, 1, 0, NULL); INSERT INTO sense_pos VALUES (1, 'Ichidan verb');
    INSERT INTO glosses VALUES (2, 1, 'to look', 'eng', NULL), (1, 1, 'to see', NULL, NULL);""")
    db.commit()
    db.close()
    d = read_sqlite(spark, str(tmp_path / "d.db"))
    (r,) = d.entries.collect()
    assert r["type_mask"] == 1 and [g["text"] for g in r["senses"][0]["glosses"]] == ["to see", "to look"] and d.forms.count() == 2
    assert r["kanji_readings"][0]["info"] == "rK,iK" and r["senses"][0]["misc"] == ["archaic", "uk"]
    assert read_sqlite(spark, str(tmp_path / "d.db"), info_codes=False).entries.first()["kanji_readings"][0]["info"].startswith("rarely used")


def test_type_mask(spark):
    rows = [(["v1"], 1), (["Ichidan verb"], 1), (["v5k"], 2), (["v4r"], 2), (["Godan verb with 'ku' ending"], 2), (["adj-i"], 4), (["Adjective"], 4), (["vk"], 8), (["vs-i"], 16), (["vs-s"], 48), (["vz"], 32), (["vs"], 64), (["noun or participle which takes the aux. verb suru"], 64), (["n"], 0), ([], 0), (["v1", "vk"], 9)]
    got = spark.createDataFrame(rows, "t array<string>, want int").select(type_mask(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_priorities(spark):
    marks = {"i1": 50, "i2": 20, "n1": 40, "s1": 32, "g1": 30, "nf01": 47, "nf03": 46, "nf48": 0, "nf": 0, "unknown": 0, "ichi1": 50, "gai2": 15}
    got = spark.createDataFrame([(m,) for m in marks], "m string").select("m", R.priority_score(F.col("m")).alias("s")).collect()
    assert {r["m"]: r["s"] for r in got} == marks
    sums = spark.createDataFrame([(["i1"],), (["n1", "i1"],), (["i1", "n1", "i2"],), ([],)], "m array<string>").select(R.priority_sum(F.col("m")).alias("s")).collect()
    assert [round(r["s"], 6) for r in sums] == [50.0, 54.0, 54.2, 0.0]


def test_lookup(spark):
    d = sample_dictionary(spark)
    words = spark.createDataFrame([("は",), ("ハ",), ("食べる",), ("タベル",), ("タワー",), ("たわー",), ("",), ("おおさか",)], "word string")
    by_id = {r["entry_id"]: r["ent_seq"] for r in d.entries.select("entry_id", "ent_seq").collect()}
    got = {}
    for r in lookup(words, d, 20).orderBy("word", "hit_ord").collect():
        got.setdefault(r["word"], []).append(by_id[r["entry_id"]])
    assert got["は"] == got["ハ"] == ["1000040", "1000050", "1000060"]
    assert got["食べる"] == got["タベル"] == ["1000010"] and got["タワー"] == ["1000280"] and "たわー" not in got and "" not in got
    assert lookup(words, d, 1).groupBy("word").count().where("count > 1").isEmpty()
    flags = {(r["word"], r["ent_seq"]): r for r in get_words(words, d, 20).collect()}
    r = flags["ハ", "1000050"]
    assert [f["match"] for f in r["kanji_readings"]] == [True] and r["kana_readings"][0]["match_range"]["end"] == 1
    r = flags["食べる", "1000010"]
    assert r["kanji_readings"][0]["matched"] and not r["kana_readings"][0]["matched"] and r["kana_readings"][0]["match"]


def test_any_frame_is_a_dictionary(spark):
    entries = sample_dictionary(spark).entries.where("ent_seq = '1000010'").drop("type_mask")
    assert Dictionary.of(entries).statistics().first()["entries"] == 1


def test_the_sample_stays_parsed(spark):
    """Whoever clears the cache doesn't bring the parser's plan back into every use of the dictionary."""
    d = sample_dictionary(spark)
    spark.catalog.clearCache()
    for table in (d.entries, d.forms):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "LocalTableScan" in plan and "Exchange" not in plan and "from_xml" not in plan.lower()
    assert d.entries.count() == len(sample.entries())
