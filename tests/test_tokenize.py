import re

import pytest
from pyspark.sql import functions as F

from sorakana.functions.text import FULL_DIGITS, HALF_DIGITS, NEW_KANJI, OLD_KANJI, VOWELS
from sorakana.operators.search import VIEW, distinct_texts, fold, positions, view_hits, views, word_search
from sorakana.operators.tokenize import _walk_column, tokenize, windows, with_glosses
from sorakana.plans.words import Reason
from sorakana.queries import INFLECTED, SENTENCES
from sorakana.sources.dictionary import read_xml, sample_dictionary
from sorakana.streaming.tokenizer import MemoryDictionary, tokenize_stream

TEXTS = [*SENTENCES, "", None, "一", "a" * 50, "がくせい", "勉‌強‌する‌", "‌食べた", "𠮟る😀", "食べる" * 10, "ハ゛ッグ", "おーさか", "コーヒーーー", "もう。もう、", "舊體", "したためる"]


@pytest.fixture(scope="module")
def d(spark, tmp_path_factory):
    return sample_dictionary(spark).write(str(tmp_path_factory.mktemp("dict")))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "text_id int, text string")


def listed(frame):
    return [(r["text_id"], r["index"], r["text"], r["start"], r["end"], r["ent_seq"], r["reason_chains"]) for r in frame.orderBy("text_id", "index").collect()]


def test_tokens_join_to_the_text(d, texts):
    by = {}
    for r in listed(tokenize(texts, d)):
        by.setdefault(r[0], []).append(r)
    for i, text in enumerate(TEXTS):
        got = by.get(i, [])
        assert "".join(r[2] for r in got) == (text or "")
        assert [r[3] for r in got] == [0, *(r[4] for r in got)][: len(got)] and all(r[4] > r[3] for r in got)


def test_batch_equals_memory(d, texts):
    assert listed(tokenize(texts, d)) == listed(tokenize_stream(texts, d))


def test_known_sentences(d, texts):
    got = {}
    for r in listed(tokenize(texts, d)):
        got.setdefault(r[0], []).append(r)
    text = lambda i: [r[2] for r in got[i]]
    assert text(0) == ["私", "は", "学生", "です"] and all(r[5] for r in got[0])
    assert got[1][0][2] == "食べました" and got[1][0][6] == [[int(Reason.PolitePast)]]
    assert text(2) == ["今日", "は", "良い", "天気", "です", "。"]
    assert text(5) == ["コーヒー", "を", "食べたくなかった"]
    assert text(7) == ["あ", "😀", "い", "𠮟る"]
    assert text(TEXTS.index("がくせい")) == ["がくせい"]


def test_stream_of_files(spark, d, texts, tmp_path):
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text_id int, text string").parquet(str(tmp_path / "in"))
    query = tokenize_stream(stream, d).writeStream.format("memory").queryName("tokens").outputMode("append").start()
    try:
        query.processAllAvailable()
        assert listed(spark.table("tokens")) == listed(tokenize(texts, d))
    finally:
        query.stop()


def test_longer_prefixes_change_nothing(d, texts):
    assert listed(tokenize(texts, d)) == listed(tokenize(texts, d, longest=200))


LONG = ("書かせられすぎちゃっていらっしゃらざるを得なくありません", "書かせられたくなくなりすぎなさそうでいらっしゃいませんでした")


def test_long_chains_are_one_word(spark, tmp_path):
    """Conjugations of any length are found, in the batch plan and in memory."""
    xml = "<JMdict>\n<entry><ent_seq>1</ent_seq><k_ele><keb>書く</keb></k_ele><r_ele><reb>かく</reb></r_ele><sense><pos>v5k</pos><gloss>to write</gloss></sense></entry>\n</JMdict>\n"
    (tmp_path / "d.xml").write_text(xml, encoding="utf-8")
    one = read_xml(spark, str(tmp_path / "d.xml"))
    frame = spark.createDataFrame([(0, LONG[0]), (1, "本を" + LONG[0] + "ね"), (2, LONG[0].replace("書か", "カか"))], "text_id int, text string")
    got = listed(tokenize(frame, one))
    assert got == listed(tokenize_stream(frame, one)) == listed(tokenize(frame, one, longest=100))
    assert [r[2] for r in got if r[0] == 0] == [LONG[0]] and LONG[0] in [r[2] for r in got if r[0] == 1]


def test_all_inflected_spellings_of_the_sentences_are_listed(d):
    """The SQL of searches and tokens takes what is inflected from a list; it has all there is and nothing else."""
    memory = MemoryDictionary.collect(d)
    found = set()
    for text in (s.translate(str.maketrans(HALF_DIGITS, FULL_DIGITS)) for s in SENTENCES):
        for part in {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}:
            for spelling in {part, part.translate(str.maketrans(OLD_KANJI, NEW_KANJI)), *(part.replace("ー", v, 1) for v in VOWELS)}:
                for cand, (word, kind, chains) in enumerate(memory.undo.candidates(spelling)):
                    if cand and any(kind & memory.entries[e][1] for e in memory.lookup(word, 20)):
                        found.add((spelling, cand, word, kind, " or ".join("<".join(Reason(r).name for r in c) for c in chains)))
    assert found == set(INFLECTED)


def test_word_search(spark, d):
    frame = spark.createDataFrame([(1, "食べる"), (2, "は"), (3, "xyz"), (4, "２４"), (5, "大坂に")], "text_id int, text string")
    got = {r["text_id"]: r["result"] for r in word_search(frame, d).collect()}
    assert set(got) == {1, 2, 5}
    seqs = {r["entry_id"]: r["ent_seq"] for r in d.entries.collect()}
    # The particle is a headword in kana; the others are read so, and rank by priority.
    assert [seqs[x["entry_id"]] for x in got[2]["data"]] == ["1000040", "1000060", "1000050"] and not got[2]["more"]
    assert word_search(frame, d, 1).where("text_id = 2").first()["result"]["more"]
    assert got[5]["match_len"] == 2


def test_cut_entries_are_not_seen():
    """What was cut at a long prefix may come back at a shorter one."""
    hit = lambda e, p: (e, [], 0, 1, p, 1, p)
    results, longest = fold([(2, "ab", "ab", 2, [hit(1, 5), hit(2, 9)]), (1, "a", "a", 1, [hit(1, 5), hit(2, 9)])], 1)
    assert [(r[0], r[1]) for r in results] == [(2, 2)] and longest == 2
    results, _ = fold([(2, "ab", "ab", 2, [hit(1, 5), hit(2, 9)]), (1, "a", "a", 1, [hit(1, 5), hit(2, 9)])], 1 + 1)
    assert [(r[0], r[1]) for r in results] == [(2, 2), (1, 2)]


def test_fold_keeps_to_its_variant():
    hit = lambda e: (e, [], 0, 1, 0.0, 1, 0.0)
    rows = [(2, "aー", "aー", 2, []), (2, "aー", "aあ", 2, [hit(1)]), (2, "aー", "aい", 2, [hit(2)]), (1, "b", "b", 1, [hit(3)]), (1, "a", "a", 1, [hit(4)])]
    results, _ = fold(rows, 5)
    assert [r[0] for r in results] == [1, 4]


def test_windows(spark, d):
    frame = spark.createDataFrame([(1, "あ" * 12), (2, "い"), (3, "")], "text_id int, text string")
    got = sorted((r["text_id"], r["window"], len(r["text"])) for r in windows(frame).collect())
    assert got == [(1, 1, 10), (1, 2, 10), (1, 3, 10), (2, 1, 1), (3, 1, 0)]


def test_glosses_and_size_check(spark, d, texts):
    rows = with_glosses(tokenize(texts.where("text_id = 0"), d), d).orderBy("index").collect()
    assert [r["gloss"] for r in rows] == ["I", "topic marker", "student", "to be"]
    with pytest.raises(ValueError):
        MemoryDictionary.collect(d, 3)


def test_lookups_are_hash_joins(spark, d):
    plan = tokenize(spark.createDataFrame([(1, "食べる")], "text_id int, text string"), d)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_plans_are_small(spark, d):
    """What several parts of a search read is made once, and each function in Python is run once for it."""
    frame = spark.createDataFrame([(1, "食べる")], "text_id int, text string")
    python = lambda x: x._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert python(tokenize(frame, d)) == 4  # both sides normalize, one has runs of endings, one walks
    plan = view_hits(views(positions(frame), d).select(*VIEW).distinct(), d, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_walks_are_dealt_to_all_partitions(spark, d):
    """They take long for their size, by which a shuffle of the join's own was merged into few tasks."""
    plan = tokenize(spark.createDataFrame([(1, "食べる")], "text_id int, text string"), d)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(text_id#\d+, 4\), REPARTITION_BY_NUM", plan)) == 1


def test_texts_are_dealt_to_all_partitions(spark):
    """Their positions are many; a shuffle that is as small as they are was merged into one task."""
    frame = spark.range(400).select(F.col("id").alias("text_id"), F.col("id").cast("string").alias("text"))
    assert distinct_texts(frame).select(F.spark_partition_id()).distinct().count() == 4


def test_positions_that_look_the_same_are_searched_once(spark, d):
    """Views are all that a search depends on: spelling, the end of the text, and places in the text as it was given."""
    texts = [f"{i}。食べました。" for i in range(50)] + ["食べました", "ハ゛が食べました。".replace("ハ゛", "ハ\u3099"), "食べ\u200cました。"]
    frame = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    seen = views(positions(frame), d).where("view LIKE '食%'").groupBy(*VIEW).count().collect()
    assert sorted((r["view"], r["places"], r["count"]) for r in seen) == [("食べました", [], 1), ("食べました。", [], 51), ("食べました。", [0, 1, 3, 4, 5, 6], 1)]
    assert listed(tokenize(frame, d)) == listed(tokenize_stream(frame, d))
    found = {(r["text_id"], r["pos"]): (r["result"]["match_len"], [x["entry_id"] for x in r["result"]["data"]]) for r in word_search(frame, d, every_position=True).collect()}
    assert found[3, 2] == found[49, 3] == found[50, 0] == found[51, 2] and found[52, 0] == (6, found[50, 0][1])


def test_walk_gets_only_numbers_of_matches(spark):
    """Entries and chains of reasons stay where they are; tokens tell the place of their match."""
    frame = spark.createDataFrame([("食べました。", list(range(7)), [3, 0], [1, 5]), ("あ", [0, 1], None, None)], "text string, starts array<int>, pos array<int>, n array<int>")
    got = [r["t"] for r in frame.select(_walk_column(F.col("text"), F.col("starts"), F.col("pos"), F.col("n")).alias("t")).collect()]
    assert [[(t["text"], t["start"], t["end"], t["hit"]) for t in x] for x in got] == [[("食べました", 0, 5, 1), ("。", 5, 6, None)], [("あ", 0, 1, None)]]


def test_command_line(spark, tmp_path):
    from sorakana import cli
    from sorakana.sources import sample

    (tmp_path / "d.xml").write_text(sample.xml(), encoding="utf-8")
    (tmp_path / "lines.txt").write_text("食べました\n私は学生です\n", encoding="utf-8")
    assert cli.main(["build", "--db-path", f"{tmp_path}/db", "--quiet"]) == 1
    assert cli.main(["build", "--xml-path", f"{tmp_path}/d.xml", "--db-path", f"{tmp_path}/db", "--quiet"]) == 0
    assert cli.main(["tokenize", "--db-path", f"{tmp_path}/db", "--input", f"{tmp_path}/lines.txt", "--output", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
