import pytest
from pyspark.sql import functions as F

from sorakana.plans.rules import GODAN, rules, rules_frame
from sorakana.plans.unconjugate import Unconjugator, candidates, reachable
from sorakana.plans.words import ALL_WORDS, REASONS, Reason
from sorakana.queries import WORDS

UNDO = Unconjugator()


def found(word, plain):
    return [(kind, [[REASONS[r] for r in c] for c in chains]) for w, kind, chains in UNDO.candidates(word) if w == plain]


def says(word, plain, *chain):
    return any(list(chain) in chains for _, chains in found(word, plain))


def test_rules():
    made = rules()
    assert len(made) == len({(r.ending, r.becomes, r.left, r.right, r.reasons) for r in made}) == 241
    assert [len(r.ending) for r in made] == sorted((len(r.ending) for r in made), reverse=True)
    by = [sum(len(r.ending) == n for r in made) for n in range(1, 8)]
    assert by == [56, 90, 50, 23, 6, 12, 4]
    assert sum(not r.reasons for r in made) == 49 and sum(not r.becomes for r in made) == 71
    assert len(REASONS) == 38 and Reason.Irregular == 37


@pytest.mark.parametrize(
    "word,plain,chain",
    [
        ("走ります", "走る", "Polite"), ("踊りたくなかった", "踊る", "Tai Negative Past"), ("食べました", "食べる", "PolitePast"), ("食べない", "食べる", "Negative"), ("食べている", "食べる", "Continuous"),
        ("行った", "行く", "Past"), ("いって", "いく", "Te"), ("来られる", "来る", "PotentialOrPassive"), ("しない", "する", "Negative"), ("しろ", "する", "Imperative"), ("せず", "する", "Zu"), ("できる", "する", "Potential"),
        ("書かせられる", "書く", "CausativePassive"), ("書かされる", "書く", "CausativePassive"), ("見させられる", "見る", "CausativePassive"), ("読んじゃう", "読む", "Chau"), ("買っとく", "買う", "Toku"), ("買えば", "買う", "Ba"),
        ("待とう", "待つ", "Volitional"), ("死ね", "死ぬ", "Imperative"), ("新しければ", "新しい", "Ba"), ("新しさ", "新しい", "Noun"), ("高すぎる", "高い", "Sugiru"), ("食べすぎる", "食べる", "Sugiru"), ("ください", "くださる", "Imperative"),
        ("いらっしゃい", "いらっしゃる", "Imperative"), ("ございます", "ござる", "Polite"), ("問うた", "問う", "Past"), ("話さざるを得ない", "話す", "ZaruWoEnai"), ("勉強する", "勉強", "SuruNoun"), ("お待ちになる", "お待つ", "Respectful"), ("論ずれば", "論ずる", "Irregular Ba"),
        ("走りまス", "走る", "Polite"), ("走ッタ", "走る", "Past"), ("食べなさい", "食べる", "Respectful Imperative"), ("なさい", "なさる", "Imperative"), ("あり得る", "ある", "EruUru"), ("食べておる", "食べる", "HumbleOrKansaiDialect Continuous"),
    ],
)
def test_chains(word, plain, chain):
    assert says(word, plain, *chain.split())


def test_stems_and_types():
    assert found("食べ", "食べる") == [(9, [["MasuStem"]])]
    for u, row in GODAN.items():
        assert any(kind & 2 for kind, _ in found("か" + row[0] + "ぬ", "か" + u))
    assert any(kind & 16 for kind, _ in found("せぬ", "する"))


def test_what_is_not_said():
    assert not found("もどって", "もどく")
    assert not says("食べて", "食べる", "Continuous")
    assert not any(len(set(c)) < len(c) for w in ("見させさせる", "食べられられる") for _, _, chains in UNDO.candidates(w) for c in chains)
    assert UNDO.candidates("")[0][0] == ""


def test_column_and_relation(spark):
    words = ["食べました", "踊りたくなかった", "走ります", "書かせられる", "しなかった", "来られる"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: [(c["word"], c["type"], tuple(map(tuple, c["reason_chains"]))) for c in r["c"]] for r in frame.withColumn("c", candidates(F.col("word"))).collect()}
    assert got == {w: UNDO.candidates(w) for w in words}
    reached = {(r["start"], r["word"]): 0 for r in reachable(spark, frame).collect()}
    assert all((w, x) in reached for w in words for x, _, _ in UNDO.candidates(w))
    assert rules_frame(spark).count() == 241


def test_reachable_has_all_candidates(spark):
    """食べたくなかった and 見させられた have candidates more than four rules away."""
    frame = spark.createDataFrame([(w,) for w in WORDS], "word string")
    reached = {(r["start"], r["word"], r["type"]) for r in reachable(spark, frame).collect()}
    assert {(w, x, kind & ALL_WORDS) for w in WORDS for x, kind, _ in UNDO.candidates(w)} <= reached
