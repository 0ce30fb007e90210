"""Rules that undo conjugations, generated from paradigms.

A rule says: a word of one of the types ``left`` that ends in ``ending`` comes from the word
with ``becomes`` in its place, which is of the types ``right``, by ``reasons``. Rules with
one ending apply in the order in which they are made here, longer endings first.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import HIRAGANA, KATAKANA, LONG_VOWEL, NEW_KANJI, OLD_KANJI
from .words import Reason, WordType

# Short names of types, for the tables below.
TYPES = {"V1": WordType.ICHIDAN, "V5": WordType.GODAN, "Adj": WordType.I_ADJ, "VK": WordType.KURU, "VS": WordType.SURU, "VSS": WordType.SPECIAL_SURU, "NVS": WordType.NOUN_SURU, "Init": WordType.INITIAL, "Ta": WordType.TA_TE, "Da": WordType.DA_DE, "Masu": WordType.MASU, "Irr": WordType.IRREALIS}
# The five rows that godan verbs move through, by their last kana.
GODAN = {"う": "わいうえお", "く": "かきくけこ", "ぐ": "がぎぐげご", "す": "さしすせそ", "つ": "たちつてと", "ぬ": "なにぬねの", "ぶ": "ばびぶべぼ", "む": "まみむめも", "る": "らりるれろ"}
# Sounds before ta and te, and before da and de.
TA_SOUND = {"く": "い", "す": "し", "う": "っ", "つ": "っ", "る": "っ"}
DA_SOUND = {"ぐ": "い", "ぬ": "ん", "ぶ": "ん", "む": "ん"}
# Honorific verbs whose stem ends in i, and whether the stem is an imperative too.
HONORIFIC = {"いらっしゃる": True, "てらっしゃる": False, "でらっしゃる": False, "おっしゃる": True, "くださる": True, "下さる": True, "ござる": False, "ご座る": False, "御座る": False, "なさる": True, "仰る": True}
# Verbs in u that keep it before ta and te.
KEEPS_U = "たゆたう たゆとう のたまう のたもう たまう たもう 揺蕩う おう こう そう とう 請う 乞う 恋う 問う 負う 沿う 添う 副う 厭う 給う 賜う 宣う 曰う".split()
# Forms of to go that double a consonant before ta.
GOING = {"いっ": "いく", "行っ": "行く", "逝っ": "逝く", "往っ": "往く"}

# Endings with what they attach to. Each line: endings, what takes their place
# ("-": nothing), types of the inflected word, types of the result, reasons.
BEFORE_STEMS = """
ていらっしゃい てらっしゃい | - | Init | Ta | Respectful+Continuous+Imperative
でいらっしゃい でらっしゃい | - | Init | Da | Respectful+Continuous+Imperative
ていらっしゃる てらっしゃる | - | V5 | Ta | Respectful+Continuous
でいらっしゃる でらっしゃる | - | V5 | Da | Respectful+Continuous
なさい | - | Init | Masu | Respectful+Imperative
なさる になる | - | V5 | Masu | Respectful
なさる になる | - | V5 | NVS | SuruNoun+Respectful
いたす 致す | - | V5 | Masu | Humble
いたす 致す | - | V5 | NVS | SuruNoun+Humble
さ | い | Init | Adj | Noun
き | い | Init | Adj | Ki
く | い | Init | Adj | Adv
て | - | Init | Ta | Te
で | - | Init | Da | Te
くて | い | Init | Adj | Te
そう | - | Init | Masu | Sou
そう | い | Init | Adj | Sou
すぎ 過ぎ | い | Init | Adj | Sugiru
すぎ 過ぎ | - | Init | Masu | Sugiru
すぎる 過ぎる | い | V1 | Adj | Sugiru
すぎる 過ぎる | - | V1 | Masu | Sugiru
"""
AFTER_STEMS = """
た | - | Init | Ta | Past
だ | - | Init | Da | Past
かった | い | Init | Adj | Past
たら | - | Init | Ta | Tara
だら | - | Init | Da | Tara
かったら | い | Init | Adj | Tara
たり | - | Init | Ta | Tari
だり | - | Init | Da | Tari
かったり | い | Init | Adj | Tari
な | - | Init | V1,V5,VK,VS | ImperativeNegative
ない | - | Adj | Irr | Negative
ぬ ん | - | Init | Irr | Negative
くない | い | Adj | Adj | Negative
しない | する | Adj | VS | Negative
せぬ せん | する | Init | VS | Negative
さない | する | Adj | VSS | Irregular+Negative
ぜぬ | ずる | Init | VSS | Irregular+Negative
ないで | - | Init | Irr | NegativeTe
しないで | する | Init | VS | NegativeTe
さないで | する | Init | VSS | Irregular+NegativeTe
ず | - | Init | Irr | Zu
せず | する | Init | VS | Zu
さず | する | Init | VSS | Irregular+Zu
ぜず | ずる | Init | VSS | Irregular+Zu
ざるをえない ざるを得ない ざるえない ざる得ない ざるをえぬ ざるを得ぬ ざるえぬ ざる得ぬ | - | Adj | Irr | ZaruWoEnai
ます | - | Init | Masu | Polite
ませ | - | Init | Masu | Polite+Imperative
ましたら | - | Init | Masu | Polite+Tara
ましたり | - | Init | Masu | Polite+Tari
まして | - | Init | Masu | Polite+Te
ません | - | Init | Masu | PoliteNegative
くありません | い | Init | Adj | PoliteNegative
ました | - | Init | Masu | PolitePast
ませんでした | - | Init | Masu | PolitePastNegative
ましょう | - | Init | Masu | PoliteVolitional
たい | - | Adj | Masu | Tai
しうる | する | Init | VS | EruUru
しえる | する | V1 | VS | EruUru
得る | - | V1 | Masu | EruUru
する | - | VS | NVS | SuruNoun
"""
AFTER_POTENTIAL = """
れる | る | V1 | V1,V5 | Potential
できる | する | V1 | VS | Potential
これる | くる | V1 | VK | Potential
来れる | 来る | V1 | VK | Potential
來れる | 來る | V1 | VK | Potential
られる | る | V1 | V1,VK | PotentialOrPassive
こられる | くる | V1 | VK | PotentialOrPassive
せられる しられる | する | V1 | VSS | Irregular+PotentialOrPassive
ぜられる | ずる | V1 | VSS | Irregular+PotentialOrPassive
せる | - | V1 | Irr | Causative
させる | る | V1 | V1,VK | Causative
させる | する | V1 | VS | Causative
こさせる | くる | V1 | VK | Causative
しさせる せさせる | する | V1 | VSS | Irregular+Causative
ぜさせる | ずる | V1 | VSS | Irregular+Causative
される | - | V1 | Irr | CausativePassive
れる | - | V1 | Irr | Passive
される | する | V1 | VS | Passive
ている てる | - | V1 | Ta | Continuous
でいる でる | - | V1 | Da | Continuous
ておる とる | - | V5 | Ta | HumbleOrKansaiDialect+Continuous
でおる どる | - | V5 | Da | HumbleOrKansaiDialect+Continuous
とく | - | V5 | Ta | Toku
どく | - | V5 | Da | Toku
ちゃう | - | V5 | Ta | Chau
じゃう | - | V5 | Da | Chau
"""
AFTER_IMPERATIVE = """
よ ろ | る | Init | V1 | Imperative
こい | くる | Init | VK | Imperative
い | る | Init | VK | Imperative
しろ せよ | する | Init | VS | Imperative
せ | する | Init | VSS | Irregular+Imperative
ぜよ | ずる | Init | VSS | Irregular+Imperative
"""
AFTER_BA = """
れば | る | Init | V1,V5,VK,VS | Ba
ければ | い | Init | Adj | Ba
せば | する | Init | VSS | Irregular+Ba
ずれば | ずる | Init | VSS | Irregular+Ba
"""
AFTER_VOLITIONAL = """
よう | る | Init | V1,VK | Volitional
こよう | くる | Init | VK | Volitional
しよう | する | Init | VS | Volitional
そう | する | Init | VSS | Irregular+Volitional
"""


class Rule(NamedTuple):
    rule_id: int
    ending: str
    becomes: str
    left: int
    right: int
    reasons: tuple[int, ...]


def _types(names: str) -> int:
    return sum(int(TYPES[n]) for n in names.split(","))


def _listed(table: str):
    for line in table.strip().splitlines():
        endings, becomes, left, right, reasons = (x.strip() for x in line.split("|"))
        for ending in endings.split():
            yield ending, "" if becomes == "-" else becomes, left, right, reasons


def _generated():
    short = [u for u in GODAN if u != "る"]
    yield from _listed(BEFORE_STEMS)
    for u, row in GODAN.items():
        yield row[1], u, "Masu", "V5", "MasuStem"
    for verb in HONORIFIC:
        yield verb[:-1] + "い", verb, "Masu", "V5", "MasuStem"
    yield "し", "する", "Masu", "VS", "MasuStem"
    # Stems that stand for their verb, whatever is attached to them.
    for sounds, stem in ((TA_SOUND, "Ta"), (DA_SOUND, "Da")):
        for u, sound in sounds.items():
            yield sound, u, stem, "V5", ""
    for u, row in GODAN.items():
        yield row[0], u, "Irr", "V5", ""
    yield "き", "くる", "Ta", "VK", ""
    yield "こ", "くる", "Irr", "VK", ""
    yield "し", "する", "Ta", "VS", ""
    yield "き", "くる", "Masu", "VK", "MasuStem"
    yield from _listed(AFTER_STEMS)
    for u in short:
        yield GODAN[u][3] + "る", u, "V1", "V5", "Potential"
    yield from _listed(AFTER_POTENTIAL)
    for u, row in GODAN.items():
        yield row[3], u, "Init", "V5", "Imperative"
    for verb, commands in HONORIFIC.items():
        if commands:
            yield verb[:-1] + "い", verb, "Init", "V5", "Imperative"
    yield from _listed(AFTER_IMPERATIVE)
    for u in short:
        yield GODAN[u][3] + "ば", u, "Init", "V5", "Ba"
    yield from _listed(AFTER_BA)
    for u, row in GODAN.items():
        yield row[4] + "う", u, "Init", "V5", "Volitional"
    yield from _listed(AFTER_VOLITIONAL)
    for sound, verb in GOING.items():
        yield sound, verb, "Ta", "V5", ""
    for verb in KEEPS_U:
        yield verb, verb, "Ta", "V5", ""


def rules() -> list[Rule]:
    """All rules, longest endings first."""
    made = sorted(_generated(), key=lambda r: -len(r[0]))
    return [Rule(i, e, b, _types(x), _types(y), tuple(int(Reason[r]) for r in why.split("+") if r)) for i, (e, b, x, y, why) in enumerate(made)]


def rules_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "rule_id int, ending string, becomes string, left int, right int, reasons array<int>")


def by_ending() -> dict[str, list[Rule]]:
    found: dict[str, list[Rule]] = defaultdict(list)
    for r in rules():
        found[r.ending].append(r)
    return dict(found)


def ending_characters() -> str:
    """All characters that rules can take from the end of a word, in all spellings that count as equal."""
    plain = {c for r in rules() for c in r.ending}
    folded = {k for k, h in (*zip(KATAKANA, HIRAGANA, strict=True), *zip(OLD_KANJI, NEW_KANJI, strict=True)) if h in plain}
    return "".join(sorted(plain | folded | {LONG_VOWEL}))


def most_added() -> int:
    """Characters that conjugation can add to a word, at most.

    A reason isn't undone twice; it can be absorbed in another one, and then comes again.
    Rules without a reason never shorten a word.
    """
    most: dict[int, int] = defaultdict(int)
    for r in rules():
        for x in r.reasons:
            most[x] = max(most[x], len(r.ending) - len(r.becomes))
    return 2 * sum(most.values())
