"""A small dictionary, written for this repository, in the XML form of JMdict."""

from __future__ import annotations

from xml.sax.saxutils import escape

# Codes of the document type, with the phrases that they stand for.
ENTITIES = {
    "v1": "Ichidan verb", "v5k": "Godan verb with 'ku' ending", "v5k-s": "Godan verb - Iku/Yuku special class", "v5r": "Godan verb with 'ru' ending", "v5s": "Godan verb with 'su' ending", "v5t": "Godan verb with 'tsu' ending", "v5u": "Godan verb with 'u' ending",
    "v5g": "Godan verb with 'gu' ending", "v5n": "Godan verb with 'nu' ending", "v5b": "Godan verb with 'bu' ending", "v5m": "Godan verb with 'mu' ending", "vk": "Kuru verb - special class", "vs-i": "suru verb - included", "vs": "noun or participle which takes the aux. verb suru",
    "adj-i": "adjective (keiyoushi)", "adj-na": "adjectival nouns or quasi-adjectives (keiyodoshi)", "n": "noun (common) (futsuumeishi)", "pn": "pronoun", "prt": "particle", "cop": "copula", "adv": "adverb (fukushi)", "int": "interjection (kandoushi)", "exp": "expressions (phrases, clauses, etc.)",
    "uk": "word usually written using kana alone", "rK": "rarely-used kanji form", "ok": "out-dated or obsolete kana usage", "yoji": "yojijukugo", "food": "food term", "ksb": "Kansai-ben",
}
# Each line: kanji forms / readings / parts of speech / glosses. A form may carry =priority
# and !info, a reading * for no kanji; glosses of further senses follow ;; and may start with
# codes of usage in parentheses.
WORDS = """
食べる=ichi1,news2 / たべる=ichi1,news2 / v1 / to eat
私=ichi1 / わたし=ichi1 わたくし / pn / I ;; privacy
学生=ichi1,nf03 / がくせい=ichi1,nf03 / n / student
は / は=spec1 / prt / topic marker
葉=ichi1 / は=ichi1 / n / leaf
歯=ichi1,news1 / は=ichi1,news1 / n / tooth
です / です=spec1 / cop / to be
日本語=ichi1,nf10 / にほんご=ichi1 にっぽんご / n / Japanese language
を / を=spec1 / prt / object marker
勉強=ichi1 / べんきょう=ichi1 / n,vs / study
する=!rK 為る!rK / する=ichi1 / vs-i / (uk) to do ;; (uk) to cause
来る=ichi1 / くる=ichi1 / vk / to come
行く=ichi1 / いく=ichi1 ゆく / v5k-s / to go
走る=ichi1 / はしる=ichi1 / v5r / to run
見る=ichi1 / みる=ichi1 / v1 / to see
読む=ichi1 / よむ=ichi1 / v5m / to read
書く=ichi1 / かく=ichi1 / v5k / to write
泳ぐ=ichi1 / およぐ=ichi1 / v5g / to swim
話す=ichi1 / はなす=ichi1 / v5s / to speak
待つ=ichi1 / まつ=ichi1 / v5t / to wait
買う=ichi1 / かう=ichi1 / v5u / to buy
死ぬ=ichi1 / しぬ=ichi1 / v5n / to die
遊ぶ=ichi1 / あそぶ=ichi1 / v5b / to play
今日=ichi1 / きょう=ichi1 こんにち / n,adv / today
良い=ichi1 / よい=ichi1 いい=spec1 / adj-i / good
天気=ichi1 / てんき=ichi1 / n / weather
東京=spec1 / とうきょう=spec1 / n / Tokyo
- / タワー=gai1 / n / tower
- / コーヒー=gai1 / n / (food) coffee
- / ベッド=gai1 / n / bed
毎日=ichi1 / まいにち=ichi1 / n,adv / every day
新しい=ichi1 / あたらしい=ichi1 / adj-i / new
単語=ichi1 / たんご=ichi1 / n / word
覚える=ichi1 / おぼえる=ichi1 / v1 / to remember
に / に=spec1 / prt / at; to
鮸!rK / にべ / n / (uk) croaker
大阪=spec1 / おおさか=spec1 / n / Osaka
大坂!rK / おおさか / n / Osaka (old spelling)
蛋白質=ichi1 / たんぱくしつ=ichi1 タンパクシツ* / n / protein
頑張る=ichi1 / がんばる=ichi1 / v5r / to persevere
旧体=nf40 / きゅうたい / n / old style
一石二鳥 / いっせきにちょう / exp / (yoji) two birds with one stone
𠮟る / しかる / v5r / to scold
認める=ichi1 / みとめる=ichi1 したためる!ok / v1 / to recognise
こんにちは / こんにちは=spec1 / int / (uk) hello
元気=ichi1 / げんき=ichi1 / adj-na,n / lively
か / か=spec1 / prt / question marker
もう / もう=ichi1 / adv / already
も / も=spec1 / prt / also
ほんま / ほんま / n / (ksb) truth
"""


def entries() -> list[dict]:
    """Entries with numbered forms and senses; codes, not phrases."""
    out = []
    for i, line in enumerate(WORDS.strip().splitlines(), 1):
        kanji, kana, pos, senses = (x.strip() for x in line.split(" / "))

        def form(x: str) -> dict:
            x, _, info = x.partition("!")
            x, _, priority = x.partition("=")
            return {"text": x.rstrip("*"), "no_kanji": x.endswith("*"), "priority": priority.split(",") if priority else [], "info": info.split(",") if info else []}

        readings = [form(x) for x in kana.split()]
        written = [form(x) for x in kanji.split() if x != "-"]
        # Words written as they are read have no kanji.
        written = [w for w in written if w["text"] not in {r["text"] for r in readings}]
        found = []
        for s in senses.split(" ;; "):
            marks, text = (s[1:].split(") ", 1) if s.startswith("(") else ("", s))
            codes = [c for c in marks.split(",") if c]
            found.append({"pos": pos.split(","), "glosses": text.split("; "), "misc": [c for c in codes if c in ("uk", "yoji")], "field": [c for c in codes if c == "food"], "dial": [c for c in codes if c == "ksb"]})
        out.append({"ent_seq": str(1000000 + 10 * i), "kanji": written, "readings": readings, "senses": found})
    return out


def xml() -> str:
    """The dictionary as an XML document with its codes as entities."""

    def forms(items: list[dict], outer: str, inner: str, pri: str, inf: str) -> str:
        return "".join(f"<{outer}><{inner}>{escape(f['text'])}</{inner}>{'<re_nokanji/>' if outer == 'r_ele' and f['no_kanji'] else ''}" + "".join(f"<{inf}>&{c};</{inf}>" for c in f["info"]) + "".join(f"<{pri}>{c}</{pri}>" for c in f["priority"]) + f"</{outer}>" for f in items)

    rows = []
    for e in entries():
        senses = "".join("<sense>" + "".join(f"<{tag}>&{c};</{tag}>" for tag in ("pos", "field", "misc", "dial") for c in s[tag]) + "".join(f"<gloss>{escape(g)}</gloss>" for g in s["glosses"]) + "</sense>" for s in e["senses"])
        rows.append(f"<entry>\n<ent_seq>{e['ent_seq']}</ent_seq>\n{forms(e['kanji'], 'k_ele', 'keb', 'ke_pri', 'ke_inf')}\n{forms(e['readings'], 'r_ele', 'reb', 're_pri', 're_inf')}\n{senses}\n</entry>")
    dtd = "\n".join(f'<!ENTITY {name} "{text}">' for name, text in ENTITIES.items())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE JMdict [\n{dtd}\n]>\n<JMdict>\n' + "\n".join(rows) + "\n</JMdict>\n"
