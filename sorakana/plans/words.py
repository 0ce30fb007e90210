"""Word types and grammatical reasons, with the codes that users see."""

from __future__ import annotations

from enum import IntEnum, IntFlag

# Bits of word types.
WordType = IntFlag("WordType", [("ICHIDAN", 1), ("GODAN", 2), ("I_ADJ", 4), ("KURU", 8), ("SURU", 16), ("SPECIAL_SURU", 32), ("NOUN_SURU", 64), ("INITIAL", 128), ("TA_TE", 256), ("DA_DE", 512), ("MASU", 1024), ("IRREALIS", 2048)])
#: Types that words in a dictionary have.
ALL_WORDS = 127
#: What an unconjugated input may be: anything but a stem that needs an ending.
UNKNOWN = 0xFFFF & ~int(WordType.TA_TE | WordType.DA_DE | WordType.IRREALIS)
# Names of reasons, in the order of their codes from 0.
REASONS = (
    "PolitePastNegative PoliteNegative PoliteVolitional Chau Sugiru PolitePast Tara Tari Causative PotentialOrPassive Toku Sou Tai Polite Respectful Humble HumbleOrKansaiDialect Past Negative Passive Ba Volitional Potential EruUru "
    "CausativePassive Te Zu Imperative MasuStem Adv Noun ImperativeNegative Continuous Ki SuruNoun ZaruWoEnai NegativeTe Irregular"
).split()
Reason = IntEnum("Reason", [(name, code) for code, name in enumerate(REASONS)])
