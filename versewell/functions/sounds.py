"""Keys of words by sound, and numbers of akṣaras, as column expressions: one result for every script.

The Indic scripts share one layout, so a text is first shifted to Devanagari; a consonant that no vowel sign or virama
follows gets its inherent vowel by one regular expression; the rest is replacement of characters.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE, BLOCK = 0x0900, 0x80
OTHERS = [BASE + BLOCK * k for k in range(1, 9)]
INDIC = "[ऀ-ൿ]"

# Plain keys of the Devanagari letters from each offset on, an aspirate by its stop.
CONSONANTS = (0x15, "k k g g n c c j j n t t d d n t t d d n n p p b b m y r r l l l v s s s h".split())
NUKTA = (0x58, "k k g j d d p y".split())
ASPIRATES = [0x16, 0x18, 0x1B, 0x1D, 0x20, 0x22, 0x25, 0x27, 0x2B, 0x2D, 0x59, 0x5D, 0x5E]
VOWELS = (0x05, "a a i i u u r l e e e ai o o o au".split())
SIGNS = (0x3E, "a i i u u r r e e e ai o o o au".split())
MARKS = (0x01, ["n", "m", "h"])
OM, VIRAMA = 0x50, 0x4D


def _at(offset: int) -> str:
    return chr(BASE + offset)


def _class(first: int, last: int) -> str:
    return f"{_at(first)}-{_at(last)}"


CONSONANT = f"[{_class(0x15, 0x39)}{_class(0x58, 0x5F)}]"
SILENT = f"[{_at(0)}{_at(4)}{_class(0x3A, 0x3D)}{_class(0x4E, 0x4F)}{_class(0x51, 0x57)}{_class(0x60, 0x7F)}]"
SIGN_OR_VIRAMA = f"[{_class(0x3E, 0x4D)}]"


@cache
def _accents() -> tuple[str, str]:
    """Every letter of the basic plane that is a letter and combining marks of Latin, Greek and Cyrillic, without these."""
    found = {}
    for k in range(0xA0, 0xFFFE):
        whole = unicodedata.normalize("NFD", chr(k))
        if len(whole) > 1 and all("̀" <= c <= "ͯ" for c in whole[1:]):
            found[chr(k)] = whole[0]
    return "".join(found), "".join(found.values())


@cache
def _two_part_signs() -> list[tuple[str, str]]:
    """Vowel signs that may be written in two parts, by the canonical compositions of the blocks; without the nukta."""
    out = []
    for k in range(BASE + BLOCK, BASE + BLOCK * 9):
        parts = unicodedata.normalize("NFD", chr(k))
        composed = unicodedata.normalize("NFC", parts)
        if len(parts) > 1 and composed == chr(k) and unicodedata.name(parts[-1]).find("NUKTA") < 0:
            out.append((parts, composed))
    return sorted(out, key=lambda x: -len(x[0]))


def plain(text: Column) -> Column:
    """Lower case without accents."""
    bare = F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), *_accents())
    return F.regexp_replace(F.lower(bare), "[̀-ͯ]", "")


def in_devanagari(text: Column) -> Column:
    """Text of the nine Indic scripts in the letters of one."""
    for parts, composed in _two_part_signs():
        text = F.replace(text, F.lit(parts), F.lit(composed))
    block = lambda base: "".join(chr(base + k) for k in range(BLOCK))
    return F.translate(text, "".join(map(block, OTHERS)), block(BASE) * len(OTHERS))


def _indic_key(text: Column) -> Column:
    x = F.regexp_replace(in_devanagari(text), f"({CONSONANT})(?!{SILENT}*{SIGN_OR_VIRAMA})", "$1a")
    x = F.regexp_replace(x, f"([{''.join(map(_at, ASPIRATES))}])", "$1h")
    single: dict[str, str] = {}
    for first, keys in (CONSONANTS, NUKTA, VOWELS, SIGNS, MARKS):
        for k, key in enumerate(keys, first):
            if len(key) == 1:
                single[_at(k)] = key
            else:
                x = F.replace(x, F.lit(_at(k)), F.lit(key))
    x = F.replace(x, F.lit(_at(OM)), F.lit("om"))
    rest = "".join(_at(k) for k in range(BLOCK) if _at(k) not in single)
    return F.translate(x, "".join(single) + rest, "".join(single.values()))


def phonetic_key(text: Column) -> Column:
    """How a word sounds, in plain Latin letters: equal for its spellings in nine Indic scripts and in Latin, with or
    without accents."""
    return plain(F.when(text.rlike(INDIC), _indic_key(text)).otherwise(text))


# Vowels of romanised text; two of them side by side are one where they are listed together.
ROMAN_VOWELS = "ai|au|aa|ii|ee|uu|oo|[aāiīuūṛṝeēoō]"
ACCENTED_VOWELS = ("àáâãäåèéêëìíîïòóôõöùúûü", "āāāāāāeeeeīīīīoooooūūūū")


def akshara_counts(words: Column) -> Column:
    """Akṣaras of each word: its vowels (an Indic consonant without virama has one); a word of consonants alone has one."""

    def count(w: Column) -> Column:
        roman = F.regexp_count(F.translate(F.lower(w), *ACCENTED_VOWELS), F.lit(ROMAN_VOWELS))
        x = in_devanagari(w)
        indic = F.regexp_count(x, F.lit(f"{CONSONANT}(?!{_at(0x3C)}?{_at(VIRAMA)})|[{_class(0x05, 0x14)}{_class(0x60, 0x61)}{_at(OM)}]"))
        n = F.when(w.rlike(INDIC), indic).otherwise(roman)
        return F.when((n == 0) & w.rlike(r"\p{L}"), 1).otherwise(n)

    return F.transform(words, count)
