"""The Porter stemmer, after the 1980 paper: suffix rules as tables, applied in five steps."""

from __future__ import annotations

import re

# Suffix, replacement; a rule fires where the stem's measure is above the step's limit.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    pairs = [tuple(x.split(":")) if ":" in x else (x, "") for x in text.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_RULES = {2: _rules(_STEP2), 3: _rules(_STEP3), 4: _rules(_STEP4)}


def _shape(word: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _table(word: str, step: int, least: int) -> str:
    for suffix, put in _RULES[step]:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if _measure(stem) > least and (suffix != "ion" or stem[-1:] in ("s", "t")):
                return stem + put
            return word
    return word


def stem(word: str) -> str:
    """The stem of a word in lower case; other bytes than letters count as consonants, words below 3 or above 64 bytes stay."""
    data = word.encode()
    return _stem(data.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore") if 3 <= len(data) <= 64 else word


def _stem(word: str) -> str:
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix) and (len(suffix) < 3 or len(word) > len(suffix)):
            word = word[: len(word) - len(suffix)] + put
            break
    if len(word) > 3 and word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (m := re.fullmatch("(.*?)(ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _table(_table(_table(word, 2, 0), 3, 0), 4, 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _ends_cvc(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
