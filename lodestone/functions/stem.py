"""The suffix-stripping stemmer that Porter published in 1980."""

from __future__ import annotations

import re
from collections.abc import Callable

# The published suffixes of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(stem: str) -> str:
    """The stem as consonants (c) and vowels (v); y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def _short_end(stem: str) -> bool:
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings: dict[str, str], keeps: Callable[[str, str], bool]) -> str:
    for ending in sorted(endings, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + endings[ending] if keeps(stem, ending) else word
    return word


def stemmed(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other characters than a to z, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    word = _longest(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, lambda s, e: True)
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        ending = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in shape(word[: -len(e)])), "")
        if ending:
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, STEP2, lambda s, e: measure(s) > 0)
    word = _longest(word, STEP3, lambda s, e: measure(s) > 0)
    word = _longest(word, dict.fromkeys(STEP4, ""), lambda s, e: measure(s) > 1 and (e != "ion" or s.endswith(("s", "t"))))
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
