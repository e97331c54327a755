"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), written from the paper's rules.

Words of fewer than 3 or more than 64 bytes stay as they are. Suffixes are ASCII letters; any other byte of a word counts as a
consonant, as it does in the full-text index whose stems these have to equal.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of steps 2, 3 and 4, longest match first.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        out.append("v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, table, least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    if word.isascii():
        return _stem(word)
    return _stem(word.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "replace")  # byte by byte


def _stem(word: str) -> str:
    if not 3 <= len(word) <= 64:
        return word
    # plurals
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and continuous forms
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ing", "ed"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP2, 0)
    word = _swap(word, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def porter_udf(words: pd.Series) -> pd.Series:
    """Meant for a column of distinct words, not for texts."""
    return words.map(porter)
