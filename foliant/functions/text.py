"""Text normalisation as column expressions: white space, lines, words, diacritics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class, wider than Java's \s, and its inside; word characters likewise.
W_IN = r"\s\x1c-\x1f\x85\p{Z}"
W = f"[{W_IN}]"
#: White space, and white space other than a plain space; letters and signs of ASCII are told by their range.
_W_ANY, _W_ODD = rf"[\x00-\x20\x7f-\x{{10ffff}}&&[{W_IN}]]", rf"[\x00-\x1f\x7f-\x{{10ffff}}&&[{W_IN}]]"
#: The same characters one by one, for functions that take no pattern.
W_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WC = r"[\p{L}\p{N}_]"
#: One line end or several: blank lines count for nothing.
LINE_ENDS = r"[\x0a-\x1e\x85-\u2029&&[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]]+"
TOKEN = r"[\p{L}\p{N}]+"
#: No letter or digit before: where a word can begin.
BEGIN = r"(?<![\p{L}\p{N}])"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(W_CHARS))


def clean(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # a single space stays as it is, so most words cost no replacement
    return F.trim(F.regexp_replace(blank_if_null(c), f" {_W_ANY}+|{_W_ODD}{_W_ANY}*", " "))


def lines(c: Column) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(F.split(blank_if_null(c), LINE_ENDS), strip), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(f"({TOKEN})"), F.lit(1))


def spaced(lowered: Column) -> Column:
    """The runs of letters and digits of a lower-cased text, one space apart."""
    other = r"[^\p{L}\p{N}]"
    # a single space stays as it is, so most words cost no replacement
    return F.trim(F.regexp_replace(lowered, rf" {other}+|[^ \p{{L}}\p{{N}}]{other}*", " "))


def folding_pairs() -> tuple[str, str]:
    """Letters with a single diacritic and their bases, by rule: canonical decomposition into base and one mark."""
    odd, base = [], []
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isascii() and parts[0].isalpha():
            odd.append(chr(code))
            base.append(parts[0])
    return "".join(odd), "".join(base)


_ODD, _BASE = folding_pairs()


#: Diacritics that follow their letter.
_MARKS = "".join(map(chr, range(0x300, 0x332)))


def fold(c: Column) -> Column:
    """Letters with one diacritic as their base, diacritics of their own dropped; letters with two stay."""
    return F.translate(c, _ODD + _MARKS, _BASE)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(_ODD, _BASE, _MARKS))
