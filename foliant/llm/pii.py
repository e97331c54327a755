"""Personal data in texts: exact detection, and detection under disguise with spans of the source text.

A transducer rewrites a text and keeps, for each character it writes, the source characters it read. Chained, they
fold homoglyphs (letters and digits that look like ASCII, full width forms, invisible characters dropped), spelled
digits ("five five", "double five", "twenty one", "fünf", "plus") and disguised separators ("(at)", " at ", "[dot]", " punkt "). Identifiers are
detected in the rewritten text by the same rules as in the source, and their spans mapped back. A disguised span is
added unless it lies within one of the same kind that the source text shows openly; open ones are never changed.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")

# The classes of the four kinds of identifiers.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Characters that look like ASCII ones, beyond those that compatibility decomposition finds.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3", "з": "3", "б": "6",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ᴏ": "o", "։": ":", "․": ".", "。": ".", "·": ".", "•": ".", "٫": ".", "⁺": "+", "➕": "+",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
# Characters that show nothing.
INVISIBLE = frozenset("­​‌‍‎‏⁠⁡⁢⁣﻿᠎͏")
# Digits and signs in words, in the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words that repeat the digit after them, and English numbers of two digits.
TIMES = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}
TENS = {"twenty": "two", "thirty": "three", "forty": "four", "fifty": "five", "sixty": "six", "seventy": "seven", "eighty": "eight", "ninety": "nine"}
TEENS = {
    "ten": "one zero", "eleven": "one one", "twelve": "one two", "thirteen": "one three", "fourteen": "one four", "fifteen": "one five", "sixteen": "one six", "seventeen": "one seven",
    "eighteen": "one eight", "nineteen": "one nine",
}
UNITS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
PLUS_WORDS = ("plus", "más", "mas")
AT_WORDS = ("at", "arobase", "arroba", "chez")
DOT_WORDS = ("dot", "point", "punkt", "punto", "period")

_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"(?i)(?<![^\W_])(?:(?:{'|'.join(PLUS_WORDS)})\s+)?(?:(?:{_WORDS})|[0-9])(?:(?:[\s.,-]{{1,3}}(?:{'|'.join(DOT_WORDS)})[\s.,-]{{1,3}}|[\s.,()-]{{0,3}})(?:(?:{_WORDS})|[0-9]))+(?![^\W_])")
_DIGIT_WORD = re.compile(rf"(?i)(?<![^\W\d_])(?:{_WORDS})(?![^\W\d_])")
_PLUS = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(PLUS_WORDS)})\s+(?=[0-9])")
_LARGE = tuple([*TIMES, *TENS, *TEENS])
_LONG, _TEN = tuple(w for w in _LARGE if w != "ten"), re.compile(r"\bten\b")
_NUMBERS = "|".join(sorted([*SPELLED, *_LARGE], key=len, reverse=True))
_NUMBER_RUN = re.compile(rf"(?i)(?<![^\W_])(?:{_NUMBERS})(?:[\s,.-]{{1,3}}(?:(?:{'|'.join(DOT_WORDS)})[\s,.-]{{1,3}})?(?:(?:{_NUMBERS})(?![^\W_])|[0-9]++))++(?![^\W_])")
_NUMBER_WORD = re.compile(
    rf"(?i)(?<![^\W_])(?:(?P<times>{'|'.join(TIMES)})[\s,.-]{{1,3}}(?P<what>(?:{_WORDS})(?![^\W_])|[0-9](?![0-9]))"
    rf"|(?P<tens>{'|'.join(TENS)})(?![^\W_])(?:[\s-](?P<unit>{'|'.join(UNITS)})(?![^\W_]))?|(?P<teens>{'|'.join(sorted(TEENS, key=len, reverse=True))})(?![^\W_]))"
)
_OPEN, _SHUT = r"[(\[{<]\s*", r"\s*[)\]}>]"
_AT = "|".join(AT_WORDS)
_DOT = "|".join(DOT_WORDS)
#: At words that are hardly prose, and so may stand bare before a domain with plain dots.
SURE_AT_WORDS = ("arobase", "arroba")
_SURE_AT = re.compile(rf"(?i)\s+(?:{'|'.join(SURE_AT_WORDS)})\s+")
_PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOT_SIGN = rf"\s*{_OPEN}(?:{_DOT}|\.){_SHUT}\s*|\s+(?:{_DOT})\s+"
_NO_AT = rf"(?!(?:{_AT})\s+(?!(?:{_AT}|{_DOT})\s)[A-Za-z0-9])"  # "dot at example": the at word is no part of the name
# possessive and never retried from within a name, so that names of any number of parts take linear time
_MAIL = re.compile(
    rf"(?i)(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:(?:\s*\.\s*|{_DOT_SIGN}){_NO_AT}[A-Za-z0-9_%+-]++)*+"
    rf"(?:(?:(?P<mark>\s*{_OPEN}(?:{_AT}|@){_SHUT}\s*|\s*@\s*)|(?P<bare>\s+(?:{_AT})\s+))"
    rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT_SIGN}|\s+\.\s*|\s*\.\s+(?=[a-z]))[A-Za-z0-9-]+)+)?+"
)
_AT_PART = re.compile(rf"(?i)\s*{_OPEN}(?:{_AT}|@){_SHUT}\s*|\s*@\s*|\s+(?:{_AT})\s+")
_DOT_PART = re.compile(rf"(?i)\s*{_OPEN}(?:{_DOT}|\.){_SHUT}\s*|\s+(?:{_DOT})\s+|\s*\.\s*")
_END, _NEW_SENTENCE = re.compile(r"\.\s+"), re.compile(r"\.\s+[A-Z]")
_DOT_WORD = re.compile(rf"(?i)(?:{_OPEN}(?:{_DOT}|\.){_SHUT}|\s(?:{_DOT})\s)")
_BREAK_DOT = re.compile(rf"(?i)(?<=[0-9])[\s.,-]+(?:{_DOT})[\s.,-]+(?=[0-9])|(?<=[0-9])\s*{_OPEN}(?:{_DOT}|\.){_SHUT}\s*(?=[0-9])")


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {ord(c): None for c in INVISIBLE}
    for lo, hi in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2500), (0x2070, 0x209C), (0x0660, 0x066A), (0x06F0, 0x06FA), (0x0966, 0x0970)):
        for c in range(lo, hi):
            plain = unicodedata.normalize("NFKC", chr(c))
            digit = unicodedata.digit(chr(c), None)
            if digit is not None:
                plain = str(digit)
            if c not in table and len(plain) == 1 and plain.isascii():
                table[c] = plain
    return table


FOLD = _fold_table()
_LETTERS = re.compile(r"[^\W\d_]+")
#: Anything beyond Latin letters, and the few signs below them that FOLD rewrites.
_UNUSUAL = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xb6\xb8-\u0130\u0132-\u024f]")


def _lower(text: str) -> str:
    """``text`` in lower case, with the four other characters that match i, s and k where case is ignored."""
    if text.isascii():
        return text.lower()
    return text.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017f", "s").replace("\u212a", "k")


def _any_of(words, low: str) -> bool:
    return any(w in low for w in words)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    found, end = [], 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            end = m.end()
    return found


def detect(text: str) -> list[tuple[str, int, int]]:
    """Open identifiers, leftmost and non-overlapping within a kind, as (kind, start, end) by start, then kind."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Tape:
    """A rewritten text: character i stands for source[start[i]:stop[i]]."""

    def __init__(self, text: str, start, stop):
        self.text, self.start, self.stop = text, start, stop

    @staticmethod
    def of(text: str) -> "Tape":
        return Tape(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace [a:b] by a short text, for ordered, disjoint edits; every character written reads all of [a:b]."""
        if not edits:
            return self
        text, start, stop, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start.extend(self.start[at:a])
            stop.extend(self.stop[at:a])
            text.append(new)
            start.extend([self.start[a]] * len(new))
            stop.extend([self.stop[b - 1]] * len(new))
            at = b
        text.append(self.text[at:])
        start.extend(self.start[at:])
        stop.extend(self.stop[at:])
        return Tape("".join(text), start, stop)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.stop[b - 1]


def fold_homoglyphs(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    return tape.rewrite([(m.start(), m.end(), FOLD[ord(m[0])] or "") for m in _UNUSUAL.finditer(tape.text) if ord(m[0]) in FOLD])


def number_words(tape: Tape) -> Tape:
    """Repeated digits and numbers of two digits as single digits in words, beside other numbers in words only."""
    low = _lower(tape.text)
    if not _any_of(_LONG, low) and not ("ten" in low and _TEN.search(low)):
        return tape
    edits = []
    for run in _NUMBER_RUN.finditer(tape.text):
        if len(_LETTERS.findall(run[0])) < 2:
            continue
        for m in _NUMBER_WORD.finditer(tape.text, run.start(), run.end()):
            if m["times"]:
                new = " ".join([m["what"]] * TIMES[m["times"].lower()])
            elif m["tens"]:
                new = f"{TENS[m['tens'].lower()]} {m['unit'] or 'zero'}"
            else:
                new = TEENS[m["teens"].lower()]
            edits.append((m.start(), m.end(), new))
    return tape.rewrite(edits)


def _joined(run: str, at: int) -> list[tuple[int, int, str]]:
    """Edits that turn a run of spelled and plain digits into digits; separators between two spelled ones go."""
    edits, last = [], None
    for m in re.finditer(rf"(?i)(?:{_WORDS})|[0-9]+", run):
        word = m[0].lower()
        spelled = word in SPELLED
        if last is not None:
            gap = run[last[1] : m.start()]
            if re.search(rf"(?i){_DOT}|\.", gap) and not gap.strip(" \t\n-,()") == "":
                edits.append((at + last[1], at + m.start(), "."))
            elif gap and (spelled or last[2]):
                edits.append((at + last[1], at + m.start(), ""))
        if spelled:
            edits.append((at + m.start(), at + m.end(), SPELLED[word]))
        last = (m.start(), m.end(), spelled)
    return [e for e in edits if e[0] < e[1]]


def _inside(run: str, a: int, b: int) -> bool:
    """Whether run[a:b] has figures on both sides, a space or hyphen away at most, and fewer than 9 before it."""
    return re.search(r"[0-9][ -]?$", run[:a]) is not None and re.match(r"[ -]?[0-9]", run[b:]) is not None and len(_digits(run[:a])) < 9


def spell_digits(tape: Tape) -> Tape:
    low = _lower(tape.text)
    if sum(w in SPELLED for w in _LETTERS.findall(low)) < (1 if "+" in low or _any_of(PLUS_WORDS, low) else 2):
        return tape
    edits = []
    for m in _RUN.finditer(tape.text):
        head = re.match(rf"(?i)(?:{'|'.join(PLUS_WORDS)})\s+", m[0])
        words = list(_DIGIT_WORD.finditer(m[0]))
        # one word among figures is prose, unless it stands inside a number after a plus that is not yet a phone
        if len(words) < 2 and not (words and (head or tape.text.endswith("+", 0, m.start())) and _inside(m[0], *words[0].span())):
            continue
        if head:
            edits.append((m.start(), m.start() + head.end(), "+"))
        edits += _joined(m[0][head.end() if head else 0 :], m.start() + (head.end() if head else 0))
    return tape.rewrite(edits)


def open_signs(tape: Tape) -> Tape:
    """Disguised at and dot signs, where the whole reads as an address; "word at word.word" alone is prose."""
    edits, low = [], _lower(tape.text)
    dots = _any_of(DOT_WORDS, low) or any(c in low for c in "([{<")
    if not dots and "@" not in low and not _any_of(SURE_AT_WORDS, low):  # other at words need a dot word or a sign in brackets
        return tape
    for m in _MAIL.finditer(tape.text) if "@" in low or _any_of(AT_WORDS, low) else ():
        if m.lastgroup is None:  # a name without an at sign
            continue
        whole = m[0]
        at = _AT_PART.search(whole, max(0, (m.start("mark") if m["mark"] else m.start("bare")) - m.start()))
        domain = whole[at.end() :]
        plain = m["bare"] and not _DOT_WORD.search(domain)
        if plain and not (_SURE_AT.fullmatch(m["bare"]) and _PLAIN_DOMAIN.match(domain)):
            continue
        if m["mark"] and m["mark"].strip() == "@" and not _DOT_WORD.search(domain) and not _DOT_WORD.search(whole[: at.start()]):
            if m["mark"] != "@" and re.search(r"\s\.|\.\s", whole):
                continue
        local = [(p.start(), p.end(), ".") for p in _DOT_PART.finditer(whole[: at.start()])]
        rest = [(at.end() + p.start(), at.end() + p.end(), ".") for p in _DOT_PART.finditer(domain)]
        if plain:
            rest = [e for e in rest if e[1] <= at.end() + _PLAIN_DOMAIN.match(domain).end()]
        if m["mark"] == "@":  # the ends of sentences beside an open address are no disguise
            first = next((i for i, (a, b, _) in enumerate(rest) if i and _NEW_SENTENCE.fullmatch(whole, a, b + 1)), len(rest))
            rest = rest[:first]
            if all(b - a == 1 for a, b, _ in rest) and all(b - a == 1 or _END.fullmatch(whole, a, b) for a, b, _ in local):
                continue
        for a, b, new in [*local, (at.start(), at.end(), "@"), *rest]:
            if whole[a:b] != new:
                edits.append((m.start() + a, m.start() + b, new))
    edits += [(m.start(), m.end(), ".") for m in _BREAK_DOT.finditer(tape.text)] if dots else []
    out, end = [], 0
    for e in sorted(edits):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return tape.rewrite(out)


def plus_words(tape: Tape) -> Tape:
    if not _any_of(PLUS_WORDS, _lower(tape.text)):
        return tape
    return tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])


# Letters read as digits inside a number.
DIGIT_LETTERS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_NUMBER = re.compile(r"(?<!\w)[0-9OolI]*[0-9][OolI][0-9OolI]*(?!\w)|(?<!\w)[OolI][0-9][0-9OolI]*(?!\w)")


def digit_letters(tape: Tape) -> Tape:
    edits = []
    for m in _NUMBER.finditer(tape.text):
        edits += [(m.start() + i, m.start() + i + 1, DIGIT_LETTERS[c]) for i, c in enumerate(m[0]) if c in DIGIT_LETTERS]
    return tape.rewrite(edits)


TRANSDUCERS = (fold_homoglyphs, digit_letters, number_words, spell_digits, plus_words, open_signs)


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Identifiers that only the rewritten text shows, as spans of the source text."""
    tape = Tape.of(text)
    for step in TRANSDUCERS:
        tape = step(tape)
    if tape.text == text:
        return []
    return [(kind, *tape.source(a, b)) for kind, a, b in detect(tape.text)]


def find(text: str | None) -> tuple[list, list]:
    """(open spans, all spans) of a whole text, each by start, then kind. Null and empty texts have none."""
    text = text or ""
    base = detect(text)
    every = list(base)
    for kind, a, b in disguised(text):
        if not any(k == kind and x <= a and b <= y for k, x, y in base):
            every.append((kind, a, b))
    return base, sorted(set(every), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list) -> str:
    """The text with each span, and any that overlap it, replaced by the mark of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a])
            out.append(f"<{kind.upper()}>")
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def _rows(batches):
    for batch in batches:
        found = [find(t) for t in batch.column(1).to_pylist()]
        counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), *[pa.array(c, pa.int64()) for c in counts],
                pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([written(every) for _, every in found], pa.string()),
                pa.array([len(every) - len(base) for base, every in found], pa.int64()),
            ],
            names=["key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
        )


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, counts of open spans by kind, base_sha256, spans, n_added (long).

    Null and empty texts have no spans; texts are searched whole, in time in proportion to their length. Null keys stay
    null, repeated rows stay, extra columns are not read. Empty tables give no rows.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_rows, f"key {kind}, {counts}, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's mark; ``length``, if it is a column, follows.

    Overlapping spans give one mark, of the first. Null and empty texts and null lengths of them stay; all other columns
    and repeated rows stay as they are. Empty tables give no rows.
    """
    prepare(docs.sparkSession)

    def rewrite(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = [t and redact(t, find(t)[1]) for t in batch.column(i).to_pylist()]
            columns = list(batch.columns)
            columns[i] = pa.array(new, pa.string())
            j = batch.schema.get_field_index(length)
            if j >= 0:
                columns[j] = pa.array([o if n is None else len(n) for n, o in zip(new, columns[j].to_pylist())], batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)
