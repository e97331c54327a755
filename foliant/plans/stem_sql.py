"""Porter's stemmer as SQL, from the paper's rules, for the oracle of queries on stems. A word's bytes count, as in ``functions.stem``."""

from __future__ import annotations

from foliant.functions.stem import STEP2, STEP3, STEP4


def shape(x: str) -> str:
    """V or C for each byte of a word: y is a vowel after a consonant, whatever is not ASCII a consonant."""
    x = f"regexp_replace(regexp_replace({x}, '[\\x{{800}}-\\x{{10FFFF}}]', 'bbb', 'g'), '[^\\x00-\\x7F]', 'bb', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '^y', 'b'), '([^aeiouy])y', '\\1a', 'g')"
    return f"regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[^V]', 'C', 'g')"


def measure(x: str) -> str:
    return f"len(regexp_extract_all({shape(x)}, 'V+C'))"


def _vowel(x: str) -> str:
    return f"contains({shape(x)}, 'V')"


def _short(x: str) -> str:
    return f"(ends_with({shape(x)}, 'CVC') AND NOT regexp_matches({x}, '[wxy]$'))"


def _without(n: int, x: str = "w") -> str:
    return f"left({x}, length({x}) - {n})"


def _swap(table: dict[str, str], least: int) -> str:
    found = f"regexp_extract(w, '({'|'.join(table)})$', 1)"
    stem = f"left(w, length(w) - length({found}))"
    to = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    return f"CASE WHEN {found} <> '' AND {measure(stem)} > {least} THEN {stem} || CASE {found} {to} END ELSE w END"


def stems(words: str) -> str:
    """Common table expressions that end in ``stems`` (word, term) of a table ``words`` (word)."""
    last = f"regexp_extract(w, '({'|'.join(STEP4)})$', 1)"
    rest = f"left(w, length(w) - length({last}))"
    steps = [
        "CASE WHEN (ends_with(w, 'sses') AND strlen(w) > 4) OR (ends_with(w, 'ies') AND strlen(w) > 3) THEN "
        f"{_without(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_without(1)} ELSE w END",
        # a mark says that a suffix was cut, for the step after
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {measure(_without(3))} > 0 THEN {_without(1)} ELSE w END"
        f" WHEN ends_with(w, 'ing') AND {_vowel(_without(3))} THEN {_without(3)} || '|' WHEN ends_with(w, 'ed') AND {_vowel(_without(2))} THEN {_without(2)} || '|' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '|') THEN w WHEN regexp_matches(w, '(at|bl|iz)\\|$') THEN {_without(1)} || 'e'"
        f" WHEN length(w) > 2 AND w[-2] = w[-3] AND w[-2] <= '~' AND ends_with({shape(_without(1))}, 'C') THEN CASE WHEN w[-2] IN ('l', 's', 'z') THEN {_without(1)} ELSE {_without(2)} END"
        f" WHEN {measure(_without(1))} = 1 AND {_short(_without(1))} THEN {_without(1)} || 'e' ELSE {_without(1)} END",
        f"CASE WHEN ends_with(w, 'y') AND {_vowel(_without(1))} THEN {_without(1)} || 'i' ELSE w END", _swap(STEP2, 0), _swap(STEP3, 0),
        f"CASE WHEN {last} <> '' AND {measure(rest)} > 1 AND ({last} <> 'ion' OR regexp_matches({rest}, '[st]$')) THEN {rest} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({measure(_without(1))} > 1 OR ({measure(_without(1))} = 1 AND NOT {_short(_without(1))})) THEN {_without(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {measure('w')} > 1 THEN {_without(1)} ELSE w END",
    ]
    parts = [f"stem0 AS (SELECT word, word AS w FROM {words} WHERE strlen(word) BETWEEN 3 AND 64)"]
    parts += [f"stem{i} AS MATERIALIZED (SELECT word, {step} AS w FROM stem{i - 1})" for i, step in enumerate(steps, 1)]
    parts.append(f"stems AS (SELECT word, w AS term FROM stem{len(steps)} UNION ALL SELECT word, word FROM {words} WHERE strlen(word) NOT BETWEEN 3 AND 64)")
    return ", ".join(parts)
