"""Porter's stemming algorithm of 1980: as SQL expressions, the same for Spark and for other engines with regular expressions, and word by word.

A word goes through eight steps, each a CASE over the word as the step before left it. In a plan every step is a lambda over
the word, so no expression is repeated; in SQL every step is a subquery.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that make a consonant run and a vowel run; the endings of steps 2, 3 and 4 with what replaces them.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# The measure of a stem: more than 0, exactly 1, more than 1; a vowel; consonant, vowel, consonant at the end.
_MORE0, _ONE, _MORE1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _steps(like: Callable[[str, str], str]) -> list[Callable[[str], str]]:
    """The steps as functions from the name of a word column to SQL; like(expression, pattern) is the engine's regex test."""
    cut = lambda w, n: f"left({w}, length({w}) - {n})"
    stem = lambda w, ends: f"regexp_extract({w}, '^(.+?)({'|'.join(ends)})$', 1)"
    end = lambda w, ends: f"regexp_extract({w}, '^(.+?)({'|'.join(ends)})$', 2)"

    def plural(w):
        return f"CASE WHEN {like(w, '^.+?(ss|i)es$')} THEN {cut(w, 2)} WHEN {like(w, '^.+?[^s]s$')} THEN {cut(w, 1)} ELSE {w} END"

    def past(w):
        at = stem(w, ("ed", "ing"))
        tidy = f"CASE WHEN {like(at, '(at|bl|iz)$')} THEN {at} || 'e' WHEN right({at}, 1) = left(right({at}, 2), 1) AND length({at}) > 1 AND {like(at, '[^aeiouylsz]$')} THEN {cut(at, 1)} WHEN {like(at, _SHORT)} THEN {at} || 'e' ELSE {at} END"
        return f"CASE WHEN {like(w, '^.+?eed$')} THEN CASE WHEN {like(stem(w, ('eed',)), _MORE0)} THEN {cut(w, 1)} ELSE {w} END WHEN {like(w, '^.+?(ed|ing)$')} AND {like(at, _VOWEL)} THEN {tidy} ELSE {w} END"

    def last_y(w):
        return f"CASE WHEN {like(w, '^.+?y$')} AND {like(cut(w, 1), _VOWEL)} THEN {cut(w, 1)} || 'i' ELSE {w} END"

    def replaced(ends):
        return lambda w: f"CASE WHEN {like(stem(w, ends), _MORE0)} THEN {stem(w, ends)} || CASE {end(w, ends)} {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in ends.items())} END ELSE {w} END"

    def dropped(w):
        ion = cut(w, 3)
        return f"CASE WHEN {like(w, f'^.+?({chr(124).join(STEP4)})$')} THEN CASE WHEN {like(stem(w, STEP4), _MORE1)} THEN {stem(w, STEP4)} ELSE {w} END WHEN {like(w, '^.+?(s|t)ion$')} AND {like(ion, _MORE1)} THEN {ion} ELSE {w} END"

    def last_e(w):
        at = cut(w, 1)
        return f"CASE WHEN {like(w, '^.+?e$')} AND ({like(at, _MORE1)} OR ({like(at, _ONE)} AND NOT {like(at, _SHORT)})) THEN {at} ELSE {w} END"

    def last_l(w):
        return f"CASE WHEN {like(w, 'll$')} AND {like(w, _MORE1)} THEN {cut(w, 1)} ELSE {w} END"

    # an initial y is a consonant: it passes through as a capital
    return [
        lambda w: f"CASE WHEN left({w}, 1) = 'y' THEN 'Y' || substring({w}, 2) ELSE {w} END",
        plural, past, last_y, replaced(STEP2), replaced(STEP3), dropped, last_e, last_l, lambda w: f"lower({w})",
    ]


def stemmed(df: DataFrame, word: str, into: str) -> DataFrame:
    """Adds the stem of a column of lower-case words; words of up to two letters, and null, are their own stems."""
    out = f"`{word}`"
    for k, step in enumerate(_steps(lambda c, p: f"({c} RLIKE '{p}')")):
        # the lambda's variable holds the word, so that a step's expression has it once
        out = f"element_at(transform(array({out}), w{k} -> {step(f'w{k}')}), 1)"
    return df.withColumn(into, F.expr(f"CASE WHEN length(`{word}`) > 2 THEN {out} ELSE `{word}` END"))


def stem_sql(source: str, word: str) -> str:
    """A subquery with all columns of source and ``stem``, in SQL with regexp_matches."""
    sql = f"(SELECT *, {word} AS stem FROM {source})"
    for step in _steps(lambda c, p: f"regexp_matches({c}, '{p}')"):
        sql = f"(SELECT * REPLACE (CASE WHEN length({word}) > 2 THEN {step('stem')} ELSE stem END AS stem) FROM {sql})"
    return sql


def _ending(ends) -> re.Pattern:
    return re.compile(f"(.+?)({'|'.join(ends)})")


_MEASURE0, _MEASURE1, _EXACTLY1, _HAS_VOWEL, _IS_SHORT = (re.compile(p) for p in (_MORE0, _MORE1, _ONE, _VOWEL, _SHORT))
_TWO, _THREE, _FOUR, _PAST = _ending(STEP2), _ending(STEP3), _ending(STEP4), _ending(("ed", "ing"))


def stem(word: str) -> str:
    """The stem of one lower-case word, for kernels that keep what they have seen."""
    if len(word) <= 2:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if _MEASURE0.search(w[:-3]) else w
    elif (m := _PAST.fullmatch(w)) and _HAS_VOWEL.search(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif _IS_SHORT.search(w):
            w += "e"
    if w.endswith("y") and len(w) > 1 and _HAS_VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for ends, known in ((_TWO, STEP2), (_THREE, STEP3)):
        if (m := ends.fullmatch(w)) and _MEASURE0.search(m[1]):
            w = m[1] + known[m[2]]
    if m := _FOUR.fullmatch(w):
        w = m[1] if _MEASURE1.search(m[1]) else w
    elif w.endswith(("sion", "tion")) and len(w) > 4 and _MEASURE1.search(w[:-3]):
        w = w[:-3]
    if w.endswith("e") and len(w) > 1 and (_MEASURE1.search(w[:-1]) or (_EXACTLY1.search(w[:-1]) and not _IS_SHORT.search(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _MEASURE1.search(w):
        w = w[:-1]
    return w.lower()
