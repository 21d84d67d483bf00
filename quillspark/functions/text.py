"""Text expressions: Column in, Column out, all inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a keyword query drops because they match everything.
NOISE = (
    "the", "and", "for", "that", "with", "shall", "must", "any", "all", "not", "this", "such", "which", "from", "under",
    "upon", "each", "may", "are", "was", "been", "have", "has", "will", "would", "its", "their", "other", "than",
)

# Number words and days of a unit, for durations in prose.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "sixty": 60, "ninety": 90,
}
UNIT_DAYS = {"year": 365.0, "month": 30.0, "day": 1.0, "business day": 1.4, "hour": 1 / 24}
DURATION = r"(?i)(?:not less than|at least|minimum of|no later than|within|for)\s+(?:a period of\s+)?(\w+)\s*(?:\(\d+\)\s*)?(year|month|day|business day|hour)s?"

# How a heading carries its own reference (one group of these), and where a sentence ends.
REFERENCE = (
    r"^\s*(?:(?:§+\s*)?(\d+(?:\.\d+)+)|(?:§+\s*)?(\d+)(?=[.)])|([IVXLCDM]+(?:\.[A-Z0-9]+)*)(?=[.)\s])"
    r"|\(([a-z]{1,3}|[ivxlcdm]{1,4}|\d{1,3})\)|(?i:Article|Section|Sec\.|Part|Rule)\s+([\w.\-]+))[\s.\-\u2014:)]*"
)
SENTENCE_END = r"(?<=[.;:])\s+(?=[A-Z(])"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; ``trim`` only takes spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def grounding_form(c: Column) -> Column:
    """Quotes, dashes and non-breaking space folded, white space collapsed, lower case."""
    return F.lower(collapsed(F.translate(c, "’‘“”—–‑ ", "''\"\"--- ")))


def strict_date(c: Column) -> Column:
    """A date or null: malformed text never raises. One-digit months and days are accepted."""
    text = strip(c)
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy-M-d")))


def months_stale(reviewed: Column, today: Column, months: int = 24) -> Column:
    """Calendar months apart, days ignored; a missing date is stale."""
    gap = (F.year(today) - F.year(reviewed)) * 12 + F.month(today) - F.month(reviewed)
    return F.coalesce(gap > months, F.lit(True))


def or_terms(c: Column, noise=NOISE, most: int = 40) -> Column:
    """Distinct terms of three characters or more, in order of appearance, noise dropped."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9]{2,})"), 1))
    return F.slice(F.filter(words, lambda w: ~w.isin(*noise)), 1, most)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9]{2,})"), 1)


def term_density(c: Column, term: str) -> Column:
    """Characters that occurrences of term take, in any case, inside words too; term is text, not a pattern."""
    return F.lit(len(term)) * F.regexp_count(c, F.lit(f"(?i){re.escape(term)}"))


def heading_reference(c: Column) -> Column:
    """The reference a heading begins with, or null."""
    groups = [F.nullif(F.regexp_extract(c, REFERENCE, k), F.lit("")) for k in range(1, 6)]
    return F.coalesce(*groups)


def durations(c: Column) -> Column:
    """array<struct<days, phrase>> of the durations stated in a text; unknown number words are skipped."""
    raw = F.transform(F.regexp_extract_all(c, F.lit(DURATION), 1), F.lower)
    unit = F.transform(F.regexp_extract_all(c, F.lit(DURATION), 2), F.lower)
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], float(pair[1]))])
    days = F.create_map(*[F.lit(x) for pair in UNIT_DAYS.items() for x in pair])
    number = lambda w: F.coalesce(F.try_element_at(words, w), F.when(w.rlike(r"^\d+$"), w.cast("double")))
    pairs = F.zip_with(raw, unit, lambda r, u: F.struct((number(r) * F.try_element_at(days, u)).alias("days"), F.concat(r, F.lit(" "), u, F.lit("s")).alias("phrase")))
    return F.filter(pairs, lambda p: p["days"].isNotNull())


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """At blank lines; a text without any is cut at sentence ends."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 1, parts).otherwise(sentences(c))
