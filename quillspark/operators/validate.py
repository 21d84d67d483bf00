"""Checks on model output: every rule a column expression, violations an array, empty if valid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import text as T

# Domains of the enumerated fields.
PARTIES = ("provider", "deployer", "importer", "distributor", "authorised_representative", "notified_body", "member_state", "unspecified")
MODALITIES = ("mandatory", "conditional", "permitted", "prohibited", "recommended")
VERDICTS = ("affected", "not_affected", "ambiguous")
SEVERITIES = ("high", "medium", "low", "none")

# What marks a failure as passing, and as a quota problem, in "ClassName message", lower case.
TRANSIENT = (
    "servererror", "internalserver", "serviceunavailable", "unavailable", "resourceexhausted", "toomanyrequests", "deadlineexceeded",
    "timeout", "high demand", "overloaded", "try again later", "rate limit", "quota", "connectionerror", "remoteprotocol",
)
RATE_LIMIT = ("ratelimit", "resourceexhausted", "toomanyrequests", "too_many_requests", "quota", "rate limit")

# Status codes of both, and where a number is a status and no identifier or amount: after the class name, after a word for it, before its phrase.
TRANSIENT_CODES, RATE_LIMIT_CODES = "429|500|502|503|504", "429"
STATUS = (
    r"^\s*[\w.]+:?\s+\(?({0})\b", r"\b(?:code|status|error|http(?:/[\d.]+)?|response|returned|got|received)(?: code)?[\"']?\s*[:=]?\s*[(\[]?({0})\b",
    r"\b({0})[\s:,-]+(?:too many requests|internal server error|bad gateway|service unavailable|gateway time-?out|unavailable|resource_exhausted)",
)


def violations(**rules: Column) -> Column:
    """Names of the rules (name -> condition of a violation) that a row breaks; null conditions break nothing."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def obligation_violations(quote: Column, action: Column, party: Column | None = None, modality: Column | None = None) -> Column:
    """Broken rules of an obligation: a quote of 25 characters, an action of 1 to 15 words, known party and modality."""
    rules = {"quote_short": F.length(T.strip(quote)) < 25, "action_blank": T.strip(action) == "", "action_long": words(action) > 15}
    if party is not None:
        rules["party_unknown"] = ~F.coalesce(party.isin(*PARTIES), F.lit(False))
    if modality is not None:
        rules["modality_unknown"] = ~F.coalesce(modality.isin(*MODALITIES), F.lit(False))
    return violations(**rules)


def assessment_violations(verdict: Column, severity: Column, reasoning: Column) -> Column:
    """Broken rules of an assessment: known verdict and severity (a missing one is none), a reason of 30 characters."""
    return violations(
        verdict_unknown=~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)),
        severity_unknown=~F.coalesce(severity, F.lit("none")).isin(*SEVERITIES),
        reasoning_short=F.length(T.strip(F.coalesce(reasoning, F.lit("")))) < 30,
    )


def repeated(refs: Column) -> Column:
    """Values that stand more than once in an array, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(refs, lambda r: F.size(F.filter(refs, lambda x: x.eqNullSafe(r))) > 1)))


def result_violations(obligations: Column, none_stated: Column) -> Column:
    """Broken rules of a result (array of obligations with source_ref, and whether it says that there are none)."""
    refs = F.transform(obligations, lambda o: o["source_ref"])
    return violations(refs_repeated=F.size(repeated(refs)) > 0, says_none_but_has_some=none_stated & (F.size(obligations) > 0))


def grounded(quote: Column, source: Column) -> Column:
    """Whether the quote stands in the source, after folding quotes, dashes, case and white space."""
    return F.contains(T.grounding_form(source), T.grounding_form(quote))


#: Letters of quotes that one automaton holds (of some hundred bytes a letter), and automata up to which sources are scanned for each.
AUTOMATON_CHARS, AUTOMATA = 1 << 20, 32

#: A worker's automaton, which lives as long as the worker.
_AUTOMATA: dict[bytes, object] = {}


def _automaton(forms: list[str], mark: bytes):
    if mark not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        machine = ahocorasick.Automaton()
        for k, form in enumerate(forms):
            machine.add_word(form, k)
        machine.make_automaton()
        _AUTOMATA[mark] = machine
    return _AUTOMATA[mark]


def _quote_blocks(quotes: DataFrame, quote_id: str) -> Iterator[tuple[list, list[str]]]:
    """(ids, forms) of as many quotes at a time as an automaton holds letters."""
    ids, forms, n = [], [], 0
    for r in quotes.select(quote_id, "_q").toLocalIterator():
        ids.append(r[0])
        forms.append(r[1])
        n += len(r[1])
        if n >= AUTOMATON_CHARS:
            yield ids, forms
            ids, forms, n = [], [], 0
    if ids:
        yield ids, forms


def _by_automata(quotes: DataFrame, forms: DataFrame, quote_id: str, source_id: str) -> DataFrame:
    """Pairs of quotes (quote_id, _q) and sources (source_id, _s), a pass over the sources for each automaton."""
    kinds, quote_type = dict(quotes.dtypes) | dict(forms.dtypes), to_arrow_type(quotes.schema[quote_id].dataType)
    ddl = f"{quote_id} {kinds[quote_id]}, {source_id} {kinds[source_id]}"
    found = forms.sparkSession.createDataFrame([], ddl)
    for ids, own in _quote_blocks(quotes, quote_id):
        # quotes of one form are found together
        numbers: dict[str, int] = {}
        who: list[list] = []
        for i, form in zip(ids, own, strict=True):
            if numbers.setdefault(form, len(numbers)) == len(who):
                who.append([])
            who[numbers[form]].append(i)
        each = list(numbers)
        mark = hashlib.sha256("\0".join(each).encode()).digest()

        def hits(batches: Iterator[pa.RecordBatch], each=each, who=who, mark=mark) -> Iterator[pa.RecordBatch]:
            machine = _automaton(each, mark)
            for b in batches:
                rows, quoted = [], []
                for k, text in enumerate(b.column("_s").to_pylist()):
                    for form in {n for _, n in machine.iter(text)}:
                        quoted += who[form]
                        rows += [k] * len(who[form])
                yield pa.RecordBatch.from_arrays([pa.array(quoted, quote_type), b.column(source_id).take(pa.array(rows, pa.int64()))], [quote_id, source_id])

        found = found.unionByName(forms.filter("_s is not null").mapInArrow(hits, ddl))
    return found.distinct()


def grounding(quotes: DataFrame, sources: DataFrame, quote_id: str, source_id: str, automata: int | None = None) -> DataFrame:
    """(quote_id, source_id) of every quote that stands in a source, for all quotes against all sources, each pair once.

    Quotes go along with the tasks as automata of bounded size, each of which finds all its quotes in a source in one pass over its text; no
    source text is cut up or shuffled, only the pairs found are. Quotes that would take more than ``automata`` of them are joined by a shared
    gram instead (``grounding_by_grams``). Blank quotes stand nowhere; null texts hold none.
    """
    q = quotes.select(quote_id, T.grounding_form(F.col("text")).alias("_q")).filter("_q <> ''")
    if (q.agg(F.sum(F.length("_q"))).first()[0] or 0) > (AUTOMATA if automata is None else automata) * AUTOMATON_CHARS:
        return grounding_by_grams(quotes, sources, quote_id, source_id)
    return _by_automata(q, sources.select(source_id, T.grounding_form(F.col("text")).alias("_s")), quote_id, source_id)


#: Bits of the filter that grams of sources pass before they are shuffled, and tasks that a gram is dealt to.
FILTER_BITS, SALTS = 1 << 24, 16


def key_bits(quotes: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys (_key) with one hash, made by Spark in maps of 4 kB, FILTER_BITS in all."""
    # counted from one: bucket n holds the numbers from 32768 (n - 1) + 1 on
    place = F.pmod("_key", F.lit(FILTER_BITS)) + 1
    maps = quotes.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    bits = np.zeros(FILTER_BITS + (1 << 15), bool)
    for r in maps.collect():
        own = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")
        bits[(r.n - 1) << 15 : ((r.n - 1) << 15) + len(own)] |= own.astype(bool)
    return bits


def grounding_by_grams(quotes: DataFrame, sources: DataFrame, quote_id: str, source_id: str, gram: int = 8) -> DataFrame:
    """The rows of ``grounding`` by a containment join through a shared gram, for more quotes than automata can hold.

    A quote's first ``gram`` whole words must stand in the source in this order. Only hashes of grams are shuffled, and of a source only those
    that a filter of the quotes' hashes lets pass; they give candidate pairs, to which the texts are joined once and compared in
    full. Quotes of fewer words are joined on what they have, and those of one or two, which share no whole word, are left to automata.
    """
    cut = lambda c: F.filter(F.split(T.grounding_form(c), " "), lambda w: w != "")
    q = quotes.select(quote_id, T.grounding_form(F.col("text")).alias("_q"), cut(F.col("text")).alias("_w")).filter("_q <> ''")
    # words at the ends may be parts of words in the source; the inner ones may not
    inner = F.when(F.size("_w") > 2, F.slice("_w", 2, F.least(F.lit(gram), F.size("_w") - 2))).otherwise(F.array().cast("array<string>"))
    q = q.withColumn("_inner", inner).withColumn("_n", F.size("_inner")).withColumn("_key", F.xxhash64("_inner"))
    # as many sizes at most as a gram has words
    sizes = sorted(r["_n"] for r in q.select("_n").distinct().collect())
    forms = sources.select(source_id, T.grounding_form(F.col("text")).alias("_s"))
    found = _by_automata(q.filter("_n = 0").select(quote_id, "_q"), forms, quote_id, source_id)
    if long := [n for n in sizes if n]:
        kind, bits = dict(sources.dtypes)[source_id], key_bits(q.filter("_n > 0"))

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("_keys")
                keys = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                may = bits[keys % FILTER_BITS] if len(keys) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column(source_id).take(pa.array(row[may])), pa.array(keys[may], pa.int64())], [source_id, "_key"])

        grams = F.array_distinct(F.flatten(F.array(*[_gram_hashes("_w", n) for n in long])))
        keys = sources.filter("text is not null").select(source_id, cut(F.col("text")).alias("_w")).select(source_id, grams.alias("_keys")).mapInArrow(known, f"{source_id} {kind}, _key long")
        # a common gram is dealt to several tasks
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        left = keys.withColumn("_salt", F.pmod(F.xxhash64(source_id), F.lit(SALTS)))
        pairs = left.join(q.filter("_n > 0").select(quote_id, "_key", every.alias("_salt")), ["_key", "_salt"]).select(quote_id, source_id).distinct()
        found = found.unionByName(pairs.join(q.select(quote_id, "_q"), quote_id).join(forms, source_id).filter(F.contains("_s", "_q")).select(quote_id, source_id).distinct())
    return found


def _gram_hashes(words_: str, n: int) -> Column:
    """Hashes of every n words in a row."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words_) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words_, i, n)))


def fabricated(cited: Column, offered: Column) -> Column:
    """Cited identifiers that were not offered, repeats kept."""
    return F.filter(cited, lambda c: ~F.coalesce(F.array_contains(offered, c), F.lit(False)))


def schema_gate(raw: Column, ddl: str, required: list[str]) -> tuple[Column, Column]:
    """(parsed, valid): malformed text, a missing or a wrongly typed required field is invalid; never an error."""
    parsed = F.from_json(raw, ddl)
    valid = F.lit(True)
    for name in required:
        valid = valid & parsed[name].isNotNull()
    return parsed, F.coalesce(valid, F.lit(False))


def failure_kind(error: Column) -> Column:
    """rate_limit, transient or permanent, of ``ClassName message``. A number counts only where it is a status: a user 429 is none."""
    low = F.lower(error)
    any_of = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(low, m))
    status = lambda codes: low.rlike("|".join(f"(?:{p.format(codes)})" for p in STATUS))
    return F.when(any_of(RATE_LIMIT) | status(RATE_LIMIT_CODES), "rate_limit").when(any_of(TRANSIENT) | status(TRANSIENT_CODES), "transient").otherwise("permanent")


# How an error states a waiting time, and the model to use instead.
RETRY = (r"(?i)retry in ([\d.]+)\s*s", r"(?i)retry_?delay[\"'\s:]+([\d.]+)\s*s")
REPLACEMENT = r"(?i)use\s+models/([\w.\-]+)"


def retry_after(error: Column) -> Column:
    first, second = (F.try_to_number(F.nullif(F.regexp_extract(error, p, 1), F.lit("")), F.lit("999999.999")) for p in RETRY)
    return F.coalesce(first, second).cast("double")


def replacement_model(error: Column) -> Column:
    return F.nullif(F.regexp_extract(error, REPLACEMENT, 1), F.lit(""))
