"""Corpus review and labelling: candidate mining, contradictions of durations, deferrals, joins of labels and decisions."""

from __future__ import annotations

import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators.evaluate import upper_median
from quillspark.operators.store import first_per_group

# Topics in the order in which a clause is put under the first that fits, and phrases that defer to other documents.
TOPICS = ("audit log", "log", "retain", "retention", "notif", "review")
DEFERRAL = r"(?i)governed by|as set out in|in accordance with the applicable"


def candidates(sections: DataFrame, documents: DataFrame, key: str, wanted: str, unwanted: str | None, limit: int, term: str, low: int = 300, high: int = 4000, domain: str | None = None) -> DataFrame:
    """The densest section of each document, then the densest of those: sections (key, ordinal, heading, body).

    The body must match wanted, and domain if given; the heading must be there and not match unwanted (None leaves that
    test out). wanted and domain are whole words, unwanted any part of the heading, all in any case.
    """
    word = lambda p: F.col("body").rlike(rf"(?i)\b(?:{p})\b")
    ok = F.length("body").between(low, high) & word(wanted) & F.col("heading").isNotNull()
    if domain:
        ok = ok & word(domain)
    if unwanted:
        ok = ok & ~F.col("heading").rlike(f"(?i)(?:{unwanted})")
    rows = sections.filter(ok).join(documents.select(key), key).withColumn("density", T.term_density(F.col("body"), term))
    return first_per_group(rows, key, "density", "ordinal", limit)


def inventory(sections: DataFrame, documents: DataFrame, key: str, domain: str, term: str = "shall") -> DataFrame:
    """(key, sections, domain_sections, usable) of every document, those without sections too: sections that speak of the domain, and of them those with the term."""
    word = lambda p: F.col("body").rlike(rf"(?i)\b(?:{p})\b")
    own = sections.select(key, word(domain).alias("_d"), (word(domain) & word(term)).alias("_u")).groupBy(key).agg(F.count("*").alias("sections"), F.count_if("_d").alias("domain_sections"), F.count_if("_u").alias("usable"))
    return documents.select(key).join(own, key, "left").fillna(0, ["sections", "domain_sections", "usable"])


def corpus_shape(clauses: DataFrame) -> DataFrame:
    """(by, name, clauses, low, median, high) of clause lengths: of all, by domain and by policy; the median is at index n // 2."""
    d = clauses.select(F.length("text").alias("chars"), F.explode(F.array(F.struct(F.lit("all").alias("by"), F.lit("").alias("name")), F.struct(F.lit("domain").alias("by"), F.col("domain").alias("name")), F.struct(F.lit("policy").alias("by"), F.col("policy_id").alias("name")))).alias("g"))
    return upper_median(d, "g", "chars").select("g.by", "g.name", F.col("n").alias("clauses"), "low", "median", "high")


def with_original(assessments: DataFrame, clauses: DataFrame, ref: str = "ref") -> DataFrame:
    """assessments with original, the text of the first clause (by ordinal) with their reference, empty where there is none."""
    first = clauses.groupBy(ref).agg(F.min_by("text", "ordinal").alias("original"))
    return assessments.join(first, ref, "left").withColumn("original", F.coalesce("original", F.lit("")))


def with_edits(cases: DataFrame, edits: DataFrame) -> DataFrame:
    """Draft cases (id, candidates array<string>, relevant, verified) with what people decided, edits (id, picks, at).

    Of several edits of a case the last counts. picks are numbers from 1 in the candidates: those clauses are relevant; an empty
    array says that none is; null leaves the case as it is. Numbers without a candidate are dropped.
    """
    last = edits.groupBy("id").agg(F.max_by(F.struct("picks"), "at")["picks"].alias("_picks"))
    chosen = F.array_distinct(F.transform(F.filter("_picks", lambda p: (p >= 1) & (p <= F.size("candidates"))), lambda p: F.element_at("candidates", p.cast("int"))))
    d = cases.join(last, "id", "left").withColumn("_judged", F.col("_picks").isNotNull())
    return d.withColumn("relevant", F.when(F.col("_judged"), chosen).otherwise(F.col("relevant"))).withColumn("verified", F.col("_judged") | F.coalesce("verified", F.lit(False))).drop("_picks", "_judged")


def unindexed(chunks: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("ref", "part")) -> DataFrame:
    """Chunks that have no vector in the index yet, by part and not by reference, so half a section is not skipped."""
    return chunks.join(index.filter("embedding is not null").select(*keys).distinct(), list(keys), "left_anti")


def topic(text: Column, heading: Column) -> Column:
    """The first topic that stands in text or heading, or null."""
    low = F.lower(F.concat_ws(" ", text, heading))
    found = F.lit(None).cast("string")
    for t in reversed(TOPICS):
        found = F.when(F.contains(low, F.lit(t)), F.lit(t)).otherwise(found)
    return found


def topic_durations(clauses: DataFrame) -> DataFrame:
    """(topic, days, phrase, clause_id, heading) of every duration in clauses that have a topic; read together, do they agree?"""
    d = clauses.withColumn("topic", topic(F.col("text"), F.col("heading"))).filter("topic is not null").withColumn("d", F.explode(T.durations(F.col("text"))))
    return d.select("topic", F.col("d.days").alias("days"), F.col("d.phrase").alias("phrase"), "clause_id", "heading")


def log_retention(clauses: DataFrame) -> DataFrame:
    """Distinct durations under both log topics whose heading speaks of logs or keeping."""
    d = topic_durations(clauses).filter(F.col("topic").isin("audit log", "log") & F.lower("heading").rlike("retain|retention|log"))
    return d.select("days", "phrase", "clause_id", "heading").distinct().orderBy("days", "phrase", "clause_id", "heading")


def defers(text: Column) -> Column:
    return text.rlike(DEFERRAL)


def stale_policies(clauses: DataFrame, today: Column, months: int = 24) -> DataFrame:
    return clauses.filter(T.months_stale(F.col("last_reviewed"), today, months)).select("policy_id", "policy_title", "last_reviewed").distinct().orderBy("policy_id", "policy_title", "last_reviewed")


def with_truth(decisions: DataFrame, truth: DataFrame, text: str = "query", order: str = "at") -> DataFrame:
    """Decisions joined with the truth on their text after collapsing white space; of repeated truths the last counts, decisions without one go."""
    key = T.collapsed(F.col(text))
    w = Window.partitionBy("_key").orderBy(F.desc(order))
    last = truth.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", text, order)
    return decisions.withColumn("_key", key).join(last, "_key").drop("_key")


def broken_labels(cases: DataFrame, clauses: DataFrame, ref: str = "ref") -> DataFrame:
    """(id, ref, known) of every label; known is false where no clause has it."""
    named = cases.select("id", F.explode("relevant").alias(ref))
    return named.join(clauses.select(ref).distinct().withColumn("_k", F.lit(True)), ref, "left").select("id", ref, F.col("_k").isNotNull().alias("known"))


def header_changes(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with starts: whether a new group begins, in the given order within part."""
    before = F.lag(group).over(Window.partitionBy("part").orderBy(order))
    return rows.withColumn("starts", ~F.col(group).eqNullSafe(before) | before.isNull())


def runs_compared(runs: DataFrame) -> DataFrame:
    """One row a saved run (file, label, recall_1, mrr, separation), by file name; undefined figures are n/a."""
    shown = lambda c: F.coalesce(F.format_number(c, 3), F.lit("n/a")).alias(c)
    return runs.select("file", "label", *[shown(c) for c in ("recall_1", "mrr", "separation")]).orderBy("file")


def wrapped(text: str | None, width: int = 70) -> str:
    return "\n".join(textwrap.wrap(text or "", width))
