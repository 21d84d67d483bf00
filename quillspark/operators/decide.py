"""Gate, derived confidence, route, and the decision pipeline with a pluggable judge."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.providers import call, task_budget
from quillspark.operators.validate import SEVERITIES, VERDICTS

AUTO, REVIEW = "auto_filed", "human_review"


@dataclass(frozen=True)
class Thresholds:
    """Fitted to one embedding model; parameters, not constants."""

    retrieval: float = 0.67
    retrieval_span: float = 0.18
    margin_span: float = 0.05
    ambiguous: float = 0.4
    confidence: float = 0.60


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def top_and_margin(similarities: Column) -> tuple[Column, Column]:
    """Of similarities in rank order; missing ones count 0."""
    top = F.coalesce(F.get(similarities, 0), F.lit(0.0))
    return top, top - F.coalesce(F.get(similarities, 1), F.lit(0.0))


def components(top: Column, margin: Column, failures: Column, ambiguous: Column, note: Column, t: Thresholds = Thresholds()) -> tuple[Column, Column, Column]:
    """Retrieval, margin and integrity, each from 0 to 1."""
    integrity = F.when(failures > 0, 0.0).when((ambiguous > 0) | (F.coalesce(note, F.lit("")) != ""), t.ambiguous).otherwise(1.0)
    return _clamped((top - t.retrieval) / t.retrieval_span), _clamped(margin / t.margin_span), integrity


def confidence(top: Column, margin: Column, failures: Column, ambiguous: Column, note: Column, t: Thresholds = Thresholds()) -> Column:
    """The weakest of three signals, so that none can cover up for another; in whole thousandths, which are rounded as SQL's ``round`` does it."""
    return F.round(F.least(*components(top, margin, failures, ambiguous, note, t)) * 1000) / 1000


def explanation(top: Column, margin: Column, failures: Column, ambiguous: Column, note: Column, t: Thresholds = Thresholds()) -> Column:
    """The three signals with what they come from, and what lowers integrity; numbers are rounded by their exact values, ties to the even digit."""
    parts = components(top, margin, failures, ambiguous, note, t)
    # format_string rounds the shortest decimal, so 0.5185, which is a little less in binary, would come out as 0.519
    shown = F.udf(lambda *x: None if None in x else "retrieval {:.2f} (top {:.3f}), margin {:.2f} ({:.3f}), integrity {:.2f}".format(*x), "string")
    why = shown(parts[0], top, parts[1], margin, parts[2])
    notes = F.array_compact(F.array(
        F.when(failures > 0, F.concat(failures.cast("string"), F.lit(" fabricated citation(s)"))),
        F.when(ambiguous > 0, F.concat(ambiguous.cast("string"), F.lit(" clause(s) marked ambiguous"))),
        F.when(F.coalesce(note, F.lit("")) != "", F.lit("obligation itself is ambiguous")),
    ))
    return F.when(F.size(notes) > 0, F.concat(why, F.lit(" — "), F.array_join(notes, "; "))).otherwise(why)


def gate(top: Column, candidates: Column, t: Thresholds = Thresholds()) -> Column:
    """Null if the judge should see the item, else why not."""
    return F.when(candidates == 0, "retrieval returned nothing").when(top < t.retrieval, "no candidate above the threshold")


def route(c: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(c >= t.confidence, AUTO).otherwise(REVIEW)


def prompt_candidates(candidates: Column) -> Column:
    """A numbered list of candidates (ref, context, body)."""
    return F.array_join(F.transform(candidates, lambda c, i: F.format_string("[%d] %s\n    %s\n    %s", i + 1, c["ref"], c["context"], c["body"])), "\n\n")


#: Given a prompt, the candidates and the feedback on the last answer, JSON text or what it stands for:
#: {"assessments": [{clause_id, verdict, severity, reasoning, proposed_text}], "ambiguity_note"}.
Judge = Callable[[str, list[dict], str], "str | dict"]
ASSESSMENTS = "array<struct<clause_id: string, verdict: string, severity: string, reasoning: string, proposed_text: string>>"


def first_judge(prompt: str, candidates: list[dict], feedback: str) -> dict:
    """Offline stand-in: the best candidate is affected, one as similar is ambiguous, others are not."""
    top = candidates[0]["similarity"] or 0.0
    verdict = lambda i, c: "affected" if i == 0 else "ambiguous" if top - (c["similarity"] or 0.0) < 1e-3 else "not_affected"
    return {"assessments": [{"clause_id": c["ref"], "verdict": verdict(i, c), "reasoning": "decided by the order of similarity alone"} for i, c in enumerate(candidates)]}


def checked(answer) -> tuple[dict | None, str]:
    """(analysis, "") of a well-formed answer, else (None, what is wrong with it)."""
    if isinstance(answer, str):
        try:
            answer = json.loads(answer)
        except ValueError as e:
            return None, f"not JSON: {e}"
    if not isinstance(answer, dict) or not isinstance(answer.get("assessments"), list):
        return None, "assessments: a list is required"
    wrong, found = [], []
    for i, a in enumerate(answer["assessments"]):
        a = a if isinstance(a, dict) else {}
        own = {"severity": "none", "proposed_text": None} | a
        if not isinstance(own.get("clause_id"), str):
            wrong.append(f"assessments[{i}].clause_id: text is required")
        if own.get("verdict") not in VERDICTS:
            wrong.append(f"assessments[{i}].verdict: one of {', '.join(VERDICTS)}")
        if own["severity"] not in SEVERITIES:
            wrong.append(f"assessments[{i}].severity: one of {', '.join(SEVERITIES)}")
        if not isinstance(own.get("reasoning"), str) or len(own["reasoning"].strip()) < 30:
            wrong.append(f"assessments[{i}].reasoning: at least 30 characters")
        if own["proposed_text"] is not None and not isinstance(own["proposed_text"], str):
            wrong.append(f"assessments[{i}].proposed_text: text or null")
        found.append(own)
    note = answer.get("ambiguity_note")
    if note is not None and not isinstance(note, str):
        wrong.append("ambiguity_note: text or null")
    return (None, "; ".join(wrong)) if wrong else ({"assessments": found, "ambiguity_note": note}, "")


def views(assessments: Column) -> tuple[Column, Column]:
    """Clause ids of the affected and of the ambiguous assessments."""
    of = lambda v: F.transform(F.filter(assessments, lambda a: a["verdict"] == v), lambda a: a["clause_id"])
    return of("affected"), of("ambiguous")


def decided(items: DataFrame, judge: Judge = first_judge, attempts: int = 3, t: Thresholds = Thresholds(), calls: int | None = None, partitions: int = 1, task_attempts: int = 1) -> DataFrame:
    """(item, route, confidence, reason, affected, ambiguous, assessments, attempts, top_score, margin, model_calls) from items (item, query, candidates).

    candidates is array<struct<ref, context, body, similarity>> in rank order. Gated items never reach the judge, nor do their
    candidates reach Python. A malformed answer, or one that cites what was not offered, is sent back with the reason, up to
    ``attempts`` times; then a person decides. Failures of the service are waited out within the budget: all tasks together make
    ``calls`` at most, dealt out over ``partitions`` and the ``task_attempts`` that a task may have. model_calls counts an item's own calls.
    """
    top, margin = top_and_margin(F.transform("candidates", lambda c: c["similarity"]))
    d = items.withColumns({"top_score": top, "margin": margin, "gated": gate(top, F.size("candidates"), t)})
    prompt = F.concat(F.lit("Obligation:\n"), F.coalesce("query", F.lit("")), F.lit("\n\nCandidates:\n"), prompt_candidates(F.col("candidates")))
    d = d.select("item", "top_score", "margin", "gated", F.when(F.col("gated").isNull(), prompt).alias("prompt"), F.when(F.col("gated").isNull(), F.col("candidates")).alias("candidates"))
    names = ["item", "top_score", "margin", "gated", "valid", "model_calls", "attempts", "assessments", "note"]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = task_budget(calls, partitions, task_attempts)
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                found, tried, feedback, used = None, [], "", budget.used
                if r["prompt"] is not None:
                    candidates = [dict(c.asDict() if hasattr(c, "asDict") else c) for c in r["candidates"]]
                    offered = {c["ref"] for c in candidates}
                    for n in range(1, attempts + 1):
                        found, feedback = checked(call(lambda f=feedback: judge(r["prompt"], candidates, f), budget))  # noqa: B023
                        if found is None:
                            tried.append(f"attempt {n}: schema invalid")
                            continue
                        bad = [a["clause_id"] for a in found["assessments"] if a["clause_id"] not in offered]
                        if not bad:
                            break
                        tried.append(f"attempt {n}: cited {bad} which were not offered")
                        found, feedback = None, f"not in the list of candidates: {bad}"
                keep = ("clause_id", "verdict", "severity", "reasoning", "proposed_text")
                own = [{k: a[k] for k in keep} for a in found["assessments"]] if found else []
                rows.append((r["item"], r["top_score"], r["margin"], r["gated"], found is not None, budget.used - used, tried, own, found["ambiguity_note"] if found else None))
            yield pd.DataFrame(rows, columns=names)

    kind = dict(items.dtypes)["item"]
    # a cap is dealt out over a known number of tasks
    out = (d if calls is None else d.repartition(partitions)).mapInPandas(judged, f"item {kind}, top_score double, margin double, gated string, valid boolean, model_calls long, attempts array<string>, assessments {ASSESSMENTS}, note string")
    affected, ambiguous = views(F.col("assessments"))
    signals = (F.col("top_score"), F.col("margin"), F.lit(0), F.size(ambiguous), F.col("note"), t)
    reason = F.when(F.col("gated").isNotNull(), F.col("gated")).when(F.col("valid"), explanation(*signals)).otherwise(F.lit(f"no valid grounded assessment after {attempts} attempts"))
    out = out.select("item", F.when(F.col("valid"), confidence(*signals)).otherwise(0.0).alias("confidence"), reason.alias("reason"), affected.alias("affected"), ambiguous.alias("ambiguous"), "assessments", "attempts", "top_score", "margin", "model_calls")
    return out.withColumn("route", route(F.col("confidence"), t))
