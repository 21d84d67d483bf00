import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.functions import metrics as M
from quillspark.operators import decide, evaluate, providers, validate

# judges run in workers that can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_field_rules(spark):
    df = spark.createDataFrame([("x" * 25, "keep it", "provider", "mandatory"), ("  short ", " ", "nobody", None), ("q" * 40, "w " * 16, None, "recommended")], "q string, a string, p string, m string")
    got = [r[0] for r in df.select(validate.obligation_violations(*map(F.col, "qapm"))).collect()]
    assert got == [[], ["quote_short", "action_blank", "party_unknown", "modality_unknown"], ["action_long", "party_unknown"]]
    df = spark.createDataFrame([("affected", "high", "y" * 30), ("maybe", "grave", " " * 40), ("ambiguous", None, "z" * 31)], "v string, s string, r string")
    assert [r[0] for r in df.select(validate.assessment_violations(*map(F.col, "vsr"))).collect()] == [[], ["verdict_unknown", "severity_unknown", "reasoning_short"], []]


def test_results_cite_each_place_once_and_agree_with_themselves(spark):
    rows = [(["a", "b"], False), (["a", "b", "a", "b", "b"], True), ([], True), ([], False)]
    df = spark.createDataFrame([([(r,) for r in refs], none) for refs, none in rows], "o array<struct<source_ref: string>>, n boolean")
    got = df.select(validate.result_violations(F.col("o"), F.col("n")), validate.repeated(F.transform("o", lambda x: x["source_ref"]))).collect()
    assert [r[0] for r in got] == [[], ["refs_repeated", "says_none_but_has_some"], [], []] and got[1][1] == ["a", "b"]


def test_grounding_variants(spark):
    source = "Each covered entity must retain the\n required “audit logs” for six years — no less."
    quotes = {"retain the required \"audit logs\"": True, "RETAIN  THE required": True, "must retain any": False, "six years - no less": True, "entity must retain the required “audit logs” for five years": False}
    df = spark.createDataFrame([(q, source) for q in quotes], "q string, s string")
    assert [r[0] for r in df.select(validate.grounded(F.col("q"), F.col("s"))).collect()] == list(quotes.values())
    q = spark.createDataFrame([*enumerate(quotes), (9, "og"), (10, "ired")], "id long, text string")
    got = validate.grounding(q, spark.createDataFrame([(7, source), (8, None)], "sid long, text string"), "id", "sid").collect()
    assert sorted(map(tuple, got)) == [(k, 7) for k, ok in enumerate(quotes.values()) if ok] + [(9, 7), (10, 7)]


def test_citations_keep_repeats(spark):
    assert one(spark, validate.fabricated(F.array(*map(F.lit, "axbx")), F.array(*map(F.lit, "ab"))))[0] == ["x", "x"]


def test_schema_gate(spark):
    df = spark.createDataFrame([('{"a": "x", "n": 1}',), ('{"a": "x"}',), ('{"a": "x", "n": "y"}',), ("nonsense",), (None,)], "j string")
    _, valid = validate.schema_gate(F.col("j"), "a string, n int", ["a", "n"])
    assert [r[0] for r in df.select(valid).collect()] == [True, False, False, False, False]


def test_gate_and_route(spark):
    top, margin = decide.top_and_margin(F.array(F.lit(0.8), F.lit(0.7)))
    assert one(spark, top, F.round(margin, 6), decide.gate(top, F.lit(2)), decide.gate(F.lit(0.5), F.lit(2)), decide.gate(F.lit(0.0), F.lit(0)))[1:] == (0.1, None, "no candidate above the threshold", "retrieval returned nothing")


def test_confidence_is_the_weakest_signal(spark):
    c = lambda *a: one(spark, decide.confidence(*[F.lit(x) for x in a]))[0]
    assert c(0.85, 0.05, 0, 0, "") == 1.0 and c(0.85, 0.05, 1, 0, "") == 0.0
    assert c(0.85, 0.05, 0, 1, "") == c(0.85, 0.05, 0, 0, "hm") == 0.4
    assert c(0.76, 0.05, 0, 0, "") == 0.5 and c(0.85, -0.1, 0, 0, "") == 0.0
    assert c(0.7, 0.05, 0, 0, "") < c(0.8, 0.05, 0, 0, "")


WHY = "the clause states the same duty as the obligation"
ITEMS = "item long, query string, candidates array<struct<ref: string, context: string, body: string, similarity: double>>"


def pair(a, b):
    return [("r1", "c", "b", a), ("r2", "c", "b", b)]


def said(*ids, verdict="affected", **more):
    return {"assessments": [{"clause_id": i, "verdict": verdict, "reasoning": WHY, **more} for i in ids]}


def test_decisions_retry_and_gate(spark):
    items = spark.createDataFrame([(1, "good", pair(0.9, 0.7)), (2, "low", pair(0.5, 0.4)), (3, "liar", pair(0.9, 0.7)), (4, "learns", pair(0.9, 0.7)), (5, "none", []), (6, "broken", pair(0.9, 0.7)), (7, "unsure", pair(0.9, 0.7))], ITEMS)

    def judge(prompt, candidates, feedback):
        query = prompt.split("\n")[1]
        if query == "liar" or query == "learns" and not feedback:
            return said("invented")
        if query == "broken":  # four kinds of malformed answers, each told what was wrong
            return {"": "no json {", "not JSON": {"assessments": [{"verdict": "affected"}]}}.get(feedback[:8], json.dumps(said("r1", severity="high")))
        return said(*[c["ref"] for c in candidates]) | ({"ambiguity_note": "defers to a missing annex"} if query == "unsure" else {})

    got = {r.item: r for r in decide.decided(items, judge).collect()}
    assert (got[1].route, got[1].model_calls, got[1].affected) == ("auto_filed", 1, ["r1", "r2"])
    assert got[1].reason == "retrieval 1.00 (top 0.900), margin 1.00 (0.200), integrity 1.00"
    assert (got[2].route, got[2].model_calls, got[2].affected) == ("human_review", 0, []) and got[5].reason == "retrieval returned nothing"
    assert (got[3].confidence, got[3].model_calls, got[3].reason) == (0.0, 3, "no valid grounded assessment after 3 attempts")
    assert got[3].attempts[0] == "attempt 1: cited ['invented'] which were not offered" and (got[4].route, got[4].model_calls) == ("auto_filed", 2)
    assert got[6].attempts == ["attempt 1: schema invalid", "attempt 2: schema invalid"] and got[6].assessments[0].severity == "high"
    assert got[7].confidence == 0.4 and got[7].reason.endswith("integrity 0.40 — obligation itself is ambiguous") and got[7].route == "human_review"


def test_malformed_answers_are_described():
    ok, why = decide.checked(said("r1"))
    assert ok["assessments"][0]["severity"] == "none" and why == ""
    for answer, part in [("{", "not JSON"), ([], "assessments"), ({"assessments": [3]}, "clause_id"), (said("r", verdict="yes"), "verdict"), (said("r", severity="grave"), "severity"), (said("r") | {"ambiguity_note": 3}, "ambiguity_note"), ({"assessments": [{"clause_id": "r", "verdict": "affected", "reasoning": "short"}]}, "reasoning")]:
        assert decide.checked(answer)[0] is None and part in decide.checked(answer)[1]


def test_the_budget_covers_all_retries(spark):
    items = spark.createDataFrame([(k, "liar", pair(0.9, 0.7)) for k in range(4)], ITEMS).coalesce(1)
    bad = lambda *_: said("invented")
    assert sum(r.model_calls for r in decide.decided(items, bad, calls=12).collect()) == 12
    with pytest.raises(Exception, match="call budget of 11 is spent"):
        decide.decided(items, bad, calls=11).collect()


def test_explanations_name_what_lowers_integrity(spark):
    why = one(spark, decide.explanation(*[F.lit(x) for x in (0.76, 0.02, 2, 1, "x")]))[0]
    assert why == "retrieval 0.50 (top 0.760), margin 0.40 (0.020), integrity 0.00 — 2 fabricated citation(s); 1 clause(s) marked ambiguous; obligation itself is ambiguous"


def test_views_and_prompt(spark):
    df = spark.createDataFrame([([("a", "affected"), ("b", "ambiguous"), ("c", "affected")], pair(0.9, 0.7))], "s array<struct<clause_id: string, verdict: string>>, c array<struct<ref: string, context: string, body: string, similarity: double>>")
    got = df.select(*decide.views(F.col("s")), decide.prompt_candidates(F.col("c"))).first()
    assert got[0] == ["a", "c"] and got[1] == ["b"] and got[2] == "[1] r1\n    c\n    b\n\n[2] r2\n    c\n    b"


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["c", "z"], 0.8), (2, ["a"], [], 0.5), (3, ["q"], ["q"], 0.6)], "id long, retrieved array<string>, relevant array<string>, top_score double")
    s = evaluate.summary(df).first()
    assert (s.cases, s.answerable, s.hit_1, s.recall_3, s.mrr, s.separation) == (3, 2, 0.5, 0.75, 0.667, 0.2)
    assert evaluate.summary(df.filter("id = 1")).first().separation is None
    assert [r[0] for r in df.orderBy("id").select(M.missed(F.col("retrieved"), F.col("relevant"))).collect()] == [["z"], [], []]
    assert [r[0] for r in df.orderBy("id").select(M.first_hit_rank(F.col("retrieved"), F.col("relevant"))).collect()] == [3, None, 1]


def test_floor_percentile(spark):
    assert one(spark, evaluate.floor_percentile(F.array(F.lit(1.0), F.lit(2.0)), 0.5), evaluate.floor_percentile(F.array().cast("array<double>"), 0.5))[:] == (2.0, 0.0)


class ServerError(Exception):
    pass


def test_calls_are_retried_within_the_budget():
    tries = []

    def fn(fails, kind=ServerError, text="503"):
        tries.append(1)
        if len(tries) <= fails:
            raise kind(text)
        return "done"

    waits = []
    assert providers.call(lambda: fn(2), providers.Budget(5), wait=waits.append) == "done" and len(waits) == 2 and waits[1] > waits[0]
    tries.clear()
    with pytest.raises(RuntimeError):
        providers.call(lambda: fn(9), providers.Budget(2), attempts=9, wait=waits.append)
    tries.clear()
    with pytest.raises(ServerError):
        providers.call(lambda: fn(9, text="quota"), providers.Budget(50), wait=waits.append)
    tries.clear()
    assert providers.call(lambda: fn(7, text="quota"), providers.Budget(50), rate_limit_is_fatal=False, wait=waits.append) == "done"
    with pytest.raises(ValueError):
        tries.clear()
        providers.call(lambda: fn(1, ValueError, "bad"), providers.Budget(50), wait=waits.append)


def test_word_diff():
    assert providers.word_diff("keep six years", "keep seven full years") == "keep [-six-] [+seven full+] years"
    assert providers.word_diff(None, "a") == "[+a+]" and providers.word_diff("a", "a") == "a"


def test_percentiles_by_rank(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), None if v == 9 else float(v)) for g, v in zip(rng.integers(0, 7, 400), rng.integers(0, 10, 400), strict=True)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r.g: r for r in evaluate.floor_percentiles(df, "g", "v", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()}
    median = {r.g: r for r in evaluate.upper_median(df, "g", "v").collect()}
    for g in range(7):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert tuple(got[g][1:]) == tuple(v[min(int(p * len(v)), len(v) - 1)] for p in (0, 0.5, 0.9, 1)) and tuple(median[g][1:]) == (len(v), v[0], v[len(v) // 2], v[-1])
    plan = evaluate.floor_percentiles(df, "g", "v", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(" not in plan and "Window" not in plan


def test_selection_of_any_values(spark, monkeypatch):
    """Signs, zeros, infinities, tiny values, whole numbers, a null group, groups of one; by broadcast and by salt."""
    rng = np.random.default_rng(2)
    odd = [-1e300, -2.5, -0.0, 0.0, 1e-310, 3.25, 7.0, 1e9, float("inf"), float("-inf")]
    rows = [(["a", "b", None][rng.integers(0, 3)], float(rng.choice(odd) if rng.random() < 0.5 else rng.uniform(-5, 5))) for _ in range(900)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for sent in (100_000, 0):
        monkeypatch.setattr(evaluate, "STATES_SENT", sent)
        got = {r.g: (r.p, r.q) for r in evaluate.floor_percentiles(df, "g", "v", {"p": 0.37, "q": 0.5}).collect()}
        for g in ("a", "b", None, "one"):
            v = sorted(x for k, x in rows if k == g and x is not None)
            assert got.pop(g) == (v[min(len(v) - 1, int(0.37 * len(v)))], v[len(v) // 2])
        assert not got
    whole = spark.createDataFrame([("x", k - 50) for k in range(101)], "g string, v int")
    assert evaluate.upper_median(whole, "g", "v").collect()[0][:] == ("x", 101, -50, 0, 50)
    assert evaluate.upper_median(whole.limit(0), "g", "v").collect() == []
    with pytest.raises(ValueError):
        evaluate.upper_median(whole.withColumn("v", F.lit("a")), "g", "v")


def test_a_cap_on_calls_holds_for_all_tasks(spark):
    """The shares of partitions and attempts add up to the cap; an attempt that wasn't planned for has none."""
    for limit, partitions, attempts in ((10, 100, 1), (10, 3, 1), (7, 4, 2), (0, 5, 1)):
        shares = [providers.call_share(limit, partitions, n, a, attempts) for n in range(partitions) for a in range(attempts + 1)]
        assert sum(shares) == limit and all(providers.call_share(limit, partitions, n, attempts, attempts) == 0 for n in range(partitions))
    texts = spark.createDataFrame([(f"text {k}",) for k in range(40)], "text string")
    assert providers.embedded(texts, "text", batch=1, calls=40 * 4, partitions=4).count() == 40
    with pytest.raises(Exception, match="call budget"):
        providers.embedded(texts, "text", batch=1, calls=20, partitions=8).collect()


def test_grounding_by_automata_and_by_grams(spark, monkeypatch):
    """Both ways find what plain containment finds: quotes of any length, repeated, blank, in several automata."""
    sources = [(k, " ".join(f"w{(k * 7 + i) % 50}" for i in range(60))) for k in range(30)] + [(99, None)]
    quotes = [(k, " ".join(f"w{(k * 7 + i) % 50}" for i in range(k % 12 + 1))) for k in range(40)] + [(100, "W3  w4"), (101, " "), (102, "nothing here at all to find my friend"), (103, "W3 w4"), (104, None)]
    want = sorted((i, j) for i, t in quotes for j, s in sources if s and t and t.strip() and " ".join(t.lower().split()) in s)
    q, s = spark.createDataFrame(quotes, "id long, text string"), spark.createDataFrame(sources, "sid long, text string")
    assert sorted(map(tuple, validate.grounding(q, s, "id", "sid").collect())) == want
    assert sorted(map(tuple, validate.grounding(q, s, "id", "sid", automata=0).collect())) == want
    monkeypatch.setattr(validate, "AUTOMATON_CHARS", 300)
    assert sorted(map(tuple, validate.grounding(q, s, "id", "sid").collect())) == want
    assert validate.grounding(q.limit(0), s, "id", "sid").collect() == []


def test_component_summary(spark):
    runs = spark.createDataFrame([(0.85, 0.01), (0.76, 0.04), (0.70, None)], "top_score double, margin double")
    r = evaluate.component_summary(runs).first()
    assert (r.judged, r.margin_binds, r.retrieval_low, r.retrieval_median, r.retrieval_high) == (3, 2, 0.166667, 0.5, 1.0)
    assert (r.margin_low, r.margin_median, r.margin_high, r.margin_dominates) == (0.0, 0.2, 0.8, True)


def test_batches_are_committed_one_by_one(spark, tmp_path):
    chunks = spark.createDataFrame([(f"r{k}", k % 2, f"text {k}") for k in range(30)], "ref string, part int, text string")
    asked = []

    def embed(texts):
        asked.extend(texts)
        return [[1.0, 2.0]] * len(texts)

    path = str(tmp_path / "index")
    assert providers.index_in_batches(chunks.limit(0), path) == 0
    assert providers.index_in_batches(chunks, path, rows=10, embed=embed) == 3
    done = spark.read.parquet(path)
    assert done.count() == done.select("ref", "part").distinct().count() == 30 and done.filter("embedding is null").count() == 0
    assert providers.index_in_batches(chunks, path, rows=10, embed=lambda t: 1 / 0) == 0


def test_embedding_tasks_and_rate(spark):
    pauses = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(f"t{k}",) for k in range(9)], "t string").coalesce(1)
    both = lambda texts, task: [[float(len(task))]] * len(texts)
    got = providers.embedded(df, "t", both, batch=2, per_minute=4, task="query", wait=lambda s: pauses.add(1)).collect()
    assert [r.embedding for r in got] == [[5.0]] * 9 and pauses.value == 2
    with pytest.raises(ValueError):
        providers.embedded(df, "t", task="other")


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("",)], "t string")
    got = [list(r.embedding) for r in providers.embedded(df, "t").collect()]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-6 and not any(got[2])


def test_agent_candidates_carry_whole_texts(spark, monkeypatch):
    from quillspark.plans import catalog

    sf = "/root/testdata/sf0.001"
    seen = []
    real = catalog.decide.decided
    monkeypatch.setattr(catalog.decide, "decided", lambda items, **more: seen.append(items) or real(items, **more))
    catalog.agent_pipeline(spark, sf)
    offered = {int(c.ref): c.body for r in seen[0].collect() for c in r.candidates if c.body}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert max(map(len, offered.values())) > 200
    assert offered == {i: texts[i] for i in offered}


def test_numbers_that_are_no_status(spark):
    """A user, an amount or a longer number that holds the digits of a status code is none; real ones count wherever they stand."""
    want = {
        "TimeoutError answer timeout of user 429": "transient", "ValueError of user 503": "permanent", "ValueError row 5000 of 42900": "permanent", "NotFound: use models/m-500 instead": "permanent",
        "ClientError 429 RESOURCE": "rate_limit", "ClientError code: 429": "rate_limit", "APIError: got 503": "transient", "ClientError {'code': 502}": "transient", "X failed, HTTP/1.1 504": "transient",
        "X the server said 500 Internal Server Error": "transient", "X (status 429)": "rate_limit", "HTTPError: 500 at /v1": "transient",
    }
    rows = spark.createDataFrame([(e,) for e in want], "e string").select("e", validate.failure_kind(F.col("e")).alias("kind")).collect()
    assert {r.e: r.kind for r in rows} == want


def test_selection_sorts_small_groups(spark, monkeypatch):
    """Small groups cost one shuffle of their rows and no radix rounds; with large ones among them, a null one too, rows are those of sorting."""
    rng = np.random.default_rng(3)
    size = {"big": 300, None: 250, "a": 40, "b": 1, "c": 200}
    rows = [(g, float(v)) for g, n in size.items() for v in rng.integers(-9, 9, n) / 4] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: sorted(v for k, v in rows if k == g and v is not None) for g in size}
    radix, met = evaluate._radix_selected, []
    monkeypatch.setattr(evaluate, "_radix_selected", lambda own, *rest: met.append({r.g for r in own.collect()}) or radix(own, *rest))
    for limit, large in ((1 << 16, []), (200, [{"big", None}]), (0, [set(size)])):
        monkeypatch.setattr(evaluate, "SORTED_ROWS", limit)
        met.clear()
        got = {r.g: r for r in evaluate.upper_median(df, "g", "v").collect()}
        assert met == large and {g: tuple(got[g][1:]) for g in got} == {g: (len(v), v[0], v[len(v) // 2], v[-1]) for g, v in want.items()}


def test_radix_selection_of_any_values(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SORTED_ROWS", 0)
    test_selection_of_any_values(spark, monkeypatch)
