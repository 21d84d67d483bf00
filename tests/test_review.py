import datetime

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import review


CLAUSES = (
    ("P-1 §1.1", "Log keeping", "Audit logs are retained for at least six years.", "2020-01-31"),
    ("P-1 §1.2", "Audit log review", "Each audit log is kept for not less than a period of thirty (30) days.", "2020-01-31"),
    ("P-2 §1.1", "Notice", "Notify within 72 hours, as set out in the contract.", None),
    ("P-3 §2.4", "Other", "Nothing here; governed by law.", "2026-01-05"),
)


def test_log_retention_and_staleness(spark):
    c = spark.createDataFrame(CLAUSES, "clause_id string, heading string, text string, reviewed string")
    c = c.select("*", F.substring("clause_id", 1, 3).alias("policy_id"), F.col("heading").alias("policy_title"), T.strict_date(F.col("reviewed")).alias("last_reviewed"))
    assert [(r.days, r.clause_id) for r in review.log_retention(c).collect()] == [(30.0, "P-1 §1.2"), (2190.0, "P-1 §1.1")]
    assert [r.policy_id for r in review.stale_policies(c, F.lit(datetime.date(2026, 9, 10))).collect()] == ["P-1", "P-1", "P-2"]
    assert [r[0] for r in c.select(review.defers(F.col("text"))).collect()] == [False, False, True, True]


def test_candidates_need_a_heading_that_is_no_boilerplate(spark):
    body = "It shall be kept. " * 30
    rows = [(1, 0, "Scope", body), (1, 1, None, body + "shall"), (2, 0, "List of Subjects", body), (3, 0, "Duties", "shall " * 60), (4, 0, "Short", "shall"), (5, 0, "None", "shallow " * 60)]
    s = spark.createDataFrame(rows, "d long, ordinal int, heading string, body string")
    docs = s.select("d").distinct()
    assert [r.d for r in review.candidates(s, docs, "d", "shall|must", "list of subjects", 9, "shall").collect()] == [3, 1]
    assert {r.d for r in review.candidates(s, docs, "d", "shall|must", None, 9, "shall").collect()} == {1, 2, 3}
    assert [r.d for r in review.candidates(s, docs, "d", "shall", None, 9, "shall", domain="kept").collect()] == [1, 2]
    got = {r.d: r[1:] for r in review.inventory(s.filter("d < 4"), spark.range(1, 6).toDF("d"), "d", "kept").collect()}
    assert got == {1: (2, 2, 2), 2: (1, 1, 1), 3: (1, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0)}


def test_edits_and_originals(spark):
    cases = spark.createDataFrame([("a", ["x", "y", "z"], None, False), ("b", ["x"], ["x"], True), ("c", ["x"], None, None), ("d", ["x"], None, False)], "id string, candidates array<string>, relevant array<string>, verified boolean")
    edits = spark.createDataFrame([("a", [1], 1), ("a", [3, 9, 1, 3], 2), ("c", [], 1), ("d", None, 1), ("q", [1], 1)], "id string, picks array<int>, at int")
    got = {r.id: (r.relevant, r.verified) for r in review.with_edits(cases, edits).collect()}
    assert got == {"a": (["z", "x"], True), "b": (["x"], True), "c": ([], True), "d": (None, False)}
    clauses = spark.createDataFrame([("r", 2, "second"), ("r", 1, "first")], "ref string, ordinal int, text string")
    found = review.with_original(spark.createDataFrame([("r",), ("none",)], "ref string"), clauses).collect()
    assert {r.ref: r.original for r in found} == {"r": "first", "none": ""}


def test_truth_is_the_last_one(spark):
    truth = spark.createDataFrame([("a  b", 1, "old"), (" a\nb ", 2, "new")], "query string, at int, want string")
    got = review.with_truth(spark.createDataFrame([(1, "a b"), (2, "c")], "id long, query string"), truth).collect()
    assert [(r.id, r.want) for r in got] == [(1, "new")]


def test_runs_and_wrapping(spark):
    runs = spark.createDataFrame([("b", "two", 0.5, 1.0, None), ("a", "one", None, 0.25, 0.1)], "file string, label string, recall_1 double, mrr double, separation double")
    assert [tuple(r) for r in review.runs_compared(runs).collect()] == [("a", "one", "n/a", "0.250", "0.100"), ("b", "two", "0.500", "1.000", "n/a")]
    assert review.wrapped("one two three", 7) == "one two\nthree" and review.wrapped(None) == ""
