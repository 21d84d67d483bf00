import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann


def brute(rows, every, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    out = []
    for q in (i for i in ids if i % every == 0):
        others = [i for i in ids if i != q]
        if not others:
            continue
        s = ann.cosines(np.stack([ok[q]] * len(others)), np.stack([ok[i] for i in others]))
        for r, j in enumerate(sorted(range(len(others)), key=lambda j: (-s[j], others[j]))[:k]):
            out.append((q, r + 1, others[j], float(s[j])))
    return sorted(out)


def test_small_tables_are_exact(spark, sf):
    got = sorted(tuple(r) for r in ann.op1_ann(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(con.execute(ann.ORACLE).fetchall()) == got
    assert got == brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], 50)


def structured(n, dim=24, groups=400, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    return (centers[rng.integers(groups, size=n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))


@pytest.mark.parametrize("n", [10_000, 50_000])
def test_recall_with_the_production_parameters(spark, n):
    """The forest leaves out half of the rows, and finds nine of ten."""
    x = structured(n)
    e = frame(spark, x)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(e, F.col("vec_id") % 100 == 0).collect()}
    q = np.arange(0, n, 100)
    unit = ann._unit(x.astype(float))
    s = unit[q] @ unit.T
    s[np.arange(len(q)), q] = -2
    want = {(int(i), int(j)) for i, row in zip(q, np.argsort(-s, axis=1, kind="stable")[:, :5], strict=True) for j in row}
    assert len(got & want) / len(want) >= 0.95


def test_recall_without_structure(spark):
    x = np.random.default_rng(2).normal(size=(12_000, 64)).astype(np.float32)
    e = frame(spark, x)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(e, F.col("vec_id") % 50 == 0, least_rows=0).collect()}
    unit = ann._unit(x.astype(float))
    q = np.arange(0, len(x), 50)
    s = unit[q] @ unit.T
    s[np.arange(len(q)), q] = -2
    want = {(int(i), int(j)) for i, row in zip(q, np.argsort(-s, axis=1)[:, :5], strict=True) for j in row}
    assert len(got & want) / len(want) >= 0.9


def test_the_forest_has_leaves_at_any_size_and_a_budget_of_one_is_exact():
    x = ann._unit(structured(300).astype(float))
    forest = ann.Forest(x, 8, 3)
    assert forest.leaves == 64 and forest.weight.sum() == pytest.approx(8)
    placed = forest.place(x)
    for q in x[:5]:
        assert np.isin(placed, forest.open(q, 1.0)).any(axis=1).all()
        some = np.isin(placed, forest.open(q, 0.5)).any(axis=1).mean()
        assert 0.4 < some < 0.8


def test_pieces_and_streams_of_queries(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "PIECE_ROWS", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in ann.op1_ann(spark, sf).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], 50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (8, []), (9, [-1.0, 1e-3]), (10, [1.0, 0.0]), (11, [1.0, 1.0]), (None, [1.0, 2.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [1.0, 0.0]), (23, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*rows, (0, [1.0, 0.0])]], "vec_id long, embedding array<float>, v string, cid int")
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 10 == 0).collect())
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10)
    assert got == want
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
