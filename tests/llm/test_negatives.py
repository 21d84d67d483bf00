"""Hard negatives against a plain ranking of all pairs, exactly, at any budget of leaves."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives

FIELDS = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100, k=5, positives=5):
    """(anchor, positive, rank, negative, scores) of rows (vec_id, embedding, label) by comparing all pairs in Python integers."""
    dims = {}
    good = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * c) for c in v]
        if sum(256 * c * 256 * c for c in v) >= negatives.MOST_NORM:
            continue
        dims[len(x)] = dims.get(len(x), 0) + 1
        good.append((i, x, label))
    dim = min(dims, key=lambda d: (-dims[d], d), default=0)
    good = [g for g in good if len(g[1]) == dim]
    good = [g for k, g in enumerate(good) if g not in good[:k]]
    out = []
    for a in good:
        if a[0] % every:
            continue
        score = [sum(p * q for p, q in zip(a[1], c[1], strict=True)) for c in good]
        near = sorted((-s, c[0]) for s, c in zip(score, good, strict=True) if c is not a and c[2] == a[2])[:positives]
        far = sorted((-s, c[0]) for s, c in zip(score, good, strict=True) if c[2] != a[2])
        for p, i in near:
            hits = [(j, -n) for n, j in far if 80 * -p <= 100 * -n <= 100 * -p][:k]
            out += [(a[0], i, r + 1, j, -p, n) for r, (j, n) in enumerate(hits)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clusters(n, dim=16, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:copies] = x[0]
    return [(k, [float(c) for c in x[k]], int(rng.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize("budget, leaf_rows", [(100_000, 2000), (60, 40)])
def test_against_all_pairs(spark, budget, leaf_rows):
    """One round over few leaves, and many rounds over small leaves; a third of the rows are one vector."""
    rows = clusters(900, copies=300)
    df = spark.createDataFrame([(*r, "x") for r in rows], FIELDS + ", score string").repartition(4)
    got = rows_of(negatives.mined(df, F.col("vec_id") % 50 == 0, budget=budget, leaf_rows=leaf_rows))
    assert got == plain(rows, 50) and len(got) > 300


def test_odd_rows(spark):
    """Nulls, zero and infinite components, other dimensions, huge components, repeated rows and ids, ties."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.5, 0.5], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.9, 0.1], 2), (4, [0.9, 0.1], 3), (5, None, 1), (6, [], 1),
        (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [None, 1.0], 2), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 2), (12, [1e18, 0.0], 2), (13, [1e300, 0.0], 2),
        (14, [0.0, 0.0], 2), (15, [-1.0, 0.0], 1), (100, [0.0, 0.0], 1), (200, [-1.0, 0.2], 3), (16, [3e6, 1.0], 2), (300, [3e6, 0.5], 1), (301, [3e6, 0.5], 1), (17, [0.7, -0.1], 2),
    ]
    df = spark.createDataFrame(rows, FIELDS)
    got = rows_of(negatives.mined(df, F.col("vec_id") % 100 == 0))
    assert got == plain(rows) and {r[0] for r in got} >= {0, 100, 300}
    assert negatives.mined(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mined(df.filter("label is null"), F.col("vec_id") % 100 == 0).collect() == []


def test_query(spark, sf):
    """The driver's table; labels move by vec_id."""
    rows = [(r.vec_id, [float(x) for x in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = rows_of(negatives.op12_hard_negatives(spark, sf))
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(con.execute(negatives.ORACLE).fetchall()) == got


def test_tree_bounds():
    """Every leaf that holds a row of a window is named, in the order of its nearest row, and no leaf that can't hold one."""
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, size=(600, 6))
    most = int((x * x).sum(axis=1).max())
    points = negatives.augmented(x, most)
    tree = negatives.Tree(points, 5)
    leaf, tree.shells = tree.place(points)
    tree.rows = np.bincount(leaf, minlength=tree.leaves)
    for q in x[:20]:
        d2 = float(q @ q) + most - 2.0 * (x @ q)
        inner, outer = np.sqrt(np.quantile(d2, [0.1, 0.3]))
        named = list(tree.nearest_first(np.append(q, 0.0), inner, outer, 1e-6))
        inside = set(leaf[(d2 >= inner**2) & (d2 <= outer**2)].tolist())
        assert inside <= {n for _, n in named} and [low for low, _ in named] == sorted(low for low, _ in named)
        for low, n in named:
            own = np.sqrt(np.maximum(d2[leaf == n], 0))
            assert low <= max(own.min(), inner) + 1e-6
