import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    held, rest = {}, sum(total.values()) * 1.5
    while True:
        free = [s for s in names if s not in held]
        share = {s: (rest - sum(held.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s] + 1e-9]
        if not over:
            break
        held |= {s: 2.0 * total[s] for s in over}
    target = share | held
    out, at = [], dict.fromkeys(names, 0)
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"{'' if rows[k][0] is None else rows[k][0]}\n{rows[k][1] or ''}".encode()).hexdigest(), rows[k][0] or 0, size[k]))
    for k in order:
        s = rows[k][2]
        copies = sum(at[s] + size[k] / 2 + j * total[s] <= target[s] for j in (0, 1))
        at[s] += size[k]
        out.append((rows[k][0], size[k], total[s], pytest.approx(target[s]), size[k] * copies))
    return sorted(out, key=lambda r: (str(r[0]), r[1], r[4]))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=lambda r: (str(r[0]), r[1], r[4]))


def test_matches_brute_force_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = rows_of(mixing.mixture(docs, bucket_rows=7))
    assert got == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    whole = [tuple(r) for r in mixing.op7_mixing(spark, sf).collect()]
    assert sorted(con.execute(mixing.ORACLE).fetchall(), key=str) == sorted(whole, key=str)
    first = [r[5] for r in whole if r[5] is not None]
    assert first == sorted(first) and sorted((r[:5] for r in whole), key=lambda r: (str(r[0]), r[1], r[4])) == got
    near = {}
    for d, r in zip(docs.collect(), [None] * len(got), strict=True):
        near[d.source] = 0
    for r in mixing.mixture(docs).groupBy("source", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.target) <= r.m


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 9, None), (3, "x " * 9, None), (4, "y z", "b"), (None, "q", "b"), (5, "w " * 100, "a"), (6, "é", "Z"), (7, None, "empty")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, target double, size int")
    assert rows_of(mixing.mixture(docs)) == brute(rows)
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.training_order(mixing.mixture(docs.filter("source = 'empty'"))).count() >= 0


def test_positions_invert_the_schedules(spark):
    for k, knots in enumerate(mixing.SCHEDULES):
        t = np.linspace(0, 1, 20001)
        m = np.interp(t, *zip(*knots, strict=True))
        area = np.concatenate([[0], np.cumsum((m[1:] + m[:-1]) / 2)])
        shares = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
        df = spark.createDataFrame([(x,) for x in shares], "u double")
        got = [r[0] for r in df.select(mixing.position(F.col("u"), F.lit(k))).collect()]
        assert got == pytest.approx(np.interp(shares, area / area[-1], t), abs=1e-3)


def test_training_order_is_sorted_and_whole(spark, sf):
    mixed = mixing.mixture(spark.read.parquet(f"{sf}/documents.parquet"))
    order = [r.position for r in mixing.training_order(mixed).collect()]
    assert order == sorted(order) and len(order) == mixed.agg(F.sum(F.size("positions"))).first()[0]
    assert 0 <= order[0] and order[-1] <= 1


def test_schedules_change_positions_and_not_what_is_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, other = (mixing.mixture(docs, schedules=x).select("doc_id", "taken", "positions").collect() for x in (mixing.SCHEDULES, mixing.SCHEDULES[::-1]))
    assert sorted(r[:2] for r in one) == sorted(r[:2] for r in other) and sorted(map(str, one)) != sorted(map(str, other))


def test_one_row_repeated_very_often(spark):
    docs = spark.range(30_000).selectExpr("CASE WHEN id < 20000 THEN 5L ELSE id END AS doc_id", "CASE WHEN id < 20000 THEN 'a b' ELSE concat('c d ', id) END AS text", "'s' AS source")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert rows_of(mixing.mixture(docs)) == brute(rows)
