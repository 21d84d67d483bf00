import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, quality


def grams(text):
    """Slots of a text, one n-gram at a time."""
    roll = common.RollingHash(0x9E3779B97F4A7C15 & ~3 | 3)
    out = []
    for w in [re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]:
        h = np.array([roll.words(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in w], np.uint64)
        out += h.tolist() + [int(roll.windows(h[i : i + 2], np.array([0]), 2)[0]) for i in range(len(w) - 1)]
    return Counter(x >> 50 for x in out)


def test_slots_do_not_depend_on_the_batch():
    texts = ["a b c", None, "", "b\tc  d", "é"]
    got = {}
    for i, s, before in quality.slots(pa.array(texts)):
        for k in range(len(before) - 1):
            got[i + k] = Counter(s[before[k] : before[k + 1]].tolist())
    assert [got[k] for k in range(5)] == [grams(t) for t in texts]


def test_weights_and_sample(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    raw, target, own = Counter(), Counter(), {}
    for r in docs.collect():
        own[r.doc_id] = grams(r.text)
        raw.update(own[r.doc_id])
        if r.doc_id in good:
            target.update(own[r.doc_id])
    p, q = (np.array([c[s] + 1.0 for s in range(quality.SLOTS)]) for c in (target, raw))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    got = {r.doc_id: r for r in quality.op3_quality(spark, sf).collect()}
    for d, c in own.items():
        n = sum(c.values())
        assert got[d].n_ngrams == n and got[d].log_weight == pytest.approx(sum(ratio[s] * k for s, k in c.items()), abs=1e-5)
    assert sum(r.kept for r in got.values()) == round(len(good) / labels.count() * len(got))


def test_weights_tell_junk_from_prose(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got.quality == 1].log_weight.to_numpy(), got[got.quality == 0].log_weight.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert got[got.quality == 1].kept.mean() > 0.93 and got[got.quality == 0].kept.mean() < 0.45


def test_largest_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(x)) for k, x in enumerate(np.round(rng.normal(size=400) * 3, 1))] + [(7, 0.3)] * 5 + [(900, -1e6), (901, -1e6), (902, 1e-9), (None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    for k in (1, 50, 140, *range(180, 200), 399, 403):
        want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
        assert sorted((tuple(r)[:2] for r in quality.largest(df, "key", k).filter("kept").collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "c"), (4, "x " * 50000)]
    docs = spark.createDataFrame([(*r, True, 3) for r in rows], "doc_id long, text string, is_target boolean, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.resampled(docs, labels).orderBy(F.desc("log_weight")).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3 and not any(r.kept for r in got if not r.n_ngrams)
    assert quality.resampled(docs, labels.limit(0)).filter("kept").count() == 6
    assert quality.resampled(docs.limit(0), labels).count() == 0
