from itertools import product

import numpy as np
import pytest

from quillspark.llm import toxicity as tox


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    way = rng.normal(size=4)
    lengths = np.array([4, 6, 1, 3])
    e = np.exp(rng.normal(size=lengths.sum()))
    grid, held, place, col = tox._chains(e, lengths)
    odds = tox._marginals(grid, held, np.exp(way))[0][place, col]
    at = 0
    for n in lengths:
        own, weight = e[at : at + n], {}
        for tags in product((0, 1), repeat=int(n)):
            weight[tags] = np.prod([own[i] for i in range(n) if tags[i]]) * np.exp(sum(way[2 * a + b] for a, b in zip(tags, tags[1:], strict=False)))
        for i in range(n):
            p = sum(w for t, w in weight.items() if t[i]) / sum(weight.values())
            assert odds[at + i] / (1 + odds[at + i]) == pytest.approx(p)
        at += n


def test_segments_join_exactly(monkeypatch):
    monkeypatch.setattr(tox, "SEGMENT", 4)
    rng = np.random.default_rng(5)
    way = np.exp(rng.normal(size=4) * 2)
    lengths = np.array([1, 4, 5, 13, 8, 2, 30])
    e = np.exp(rng.normal(size=lengths.sum()) * 6)
    grid, held, place, col = tox._chains(e, lengths)
    assert tox.long_marginals(e, lengths, way) == pytest.approx(tox._marginals(grid, held, way)[0][place, col], rel=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = tox.op5_toxicity(spark, sf)
    held = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    hit = held[held.toxic == 1]
    assert (hit.predicted == 1).mean() > 0.9 and (held[held.toxic == 0].predicted == 1).mean() < 0.02
    assert hit.score.min() >= 0 and held.score.max() <= 1


def test_spans_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    vocab = [f"word{i}" for i in range(80)]
    texts, y = [], []
    for k in range(400):
        words = rng.choice(vocab, 40).tolist()
        if k % 5 == 0:
            for at in rng.choice(40, 2, replace=False):
                words[at] = "badword" + rng.choice(["a", "b", "c"])
        texts.append(" ".join(words))
        y.append(int(k % 5 == 0))
    tagger = tox.fit(texts, y)
    text = " word1\tword2 (Badwordz)\nBADWORDA! word3"
    rows = [(1, text), (2, None), (3, ""), (4, "word1 " * 30000), (1, text), (None, "x")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in tox.tag(df, tagger).collect()}
    assert got[1].score > 0.9 and [text[s.first : s.end] for s in got[1].spans] == ["(Badwordz)\nBADWORDA!"]
    assert got[2].score == got[3].score < 0.3 and got[4].score < 0.3 and got[2].spans == []
    left = tox.without_toxic(df, tagger)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "None"]
    assert tox.tag(df.limit(0), tagger).count() == 0
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert tox.trained(df, labels).score(np.zeros(0)) == pytest.approx(0.5)


def test_scores_match_a_plain_forward_backward(spark, sf):
    """Every document's score, from the fitted weights alone: one chain after another in plain Python."""
    import math

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    tagger = tox.trained(docs, labels)
    oo, ot, to, tt = (math.exp(x) for x in tagger.way)

    def features(word):
        w = word.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())).lower()
        names = ["bias", "w=" + w, f"n={min(len(w), 9)}", *("p=" + w[:k] for k in (3, 4, 5, 6, 7) if len(w) > k), *("s=" + w[-k:] for k in (2, 3) if len(w) > k)]
        return names + ["digit"] * any(c.isdigit() for c in w)

    def score(text):
        e = [math.exp(max(-30.0, min(30.0, sum(tagger.weights.get(n, 0.0) for n in features(w))))) for w in (text or "").split()]
        if not e:
            top = some = -12.0
        else:
            fore, back = [(1.0, e[0])], [(1.0, 1.0)]
            for x in e[1:]:
                o, t = fore[-1]
                now = (o * oo + t * to, (o * ot + t * tt) * x)
                fore.append(tuple(v / sum(now) for v in now))
            for x in e[:0:-1]:
                o, t = back[-1]
                now = (oo * o + ot * x * t, to * o + tt * x * t)
                back.append(tuple(v / sum(now) for v in now))
            p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(fore, back[::-1], strict=True)]
            clip = lambda v: max(6e-6, min(1 - 6e-6, v))
            logit = lambda v: math.log(v / (1 - v))
            top = logit(clip(max(p)))
            some = logit(clip(-math.expm1(sum(math.log1p(-min(v, 1 - 1e-9)) for v in p))))
        a, b, c = tagger.calibration
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * top + c * some))))

    got = {r.doc_id: r.score for r in tox.op5_toxicity(spark, sf).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(score(r.text), abs=1e-7)


def test_a_doc_id_repeated_very_often_is_one_text_of_the_sample(spark):
    docs = spark.range(20_000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    real = tox.fit
    try:
        tox.fit = lambda texts, toxic: seen.extend(texts) or real(texts, toxic)
        tox.trained(docs, labels, held_out=False)
    finally:
        tox.fit = real
    assert len(seen) == 3
