import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vector
from quillspark.functions.stem import stem, stemmed
from quillspark.operators import retrieval as R
from quillspark.operators import validate


def fused(spark, *lists):
    rows = [(0, ref, k) for refs in lists for k, ref in enumerate(refs, 1)]
    return {r.ref: r.fused_score for r in R.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id long, ref string, rank long"), "ref").collect()}


def test_fusion(spark):
    s = fused(spark, ["a", "b", None, "c"], ["b", "d"])
    assert s["b"] == pytest.approx(1 / 62 + 1 / 61) and s["c"] == pytest.approx(1 / 64)
    assert max(s, key=s.get) == "b" and set(s) == {"a", "b", "c", "d"}
    assert fused(spark, ["b", "d"], ["a", "b", None, "c"]) == pytest.approx(s)


def test_parts_of_one_ref_add_up(spark):
    assert fused(spark, ["a", "a"])["a"] == pytest.approx(1 / 61 + 1 / 62)


VECTORS = [[1, 0.0], [1, 0.01], [0, 1.0], None]


def test_mmr_breaks_clusters_and_keeps_those_without_vectors():
    assert R.mmr_order(np.array([1.0, 0.99, 0.8, 0.1]), VECTORS, 3, 0.5)[:2] == [0, 2]
    assert 3 in R.mmr_order(np.array([1.0, 0.99, 0.8, 0.1]), VECTORS, 4)
    assert R.mmr_order(np.array([0.5, 0.5]), [None, None], 2) == [0, 1]
    assert R.mmr_order(np.array([]), [], 3) == []


@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_mmr_without_diversity_is_the_order_of_relevance(rel):
    order = R.mmr_order(np.array(rel), [[1.0, k] for k in range(len(rel))], len(rel), 1.0)
    assert order == sorted(range(len(rel)), key=lambda k: (-rel[k], k))


def test_cosine_and_coercion(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], "[1, -0.5 ,2]"), ([1.0, 1.0], [1.0], None)], "a array<double>, b array<double>, t string")
    got = df.select(vector.cosine(F.col("a"), F.col("b")), vector.cosine(F.col("a"), F.col("a")), vector.as_vector(F.col("t"))).collect()
    assert got[0][0] == 0.0 and got[0][1] == pytest.approx(1) and got[0][2] == [1.0, -0.5, 2.0]
    assert got[1][0] == pytest.approx(1 / np.sqrt(2)) and got[1][2] == []


def test_or_terms(spark):
    texts = ["The Records shall be RETAINED, records!", "", "the and for", " ".join(f"w{k}x" for k in range(60))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.or_terms(F.col("t"))).collect()]
    assert got[0] == ["records", "retained"] and got[1] == [] and got[2] == [] and len(got[3]) == 40


def test_many_queries_match_one_by_one(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "QUERY_BYTES", 4 * 8 * 64)
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    many = R.vector_topk_many(e, q, 5).collect()
    assert len(many) == 35
    for k in (0, 6):
        one = R.vector_topk(e, list(e.filter(f"vec_id = {k}").first().embedding), 5, "vec_id").collect()
        assert [(r.vec_id, r.similarity) for r in one] == [(r.vec_id, r.similarity) for r in sorted((r for r in many if r.query_id == k), key=lambda r: r["rank"])]


def test_modes(spark):
    v = spark.createDataFrame([(0, "a", 0.9, 1), (0, "b", 0.8, 2)], "query_id long, ref string, similarity double, rank long")
    k = spark.createDataFrame([(0, "c", 1), (0, "b", 2)], "query_id long, ref string, rank long")
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None)], "ref string, embedding array<float>")
    assert [r.ref for r in R.retrieve("hybrid", v, k, e, "ref").orderBy("rank").collect()] == ["b", "a", "c"]
    assert {r.ref for r in R.retrieve("rerank", v, k, e, "ref").collect()} == {"a", "b", "c"}
    assert R.retrieve("vector", v, k, e, "ref", limit=1).count() == 1
    with pytest.raises(ValueError):
        R.retrieve("other", v, k, e, "ref")
    assert R.retrieve("hybrid", v, k, e, "ref").filter("ref = 'c'").first().similarity is None


def test_published_stems(spark):
    """Pairs that the algorithm's publication gives for its steps."""
    pairs = dict(p.split(">") for p in (
        "caresses>caress ponies>poni ties>ti cats>cat feed>feed agreed>agre plastered>plaster bled>bled motoring>motor sing>sing conflated>conflat troubled>troubl sized>size hopping>hop tanned>tan falling>fall "
        "hissing>hiss fizzed>fizz failing>fail filing>file happy>happi sky>sky relational>relat conditional>condit rational>ration valenci>valenc digitizer>digit conformabli>conform radicalli>radic "
        "differentli>differ vileli>vile analogousli>analog vietnamization>vietnam predication>predic operator>oper feudalism>feudal decisiveness>decis hopefulness>hope callousness>callous formaliti>formal "
        "sensitiviti>sensit sensibiliti>sensibl triplicate>triplic formative>form formalize>formal electriciti>electr electrical>electr hopeful>hope goodness>good revival>reviv allowance>allow inference>infer "
        "airliner>airlin gyroscopic>gyroscop adjustable>adjust defensible>defens irritant>irrit replacement>replac adjustment>adjust dependent>depend adoption>adopt homologou>homolog communism>commun "
        "activate>activ angulariti>angular homologous>homolog effective>effect bowdlerize>bowdler probate>probat rate>rate cease>ceas controll>control roll>roll generalizations>gener oscillators>oscil by>by yes>ye"
    ).split())
    df = spark.createDataFrame([(w,) for w in pairs], "w string")
    assert {r.w: r.s for r in stemmed(df, "w", "s").collect()} == pairs == {w: stem(w) for w in pairs}


def test_stems_word_by_word_and_in_expressions(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    more = spark.createDataFrame([(a + b + c,) for a in ("b", "tr", "y", "gener", "sky", "agr", "") for b in ("", "a", "ee", "ll", "iz", "at", "y") for c in ("s", "es", "sses", "ies", "ed", "ing", "eed", "y", "ational", "ness", "ion", "tion", "sion", "e", "ll", "er")], "w string")
    both = stemmed(words.unionByName(more).filter("w <> ''"), "w", "s").collect()
    assert len(both) > 1000 and [(r.w, r.s) for r in both] == [(r.w, stem(r.w)) for r in both]


def test_keywords_match_by_stem_on_both_ways(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, ["retention", "policies", "retained"]), (2, ["retains", "other"]), (3, ["unrelated"])], "ref long, tokens array<string>")
    asked = spark.createDataFrame([(0, ["retain", "policy"]), (1, ["retaining", "retained"]), (2, [])], "query_id long, terms array<string>")
    want = [(0, 1, 2, 1), (0, 2, 1, 2), (1, 1, 1, 1), (1, 2, 1, 2)]
    assert sorted(map(tuple, R.keyword_rank(chunks, asked, 5, "ref").collect())) == want
    index = R.token_index(chunks, "ref")
    assert sorted(map(tuple, R.index_search(index, asked, 5, "ref").collect())) == want
    monkeypatch.setattr(R, "TERMS_SENT", 0)
    assert sorted(map(tuple, R.keyword_rank(chunks, asked, 5, "ref").collect())) == want
    assert sorted(map(tuple, R.index_search(index, asked, 5, "ref").collect())) == want
    assert R.keyword_rank(chunks, asked, 5, "ref", stems=False).count() == 2 - 1


def test_scan_and_index_find_the_same(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), T.or_terms(F.col("text")).alias("terms"))
    scan = sorted(map(tuple, R.keyword_rank(chunks, asked, 9, "doc_id").select("query_id", "doc_id", "matches", "rank").collect()))
    index = R.index_search(R.token_index(chunks, "doc_id"), asked, 9, "doc_id").select("query_id", "doc_id", "matches", "rank")
    assert scan == sorted(map(tuple, index.collect())) and len(scan) > 100
    assert R.keyword_rank(chunks.limit(0), asked, 9, "doc_id").count() == 0 and R.keyword_rank(chunks, asked.limit(0), 9, "doc_id").count() == 0


def test_plans_of_searches(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = validate.grounding(b, d, "item_id", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no text is cut up or joined
    index = R.token_index(d.select("doc_id", T.tokens(F.col("text")).alias("tokens")), "doc_id")
    asked = b.select(F.col("item_id").alias("query_id"), T.or_terms(F.col("text")).alias("terms"))
    plan = R.index_search(index, asked, 5, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "WindowGroupLimit" in plan


def test_search_view(spark):
    df = spark.createDataFrame([(1, "r", 0.98765, 0, 1, " a \n b "), (2, "s", 0.5, 1, 3, "x" * 200)], "rank long, ref string, similarity double, part int, of_parts int, body string")
    assert [tuple(r) for r in R.search_view(df).collect()] == [(1, "r", 0.988, "", "a b"), (2, "s", 0.5, "part 2 of 3", "x" * 160 + "...")]
