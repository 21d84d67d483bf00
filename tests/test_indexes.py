"""Inverted indexes with positions and blocks, and the vector index by cells."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cells, inverted
from quillspark.operators import retrieval as R


def plain_covers(words, terms):
    """Covers and score by trying every stretch: minimal ones have all terms and hold no smaller one that has."""
    hits = [k for k, w in enumerate(words) if w in terms]
    full = [(a, b) for a in hits for b in hits if a <= b and set(terms) <= set(words[a : b + 1])]
    best = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return len(best), round(sum(0.1 / (1 + (b - a + 1) - sum(a <= h <= b for h in hits)) for a, b in best), 9)


def test_minimal_covers(spark):
    rng = np.random.default_rng(4)
    docs = [(k, [f"w{x}x" for x in rng.integers(0, 7, rng.integers(0, 25))]) for k in range(60)] + [(99, None)]
    asked = [(0, ["w1x", "w2x"]), (1, ["w1x", "w2x", "w3x", "w2x"]), (2, ["w4x"]), (3, []), (4, ["w1x", "absent"])]
    chunks = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    index = inverted.positions_index(chunks, "doc_id", stems=False)
    got = {(r.query_id, r.doc_id): (r.covers, r.score, r["rank"]) for r in inverted.cover_density(index, spark.createDataFrame(asked, "query_id long, terms array<string>"), 100, "doc_id", stems=False, need="all").collect()}
    want = {}
    for q, terms in asked:
        own = {d: plain_covers(words, set(terms)) for d, words in docs if words and terms and set(terms) <= set(words)}
        for rank, d in enumerate(sorted(own, key=lambda d: (-own[d][1], d)), 1):
            want[q, d] = (*own[d], rank)
    assert got == want and len(want) > 60
    any_ = inverted.cover_density(index, spark.createDataFrame(asked, "query_id long, terms array<string>"), 3, "doc_id", stems=False)
    scan = R.keyword_rank(chunks, spark.createDataFrame(asked, "query_id long, terms array<string>"), 3, "doc_id", stems=False)
    assert sorted((r.query_id, r.doc_id, r["rank"], r.covers, r.score) for r in any_.collect()) == sorted((r.query_id, r.doc_id, r["rank"], r.matches, round(0.1 * r.matches, 9)) for r in scan.collect())
    with pytest.raises(ValueError):
        inverted.cover_density(index, scan, 3, "doc_id", need="some")


def test_postings_dealt_by_salt(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, ["common"] * (k % 5 + 1) + ["rare"] * (k == 3)) for k in range(40)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(0, ["common", "rare"])], "query_id long, terms array<string>")
    index = inverted.positions_index(chunks, "doc_id", stems=False)
    want = sorted(map(tuple, inverted.cover_density(index, asked, 9, "doc_id", stems=False).collect()))
    monkeypatch.setattr(inverted, "TERMS_SENT", 0)
    assert sorted(map(tuple, inverted.cover_density(index, asked, 9, "doc_id", stems=False).collect())) == want and want


def test_blocks_that_cannot_matter_stay_closed(spark, sf, tmp_path):
    """The rows of a search over everything, from fewer blocks; the scan reads opened folders and asked terms only."""
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), T.or_terms(F.col("text")).alias("terms"))
    spark.createDataFrame(R.token_index(chunks, "doc_id", stems=False).toArrow()).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    path = str(tmp_path)
    inverted.write_blocks(index, path, "doc_id", F.expr("doc_id div 8"))
    rows = lambda df: sorted((r.query_id, r.doc_id, r.matches, r["rank"]) for r in df.collect())
    assert rows(inverted.block_search(spark, path, asked, 3, "doc_id", stems=False)) == rows(R.index_search(index, asked, 3, "doc_id", stems=False))
    opened, all_, found = inverted.opened_blocks(spark, path, asked, 3, "doc_id", stems=False)
    assert opened.count() < 0.6 * all_.count() and opened.select("query_id", "block").distinct().count() == opened.count()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    few = asked.withColumn("terms", F.slice("terms", 1, 1)).limit(5)
    plan = inverted.opened_blocks(spark, path, few, 3, "doc_id", stems=False)[2]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term," in plan
    assert inverted.block_search(spark, path, asked.limit(0), 3, "doc_id", stems=False).collect() == []


@pytest.fixture(scope="module")
def structured(spark, tmp_path_factory):
    """6,000 vectors around 60 centres, a third of which are one vector, and an index of them."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 24))
    x[4000:] = x[4000]
    path = str(tmp_path_factory.mktemp("cells"))
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small files would be put together
    try:
        cells.write_cells(df, path, "vec_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return df, path


def test_recall_of_few_cells(spark, structured):
    df, path = structured
    asked = df.filter("vec_id % 40 = 0 and vec_id < 4000").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda d: {(r.query_id, r.vec_id, r["rank"], r.similarity) for r in d.collect()}
    want = rows(R.vector_topk_many(df, asked, 10))
    assert len(rows(cells.cell_search(spark, path, asked, 10, "vec_id", share=0.08)) & want) >= 0.9 * len(want)
    assert rows(cells.cell_search(spark, path, asked, 10, "vec_id", share=1.0)) == want


def test_cells_are_pruned_and_split(spark, structured, tmp_path):
    df, path = structured
    one = df.limit(1).select(F.col("vec_id").alias("query_id"), "embedding")
    plan = cells.cell_search(spark, path, one, 3, "vec_id", share=0.01)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[(isnotnull\()?cell", plan)
    opened = cells.routed(spark, path, df.select(F.col("vec_id").alias("query_id"), "embedding"), 0.05).groupBy("query_id").count()
    assert opened.agg(F.max("count")).first()[0] < len({r.cell for r in spark.read.parquet(f"{path}/centres").select("cell").collect()}) / 2
    # a third of the rows are one vector: its cell is several files
    sizes = spark.read.parquet(f"{path}/vectors").withColumn("f", F.input_file_name()).groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("f").alias("files")).orderBy(F.desc("n")).first()
    assert sizes.n >= 2000 and sizes.files > 1


def test_odd_vectors(spark, tmp_path):
    """Unequal lengths, nulls, zeros, an empty table: as a scan sees them, which cuts products to the shorter vector."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0, 0.0, 1.0]), (2, [1.0, None, 3.0]), (3, []), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 2.0])], "vec_id long, embedding array<double>")
    asked = df.filter("embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.vec_id): r.similarity for r in R.vector_topk_many(df, asked, 9).collect()}
    assert got[0, 0] == 1.0 and got[0, 1] == 0.0 and got[0, 2] == round(1 / 10**0.5, 6) and got[6, 1] == round(0.5**0.5, 6) and got[3, 3] == 0.0 and len(got) == 36
    one = {(0, r.vec_id): r.similarity for r in R.vector_topk(df, [1.0, 0.0], 9, "vec_id").collect()}
    assert one == {k: v for k, v in got.items() if k[0] == 0}
    cells.write_cells(df, f"{tmp_path}/a", "vec_id")
    assert {(r.query_id, r.vec_id): r.similarity for r in cells.cell_search(spark, f"{tmp_path}/a", asked, 9, "vec_id", share=1.0).collect()} == got
    cells.write_cells(df.limit(0), f"{tmp_path}/b", "vec_id")
    assert cells.cell_search(spark, f"{tmp_path}/b", asked, 9, "vec_id").collect() == []


def test_few_rows_leave_a_task(spark, monkeypatch):
    """Of many batches a task keeps k rows a query."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(400, numPartitions=2).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 17).cast("double"), F.lit(3.0)).alias("embedding"))
        asked = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "query_id long, embedding array<double>")
        top = R.RunningTop(3, "vec_id", "similarity")
        for lo in range(0, 3 << 18, 1 << 16):
            top.add(np.zeros(1 << 16, int), np.arange(lo, lo + (1 << 16)), np.arange(lo, lo + (1 << 16)) % 1000 / 1000)
        (batch,) = top.batch(R.pa.int64(), R.pa.float64())
        assert batch.column("vec_id").to_pylist() == [999, 1999, 2999] and len(top.parts) == 1
        want = {(q, i) for q in range(5) for i in [r.vec_id for r in R.vector_topk(df, [float(q), 1.0], 3, "vec_id").collect()]}
        found = R.vector_topk_many(df, asked, 3)
        assert {(r.query_id, r.vec_id) for r in found.collect()} == want
        stage = found._jdf.queryExecution().analyzed().toString()
        assert stage.count("MapInArrow") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_kept_as_text(spark):
    rows = [(0, "a", 1.0, "[1, 0]", 1), (0, "b", 0.99, "[1.0, 0.01]", 2), (0, "c", 0.8, "[0, 1]", 3), (0, "d", 0.1, None, 4)]
    df = spark.createDataFrame(rows, "query_id long, ref string, relevance double, embedding string, rank long")
    assert [r.ref for r in sorted(R.mmr(df, "ref", 2, 0.5).collect(), key=lambda r: r["rank"])] == ["a", "c"]


def test_queries_are_sent_once(spark, structured, monkeypatch):
    """A query comes to the driver with a bit for each cell, not with a copy of its vector for each; passes of few queries find the same."""
    df, path = structured
    asked = df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    opened = cells._opened(spark, path, asked, 1.0).collect()
    known = spark.read.parquet(f"{path}/centres").filter("rows > 0").count()
    assert len(opened) == asked.count() and all(int.from_bytes(r.opened).bit_count() == known for r in opened)
    few = cells._opened(spark, path, asked, 0.05)
    assert sum(int.from_bytes(r.opened).bit_count() for r in few.collect()) == cells.routed(spark, path, asked, 0.05).count()
    want = sorted(map(tuple, cells.cell_search(spark, path, asked, 5, "vec_id", share=0.3).collect()))
    monkeypatch.setattr(R, "RESULT_ROWS", 100)
    assert sorted(map(tuple, cells.cell_search(spark, path, asked, 5, "vec_id", share=0.3).collect())) == want


def test_folders_of_a_block_index_are_bounded(spark, tmp_path, monkeypatch):
    """More blocks than folders: a folder has several, and a search finds what one over everything does."""
    monkeypatch.setattr(inverted, "FOLDERS", 4)
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(k, [f"w{x}x" for x in rng.integers(0, 30, rng.integers(1, 25))]) for k in range(300)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(q, [f"w{q}x", f"w{q + 3}x", "absent"]) for q in range(20)], "query_id long, terms array<string>")
    index = R.token_index(chunks, "doc_id", stems=False)
    inverted.write_blocks(index, str(tmp_path), "doc_id", F.expr("doc_id div 8"))
    assert len(list((tmp_path / "postings").glob("folder=*"))) == 4
    rows = lambda d: sorted((r.query_id, r.doc_id, r.matches, r["rank"]) for r in d.collect())
    assert rows(inverted.block_search(spark, str(tmp_path), asked, 3, "doc_id", stems=False)) == rows(R.keyword_rank(chunks, asked, 3, "doc_id", stems=False))


def test_sums_and_counts_in_parts(spark, monkeypatch):
    """Terms are counted a part of a batch at a time, rows of one key are added up, and no pair of query and chunk is shuffled before its sum is known."""
    monkeypatch.setattr(R, "PART_TERMS", 3)
    chunks = spark.createDataFrame([(1, ["run", "runs", "a1x"]), (1, ["running"]), (2, []), (3, None), (4, ["cat", None, "cats", "cat", "dog"])], "doc_id long, tokens array<string>").coalesce(1)
    index = R.token_index(chunks, "doc_id")
    assert sorted(map(tuple, index.collect())) == [(1, "a1x", 1), (1, "run", 3), (4, "cat", 3), (4, "dog", 1)]
    asked = spark.createDataFrame([(7, ["dogs", "cat"]), (8, ["runs"]), (9, [])], "query_id long, terms array<string>")
    sums = R.term_sums(index, F.col("n"), asked, "doc_id")
    assert sorted(map(tuple, sums.collect())) == [(7, 4, 4), (8, 1, 3)]
    assert "hashpartitioning(query_id" not in sums._jdf.queryExecution().executedPlan().toString()
