import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import providers, store
from quillspark.sources import documents as D
from quillspark.streaming import ingest

POLICY = """---
id: P-001
title: Records
owner: Legal
domain: privacy
effective: 2024-01-05
last_reviewed: soon
---
## 1. Keeping

lost text
### 1.10 Later
tenth
### 1.2 How long
Keep it
  six years.
"""


def test_payloads(spark):
    item = lambda **k: json.dumps({"document_number": "n1", "title": "T", **k})
    rows = [(0, 0, item(agencies=[{"name": "A"}, {"id": 3}], publication_date="2026-09-02")), (1, 0, item(title="other")), (1, 1, item(document_number="n2", title="", publication_date="bad")), (1, 2, '{"title": "x"}')]
    got = {r.external_id: r for r in D.fetched(spark.createDataFrame(rows, "term_ix int, pos int, value string"), "reg").collect()}
    assert set(got) == {"n1", "n2"} and got["n1"].title == "T" and got["n1"].agencies == ["A"]
    assert got["n1"].published_on == datetime.date(2026, 9, 2) and got["n2"].published_on is None and got["n2"].title == "(untitled)" and got["n2"].agencies == []


def test_policies(spark, tmp_path):
    (tmp_path / "P-001.md").write_text(POLICY)
    got = D.policies(spark, str(tmp_path)).collect()
    assert [r.clause_id for r in got] == ["P-001 §1.2", "P-001 §1.10"]
    assert got[0].text == "Keep it six years." and got[0].retrieval_text == "Records — Keeping — How long\nKeep it six years."
    assert got[0].last_reviewed is None and got[0].effective == datetime.date(2024, 1, 5)
    (tmp_path / "P-002.md").write_text(POLICY)
    with pytest.raises(ValueError, match="repeated"):
        D.policies(spark, str(tmp_path))
    (tmp_path / "P-002.md").write_text("## 1. Keeping\n### 1.1 x\ntext")
    with pytest.raises(ValueError, match="no front matter"):
        D.policies(spark, str(tmp_path))
    (tmp_path / "P-002.md").write_text(POLICY.replace("owner: Legal\n", "").replace("P-001", "P-002"))
    with pytest.raises(ValueError, match="missing owner"):
        D.policies(spark, str(tmp_path))


def test_terms_may_fail_but_not_all(spark):
    def get(term):
        if term.startswith("bad"):
            raise OSError("no answer")
        return [json.dumps({"document_number": f"{term}{k}"}) for k in range(2)] if term != "empty" else []

    got = D.fetch(spark, ["a", "bad", "empty", "b"], get)
    assert sorted((r.term_ix, r.pos) for r in got.collect()) == [(0, 0), (0, 1), (3, 0), (3, 1)]
    assert sorted(r.external_id for r in D.fetched(got, "s").collect()) == ["a0", "a1", "b0", "b1"]
    with pytest.raises(RuntimeError, match="all 2 terms failed"):
        D.fetch(spark, ["bad", "bad2"], get)
    assert D.fetch(spark, [], get).count() == 0


def test_cases_skip_metadata(spark):
    lines = ['{"_about": 1}', "{}", " ", '{"id": "a", "query": "q", "relevant": ["r"], "_x": 1}', '{"id": "b", "query": "q", "relevant": [], "verified": true}']
    got = D.cases(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.id, r.note, r.verified) for r in got.collect()] == [("a", "", False), ("b", "", True)]
    drafts = got.select("*", *[F.lit(x).alias(n) for n, x in (("modality", "mandatory"), ("obliged_party", "provider"), ("source_ref", "Article 1"), ("source_document", "Act"))]).drop("note")
    assert [(r.id, r.note) for r in D.exported(drafts).collect()] == [("b", "mandatory obligation on provider, Article 1 of Act")]
    lines = [json.loads(r.value) for r in D.merged_lines(got.drop("relevant").filter("id = 'b'"), got.drop("relevant").filter("id = 'a'"), ("one", "two"), {"about": "both"}).collect()]
    assert lines[0] == {"_about": "both"} and [(x["id"], x["provenance"]) for x in lines[1:]] == [("b", "one"), ("a", "two")]
    more = D.with_drafts(got.select("id", "query"), spark.createDataFrame([("a", "new", 1), ("c", "q3", 2)], "id string, query string, n int"))
    assert sorted((r.id, r.query, r.n) for r in more.collect() if r.id != "b") == [("a", "q", None), ("c", "q3", 2)]


def test_upsert_and_replace(spark):
    ddl = "corpus string, ref string, at int"
    now, new = spark.createDataFrame([("p", "a", 1), ("p", None, 1)], ddl), spark.createDataFrame([("p", "a", 2), ("p", None, 2), ("p", "b", 0)], ddl)
    got = store.latest_wins(now, new, ["corpus", "ref"], "at").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("p", "a", 2), ("p", None, 1), ("p", None, 2), ("p", "b", 0)], key=str)
    assert store.replace_children(now.fillna("z"), spark.createDataFrame([("p", "a", 9)], ddl), "ref").count() == 2
    assert store.section_stats(spark.createDataFrame([], "d long, c int, l int"), "d", "c", "l").first()[:] == (0, 0, 0.0, 0)


def test_readiness_and_report(spark):
    e = spark.createDataFrame([(None,), ([1.0],)], "embedding array<float>")
    assert store.readiness(e).first()[:] == (True, "1 embedded chunks") and not store.readiness(e.limit(0)).first().ready
    results = spark.createDataFrame([("a", [str(k) for k in range(20)], ["3", "z"], 0.12345, True), ("b", ["1"], [], 0.5, False)], "id string, retrieved array<string>, relevant array<string>, top_score double, verified boolean")
    lines = [json.loads(r.value) for r in D.report(results, "run", "2026-01-01T00:00:00+00:00", {"mode": "vector"}).collect()]
    assert lines[0]["label"] == "run" and lines[0]["run_at"][:4] == "2026" and json.loads(lines[0]["config"]) == {"mode": "vector"} and lines[0]["summary"]["cases"] == 2
    assert len(lines[1]["retrieved"]) == 10 and lines[1]["top_score"] == 0.123 and lines[1]["first_hit_rank"] == 4 and lines[1]["missed"] == ["z"] and lines[1]["recall_10"] == 0.5 and [x["id"] for x in lines[1:]] == ["a", "b"]


def test_versions_are_committed_whole(spark, tmp_path):
    base = str(tmp_path / "t")
    assert store.read_current(spark, base, "a int").count() == 0 and store.current_version(spark, base) == 0
    df = spark.range(5)
    assert store.commit_version(df, base) == 1 and store.commit_version(df.limit(2), base) == 2
    assert store.read_current(spark, base).count() == 2
    with pytest.raises(Exception):  # what a failed writer leaves isn't read
        store.commit_version(df.selectExpr("raise_error('no') AS id"), base)
    assert store.current_version(spark, base) == 2 and store.read_current(spark, base).count() == 2
    seen = store.current_version
    store.current_version = lambda *_: 1  # a writer that built on version 1
    try:
        with pytest.raises(RuntimeError, match="another writer"):
            store.commit_version(df, base)
    finally:
        store.current_version = seen
    assert store.read_current(spark, base).count() == 2


def test_tables_are_made_once(spark, tmp_path):
    base = str(tmp_path)
    store.init_tables(spark, base)
    run = spark.createDataFrame([("duty", "auto_filed", 0.9)], "obligation string, route string, confidence double").withColumn("ran_at", F.current_timestamp())
    runs = store.read_current(spark, f"{base}/agent_runs")
    now = store.upsert_runs(runs, spark.createDataFrame([], runs.schema).unionByName(run, allowMissingColumns=True))
    store.commit_version(now, f"{base}/agent_runs")
    store.init_tables(spark, base)
    got = store.read_current(spark, f"{base}/agent_runs").collect()
    assert len(got) == 1 and got[0].obligation_hash == hashlib.sha256(b"duty").hexdigest()
    assert {n: [f.name for f in store.read_current(spark, f"{base}/{n}").schema] for n in store.TABLES}["chunks"][:3] == ["corpus", "ref", "context"]


def test_stream_adds_each_key_once(spark, tmp_path):
    def arrive(rows, name):
        spark.createDataFrame(rows, "key string, n long").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        s = spark.readStream.schema("key string, n long").parquet(f"{tmp_path}/in/*")
        ingest.ingest_new(spark, s, f"{tmp_path}/store", f"{tmp_path}/cp", "key", "n")

    arrive([("a", 1), ("a", 2), ("b", 3)], "one")
    run()
    arrive([("b", 9), ("c", 4)], "two")
    run()
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/store").select("key", "n").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_first_arrivals_watermark(spark, tmp_path):
    spark.sql("select 'a' k, timestamp_ntz'2024-01-01 00:00:00' ts union all select 'a', timestamp_ntz'2024-01-01 00:00:01'").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("k string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
    q = ingest.first_arrivals(s, ["k"], "ts").writeStream.format("memory").queryName("first_arrivals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_arrivals").agg(F.count("*")).first()[0] == 1


def test_stream_embeds_each_chunk_once(spark, tmp_path):
    """Files that arrive later, with chunks that came before, and a stream that is started again."""
    chunks = spark.createDataFrame([(str(k), k % 2, f"text {k}") for k in range(30)], "ref string, part int, text string")
    chunks.repartition(3).write.parquet(f"{tmp_path}/chunks")

    def run():
        s = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/chunks")
        providers.index_stream(s, f"{tmp_path}/index", f"{tmp_path}/cp")
        return spark.read.parquet(f"{tmp_path}/index").count()

    assert run() == 30
    chunks.limit(5).unionByName(spark.createDataFrame([("new", 0, "t")], chunks.schema)).write.mode("append").parquet(f"{tmp_path}/chunks")
    assert run() == 31 and run() == 31


def test_buckets_keep_their_files(spark, tmp_path):
    """A merge reads and rewrites the buckets that new rows fall into, and only those."""
    files = lambda p: {str(f) for f in (tmp_path / p).glob("bucket=*/*.parquet")}
    rows = spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.lit("x").alias("v"))
    store.write_buckets(rows, f"{tmp_path}/t", ["k"], 16)
    before = files("t")
    n = store.merge_buckets(spark, f"{tmp_path}/t", spark.createDataFrame([(5, 2, "y"), (6, 0, "old"), (1000, 1, "z")], "k long, at int, v string"), ["k"], 16, "at")
    got = {r.k: (r.at, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert len(got) == 301 and got[5] == (2, "y") and got[6] == (1, "x") and got[1000] == (1, "z") and got[7] == (1, "x")
    assert n <= 3 and len(before - files("t")) == n and len(before & files("t")) == len(before) - n
    children = spark.createDataFrame([(d, k) for d in range(20) for k in range(3)], "d long, k int")
    store.write_buckets(children, f"{tmp_path}/c", ["d"], 16)
    before = files("c")
    assert store.replace_in_buckets(spark, f"{tmp_path}/c", spark.createDataFrame([(4, 9)], "d long, k int"), "d", 16) == 1
    got = sorted((r.d, r.k) for r in spark.read.parquet(f"{tmp_path}/c").collect())
    assert got == sorted([(d, k) for d in range(20) for k in range(3) if d != 4] + [(4, 9)]) and len(before - files("c")) == 1


def test_readiness_of_what_is_not_there(spark, tmp_path):
    assert store.readiness(store.chunks_at(spark, f"{tmp_path}/none")).first()[:] == (False, "no table of chunks")
    assert store.readiness(store.chunks_at(spark, "no_such_table")).first()[:] == (False, "no table of chunks")
    spark.createDataFrame([([1.0],), (None,)], "embedding array<float>").write.parquet(f"{tmp_path}/chunks")
    assert store.readiness(store.chunks_at(spark, f"{tmp_path}/chunks")).first()[:] == (True, "1 embedded chunks")


def test_drafts_by_document(spark):
    old = spark.createDataFrame([("a", "D1"), ("b", "D1")], "id string, external_id string")
    new = spark.createDataFrame([("c", "D1", 1), ("d", "D2", 2), ("e", "D2", 3)], "id string, external_id string, n int")
    assert sorted((r.id, r.n) for r in D.with_drafts(old, new, "external_id").collect() if r.n) == [("d", 2), ("e", 3)]
