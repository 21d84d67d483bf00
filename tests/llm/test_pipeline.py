import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillspark.llm import decontaminate, mixing, simhash, toxicity

from test_decontaminate import holds
from test_mixing import brute as brute_mix
from test_simhash import similar_groups
from test_token_output import in_order


def test_every_stage_matches_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = dict(rows)
    names = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = docs.collect()
        assert name == "token_output" or docs.columns == names

    tagger = toxicity.trained(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    one = lambda t: tagger.score(tagger.tagged([[tagger.emission(w) for w in (t or "").split()]])[0])
    left = {d: r for d, r in left.items() if one(r.text) < 0.3}
    assert sorted(r.doc_id for r in got["toxicity"]) == sorted(left)
    left = {d: left[d] for d, c in similar_groups([(d, r.text) for d, r in left.items()]).items() if d == c}
    assert sorted(r.doc_id for r in got["simhash_dedup"]) == sorted(left)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {d for d, r in left.items() if any(decontaminate.plain_text(b) in decontaminate.plain_text(r.text) for b in bench)}
    dropped = set(left) - {r.doc_id for r in got["decontamination"]}
    assert whole and whole <= dropped
    assert all(any(holds(b, left[d].text) for b in bench) for d in dropped)
    left = {d: r for d, r in left.items() if d not in dropped}
    taken = {r[0]: r[4] // r[1] if r[1] else 1 for r in brute_mix([(d, r.text, r.source) for d, r in left.items()])}
    assert sorted(r.doc_id for r in got["mixing"]) == sorted(d for d, n in taken.items() for _ in range(n))
    # the token files keep the training order
    at = {(r.doc_id, x) for r in mixing.mixture(spark.read.parquet(f"{tmp_path}/decontamination")).collect() for x in r.positions}
    trained = [(d, left[d].text) for x, d in sorted((x, d) for d, x in at)]
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sorted(got["token_output"], key=lambda r: r.start)] == in_order(trained)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "other words stand in here"), (None, "q r"), (None, "q r"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((tuple(r)[:2] for r in simhash.deduplicated(docs).collect()), key=str)
    assert kept == sorted([(1, "a b c d e"), (1, "other words stand in here"), (None, "q r"), (2, None)], key=str)
    several = docs.union(spark.createDataFrame([(5, "A B c\td  e", "en", "s", 1), (None, None, "en", "s", 1), (None, "", "en", "s", 1)], docs.schema))
    assert sorted((tuple(r)[:2] for r in simhash.deduplicated(several).collect()), key=str) == kept
    mixed = mixing.mixed_documents(docs)
    n = mixing.mixture(docs).agg(F.sum(F.size("positions"))).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == n
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


def test_entry_lists_all_queries():
    names = __spark_entry__.queries()
    assert {int(m[1]) for x in names if (m := re.match(r"op(\d+)_", x))} == set(range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert np.all([callable(f) for f in names.values()])


def test_columns_of_any_name_stay_as_they_are(spark, sf, tmp_path):
    names = ["_id", "_k", "_key", "_position", "_positions", "_s", "__key", "key", "fp", "component", "position", "repeats", "draw", "size"]
    rows = [(k, f"word{k} " * (k % 5 + 3) + "tail of some text", "en", f"s{k % 3}", 1, *[f"{n}{k}" for n in names]) for k in [*range(12), 3, 3]]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, ddl)
    known = {(r[0], *r[5:]) for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token_output":
            assert docs.columns == [c.split()[0].strip("`") for c in ddl.split(", ")]
            assert {(r[0], *r[5:]) for r in docs.collect()} <= known and docs.count()
