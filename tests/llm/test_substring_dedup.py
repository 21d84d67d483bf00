import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import xxhash

from quillspark.llm import substring_dedup as sub


def brute(rows, width=20):
    # rows without a doc_id last, by Spark's xxhash64 of their texts
    rows = sorted((d is None, np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64).item() if d is None else d, (t or "").encode(), d) for d, t in rows)
    words = [re.findall(rb"[^\x20\x09-\x0d]+", t) for _, _, t, _ in rows]
    seen, out = set(), []
    for (*_, d), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            gone.update(range(s, s + width) if k in seen else ())
            seen.add(k)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_matches_brute_force_in_many_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 0
    assert rows_of(sub.repeated_windows(docs, group_bytes=50_000, bucket_bytes=30_000)) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(sub.ORACLE).fetchall(), key=str) == want


def test_odd_rows(spark):
    w = " ".join(f"w{i}" for i in range(30))
    rows = [(1, w), (1, w), (2, None), (2, ""), (3, "é " * 45), (4, "x\x1cy" + "\x0b" + w), (None, w), (None, "a"), (-7, w.replace(" ", "\t")), (9, "short"), (8, "w5 " + w), ((1 << 63) - 1, w + " z"), (None, w), (None, "b " + w), (-(1 << 63), "q " + w), *[(9, "short")] * 3, *[(None, w)] * 3]
    docs = spark.createDataFrame([(*r, 0, b"") for r in rows], "doc_id long, text string, grp int, small binary")
    assert rows_of(sub.repeated_windows(docs)) == brute(rows)
    assert rows_of(sub.repeated_windows(docs, group_bytes=1, bucket_bytes=1)) == brute(rows)
    assert sub.repeated_windows(docs.limit(0)).count() == 0


def test_intervals_and_text(spark):
    w = " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: r for r in sub.repeated_windows(spark.createDataFrame([(1, w), (2, f"a {w} b")], "doc_id long, text string"), with_text=True).collect()}
    assert [tuple(x) for x in got[2].removed] == [(1, 25)] and got[2].kept_text == "a b" and got[1].kept_text == w


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_words_that_polynomials_confuse(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}")]
    got = rows_of(sub.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and not any(r[2] for r in got)


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    """With the first hash functions half of all words look alike: claims fail, and others are taken."""
    good = sub.word_digests

    def weak(words, seed):
        return good([w[:1] if seed < 2 else w for w in words], seed)

    monkeypatch.setattr(sub, "word_digests", weak)
    text = lambda c, n: " ".join(f"{'abcd'[k % 4]}{c}{k}" for k in range(n))
    rows = [(1, text("x", 40)), (2, text("y", 40)), (3, text("x", 30) + " end"), (4, text("y", 25) + " " + text("y", 25)), (None, text("z", 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 1 << 20):
        assert rows_of(sub.repeated_windows(docs, group_bytes=size, bucket_bytes=size)) == brute(rows)


def test_one_row_repeated_very_often(spark):
    w = " ".join(f"w{k}" for k in range(25))
    docs = spark.range(70_000).selectExpr("CASE WHEN id % 7 > 0 THEN 5L WHEN id % 2 = 0 THEN NULL ELSE id END AS doc_id", f"CASE WHEN id % 7 > 0 THEN '{w}' ELSE concat('x', id) END AS text")
    got = sub.repeated_windows(docs)
    assert got.count() == 70_000 and got.filter("doc_id = 5 and n_removed = 25").count() == 59_999 and got.filter("n_removed = 0").count() == 10_001


def test_stretches_and_slices_change_nothing(spark, sf, monkeypatch):
    """Kernels that look at a few bytes and windows at a time find the same."""
    monkeypatch.setattr(sub, "SLICE", 50)
    monkeypatch.setattr(sub, "WINDOWS", 7)
    rows = [(k, " ".join(f"w{(k * 7 + i) % 90}" for i in range(60)) + "\n" * (k % 3)) for k in range(12)] + [(99, "x" * 500 + " a b"), (100, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array([d for d, _ in rows]), pa.array([False] * len(rows)), pa.array([t for _, t in rows])], ["grp", "id", "late", "text"])
    table = pa.Table.from_batches(list(sub._press(iter([batch]))))
    found = sub._count(pa.table({k: v for k, v in sub._windows(table, 20, 1, 0).to_pydict().items()}, schema=pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("late", pa.bool_()), ("blob", pa.binary())])))
    got = sub._remove(table, found, 20, False, 0).to_pylist()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute(rows)
