import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, simhash


def brute(rows, words=4, bits=4):
    def mark(text):
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [(d, mark(t)) for d, t in rows]
    comp = {i: i for i in range(len(fp))}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in combinations(range(len(fp)), 2):
        if (fp[i][1] ^ fp[j][1]).bit_count() <= bits:
            comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fp):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None) if d is not None or root(i) in least else None
    return sorted(((d, f"{f:016x}", least[root(i)]) for i, (d, f) in enumerate(fp)), key=str)


def five_words(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}


def similar_groups(rows, least=0.8):
    """doc_id -> smallest doc_id of its group, from all pairs of different texts that are similar.

    Such a pair shares one of the rarest fifth and one more of either's shingles.
    """
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t or "", []).append(d)
    own = {t: five_words(t) for t in by_text}
    seen = Counter(g for s in own.values() for g in s)
    root, index = {t: t for t in by_text}, {}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for t, s in own.items():
        for g in sorted(s, key=lambda g: (seen[g], g))[: len(s) - math.ceil(least * len(s)) + 1]:
            index.setdefault(g, []).append(t)
    for x, y in {tuple(sorted(p)) for same in index.values() for p in combinations(same, 2)}:
        if len(own[x] & own[y]) >= least * len(own[x] | own[y]):
            root[find(x)] = find(y)
    out = {}
    for t, ids in by_text.items():
        out.setdefault(find(t), []).extend(ids)
    return {d: min(ids) for ids in out.values() for d in ids}


def test_pairs_that_reach_the_minimum_meet_once():
    sets = simhash.position_sets()
    assert len(sets) == 70
    for mask in range(256):
        shared = {k for k in range(8) if mask >> k & 1}
        first = simhash._FIRST_SET[mask]
        assert (first < 70 and set(sets[first]) <= shared) if len(shared) >= 4 else first == 255


def test_close_fingerprints_are_linked(spark):
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fp = {x for b in base for x in (b, *(b ^ sum(1 << k for k in rng.sample(range(64), n)) for n in (1, 2, 3, 4, 4, 5, 6)))}
    rows = sorted((k << 32 | (x >> 8 * s[0] & 255) << 24 | (x >> 8 * s[1] & 255) << 16 | (x >> 8 * s[2] & 255) << 8 | x >> 8 * s[3] & 255, np.uint64(x).astype(np.int64).item()) for x in fp for k, s in enumerate(simhash.position_sets()))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["key", "fp"])
    found = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for out in simhash.links(iter([batch]), lambda a, b: simhash.close(a[:, 0], b[:, 0], 4)) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a, b in combinations(fp, 2) if (a ^ b).bit_count() <= 4}


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "oNE\ttwo", "x"), (5, "oNE\ttwo", "x"), (9, "É b c d e f", "x"), (8, "a " * 30000, "x"), (7, "a " * 30000, "x"), (None, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in rows])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_lists_are_linked(spark):
    import numpy as np

    fp = np.array([[i ^ i >> 1] for i in range(64)], np.uint64)
    left, right = simhash._flood(fp, lambda a, b: simhash.close(a[:, 0], b[:, 0], 4))
    assert sum(map(len, left)) == 63 and len(np.unique(np.concatenate(right))) == 63


def test_groups_of_similar_texts(spark):
    """On a larger table: no link that isn't one, and nearly all that are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = similar_groups(rows)
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    should = set(want.values())
    copies = {d for d, t in rows} - should
    assert should <= kept
    missed = len(kept - should)
    assert len(copies) > 500 and missed <= 0.02 * len(copies), (missed, len(copies))
    # of those that aren't exact copies nine of ten
    first = {}
    for d, t in rows:
        first.setdefault(t or "", d)
    near = {d for d in first.values() if want[d] != d}
    assert len(near) > 40 and len(near & kept) <= 0.1 * len(near), (len(near & kept), len(near))


def test_large_group_of_pairs(spark):
    """One text that is a little under 0.8 from all others, and pairs of very similar texts among those: no pair is lost to the text in the middle."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    base = [word() for _ in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 401):
        v = list(base)
        for c in range(12):
            v[(c * 33 + rng.randrange(20)) % 400] = word()
        rows.append((2 * k, " ".join(v)))
        v[rng.randrange(400)] = word()
        rows.append((2 * k + 1, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert len([k for k in range(1, 401) if {2 * k, 2 * k + 1} <= kept]) == 0


def test_similarity_at_the_edge(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    rows = []
    for k in range(60):  # a text of 300 words, and copies with so many words replaced, far apart
        w = [word() for _ in range(300)]
        rows.append((10 * k, " ".join(w)))
        for n, changes in enumerate((1, 3, 5, 6, 8, 12), 1):
            v = list(w)
            for c in range(changes):
                v[20 + c * 22] = word()
            rows.append((10 * k + n, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = similar_groups(rows)
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert set(want.values()) <= kept and len(kept - set(want.values())) <= 0.1 * len(rows)
    near = {d for d in want if d % 10 in (1, 2)}  # similarity of 0.9 and more
    assert len(near & kept) <= 0.02 * len(near)


def test_no_similar_pair_is_left_out(spark):
    """Pairs just above 0.8, common shingles in most texts, texts without shingles: the groups are those of all pairs."""
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    common = " ".join(word() for _ in range(30))
    rows = [(90000, " "), (90001, "\n\t"), (90002, "one two"), (90003, "one  TWO")]
    for k in range(150):
        w = [word() for _ in range(300)]
        v = list(w)
        for c in range(6):
            v[20 + c * 40] = word()
        rows += [(2 * k, " ".join(w) + " " + common), (2 * k + 1, common + " " + " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = similar_groups(rows)
    assert len(set(want.values())) == 152
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(want.values())


def test_components_keep_size_estimates_short(spark):
    """The size that Spark takes the result for has few digits, after many rounds too; so planning costs the driver nothing."""
    path = spark.range(1, 25).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = common.components(path)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 400
    assert {(r.node, r.component) for r in found.collect()} == {(k, 0) for k in range(25)}


def test_components_against_search(spark):
    """Hubs, chains and lone pairs, loops and repeats; every node has the smallest that it reaches."""
    rng = np.random.default_rng(8)
    pairs = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 130)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))] + [(5, 5), (7, 0)]
    least = {n: n for e in pairs if e[0] != e[1] for n in e}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = common.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(least.items())


def test_sketches_are_bounds():
    """Never further apart than the sets are, whatever their sizes; for sets of like size about as far."""
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 0, 0), (0, 1, 0), (1, 1, 1), (64, 65, 60), (300, 270, 250), (300, 300, 0), (5, 3000, 5), (200_000, 190_000, 180_000)]:
        h = rng.integers(0, 1 << 63, n + m - both).astype(np.uint64)
        x, y = simhash.sketch(h[:n]) if n else b"", simhash.sketch(h[n - both :]) if m else b""
        far = n + m - 2 * both
        assert simhash.apart(x, y) == simhash.apart(y, x) <= far
        assert simhash.apart(x, x) == 0 and (far > 50 or simhash.apart(x, y) >= far * 0.7 or not n)


def test_texts_are_sent_for_likely_pairs_alone(spark, monkeypatch):
    """Pairs that share half of their shingles meet by their prefixes, but their texts are left where they are."""
    import random

    rng = random.Random(21)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    rows = []
    for k in range(40):
        middle = some(200)
        rows += [(2 * k, f"{some(60)} {middle} {some(60)}"), (2 * k + 1, f"{some(60)} {middle} {some(60)}")]
    rows += [(100, rows[0][1] + " and"), (101, rows[2][1] + " or")]
    sent, plain = [], common.checkpointed

    def watched(df):
        out = plain(df)
        sent.extend([out.count()] * ("text" in df.columns))
        return out

    monkeypatch.setattr(common, "checkpointed", watched)
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(range(80)) and 4 <= sum(sent) <= 8, sent


def test_released_frees_the_last_shuffle(spark):
    import time

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count(".data")
    common.released(spark)
    time.sleep(1)
    before = files()
    held = common.checkpointed(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id")))
    assert files() > before
    common.released(spark)
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and held.count() == 1000
